"""How units follow one another: sections, notes, spacing, running lines, and a text cut at its edges.

Windows stay inside a key (a document, a pair, a cluster of lines). The cuts and marks of one unit are
expressions over its own arrays, so they need no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import RUN, WS, norm

#: Breaks after which a section flows on on the same page.
FLOWING = ("continuous", "nextColumn")
# Fixed values, of the font size: places and strengths of the rules under and through a text.
UNDERLINE_AT, DOUBLE_UNDERLINE_AT, STRIKE_AT, DOUBLE_STRIKE_AT = (0.11,), (0.08, 0.20), (-0.26,), (-0.31, -0.21)
SINGLE, DOUBLE = 0.06, 0.045
# A line that ends within EDGE of its size from the column's end is full; fewer full lines than
# EVIDENCE of all (or 3) tell nothing; text wraps where WRAPS of the full lines carry a sentence on.
EDGE, EVIDENCE, WRAPS = 1.0, 0.05, 0.5
SENTENCE_END = r"[.:;!?…][\"'’”)\]]*$"


def _first(w) -> Column:
    return F.row_number().over(w) == 1


def section_groups(items: DataFrame, sections: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "group") -> DataFrame:
    """items and group (from 0): stretches of one section; one that follows a flowing break stays in the group before.

    ``sections`` holds keys, section (from 0) and kind, the break that ends it; past the last section its
    kind counts on. ``order`` must be a total order within a key.
    """
    ends = sections.select(*keys, (F.col("section") + 1).alias("section"), F.col("kind").alias("_kind"))
    last = sections.groupBy(*keys).agg(F.max_by("kind", "section").alias("_last"))
    told = items.join(ends, [*keys, "section"], "left").join(last, list(keys), "left")
    w = Window.partitionBy(*keys).orderBy(*order)
    flows = F.coalesce((F.col("section") > 0) & F.coalesce("_kind", "_last").isin(*FLOWING), F.lit(False))
    turn = _first(w) | (~F.col("section").eqNullSafe(F.lag("section").over(w)) & ~flows)
    return told.withColumn("_turn", turn.cast("long")).withColumn(out, F.sum("_turn").over(w) - 1).select(*items.columns, out)


def note_groups(items: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, stream, note, side, row_idx, n: stretches of one note, with the first comparison row of each.

    A body item ends a stretch. A note whose items have no row is left out.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    note = F.when(F.col("stream") != "body", F.struct("stream", "note", "side"))
    told = items.withColumn("_note", note)
    turn = _first(w) | ~F.col("_note").eqNullSafe(F.lag("_note").over(w))
    stretches = told.withColumn("_turn", turn.cast("long")).withColumn("_run", F.sum("_turn").over(w)).filter(F.col("_note").isNotNull())
    at = F.when(F.col("row_idx").isNotNull(), F.struct(*order))
    found = stretches.groupBy(*keys, "_run", "_note").agg(F.min_by("row_idx", at).alias("row_idx"), F.count(F.lit(1)).alias("n"))
    return found.filter("row_idx IS NOT NULL").select(*keys, "_note.*", "row_idx", "n")


def note_index(rows: DataFrame, units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, side, note, mode, row_idx: the row in which a note of a side begins, and whether its mark is eq, ins or del.

    ``rows`` holds keys, row_idx, type, oi and ni; ``units`` keys, side (a or b), idx and note (null: body). Of a
    note that begins more than once the last beginning counts.
    """
    w = Window.partitionBy(*keys, "side").orderBy("idx")
    begins = F.col("note").isNotNull() & ~F.col("note").eqNullSafe(F.lag("note").over(w))
    starts = units.withColumn("_begins", begins).filter("_begins").select(*keys, "side", "idx", "note")
    ends = F.array(F.struct(F.lit("a").alias("side"), F.col("oi").alias("idx")), F.struct(F.lit("b").alias("side"), F.col("ni").alias("idx")))
    places = rows.select(*keys, "row_idx", "type", F.explode(ends).alias("_p")).select(*keys, "row_idx", "type", "_p.*").filter("idx IS NOT NULL")
    mode = F.when((F.col("side") == "b") & (F.col("type") == "inserted"), "ins").when((F.col("side") == "a") & (F.col("type") == "deleted"), "del").otherwise("eq")
    met = places.join(starts, [*keys, "side", "idx"]).withColumn("mode", mode)
    return met.groupBy(*keys, "side", "note").agg(F.max_by("mode", "row_idx").alias("mode"), F.max("row_idx").alias("row_idx"))


def noted(notes: DataFrame, references: DataFrame, keys: Sequence[str], out: str = "referenced") -> DataFrame:
    """notes and whether anything refers to them; those without a reference belong to the body."""
    named = references.select(*keys, "note").distinct().withColumn("_named", F.lit(True))
    return notes.join(named, [*keys, "note"], "left").withColumn(out, F.coalesce("_named", F.lit(False))).drop("_named")


def merged_items(rows: DataFrame, revised: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, row_idx, at, section: the merged document: revised paragraphs in order, empty ones too, and deleted rows.

    ``rows`` holds keys, row_idx, oi and ni; ``revised`` keys, at (the place of a paragraph), ni (null: empty) and ends,
    whether it ends a section. A deleted row stands before the revised paragraph that it precedes, but after the first end
    of a section between that and the one before it, in the section that ends there. An empty paragraph has no row_idx.
    """
    last = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paragraphs = revised.withColumn("_gap", F.coalesce(F.max("ni").over(last) + 1, F.lit(0)))
    ends = paragraphs.filter("ends").groupBy(*keys, F.col("_gap").alias("_next")).agg(F.min("at").alias("_end"))
    starts = paragraphs.filter("ni IS NOT NULL").select(*keys, F.col("ni").alias("_next"), F.col("at").alias("_start"))
    past = paragraphs.groupBy(*keys).agg(F.max("_gap").alias("_past"))
    later = Window.partitionBy(*keys).orderBy("row_idx").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    gone = rows.withColumn("_next", F.min("ni").over(later)).filter("ni IS NULL").join(past, list(keys), "left")
    gone = gone.withColumn("_next", F.coalesce("_next", "_past", F.lit(0))).join(ends, [*keys, "_next"], "left").join(starts, [*keys, "_next"], "left")
    # A row before the paragraph at p has the place (p, 0), the paragraph (p, 1), a row after it (p, 2).
    place = F.when(F.col("_end").isNotNull(), F.struct(F.col("_end").alias("at"), F.lit(2).alias("k"))).otherwise(F.struct(F.coalesce("_start", F.lit(2**31 - 1)).alias("at"), F.lit(0).alias("k")))
    deleted = gone.select(*keys, "row_idx", F.lit(None).cast(revised.schema["at"].dataType).alias("at"), F.lit(0).alias("_ends"), place.alias("_place"))
    named = rows.filter("ni IS NOT NULL").select(*keys, "ni", "row_idx")
    kept = revised.join(named, [*keys, "ni"], "left").select(*keys, "row_idx", "at", F.col("ends").cast("int").alias("_ends"), F.struct("at", F.lit(1).alias("k")).alias("_place"))
    order = Window.partitionBy(*keys).orderBy("_place.at", "_place.k", "row_idx")
    before = F.coalesce(F.sum("_ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - (F.col("_place.k") == 2).cast("int")
    return deleted.unionByName(kept).select(*keys, (F.row_number().over(order) - 1).alias("pos"), "row_idx", "at", before.alias("section"))


def collapse_spacing(blocks: DataFrame, keys: Sequence[str], order: Sequence[str], before: str = "space_before", after: str = "space_after") -> DataFrame:
    """The gap of two blocks is the larger of the first's space after and the second's space before."""
    taken = F.lag(after).over(Window.partitionBy(*keys).orderBy(*order))
    return blocks.withColumn("_taken", taken).withColumn(before, F.when(F.col("_taken").isNull(), F.col(before)).otherwise(F.greatest(F.lit(0.0), F.col(before) - F.col("_taken")))).drop("_taken")


def running_lines(lines: DataFrame, keys: Sequence[str], ident: Sequence[str], page: str = "page", text: str = "text") -> DataFrame:
    """keys, ident: lines of a cluster whose words stand in it twice, or whose one changed number moves with the page.

    Two lines move together if their numbers are as many, all but the i-th are equal, and the i-th less the page is
    equal too; so lines meet by that key, never all with all. Numbers over 38 digits never move.
    """
    numbers = F.transform(F.regexp_extract_all("_said", F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("decimal(38,0)"))
    told = lines.select(*keys, *ident, F.col(page).alias("_page"), norm(F.col(text)).alias("_said"))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_said"))
    repeated = told.withColumn("_n", same).filter("_n >= 2").select(*keys, *ident)
    each = told.withColumn("_numbers", numbers).select(*keys, *ident, "_page", "_numbers", F.posexplode("_numbers").alias("_i", "_number"))
    rest = F.concat(F.slice("_numbers", F.lit(1), F.col("_i")), F.array(F.lit(None).cast("decimal(38,0)")), F.slice("_numbers", F.col("_i") + 2, F.size("_numbers")))
    w = Window.partitionBy(*keys, "_i", "_rest", "_shift")
    placed = each.withColumns({"_rest": rest, "_shift": F.expr("try_subtract(_number, cast(_page as decimal(38,0)))")}).filter("_shift IS NOT NULL")
    moved = placed.withColumns({"_least": F.min("_number").over(w), "_most": F.max("_number").over(w)}).filter("_least < _most").select(*keys, *ident)
    return repeated.unionByName(moved).distinct()


def wrap_votes(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, wrapped, full, total: full lines that carry a sentence on, full lines, all lines of a side.

    ``lines`` holds keys, page, cell, y, x1, size, text and right, the end of the column.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    following = F.lead(F.struct("page", "cell", "y", "text")).over(w)
    told = lines.withColumn("_next", following)
    under = (F.col("page") == F.col("_next.page")) & F.col("cell").eqNullSafe(F.col("_next.cell")) & (F.col("_next.y") > F.col("y"))
    full = F.coalesce(under & (F.col("right") - F.col("x1") <= EDGE * F.col("size")), F.lit(False))
    on = ~norm(F.col("text")).rlike(SENTENCE_END) & norm(F.col("_next.text")).rlike(r"^\p{Ll}")
    return told.withColumns({"_full": full, "_on": on}).groupBy(*keys).agg(F.count_if(F.col("_full") & F.col("_on")).alias("wrapped"), F.count_if("_full").alias("full"), F.count(F.lit(1)).alias("total"))


def nothing_wraps(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, no_wrap: decided once for all that votes under a key, as the two sides of a pair."""
    pooled = votes.groupBy(*keys).agg(F.sum("wrapped").alias("_w"), F.sum("full").alias("_f"), F.sum("total").alias("_t"))
    few = F.col("_f") < F.greatest(F.lit(3), F.floor(F.col("_t") * EVIDENCE))
    return pooled.select(*keys, (few | (F.col("_w") / F.col("_f") < WRAPS)).alias("no_wrap"))


def justified(votes: DataFrame, keys: Sequence[str], align: str = "align", n_lines: str = "n_lines") -> DataFrame:
    """keys, justified: more paragraphs of three lines or more are justified than left aligned."""
    of = lambda kind: F.count_if((F.col(n_lines) >= 3) & (F.col(align) == kind))
    return votes.groupBy(*keys).agg((of("justify") > of("left")).alias("justified"))


# Expressions over one unit.
def pieces(start: Column, end: Column, text: Column, spans: Column, ranges: Column, tabs: Column, marks: Column) -> Column:
    """The pieces of text[start:end]: array of s, e, text, fmt, changed, tab, marks, cut wherever any of these begins or ends.

    ``spans`` are s, e, fmt (the first that covers a piece holds); ``ranges`` s, e; ``tabs`` at, n; ``marks`` at, ref. A
    mark stands before the piece at its place; marks at the end of the text are on a last, empty piece.
    """
    ends = lambda of: F.flatten(F.transform(of, lambda x: F.array(x["s"], x["e"])))
    tabbed = F.flatten(F.transform(F.filter(tabs, lambda t: (t["at"] >= start) & (t["at"] < end)), lambda t: F.array(t["at"], t["at"] + 1)))
    edges = F.filter(F.concat(ends(spans), ends(ranges), F.transform(marks, lambda m: m["at"])), lambda x: (x > start) & (x < end))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(start, end), edges, tabbed)))
    refs = lambda at: F.transform(F.filter(marks, lambda m: m["at"] == at), lambda m: m["ref"])

    def piece(a: Column, b: Column) -> Column:
        covers = lambda x: (x["s"] <= a) & (a < x["e"])
        return F.struct(
            a.alias("s"), b.alias("e"), F.substring(text, a + 1, b - a).alias("text"), F.get(F.filter(spans, covers), F.lit(0))["fmt"].alias("fmt"),
            F.exists(ranges, covers).alias("changed"), F.coalesce(F.get(F.filter(tabs, lambda t: t["at"] == a), F.lit(0))["n"], F.lit(0)).alias("tab"), refs(a).alias("marks"),
        )

    inner = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts)), piece)
    last = F.filter(F.array(F.struct(end.alias("s"), end.alias("e"), F.lit("").alias("text"), F.get(F.filter(spans, lambda x: F.lit(False)), F.lit(0))["fmt"].alias("fmt"), F.lit(False).alias("changed"), F.lit(0).alias("tab"), refs(end).alias("marks"))), lambda x: (end == F.length(text)) & (F.size(x["marks"]) > 0))
    return F.concat(inner, last)


def merge_pieces(cut: Column) -> Column:
    """Pieces of ``pieces`` with neighbours of one format and one changed flag as one; a tab or a mark begins a piece. Empty ones without a mark go."""
    alike = lambda a, p: a["fmt"].eqNullSafe(p["fmt"]) & (a["changed"] == p["changed"]) & (p["tab"] == 0) & (F.size(p["marks"]) == 0)
    grown = lambda a, p: F.struct(a["s"].alias("s"), p["e"].alias("e"), F.concat(a["text"], p["text"]).alias("text"), *[a[c].alias(c) for c in ("fmt", "changed", "tab", "marks")])

    def step(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown(last, p)))
        return F.when((F.size(done) > 0) & alike(last, p), joined).otherwise(F.concat(done, F.array(p)))

    kept = F.filter(cut, lambda p: (p["text"] != "") | (p["tab"] > 0) | (F.size(p["marks"]) > 0))
    return F.aggregate(kept, F.slice(cut, F.lit(1), F.lit(0)), step)


_SPACES = f"[{WS.replace(chr(92) + 'x09-', chr(92) + 'x0A-')}]+"
_TABS = " ?\\t[ \\t]*"


def tab_marks(text: Column) -> Column:
    """lead and marks of a raw text: tabs before the first word, and (at, n) for each collapsed space that held n tabs.

    Places are those of the text with its white space collapsed; tabs at its end go.
    """
    lead = F.regexp_extract(text, f"^{RUN}", 0)
    body = F.regexp_replace(F.regexp_replace(text, f"^{RUN}|{RUN}$", ""), _SPACES, " ")
    parts = F.split(body, _TABS, -1)
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, p: n + F.length(p)) + i
    count = lambda x: F.length(F.regexp_replace(x, "[^\\t]", ""))
    marks = F.transform(F.regexp_extract_all(body, F.lit(_TABS), F.lit(0)), lambda g, i: F.struct(before(i).alias("at"), count(g).alias("n")))
    return F.struct(count(lead).alias("lead"), marks.alias("marks"))


def note_marks(runs: Column) -> Column:
    """(at, note) of the runs (text, note) that refer to a note, as places in the text with its white space collapsed."""
    collapsed = lambda of: F.regexp_replace(F.regexp_replace(F.array_join(F.transform(F.filter(of, lambda r: r["note"].isNull()), lambda r: F.coalesce(r["text"], F.lit(""))), ""), f"^{RUN}", ""), RUN, " ")
    end = F.length(F.regexp_replace(collapsed(runs), " $", ""))
    placed = F.transform(runs, lambda r, i: F.when(r["note"].isNotNull(), F.struct(F.least(F.length(collapsed(F.slice(runs, F.lit(1), i))), end).alias("at"), r["note"].alias("note"))))
    return F.filter(placed, lambda x: x.isNotNull())


def note_numbers(digits: Column, known: Column) -> Column:
    """The notes that raised digits refer to: itself if it is known, else known notes in a row written side by side.

    Nothing for what is neither, and for digits that are none or more than 18. The shortest first number holds.
    """
    digits = F.when(digits.rlike("^[0-9]{1,18}$"), digits)
    size = F.length(digits)
    number = lambda n: F.substring(digits, F.lit(1), n).try_cast("long")
    each = F.sequence(F.lit(1), size)
    lists = F.flatten(F.transform(each, lambda k: F.transform(each, lambda m: F.struct(k.alias("k"), F.sequence(number(k), number(k) + m - 1).alias("ns")))))
    written = lambda x: F.concat(F.substring(digits, F.lit(1), x["k"]), F.array_join(F.slice(x["ns"], F.lit(2), F.size(x["ns"])), ""))
    fit = F.filter(lists, lambda x: (written(x) == digits) & (F.size(F.array_except(x["ns"], known)) == 0))
    whole = F.filter(fit, lambda x: x["k"] == size)
    return F.coalesce(F.get(whole, F.lit(0))["ns"], F.get(fit, F.lit(0))["ns"], F.array().cast("array<bigint>"))


def run_effects(effects: Column, underlined: Column) -> Column:
    """Effects of a category with the document's own underline, which takes the place of a dotted one; a double one stays."""
    own = F.array_union(F.array_remove(effects, "dotted-underline"), F.array(F.lit("underline")))
    return F.when(underlined & ~F.array_contains(effects, "double-underline"), own).otherwise(effects)


def decorations(effects: Column, x1: Column, x2: Column, baseline: Column, size: Column) -> Column:
    """x1, x2, y, thickness, dotted of every rule that the effects draw."""
    has = lambda name: F.array_contains(effects, name)
    kinds = [
        (has("underline"), UNDERLINE_AT, SINGLE, False),
        (has("dotted-underline") & ~has("underline"), UNDERLINE_AT, SINGLE, True),
        (has("double-underline"), DOUBLE_UNDERLINE_AT, DOUBLE, False),
        (has("strikethrough"), STRIKE_AT, SINGLE, False),
        (has("double-strikethrough"), DOUBLE_STRIKE_AT, DOUBLE, False),
    ]
    rule = lambda at, strong, dotted: F.struct(x1.alias("x1"), x2.alias("x2"), (baseline + at * size).alias("y"), (strong * size).alias("thickness"), F.lit(dotted).alias("dotted"))
    return F.array_compact(F.array(*[F.when(on, rule(at, strong, dotted)) for on, places, strong, dotted in kinds for at in places]))


def content_bottom(top: Column, *boxes: Column) -> Column:
    """The lowest edge on a page: ``boxes`` are arrays of (top, height); the top margin on an empty page."""
    edges = F.concat(F.array(top), *[F.transform(F.coalesce(b, F.filter(b, lambda x: F.lit(False))), lambda x: x["top"] + x["height"]) for b in boxes])
    return F.array_max(edges)
