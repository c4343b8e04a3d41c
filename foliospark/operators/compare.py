"""Comparing many document pairs: pairs, rows, passages, summaries.

One row per pair carries both unit lists, so the alignment kernel needs no shuffle of its own; what
follows (numbering, counts, projections) is window and aggregate work keyed by pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import escape_html
from foliospark.operators.alignment import align
from foliospark.operators.formats import Format
from foliospark.operators.pairing import Unit, compare_units
from foliospark.operators.units import unit_lists
from foliospark.tables import spread, written

PAIR = ("a", "b")
LINE_CHARS = 20
DICE = 0.5

SEGMENT = pa.struct([("m", pa.string()), ("t", pa.string()), ("b", pa.bool_())])
ROWS = pa.list_(
    pa.struct(
        [
            ("type", pa.string()), ("oi", pa.int32()), ("ni", pa.int32()), ("cat", pa.string()), ("num_changed", pa.bool_()), ("old_marker", pa.string()),
            ("fmt", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("desc", pa.string())]))), ("segments", pa.list_(SEGMENT)),
        ]
    )
)
ROWS_DDL = "array<struct<type:string,oi:int,ni:int,cat:string,num_changed:boolean,old_marker:string,fmt:array<struct<s:int,e:int,desc:string>>,segments:array<struct<m:string,t:string,b:boolean>>>>"
OPS_DDL = "array<struct<tag:string,i:int,j:int>>"


def listed(df: DataFrame, min_chars: int = LINE_CHARS) -> DataFrame:
    """doc_id, units and the distinct hashes of units of at least min_chars, written once for all that is made from them."""
    units = unit_lists(spread(df))
    hashes = F.array_distinct(F.transform(F.filter("units", lambda x: F.length(x) >= min_chars), lambda x: F.xxhash64(x)))
    return written(units.select("doc_id", "units", hashes.alias("lines")), "unit-lists")


def near_copies(lists: DataFrame, dice: float = DICE) -> DataFrame:
    """a, b, n_shared, dice, units_a, units_b: each document b of ``listed`` beside the earlier one that it most likely revises.

    A line points to the first document that has it, so a line in very many documents makes one pair
    candidate for each, never all pairs of them. Of the documents that b's lines point to, a is the one
    with the most of them (the least id of equals), where the lines of both overlap by ``dice``.
    """
    lines = lists.select("doc_id", F.explode("lines").alias("line"))
    first = lines.groupBy("line").agg(F.min("doc_id").alias("a"))
    votes = lines.join(first, "line").filter("a < doc_id").groupBy(F.col("doc_id").alias("b"), "a").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("b").agg(F.max(F.struct("votes", (-F.col("a")).alias("minus_a"))).alias("top")).select("b", (-F.col("top.minus_a")).alias("a"))
    side = lambda s: lists.select(F.col("doc_id").alias(s), F.col("units").alias(f"units_{s}"), F.col("lines").alias(f"lines_{s}"))
    both = best.join(side("a"), "a").join(side("b"), "b").withColumn("n_shared", F.size(F.array_intersect("lines_a", "lines_b")).cast("long"))
    scored = both.withColumn("dice", F.round(2 * F.col("n_shared") / (F.size("lines_a") + F.size("lines_b")), 6))
    return scored.filter(F.col("dice") >= dice).select("a", "b", "n_shared", "dice", "units_a", "units_b")


def near_copy_pairs(df: DataFrame, min_chars: int = LINE_CHARS, dice: float = DICE) -> DataFrame:
    """a, b, n_shared, dice of the near copies in a table of documents."""
    return near_copies(listed(df, min_chars), dice).select("a", "b", "n_shared", "dice")


def with_units(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """pairs with units_a and units_b: arrays of paragraph texts."""
    lists = unit_lists(documents)
    side = lambda s: lists.select(F.col("doc_id").alias(s), F.col("units").alias(f"units_{s}"))
    return pairs.select(*PAIR).join(side("a"), "a").join(side("b"), "b")


def edit_scripts(paired: DataFrame, ignore_case: bool = False) -> DataFrame:
    """paired with ops: the edit script of its unit texts."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("tag", pa.string()), ("i", pa.int32()), ("j", pa.int32())]))
        for a, b in batches:
            yield pa.array([[{"tag": t, "i": i, "j": j} for t, i, j in align(x, y)] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    fold = lambda c: F.transform(c, F.lower) if ignore_case else F.col(c)
    return paired.withColumn("ops", F.arrow_udf(run, OPS_DDL)(fold("units_a"), fold("units_b")))


def compare(paired: DataFrame, ignore_case: bool = False) -> DataFrame:
    """a, b, row_idx and the fields of each row of the comparison, in order.

    ``units_a`` and ``units_b`` are arrays of texts, or of structs with text and, where known, marker,
    stream, bold (spans) and formats.
    """

    def unit(x: str | dict) -> Unit:
        if isinstance(x, str):
            return Unit(x)
        formats = [Format(f["s"], f["e"], f["b"], f["i"], f["u"], f["f"], f["z"], f["clr"]) for f in x.get("formats") or ()]
        return Unit(x["text"], x.get("marker") or "", x.get("stream") or "body", [(s["s"], s["e"]) for s in x.get("bold") or ()], formats)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            out = []
            for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
                rows = compare_units([unit(u) for u in x or []], [unit(u) for u in y or []], ignore_case)
                out.append(
                    [
                        {
                            "type": r.type, "oi": r.oi, "ni": r.ni, "cat": r.cat, "num_changed": r.num_changed, "old_marker": r.old_marker,
                            "fmt": [{"s": s, "e": e, "desc": d} for s, e, d in r.fmt], "segments": [{"m": s.mode, "t": s.text, "b": s.bold} for s in r.segments],
                        }
                        for r in rows
                    ]
                )
            yield pa.array(out, ROWS)

    made = paired.withColumn("_rows", F.arrow_udf(run, ROWS_DDL)(F.col("units_a"), F.col("units_b")))
    return made.select(*PAIR, F.posexplode("_rows").alias("row_idx", "r")).select(*PAIR, "row_idx", "r.*")


#: A letter or digit, or a sentence's end before white space: what ends a passage in equal text.
LETTER = r"[\p{L}\p{N}]"
SENTENCE_END = r"[.!?][\"'’”)\]]*\s"


def passages(rows: DataFrame, count_numbering: bool = True) -> DataFrame:
    """a, b, cid, category, row_idx, seg_idx: the numbered changes of each pair in reading order.

    Per row and side a passage is a stretch of segments of one mode, ended only by equal text that
    holds a letter or digit or ends a sentence. A renumbered marker counts before the row's segments.
    """
    each = rows.select(*PAIR, "row_idx", F.posexplode("segments").alias("seg_idx", "s"), "segments")
    following = F.coalesce(F.left(F.get("segments", F.col("seg_idx") + 1)["t"], F.lit(1)), F.lit(" "))
    ends = (F.col("s.m") == "eq") & (F.col("s.t").rlike(LETTER) | F.concat("s.t", following).rlike(SENTENCE_END))
    row = Window.partitionBy(*PAIR, "row_idx").orderBy("seg_idx")
    stretch = F.sum(ends.cast("int")).over(row)
    marked = each.select(*PAIR, "row_idx", "seg_idx", F.col("s.m").alias("m"), stretch.alias("stretch")).filter("m <> 'eq'")
    starts = marked.groupBy(*PAIR, "row_idx", "m", "stretch").agg(F.min("seg_idx").alias("seg_idx"))
    found = starts.select(*PAIR, "row_idx", "seg_idx", F.when(F.col("m") == "ins", "insertion").otherwise("deletion").alias("category"))
    if count_numbering:
        found = found.unionByName(rows.filter("num_changed").select(*PAIR, "row_idx", F.lit(-1).alias("seg_idx"), F.lit("numbering").alias("category")))
    order = Window.partitionBy(*PAIR).orderBy("row_idx", "seg_idx")
    return found.withColumn("cid", F.row_number().over(order)).select(*PAIR, "cid", "category", "row_idx", "seg_idx")


def passage_counts(segments: str = "segments") -> Column:
    """struct<ins, del>: the passages of a row, counted inside the row without numbering them."""
    following = lambda i: F.coalesce(F.left(F.get(segments, i + 1)["t"], F.lit(1)), F.lit(" "))
    ends = lambda s, i: (s["m"] == "eq") & (s["t"].rlike(LETTER) | F.concat(s["t"], following(i)).rlike(SENTENCE_END))
    steps = F.transform(segments, lambda s, i: F.struct(s["m"].alias("m"), ends(s, i).alias("ends")))
    start = F.struct(F.lit(False).alias("in_ins"), F.lit(False).alias("in_del"), F.lit(0).alias("ins"), F.lit(0).alias("del"))

    def step(acc: Column, x: Column) -> Column:
        side = lambda m: (
            F.when(x["ends"], F.lit(False)).otherwise(acc[f"in_{m}"] | (x["m"] == m)).alias(f"in_{m}"),
            (acc[m] + ((x["m"] == m) & ~acc[f"in_{m}"]).cast("int")).alias(m),
        )
        (in_ins, ins), (in_del, gone) = side("ins"), side("del")
        return F.struct(in_ins, in_del, ins, gone)

    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["ins"].alias("ins"), acc["del"].alias("del")))


def summary(rows: DataFrame, count_numbering: bool = True) -> DataFrame:
    """One row per pair: passages by kind and in all, and rows by kind, in one aggregation over the rows."""
    n = lambda when: F.count_if(when).cast("long")
    changed = F.col("type") != "equal"
    counted = rows.withColumn("_n", passage_counts())
    out = counted.groupBy(*PAIR).agg(
        n(changed & ~F.col("cat").eqNullSafe("punctuation")).alias("content"), n(changed & F.col("cat").eqNullSafe("punctuation")).alias("punctuation"),
        n(F.col("num_changed")).alias("numbering"), n(~changed & (F.size("fmt") > 0)).alias("formatting"),
        F.sum("_n.ins").alias("insertions"), F.sum("_n.del").alias("deletions"), n(F.col("num_changed") & F.lit(count_numbering)).alias("numbering_changes"),
    )
    out = out.withColumn("total", F.col("insertions") + F.col("deletions") + F.col("numbering_changes"))
    return out.withColumns({c: F.lit(0).cast("long") for c in ("moves", "splits", "merges")})


def side_text(rows: DataFrame, side: str) -> DataFrame:
    """a, b, text: the original or the revised text, from the rows alone."""
    drop, place = ("ins", "oi") if side == "a" else ("del", "ni")
    text = F.array_join(F.transform(F.filter("segments", lambda s: s["m"] != drop), lambda s: s["t"]), "")
    lines = rows.filter(F.col(place).isNotNull()).groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct(place, text.alias("t")))).alias("lines"))
    return lines.select(*PAIR, F.array_join(F.transform("lines", lambda x: x["t"]), "\n").alias("text"))


def row_html(segments: str = "segments") -> Column:
    """A row as HTML: deletions in <del>, insertions in <ins>, bold in <b>."""
    bold = lambda s: F.when(s["b"], F.concat(F.lit("<b>"), escape_html(s["t"]), F.lit("</b>"))).otherwise(escape_html(s["t"]))
    own = lambda s: F.when(s["m"] == "eq", bold(s)).otherwise(F.concat(F.lit("<"), s["m"], F.lit(">"), bold(s), F.lit("</"), s["m"], F.lit(">")))
    joined = F.array_join(F.transform(segments, own), "")
    return F.regexp_replace(joined, "</(del|ins)><\\1>", "")


def merged_order(rows: DataFrame) -> DataFrame:
    """a, b, pos, row_idx, type: revised order, each deleted row before the revised row that it precedes."""
    later = Window.partitionBy(*PAIR).orderBy("row_idx").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    anchor = F.coalesce("ni", F.first("ni", ignorenulls=True).over(later), F.lit(2**31 - 1))
    key = Window.partitionBy(*PAIR).orderBy("anchor", F.col("ni").isNotNull(), "row_idx")
    return rows.withColumn("anchor", anchor).select(*PAIR, (F.row_number().over(key) - 1).alias("pos"), "row_idx", "type", "oi", "ni")


def snippets(rows: DataFrame, before: int = 24, after: int = 40, most: int = 200) -> DataFrame:
    """a, b, row_idx, seg_idx, m, snippet: each changed segment between the equal text around it."""
    each = rows.select(*PAIR, "row_idx", "segments", F.posexplode("segments").alias("seg_idx", "s")).filter("s.m <> 'eq'")
    equal = lambda i: F.when(F.get("segments", i)["m"] == "eq", F.get("segments", i)["t"]).otherwise(F.lit(""))
    left, right = F.coalesce(equal(F.col("seg_idx") - 1), F.lit("")), F.coalesce(equal(F.col("seg_idx") + 1), F.lit(""))
    text = F.concat(F.right(left, F.lit(before)), F.left(F.col("s.t"), F.lit(most)), F.left(right, F.lit(after)))
    return each.select(*PAIR, "row_idx", "seg_idx", F.col("s.m").alias("m"), text.alias("snippet"))


#: What a comparison can be asked for, and what holds if it is not said.
OPTIONS = {"ignore_case": False, "count_numbering": True}


def options(given: Mapping[str, object] | None = None) -> dict[str, bool]:
    """All options with those given; an unknown name or a value that is not a boolean is refused."""
    for name, value in (given or {}).items():
        if name not in OPTIONS:
            raise ValueError(f"unknown option: {name}")
        if not isinstance(value, bool):
            raise ValueError(f"option {name} must be true or false, not {value!r}")
    return OPTIONS | dict(given or {})


def to_json(rows: DataFrame, count_numbering: bool = True, ignore_case: bool = False, comments: DataFrame | None = None) -> DataFrame:
    """a, b, json: options, summary, passages, changes and comment changes of each pair as one nested document.

    ``comments`` are the rows of ``threads.compare_comments``, with pos.
    """
    gathered = lambda df, columns, name: df.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    changes = gathered(rows, ["row_idx", "type", "oi", "ni", "cat", "num_changed", "old_marker", "fmt", "segments"], "changes")
    numbered = gathered(passages(rows, count_numbering), ["cid", "category", F.col("row_idx").alias("row")], "passages")
    counts = summary(rows, count_numbering)
    counts = counts.select(*PAIR, F.struct(*[c for c in counts.columns if c not in PAIR]).alias("summary"))
    whole = counts.join(changes, list(PAIR)).join(numbered, list(PAIR), "left")
    chosen = F.struct(F.lit(ignore_case).alias("ignore_case"), F.lit(count_numbering).alias("count_numbering"))
    noted = F.array().alias("comments")
    if comments is not None:
        whole = whole.join(gathered(comments, [c for c in comments.columns if c not in PAIR], "noted"), list(PAIR), "left")
        noted = F.coalesce("noted", F.array()).alias("comments")
    return whole.select(*PAIR, F.to_json(F.struct(chosen.alias("options"), "summary", F.coalesce("passages", F.array()).alias("passages"), "changes", noted)).alias("json"))
