"""Projections of a comparison for reports: visible rows, sides, page lists, report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.compare import PAIR
from foliospark.operators.ranges import compress


def visible(show_equal: bool = True, show_insertions: bool = True, show_deletions: bool = True, show_formatting: bool = True) -> Column:
    """Whether a row is drawn under these options."""
    formatted = (F.size("fmt") > 0) & F.lit(show_formatting)
    return (
        F.when(F.col("type") == "equal", F.lit(show_equal) | formatted | F.col("num_changed"))
        .when(F.col("type") == "inserted", F.lit(show_insertions))
        .when(F.col("type") == "deleted", F.lit(show_deletions))
        .otherwise(F.lit(show_insertions or show_deletions))
    )


def side(rows: DataFrame, which: str) -> DataFrame:
    """The rows of the original (a) or the revised (b) document."""
    return rows.filter(F.col("oi" if which == "a" else "ni").isNotNull())


#: Where a change can be: in a paragraph of the body or a table of it, or in another stream.
LOCATIONS = ("body", "table", "footnote", "endnote", "header", "footer")


def located(rows: DataFrame, paired: DataFrame) -> DataFrame:
    """rows with marker and location, of the revised unit where there is one, else of the original.

    ``paired`` holds units_a and units_b, arrays of structs with marker, stream and ti (null outside tables).
    """
    joined = rows.join(paired.select(*PAIR, "units_a", "units_b"), list(PAIR))
    unit = F.when(F.col("ni").isNotNull(), F.get("units_b", F.col("ni"))).otherwise(F.get("units_a", F.col("oi")))
    told = joined.withColumn("_unit", unit)
    place = F.when(F.col("_unit.stream") != "body", F.col("_unit.stream")).when(F.col("_unit.ti").isNotNull(), F.lit("table")).otherwise(F.lit("body"))
    return told.withColumns({"marker": F.col("_unit.marker"), "location": place}).drop("_unit", "units_a", "units_b")


def marked_text(rows: DataFrame, which: str) -> DataFrame:
    """a, b, text: one side of ``located`` rows, a line for each paragraph of that side after its marker."""
    drop, at = ("ins", "oi") if which == "a" else ("del", "ni")
    own = F.when(F.col("num_changed"), F.col("old_marker")) if which == "a" else F.lit(None)
    words = F.array_join(F.transform(F.filter("segments", lambda s: s["m"] != drop), lambda s: s["t"]), "")
    line = F.concat_ws(" ", F.nullif(F.coalesce(own, F.col("marker")), F.lit("")), words)
    listed = rows.filter(F.col(at).isNotNull()).groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("row_idx", line.alias("t")))).alias("lines"))
    return listed.select(*PAIR, F.array_join(F.transform("lines", lambda x: x["t"]), "\n").alias("text"))


def change_list(passages: DataFrame, rows: DataFrame, category: str | None = None, location: str = "all") -> DataFrame:
    """Numbered changes with their rows' types, one category or all, and of one location of ``located`` rows or all."""
    if location not in ("all", *LOCATIONS):
        raise ValueError(f"unknown location: {location}")
    there = rows if location == "all" else rows.filter(F.col("location") == location)
    joined = passages.join(there.select(*PAIR, "row_idx", "type", "oi", "ni"), [*PAIR, "row_idx"])
    return joined if category is None else joined.filter(F.col("category") == category)


def side_items(items: DataFrame, rows: DataFrame, which: str) -> DataFrame:
    """The merged document's items of one side: of the original (a) rows with an original paragraph; of the revised (b) also its empty paragraphs."""
    told = items.join(rows.select(*PAIR, "row_idx", "oi", "ni"), [*PAIR, "row_idx"], "left")
    held = F.col("oi").isNotNull() if which == "a" else F.col("row_idx").isNull() | F.col("ni").isNotNull()
    return told.filter(held).select(*items.columns)


def paged(rows: DataFrame, lines_a_page: int = 40, chars_a_line: int = 80) -> DataFrame:
    """rows with page (from 1): a greedy fill by running line count, for plain text without fonts."""
    text = F.array_join(F.transform("segments", lambda s: s["t"]), "")
    lines = F.greatest(F.lit(1), F.ceil(F.length(text) / chars_a_line))
    before = F.sum("_lines").over(Window.partitionBy(*PAIR).orderBy("row_idx")) - F.col("_lines")
    return rows.withColumn("_lines", lines).withColumn("page", (F.floor(before / lines_a_page) + 1).cast("int")).drop("_lines")


def changed_pages(paged_rows: DataFrame) -> DataFrame:
    """a, b, n_pages, pages: the pages with a change as a list of ranges."""
    changed = paged_rows.filter((F.col("type") != "equal") | F.col("num_changed") | (F.size("fmt") > 0))
    total = paged_rows.groupBy(*PAIR).agg(F.max("page").alias("n_pages"))
    listed = compress(changed.select(*PAIR, "page"), PAIR, "page").withColumnRenamed("ranges", "pages")
    return total.join(listed, list(PAIR), "left").select(*PAIR, "n_pages", F.coalesce("pages", F.lit("")).alias("pages"))


def changed_only(paged_rows: DataFrame) -> DataFrame:
    """The rows of pages with a change, and of page 1; pages keep their numbers."""
    changed = paged_rows.filter((F.col("type") != "equal") | F.col("num_changed") | (F.size("fmt") > 0))
    wanted = changed.select(*PAIR, "page").unionByName(paged_rows.select(*PAIR, F.lit(1).cast(paged_rows.schema["page"].dataType).alias("page"))).distinct()
    return paged_rows.join(wanted, [*PAIR, "page"], "left_semi")


def comment_counts(changes: DataFrame) -> DataFrame:
    """a, b, added, removed, edited: of pairs with a comment that is not unchanged."""
    of = lambda state: F.count_if(F.col("state") == state).alias(state)
    return changes.filter("state <> 'unchanged'").groupBy(*PAIR).agg(of("added"), of("removed"), of("edited"))


def body_rows(rows: DataFrame, paired: DataFrame) -> DataFrame:
    """The rows of body paragraphs, with oi and ni counted among body paragraphs only.

    ``paired`` holds units_a and units_b, arrays of structs with a ``stream``.
    """
    joined = rows.join(paired.select(*PAIR, "units_a", "units_b"), list(PAIR))
    stream = F.coalesce(F.get("units_b", F.col("ni"))["stream"], F.get("units_a", F.col("oi"))["stream"])
    place = lambda side, at: F.when(F.col(at).isNotNull(), F.size(F.filter(F.slice(side, F.lit(1), F.greatest(F.col(at), F.lit(0))), lambda u: u["stream"] == "body")))
    body = joined.filter(stream == "body").withColumns({"oi": place("units_a", "oi"), "ni": place("units_b", "ni")})
    return body.drop("units_a", "units_b")


def row_counts(rows: DataFrame) -> DataFrame:
    """a, b, content, punctuation, numbering, formatting: rows by kind, as a summary has them."""
    n = lambda when: F.count_if(when).cast("long")
    changed = F.col("type") != "equal"
    return rows.groupBy(*PAIR).agg(
        n(changed & ~F.col("cat").eqNullSafe("punctuation")).alias("content"), n(changed & F.col("cat").eqNullSafe("punctuation")).alias("punctuation"),
        n(F.col("num_changed")).alias("numbering"), n(~changed & (F.size("fmt") > 0)).alias("formatting"),
    )


#: Columns beside a summary's that a report mentions where they are there and not null (tracked: unless both are 0).
EXTRAS = ("tracked_a", "tracked_b", "skipped_a", "skipped_b", "added", "removed", "edited", "pages_shown", "n_pages")


def report_lines(summary: DataFrame, original: Column | None = None, modified: Column | None = None, when: Column | None = None, rendering: str = "all", ignore_case: bool = False, count_numbering: bool = True) -> DataFrame:
    """a, b, report: what was compared, how, and the counts, as text.

    ``summary`` may have the columns of ``EXTRAS``: tracked changes of both sources; the pages without text of both
    as lists of ranges, for PDFs; counts of comment changes; pages shown of all pages.
    """
    there = {c: F.col(c) if c in summary.columns else F.lit(None) for c in EXTRAS}
    switch = lambda on: "on" if on else "off"
    text = lambda c: c.cast("string")
    name = lambda given, side: text(given if given is not None else F.col(side))
    tracked = F.coalesce(there["tracked_a"], F.lit(0)) + F.coalesce(there["tracked_b"], F.lit(0)) > 0
    pages = lambda c: F.when(there[c] == "", F.lit("none")).otherwise(there[c])
    is_pdf = there["skipped_a"].isNotNull() & there["skipped_b"].isNotNull()
    lines = [
        F.concat(F.lit("Original: "), name(original, "a")),
        F.concat(F.lit("Modified: "), name(modified, "b")),
        F.concat(F.lit("Compared: "), F.date_format(when if when is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm")),
        F.lit(f"Rendering set: {rendering}"),
        F.lit(f"Options: ignore case {switch(ignore_case)}; count numbering changes {switch(count_numbering)}"),
        F.when(is_pdf, F.lit("Sources: PDFs, text and tables re-read from the pages (layout approximate, images not shown)")),
        F.when(is_pdf & ((there["skipped_a"] != "") | (there["skipped_b"] != "")), F.concat(F.lit("Pages with no text, not compared: original "), pages("skipped_a"), F.lit(", modified "), pages("skipped_b"))),
        F.when(tracked, F.concat(F.lit("Tracked changes in sources: original "), F.coalesce(text(there["tracked_a"]), F.lit("0")), F.lit(", modified "), F.coalesce(text(there["tracked_b"]), F.lit("0")), F.lit(" (compared as accepted)"))),
        F.concat(
            F.lit("Changes: "), text(F.col("total")), F.lit(" (insertions "), text(F.col("insertions")), F.lit(", deletions "), text(F.col("deletions")), F.lit(", numbering "),
            text(F.col("numbering_changes")), F.lit("); formatting "), text(F.col("formatting")), F.lit(" (not counted)"),
        ),
        F.concat(F.lit("Comments: "), text(there["added"]), F.lit(" added, "), text(there["removed"]), F.lit(" removed, "), text(there["edited"]), F.lit(" edited (not counted)")),
        F.concat(F.lit("Changed pages only: "), text(there["pages_shown"]), F.lit(" of "), text(there["n_pages"]), F.lit(" pages")),
    ]
    return summary.select(*PAIR, F.concat_ws("\n", *lines).alias("report"))  # a line that does not apply is null and left out
