"""Reports and projections of a comparison."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.functions.text import sentinel
from foliospark.operators import compare as C
from foliospark.operators import report as R

COUNTS = "a long, b long, total long, insertions long, deletions long, numbering_changes long, formatting long"


def test_report_text(spark):
    one = spark.createDataFrame([(1, 2, 7, 3, 2, 2, 5)], COUNTS)
    when = F.lit("2024-03-05 07:09:59").cast("timestamp")
    base = ["Original: old.docx", "Modified: new.docx", "Compared: 2024-03-05 07:09", "Rendering set: all", "Options: ignore case on; count numbering changes off"]
    last = "Changes: 7 (insertions 3, deletions 2, numbering 2); formatting 5 (not counted)"
    make = lambda df: R.report_lines(df, F.lit("old.docx"), F.lit("new.docx"), when, ignore_case=True, count_numbering=False).first().report.split("\n")
    assert make(one) == [*base, last]
    assert make(one.selectExpr("*", "0 AS tracked_a", "0 AS tracked_b")) == [*base, last]
    full = one.selectExpr("*", "0 AS tracked_a", "4 AS tracked_b", "1 AS added", "0 AS removed", "2 AS edited", "3 AS pages_shown", "9 AS n_pages")
    tracked = "Tracked changes in sources: original 0, modified 4 (compared as accepted)"
    assert make(full) == [*base, tracked, last, "Comments: 1 added, 0 removed, 2 edited (not counted)", "Changed pages only: 3 of 9 pages"]
    pdf = "Sources: PDFs, text and tables re-read from the pages (layout approximate, images not shown)"
    assert make(one.selectExpr("*", "'' AS skipped_a", "'' AS skipped_b")) == [*base, pdf, last]
    assert make(one.selectExpr("*", "'2-3' AS skipped_a", "'' AS skipped_b"))[6] == "Pages with no text, not compared: original 2-3, modified none"


def test_body_rows(spark):
    unit = "array<struct<text:string,stream:string>>"
    a = [("note", "footnote"), ("one two", "body"), ("gone", "body"), ("foot", "footer")]
    b = [("one two", "body"), ("note", "footnote"), ("added words", "body"), ("foot", "footer")]
    paired = spark.createDataFrame([(1, 2, a, b)], f"a long, b long, units_a {unit}, units_b {unit}")
    got = sorted((r.row_idx, r.type, r.oi, r.ni) for r in R.body_rows(C.compare(paired), paired).collect())
    assert [x[1:] for x in got] == [("equal", 0, 0), ("deleted", 1, None), ("inserted", None, 1)]
    counts = R.row_counts(R.body_rows(C.compare(paired), paired)).first()
    assert (counts.content, counts.punctuation, counts.numbering, counts.formatting) == (2, 0, 0, 0)


def test_changed_pages_and_comments(spark):
    rows = spark.createDataFrame([(1, 2, i, p, t, False, []) for i, (p, t) in enumerate([(1, "equal"), (2, "equal"), (3, "changed"), (3, "equal"), (4, "equal")])], "a long, b long, row_idx int, page int, type string, num_changed boolean, fmt array<string>")
    assert sorted((r.page, r.row_idx) for r in R.changed_only(rows).collect()) == [(1, 0), (3, 2), (3, 3)]
    changes = spark.createDataFrame([(1, 2, "added"), (1, 2, "edited"), (1, 2, "added"), (3, 4, "unchanged")], "a long, b long, state string")
    assert [tuple(r) for r in R.comment_counts(changes).collect()] == [(1, 2, 2, 0, 1)]


def test_options():
    assert C.options() == {"ignore_case": False, "count_numbering": True} and C.options({"ignore_case": True})["ignore_case"]
    for wrong in ({"colour": True}, {"ignore_case": 1}, {"count_numbering": "no"}):
        with pytest.raises(ValueError, match="option"):
            C.options(wrong)


def test_json(spark):
    paired = spark.createDataFrame([(1, 2, ["One line.", "Two old words."], ["One line.", "Two new words."]), (3, 4, ["x"], ["x"])], "a long, b long, units_a array<string>, units_b array<string>")
    comments = spark.createDataFrame([(1, 2, 0, "added", 5), (1, 2, 1, "removed", 6)], "a long, b long, pos int, state string, new_id long")
    got = {r.a: json.loads(r.json) for r in C.to_json(C.compare(paired), ignore_case=True, comments=comments).collect()}
    assert got[1]["options"] == {"ignore_case": True, "count_numbering": True} and [c["type"] for c in got[1]["changes"]] == ["equal", "changed"]
    assert [c["state"] for c in got[1]["comments"]] == ["added", "removed"] and got[3]["comments"] == [] and got[3]["passages"] == []
    assert got[1]["summary"]["total"] == 2 and [p["category"] for p in got[1]["passages"]] == ["deletion", "insertion"]


def test_sentinel(spark):
    assert spark.range(1).select(sentinel(F.lit("footnote"), F.lit(3))).first()[0] == "\ue000footnote:3\ue001"
