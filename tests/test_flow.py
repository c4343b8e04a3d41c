"""Units that follow one another, and texts cut at their edges: fixed cases beside the SQL of the queries."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import flow, report


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_sections_flow_on_after_a_continuous_break(spark):
    items = spark.createDataFrame([("d", i, s) for i, s in enumerate([0, 0, 1, 2, 2, 3, 5])], "d string, idx int, section long")
    sections = spark.createDataFrame([("d", 0, "continuous"), ("d", 1, "nextPage"), ("d", 2, "nextColumn")], "d string, section long, kind string")
    assert rows(flow.section_groups(items, sections, ["d"], ["idx"]), "idx", "group") == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1)]
    none = sections.limit(0)
    assert [g for _, g in rows(flow.section_groups(items, none, ["d"], ["idx"]), "idx", "group")] == [0, 0, 1, 2, 2, 3, 4]


def test_notes_in_stretches(spark):
    made = [("body", None, 0), ("footnotes", 1, None), ("footnotes", 1, 4), ("footnotes", 2, None), ("body", None, 6), ("footnotes", 1, 7)]
    items = spark.createDataFrame([("d", i, s, n, "b", r) for i, (s, n, r) in enumerate(made)], "d string, idx int, stream string, note int, side string, row_idx int")
    assert rows(flow.note_groups(items, ["d"], ["idx"]), "stream", "note", "row_idx", "n") == [("footnotes", 1, 4, 2), ("footnotes", 1, 7, 1)]


def test_note_index_takes_the_last_beginning(spark):
    units = spark.createDataFrame([("p", "a", 0, 1), ("p", "a", 1, 1), ("p", "b", 0, None), ("p", "b", 1, 1), ("p", "b", 2, None), ("p", "b", 3, 1)], "p string, side string, idx int, note int")
    changed = spark.createDataFrame([("p", 0, "deleted", 0, None), ("p", 1, "equal", 1, 1), ("p", 2, "inserted", None, 3)], "p string, row_idx int, type string, oi int, ni int")
    assert rows(flow.note_index(changed, units, ["p"]), "side", "note", "mode", "row_idx") == [("a", 1, "del", 0), ("b", 1, "ins", 2)]


def test_spacing(spark):
    blocks = spark.createDataFrame([("d", 0, -2.0, 8.0), ("d", 1, 10.0, 0.0), ("d", 2, 3.0, 9.0), ("d", 3, 4.0, 1.0)], "d string, idx int, space_before double, space_after double")
    assert rows(flow.collapse_spacing(blocks, ["d"], ["idx"]), "idx", "space_before") == [(0, -2.0), (1, 2.0), (2, 3.0), (3, 0.0)]


@pytest.mark.parametrize(
    ("texts", "running"),
    [
        ({1: "Contract of sale", 2: "Contract  of sale", 3: "Contract of purchase"}, [1, 2]),
        ({2: "Schedule 3 - Page 2", 4: "Schedule 3 - Page 4"}, [2, 4]),
        ({2: "Schedule 3 - Page 2", 4: "Schedule 4 - Page 4"}, []),
        ({1: "SCHEDULE 2.2(b)", 2: "SCHEDULE 2.9(b)"}, []),
        ({1: "Page 01", 2: "page 2"}, [1, 2]),
        ({1: "9" * 60, 2: "8" * 60}, []),
    ],
)
def test_running_lines(spark, texts, running):
    lines = spark.createDataFrame([("d", p, 0, t) for p, t in texts.items()], "d string, page int, line int, text string")
    assert [p for p, _ in rows(flow.running_lines(lines, ["d"], ["page", "line"]), "page", "line")] == running


def test_pair_votes_once(spark):
    """One side alone shows too few full lines; with the other's it is read as wrapped."""
    texts = {"a": ["a full line without an end"] + ["goes on here"], "b": ["a full line without an end", "goes on"] * 4 + ["Done."]}
    lines = [("p", s, i, 1, None, 12.0 * i, 400.0 if t.startswith("a full") else 100.0, 10.0, t, 400.0) for s, ts in texts.items() for i, t in enumerate(ts)]
    table = spark.createDataFrame(lines, "p string, side string, idx int, page int, cell int, y double, x1 double, size double, text string, right double")
    votes = flow.wrap_votes(table, ["p", "side"], ["idx"])
    assert rows(votes, "side", "wrapped", "full", "total") == [("a", 1, 1, 2), ("b", 4, 4, 9)]
    assert rows(flow.nothing_wraps(votes.filter("side = 'a'"), ["p"]), "no_wrap") == [(True,)]
    assert rows(flow.nothing_wraps(votes, ["p"]), "no_wrap") == [(False,)]


def test_justified(spark):
    votes = spark.createDataFrame([("p", "justify", 3), ("p", "justify", 2), ("p", "left", 4), ("q", "justify", 5)], "p string, align string, n_lines int")
    assert rows(flow.justified(votes, ["p"]), "p", "justified") == [("p", False), ("q", True)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_pieces(spark):
    span = lambda s, e, f: F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(f).alias("fmt"))
    ranges = F.array(F.struct(F.lit(4).alias("s"), F.lit(9).alias("e")))
    tabs = F.array(F.struct(F.lit(5).alias("at"), F.lit(2).alias("n")))
    marks = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(r).alias("ref")) for a, r in ((0, 1), (5, 2), (11, 3))])
    cut = flow.pieces(F.lit(0), F.lit(11), F.lit("hello world"), F.array(span(0, 5, "x")), ranges, tabs, marks)
    assert [tuple(p) for p in one(spark, cut)] == [
        (0, 4, "hell", "x", False, 0, [1]), (4, 5, "o", "x", True, 0, []), (5, 6, " ", None, True, 2, [2]),
        (6, 9, "wor", None, True, 0, []), (9, 11, "ld", None, False, 0, []), (11, 11, "", None, False, 0, [3]),
    ]
    part = flow.pieces(F.lit(6), F.lit(8), F.lit("hello world"), F.array(span(0, 5, "x")), ranges, tabs, marks)
    assert [(p.text, p.marks) for p in one(spark, part)] == [("wo", [])]


@pytest.mark.parametrize(("text", "lead", "marks"), [("\t a\t\tb  c\n\td \t", 1, [(1, 2), (5, 1)]), ("\t \t", 2, []), ("", 0, []), ("plain words", 0, [])])
def test_tab_marks(spark, text, lead, marks):
    got = one(spark, flow.tab_marks(F.lit(text)))
    assert (got.lead, [tuple(m) for m in got.marks]) == (lead, marks)


def test_note_marks(spark):
    made = [("  a ", None), ("x", 1), (" b", None), (None, 2), ("  ", None), ("", 3)]
    runs = F.from_json(F.to_json(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(n).cast("int").alias("note")) for t, n in made])), "array<struct<text:string,note:int>>")
    assert [tuple(m) for m in one(spark, flow.note_marks(runs))] == [(2, 1), (3, 2), (3, 3)]


@pytest.mark.parametrize(
    ("digits", "known", "notes"),
    [("142143", [142, 143], [142, 143]), ("142143", [142143, 142, 143], [142143]), ("12", [1, 2], [1, 2]), ("123", [12, 1, 2], []), ("99100101", [99, 100, 101], [99, 100, 101]), ("078", [7, 8], [7, 8]), ("007", [7], [7]), ("5", [], []), ("x", [1], []), ("", [1], []), ("9" * 30, [9], [])],
)
def test_note_numbers(spark, digits, known, notes):
    assert one(spark, flow.note_numbers(F.lit(digits), F.lit(known) if known else F.array().cast("array<bigint>"))) == notes


def test_decorations(spark):
    dotted = F.array(F.lit("dotted-underline"), F.lit("bold"))
    places = lambda effects: [(round(d.y, 3), round(d.thickness, 3), d.dotted) for d in one(spark, flow.decorations(effects, F.lit(0.0), F.lit(9.0), F.lit(100.0), F.lit(10.0)))]
    assert places(dotted) == [(101.1, 0.6, True)]
    assert places(flow.run_effects(dotted, F.lit(True))) == [(101.1, 0.6, False)]
    assert places(flow.run_effects(F.array(F.lit("double-underline")), F.lit(True))) == [(100.8, 0.45, False), (102.0, 0.45, False)]


def test_content_bottom(spark):
    boxes = F.array(F.struct(F.lit(80.0).alias("top"), F.lit(12.0).alias("height")))
    assert one(spark, flow.content_bottom(F.lit(72.0), boxes)) == 92.0
    assert one(spark, flow.content_bottom(F.lit(72.0), F.filter(boxes, lambda x: F.lit(False)))) == 72.0


def merged(rows, revised):
    """The merged document by walking the revised paragraphs."""
    out, done, section = [], 0, 0
    at_ni = {ni: k for k, (_, ni) in enumerate(rows) if ni is not None}

    def flush(until):
        nonlocal done
        while done < until:
            if rows[done][1] is None:
                out.append((done, None, section))
            done += 1

    seen = 0
    for at, (ni, ends) in enumerate(revised):
        if ni is not None:
            flush(at_ni[ni])
            seen, done = seen + 1, max(done, at_ni[ni] + 1)
        out.append((None if ni is None else at_ni[ni], at, section))
        if ends:
            flush(at_ni.get(seen, len(rows)))
            section += 1
    flush(len(rows))
    return out


def test_merged_items_against_a_walk(spark):
    rng, cases = random.Random(7), []
    for _ in range(60):
        n = rng.randrange(0, 6)
        rows, revised = [], []
        for j in range(n + 1):
            rows += [(0, None)] * rng.choice([0, 0, 1, 2])
            revised += [(None, rng.random() < 0.3) for _ in range(rng.choice([0, 0, 1, 2]))]
            if j < n:
                rows.append((rng.choice([0, None]), j))
                revised.append((j, rng.random() < 0.3))
        cases.append((rows, revised))
    table = spark.createDataFrame([(c, k, oi, ni) for c, (rows, _) in enumerate(cases) for k, (oi, ni) in enumerate(rows)], "d int, row_idx int, oi int, ni int")
    paragraphs = spark.createDataFrame([(c, at, ni, ends) for c, (_, revised) in enumerate(cases) for at, (ni, ends) in enumerate(revised)], "d int, at int, ni int, ends boolean")
    items = flow.merged_items(table, paragraphs, ["d"])
    got = {c: [] for c in range(len(cases))}
    for r in items.orderBy("d", "pos").collect():
        got[r.d].append((r.row_idx, r.at, r.section))
    assert [got[c] for c in got] == [merged(*case) for case in cases]
    pair = lambda df: df.withColumns({"a": F.col("d"), "b": F.col("d")})
    sides = {s: report.side_items(pair(items), pair(table), s).count() for s in "ab"}
    assert sides == {"a": sum(oi is not None for rows, _ in cases for oi, _ in rows), "b": sum(len(revised) for _, revised in cases)}


def test_merged_pieces(spark):
    piece = lambda s, e, text, fmt, tab=0, marks=(): F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(text).alias("text"), F.lit(fmt).cast("string").alias("fmt"), F.lit(False).alias("changed"), F.lit(tab).alias("tab"), F.array(*map(F.lit, marks)).cast("array<int>").alias("marks"))
    cut = F.array(piece(0, 1, "a", "x"), piece(1, 2, "b", "x"), piece(2, 3, " ", "x", tab=1), piece(3, 4, "c", "x"), piece(4, 4, "", None), piece(4, 5, "d", None), piece(5, 6, "e", None, marks=[1]))
    assert [(p.s, p.e, p.text) for p in one(spark, flow.merge_pieces(cut))] == [(0, 2, "ab"), (2, 4, " c"), (4, 5, "d"), (5, 6, "e")]
