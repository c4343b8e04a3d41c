"""Lines, bars and drawings of the merged document."""

from foliospark.operators import compare as C
from foliospark.operators import draw


def test_fill_keeps_text_and_width():
    segments = [{"m": "eq", "t": "one two ", "b": False}, {"m": "ins", "t": "three four five", "b": True}, {"m": "eq", "t": " abcdefghijkl", "b": False}]
    lines = draw.fill(segments, 9)
    assert all(sum(len(s["t"]) for s in line) <= 9 for line in lines)
    squeeze = lambda x: "".join(x.split())
    assert squeeze("".join(s["t"] for line in lines for s in line)) == squeeze("one two three four five abcdefghijkl")
    assert draw.fill([], 5) == [[]]


def test_pages_bars_and_svg(spark):
    old = [f"paragraph {i} stays as it is" for i in range(60)]
    new = [*old[:30], "paragraph 30 stays as <it> was", *old[31:], "and one more"]
    rows = C.compare(spark.createDataFrame([(1, 2, old, new)], "a long, b long, units_a array<string>, units_b array<string>")).cache()
    lines = draw.layout(rows).cache()
    assert lines.agg({"page": "max"}).first()[0] == 2 and lines.count() == 61
    assert [(r.page, r.e - r.s) for r in draw.change_bars(lines).orderBy("page", "s").collect()] == [(1, 1), (2, 1)]
    svgs = {r.page: r.svg for r in draw.svg_pages(lines).collect()}
    assert set(svgs) == {1, 2} and "&lt;" in "".join(svgs.values()) and svgs[1].startswith("<svg") and 'style="fill:#ff0000' in "".join(svgs.values())
    assert {r.cid for r in draw.first_lines(lines, C.passages(rows)).collect()} == {r.cid for r in C.passages(rows).collect()}
