"""Reply threads and comment changes."""

import pytest

from foliospark.operators import threads as T


def comment(i, text, author="ann", **more):
    return {"id": i, "author": author, "text": text, **more}


def test_order_of_changes():
    old = [comment(1, "please check the price", pos=4), comment(2, "remove this", pos=1), comment(3, "no anchor")]
    new = [
        comment(10, "please check the new price", pos=4, date="2024-05-01", done=True), comment(11, "a reply to that", "bob", pos=4, parent=10),
        comment(12, "first of all", "bob", pos=0), comment(13, "no anchor"), comment(14, "deep", "cy", pos=4, parent=11),
    ]
    got = T.changes(old, new)
    assert [(c["state"], c["old_id"], c["new_id"], c["cid"], c["depth"]) for c in got] == [
        ("added", None, 12, 1, 0), ("removed", 2, None, 2, 0), ("edited", 1, 10, 3, 0), ("added", None, 11, 4, 1), ("added", None, 14, 5, 2), ("unchanged", 3, 13, None, 0),
    ]
    assert (got[2]["date"], got[2]["done"], got[0]["done"]) == ("2024-05-01", True, None)


def test_matches_prefer_the_same_row():
    old = [comment(1, "fix the wording here", row=3), comment(2, "fix the wording here", row=8)]
    new = [comment(10, "fix the wording here", row=8), comment(11, "fix the wording here please", row=3)]
    assert T.match(old, new) == {0: 1, 1: 0}
    assert T.match(old, [comment(10, "fix the wording here", "bob", row=3)]) == {}


def test_anchors():
    cut = [{"m": "eq", "t": "The "}, {"m": "del", "t": "old"}, {"m": "ins", "t": "brand new"}, {"m": "eq", "t": " price"}]
    assert T.anchored("deleted", [], "a", 0) and T.anchored("inserted", [], "b", 0) and not T.anchored("deleted", [], "b", 0) and not T.anchored("equal", [], "a", 0)
    assert [T.anchored("changed", cut, "a", *x) for x in ((0,), (4,), (6,), (7,), (0, 4), (0, 5), (7, 13))] == [False, True, True, False, False, True, False]
    assert [T.anchored("changed", cut, "b", *x) for x in ((4,), (12,), (13,), (13, 19))] == [True, True, False, False]


def test_depths_of_odd_threads(spark):
    rows = [(i, None if i == 0 else i - 1) for i in range(37)] + [(100, 101), (101, 100), (200, 999), (300, None), (301, 300), (302, 300)]
    got = {r.id: r.depth for r in T.depths(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {i: i for i in range(37)} | {300: 0, 301: 1, 302: 1}
    assert T.depths(spark.createDataFrame([], "id long, parent long")).count() == 0


@pytest.mark.parametrize(("comments", "want"), [([(1, None), (2, 1), (3, 2)], {1: 0, 2: 1, 3: 2}), ([(1, 2), (2, 1)], {1: 1, 2: 1}), ([(1, 9)], {1: 0})])
def test_reply_depths(comments, want):
    assert T.reply_depths([{"id": i, "parent": p} for i, p in comments]) == want
