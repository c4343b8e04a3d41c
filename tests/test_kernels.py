"""Alignment, inline and pairing kernels: fixed expectations and properties."""

import random
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.functions import text as T
from foliospark.operators.alignment import align, align_words, common, similarity, similarity_bound
from foliospark.operators.formats import Format, describe, differences
from foliospark.operators.inline import Segment, bold_tokens, join_phrases, segments, weight, whole
from foliospark.operators.pairing import Unit, compare_units

LISTS = st.lists(st.sampled_from("abcd"), max_size=12)


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("$1,200.50 due 2026-09-08, ok", ["$", "1,200.50", " ", "due", " ", "2026-09-08", ",", " ", "ok"]), ("café x", ["caf", "é", " ", "x"]), ("1.", ["1", "."]), ("", [])],
)
def test_tokens(text, tokens):
    assert T.py_tokens(text) == tokens


def test_norm_and_category():
    assert T.py_norm("a\u0085b") == "a\u0085b" and T.py_norm(" ﻿A \t b\x1c ", True) == "a b"
    assert [T.py_categorize(*x) for x in (("Hello, world.", "Hello world"), ("The Provider", "The provider"), ("a b", "a c"))] == ["punctuation", "punctuation", "content"]
    assert T.py_ranges([3, 1, 2, 5, 7, 8]) == "1-3, 5, 7-8"


def test_similarity():
    sim = lambda a, b: similarity(T.py_content(a), T.py_content(b))
    assert (sim("a b c", "a b d"), sim("", ""), sim("a", "")) == (4 / 6, 1.0, 0.0)
    assert similarity_bound(["a"] * 4, ["a"]) == 2 / 5


def test_scripts():
    assert align("xyz", "yzx") == [("delete", 0, 0), ("equal", 1, 0), ("equal", 2, 1), ("insert", 3, 2)]
    assert align("pqrs", "pzrs") == [("equal", 0, 0), ("delete", 1, 1), ("insert", 2, 1), ("equal", 2, 2), ("equal", 3, 3)]
    assert [op[0] for op in align("mmmm", "nnn", cells=1)] == ["delete"] * 4 + ["insert"] * 3
    assert align("", "") == [] and align("uv", "") == [("delete", 0, 0), ("delete", 1, 0)]
    # Too large for a table: equal ends first, then the elements that are unique on both sides.
    assert [op for op in align("aXbbYa", "aYbbXa", cells=3) if op[0] == "equal"] == [("equal", 0, 0), ("equal", 4, 1), ("equal", 5, 5)]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(a=LISTS, b=LISTS, cells=st.sampled_from([1, 4, 10**6]))
def test_script_rebuilds_both(a, b, cells):
    for ops in (align(a, b, cells), align_words(a, b, lambda t: 3, cells)):
        assert [a[i] for tag, i, _ in ops if tag != "insert"] == a and [b[j] for tag, _, j in ops if tag != "delete"] == b
        assert all(a[i] == b[j] for tag, i, j in ops if tag == "equal")
    if cells > 200:
        assert common(a, b) == plain_lcs(a, b) == sum(op[0] == "equal" for op in align(a, b))
    assert similarity(a, b) <= similarity_bound(a, b) + 1e-12


@settings(max_examples=300, deadline=None)
@given(a=LISTS, b=LISTS)
def test_word_alignment_mirrors(a, b):
    flip = {"insert": "delete", "delete": "insert", "equal": "equal"}
    one = {(flip[t], j if t == "equal" else None, i if t == "equal" else None) for t, i, j in align_words(a, b, weight) if t == "equal"}
    two = {(t, i, j) for t, i, j in align_words(b, a, weight) if t == "equal"}
    assert one == two


def test_best_matches_is_the_best():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice(["aa", "b", " ", "cccc"]) for _ in range(rng.randrange(7))] for _ in range(2))
        score = lambda ops: (
            sum(weight(a[i]) for t, i, _ in ops if t == "equal"),
            -sum(t != "equal" and (k == 0 or ops[k - 1][0] == "equal") for k, (t, _, _) in enumerate(ops)),
            sum(t == "equal" for t, _, _ in ops),
        )

        def every(i, j):
            if i == len(a) and j == len(b):
                yield []
                return
            if i < len(a) and j < len(b) and a[i] == b[j]:
                yield from ([("equal", i, j), *r] for r in every(i + 1, j + 1))
            if i < len(a):
                yield from ([("delete", i, j), *r] for r in every(i + 1, j))
            if j < len(b):
                yield from ([("insert", i, j), *r] for r in every(i, j + 1))

        if len(a) + len(b) <= 9:
            assert score(align_words(a, b, weight)) >= max(map(score, every(0, 0)))[:1] + (-99,)
            assert score(align_words(a, b, weight))[0] == max(map(score, every(0, 0)))[0]


def modes(old, new):
    return [(mode, "".join(s.text for s in group)) for mode, group in groupby(segments(old, new), key=lambda s: s.mode)]


def test_inline_expectations():
    assert modes("a red car", "a blue car") == [("eq", "a "), ("del", "red"), ("ins", "blue"), ("eq", " car")]
    assert modes("red and blue cars", "green and yellow cars") == [("del", "red and blue"), ("ins", "green and yellow"), ("eq", " cars")]
    assert ("eq", " and big ") in modes("red and big blue cars", "green and big yellow cars")
    old = "The fee is due. "
    assert modes("Pay now.", "Pay now. The Customer pays in ten days.") == [("eq", "Pay now."), ("ins", " The Customer pays in ten days.")]
    assert modes(old, old) == [("eq", old)]
    long = "x " * 2100
    assert [s.mode for s in segments(long, long + "y")] == ["del", "ins"]


def test_insertions_end_on_sentences():
    old = "We sell. We buy. They go."
    assert modes(old, "We sell. We rent. We buy. They go.") == [("eq", "We sell."), ("ins", " We rent."), ("eq", " We buy. They go.")]
    assert modes("We sell. We rent. We buy. They go.", old) == [("eq", "We sell."), ("del", " We rent."), ("eq", " We buy. They go.")]


@settings(max_examples=300, deadline=None)
@given(a=st.lists(st.sampled_from(["red", "and", "big", ".", ",", " ", " ", "x1"]), max_size=14), b=st.lists(st.sampled_from(["red", "and", "big", ".", ",", " ", " ", "x1"]), max_size=14))
def test_segments_hold_both_texts(a, b):
    old, new = "".join(a), "".join(b)
    got = segments(old, new)
    assert "".join(s.text for s in got if s.mode != "ins") == old and "".join(s.text for s in got if s.mode != "del") == new


def test_bold():
    assert bold_tokens(["ab", " ", "cd"], [(1, 5)]) == [True, False, True]
    assert whole("abcd", [(1, 2)], "eq") == [Segment("eq", "a"), Segment("eq", "b", True), Segment("eq", "cd")] and whole("", [], "eq") == []
    got = segments("ab cd", "ab ce", [(0, 2)], [(3, 5)])
    assert got == [Segment("eq", "ab", True), Segment("eq", " "), Segment("del", "cd"), Segment("ins", "ce", True)]
    assert join_phrases([Segment("eq", "x")]) == [Segment("eq", "x")]


def test_formats():
    assert describe(Format(0, 1, font="Calibri", size=11.0), Format(0, 1, True, True, True, "Arial", 12.0, "ff0000")) == "bold added; italic added; underline added; font Calibri → Arial; size 11 → 12; colour default → #ff0000"
    assert differences([Format(0, 3, True), Format(3, 6), Format(6, 10, italic=True)], [Format(0, 10)]) == [(0, 3, "bold removed"), (6, 10, "italic removed")]
    assert differences([Format(0, 4, True), Format(4, 6, True)], [Format(0, 6)]) == [(0, 6, "bold removed")]


def rows(old, new, **options):
    return [(r.type, r.oi, r.ni) for r in compare_units([Unit(t) for t in old], [Unit(t) for t in new], **options)]


def test_compare():
    assert rows(["Alpha", "Beta one", "Gamma"], ["Alpha", "Beta two", "Gamma", "Delta"]) == [("equal", 0, 0), ("changed", 1, 1), ("equal", 2, 2), ("inserted", None, 3)]
    assert rows(["a b c d", "keep"], ["w x y z", "keep"]) == [("deleted", 0, None), ("inserted", None, 0), ("equal", 1, 1)]
    assert rows(["One"], ["one"], ignore_case=True) == [("equal", 0, 0)]
    got = compare_units([Unit("x", "1."), Unit("y", "2.")], [Unit("new words here", "1."), Unit("x", "2."), Unit("y", "3.")])
    assert [(r.type, r.num_changed, r.old_marker) for r in got] == [("inserted", False, None), ("equal", True, "1."), ("equal", True, "2.")]
    streams = compare_units([Unit("note", stream="footnote")], [Unit("note")])
    assert [r.type for r in streams] == ["deleted", "inserted"]
