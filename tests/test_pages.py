"""Line breaking and page planning."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.operators.pages import Block, plan, wrap


def block(n, **options):
    return Block([10.0] * n, **options)


def test_wrap():
    assert wrap("aaa bbb ccc", 7 * 5.5) == ["aaa bbb", "ccc"] and wrap("abcdefgh", 3 * 5.5) == ["abc", "def", "gh"] and wrap("", 50) == [""]


@pytest.mark.parametrize(
    ("blocks", "height", "breaks"),
    [
        ([block(3), block(3)], 100, []),
        ([block(8), block(4)], 100, [(1, 2)]),
        ([block(9), block(3)], 100, [(1, 0)]),  # one line may not stay behind
        ([block(11)], 100, [(0, 9)]),  # nor go over alone
        ([block(8), block(3, keep_lines=True)], 100, [(1, 0)]),
        ([block(7), block(1, keep_next=True), block(5)], 100, [(2, 2)]),
        ([block(8), block(1, keep_next=True), block(5)], 100, [(1, 0)]),
        ([block(2), block(2, page_break=True)], 100, [(1, 0)]),
        ([block(2, page_break=True)], 100, []),
        ([block(25)], 100, [(0, 10), (0, 20)]),
        ([Block([300.0]), block(1)], 100, [(0, 1)]),
        ([Block([10.0] * 4, notes=[0, 0, 60.0, 0])], 100, [(0, 2)]),
    ],
)
def test_breaks(blocks, height, breaks):
    assert plan(blocks, height)[0] == breaks


def test_space_above():
    assert plan([block(9, before=5), block(3, before=5)], 100)[1] == [True, False]
    assert plan([block(2), block(2, before=5, page_break=True)], 100)[1] == [True, True]


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(1, 30), max_size=12), height=st.integers(3, 20), keep=st.booleans())
def test_every_page_holds_what_it_is_given(sizes, height, keep):
    blocks = [block(n, after=3.0, keep_next=keep and n == 1) for n in sizes]
    breaks, _ = plan(blocks, 10.0 * height)
    assert breaks == sorted(breaks) and len(set(breaks)) == len(breaks)
    lines = [(b, i) for b, n in enumerate(sizes) for i in range(n)]
    edges = [lines.index(x) if x in lines else next(k for k, y in enumerate(lines + [(99, 0)]) if y > x) for x in breaks]
    for a, z in zip([0, *edges], [*edges, len(lines)], strict=True):
        assert z - a <= height
