"""The rows of a comparison: equal, changed, deleted and inserted paragraphs of two versions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import groupby

from foliospark.functions.text import py_categorize, py_content, py_norm
from foliospark.operators.alignment import DELETE, EQUAL, INSERT, align, similarity, similarity_bound
from foliospark.operators.formats import Format, differences
from foliospark.operators.inline import Segment, Span, segments, whole

SIMILAR = 0.5


@dataclass
class Unit:
    """A paragraph: its text with single spaces, list marker, stream (body, footnote, header, ...), bold spans and formats."""

    text: str
    marker: str = ""
    stream: str = "body"
    bold: list[Span] = field(default_factory=list)
    formats: list[Format] = field(default_factory=list)


@dataclass
class Row:
    type: str
    oi: int | None
    ni: int | None
    segments: list[Segment]
    cat: str | None = None
    num_changed: bool = False
    old_marker: str | None = None
    fmt: list[tuple[int, int, str]] = field(default_factory=list)


class _Side:
    def __init__(self, units: Sequence[Unit], ignore_case: bool) -> None:
        self.units = units
        self.texts = [py_norm(u.text, ignore_case) for u in units]
        self.tokens = [py_content(t) for t in self.texts]
        self.keys = [(u.stream, t) for u, t in zip(units, self.texts, strict=True)]
        # Headers and footers are a problem of their own, so they never move a body row.
        self.split = next((i for i, u in enumerate(units) if u.stream in ("header", "footer")), len(units))


def _renumber(row: Row, a: Unit, b: Unit) -> Row:
    if (a.marker or "") != (b.marker or ""):
        row.num_changed, row.old_marker = True, a.marker or ""
    return row


def _partner(a: _Side, b: _Side, i: int, free: list[int]) -> int | None:
    """The most similar free insertion of the same stream, the first of equals; none below SIMILAR."""
    best, score = None, 0.0
    for j in free:
        if a.units[i].stream != b.units[j].stream or similarity_bound(a.tokens[i], b.tokens[j]) <= max(score, SIMILAR - 1e-9):
            continue
        found = similarity(a.tokens[i], b.tokens[j])
        if found > score:
            best, score = j, found
    return best if score >= SIMILAR else None


def _block(a: _Side, b: _Side, gone: list[int], new: list[int]) -> list[Row]:
    """The rows of a deleted stretch beside an inserted one: deletions in order, each paired if it can be, then what is left."""
    rows, free = [], list(new)
    for i in gone:
        old, j = a.units[i], _partner(a, b, i, free)
        if j is None:
            rows.append(Row("deleted", i, None, whole(old.text, old.bold, "del")))
            continue
        free.remove(j)
        now = b.units[j]
        row = Row("changed", i, j, segments(old.text, now.text, old.bold, now.bold), py_categorize(a.texts[i], b.texts[j]))
        rows.append(_renumber(row, old, now))
    return rows + [Row("inserted", None, j, whole(b.units[j].text, b.units[j].bold, "ins")) for j in free]


def _part(a: _Side, b: _Side, a0: int, a1: int, b0: int, b1: int) -> list[Row]:
    runs = [(tag, [(a0 + i, b0 + j) for _, i, j in group]) for tag, group in groupby(align(a.keys[a0:a1], b.keys[b0:b1]), key=lambda op: op[0])]
    rows, k = [], 0
    while k < len(runs):
        tag, places = runs[k]
        k += 1
        if tag == EQUAL:
            for i, j in places:
                old, now = a.units[i], b.units[j]
                rows.append(_renumber(Row("equal", i, j, whole(now.text, now.bold, "eq"), fmt=differences(old.formats, now.formats)), old, now))
            continue
        sides = {DELETE: [], INSERT: [], tag: places}
        if k < len(runs) and runs[k][0] != EQUAL:
            sides[runs[k][0]] = runs[k][1]
            k += 1
        rows += _block(a, b, [i for i, _ in sides[DELETE]], [j for _, j in sides[INSERT]])
    return rows


def compare_units(original: Sequence[Unit], revised: Sequence[Unit], ignore_case: bool = False) -> list[Row]:
    """All rows in order: body and notes first, then headers and footers."""
    a, b = _Side(original, ignore_case), _Side(revised, ignore_case)
    return _part(a, b, 0, a.split, 0, b.split) + _part(a, b, a.split, len(original), b.split, len(revised))
