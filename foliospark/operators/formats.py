"""Formatting differences of equal paragraphs."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple


class Format(NamedTuple):
    """A span of one format: bold, italic, underline, font, size, colour."""

    start: int
    end: int
    bold: bool = False
    italic: bool = False
    underline: bool = False
    font: str | None = None
    size: float | None = None
    colour: str | None = None


def _number(x: float | None) -> str:
    return "null" if x is None else f"{x:g}" if float(x).is_integer() and abs(x) < 1e6 else str(int(x)) if float(x).is_integer() else repr(float(x))


def describe(a: Format, b: Format) -> str:
    """What changes from a to b, in a fixed order; empty if nothing compared does."""
    flags = [f"{name} {'added' if new else 'removed'}" for name, old, new in zip(("bold", "italic", "underline"), a[2:5], b[2:5], strict=True) if old != new]
    values = [
        (a.font != b.font, "font", "null" if a.font is None else a.font, "null" if b.font is None else b.font),
        (a.size != b.size, "size", _number(a.size), _number(b.size)),
        (a.colour != b.colour, "colour", f"#{a.colour}" if a.colour else "default", f"#{b.colour}" if b.colour else "default"),
    ]
    return "; ".join(flags + [f"{name} {old} → {new}" for differs, name, old, new in values if differs])


def differences(a: Sequence[Format], b: Sequence[Format]) -> list[tuple[int, int, str]]:
    """(start, end, description) where overlapping spans differ; touching ranges of one description are one."""
    out: list[tuple[int, int, str]] = []
    i = j = 0
    while i < len(a) and j < len(b):
        start, end = max(a[i].start, b[j].start), min(a[i].end, b[j].end)
        if start < end and a[i][2:] != b[j][2:]:
            text = describe(a[i], b[j])
            if out and out[-1][1] == start and out[-1][2] == text:
                out[-1] = (out[-1][0], end, text)
            else:
                out.append((start, end, text))
        if a[i].end <= b[j].end:
            i += 1
        else:
            j += 1
    return out
