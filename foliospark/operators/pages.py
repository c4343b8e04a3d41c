"""Pages: line breaking with fixed metrics, and the page-break planner.

There are no fonts here: a character is half an em wide and a line 1.2 em high, which keeps results the
same on every machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.compare import PAIR

ADVANCE, LEADING = 0.5, 1.2
#: Height of the rule above a page's footnotes.
NOTE_RULE = 9.0
#: How far a chain of paragraphs that stay with their next is looked along.
CHAIN = 4
EPSILON = 1e-9


@dataclass
class Block:
    """A paragraph to place: heights of its lines and, per line, of the footnotes that it brings."""

    lines: list[float]
    before: float = 0.0
    after: float = 0.0
    keep_next: bool = False
    keep_lines: bool = False
    page_break: bool = False
    notes: list[float] = field(default_factory=list)


def wrap(text: str, width: float, size: float = 11.0) -> list[str]:
    """Greedy lines of at most width points; a word that is longer than a line is cut."""
    most = max(1, int(width / (ADVANCE * size) + EPSILON))
    lines, line = [], ""
    for word in text.split(" "):
        joined = f"{line} {word}" if line else word
        if len(joined) <= most:
            line = joined
            continue
        if line:
            lines.append(line)
        while len(word) > most:
            lines.append(word[:most])
            word = word[most:]
        line = word
    return [*lines, line] if line or not lines else lines


class _Planner:
    def __init__(self, blocks: Sequence[Block], height: Callable[[int], float]) -> None:
        self.blocks, self.height = blocks, height
        self.breaks: list[tuple[int, int]] = []
        self.spaced = [False] * len(blocks)
        self.page = -1
        self.turn(explicit=True)

    def turn(self, at: tuple[int, int] | None = None, explicit: bool = False) -> None:
        """Begin a page, with a break before line at[1] of block at[0]."""
        if at is not None:
            self.breaks.append(at)
        self.page += 1
        self.room, self.empty, self.explicit, self.ruled = self.height(self.page), True, explicit, False

    def cost(self, block: Block, start: int, end: int) -> float:
        notes = sum(block.notes[start:end])
        return sum(block.lines[start:end]) + notes + (NOTE_RULE if notes > 0 and not self.ruled else 0.0)

    def put(self, block: Block, start: int, end: int) -> None:
        self.room -= self.cost(block, start, end)
        self.ruled |= any(block.notes[start:end])

    def wanted(self, b: int, depth: int = 0) -> float:
        """Height that must be free to begin block b here: its first lines, all of it, or all and what it stays with."""
        block, whole = self.blocks[b], sum(self.blocks[b].lines)
        follows = self.blocks[b + 1] if b + 1 < len(self.blocks) else None
        if block.keep_next and depth < CHAIN and follows is not None and not follows.page_break:
            return whole + block.after + follows.before + self.wanted(b + 1, depth + 1)
        return whole if block.keep_lines and whole <= self.height(self.page) else sum(block.lines[:2])

    def begin(self, b: int) -> None:
        """Turn the page before block b if it has to, and spend the space above it."""
        block = self.blocks[b]
        if block.page_break and not self.empty:
            self.turn((b, 0), explicit=True)
        if not self.empty and block.before + self.wanted(b) > self.room:
            self.turn((b, 0))
        if self.empty and not (self.page == 0 or self.explicit):
            return  # no space at the top of a page that began by itself
        self.spaced[b] = True
        self.room = max(0.0, self.room - block.before) if self.empty else self.room - block.before

    def place(self, b: int) -> None:
        block, start, n = self.blocks[b], 0, len(self.blocks[b].lines)
        while start < n:
            fit = start
            while fit < n and self.cost(block, start, fit + 1) <= self.room + EPSILON:
                fit += 1
            if fit == n:
                self.put(block, start, n)
                self.empty = False
                break
            cut = fit - (n - fit == 1)  # two lines at least go over
            if start == 0 and cut == 1:  # and two at least stay
                cut = 0
            if cut > start:
                self.put(block, start, cut)
                start = cut
            elif self.empty and (fit == start or abs(self.room - self.height(self.page)) < EPSILON):
                start = max(fit, start + 1)  # another page would not help
            elif start == 0:
                self.spaced[b] = False
            self.turn((b, start))
        if not self.empty:
            self.room = max(0.0, self.room - block.after)


def plan(blocks: Sequence[Block], height: float | Callable[[int], float]) -> tuple[list[tuple[int, int]], list[bool]]:
    """Breaks as (block, line that the break precedes), and for each block whether the space above it is kept."""
    planner = _Planner(blocks, height if callable(height) else lambda _: height)
    for b in range(len(blocks)):
        planner.begin(b)
        planner.place(b)
    return planner.breaks, planner.spaced


def paginate(rows: DataFrame, width: float = 450.0, height: float = 650.0, size: float = 11.0, after: float = 8.0) -> DataFrame:
    """a, b, row_idx, page (of the row's first line), n_lines: the merged document of each pair on pages."""
    text = F.array_join(F.transform("segments", lambda s: s["t"]), "")
    listed = rows.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("row_idx", text.alias("t")))).alias("rows"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("row_idx", pa.int32()), ("page", pa.int32()), ("n_lines", pa.int32())]))
        for batch in batches:
            out = []
            for items in batch.to_pylist():
                blocks = [Block([LEADING * size] * len(wrap(x["t"], width, size)), after=after) for x in items]
                breaks, _ = plan(blocks, height)
                starts = sorted(b + (line > 0) for b, line in breaks)  # a block's first line is on the page that begins at or before it
                at, page = [], 1
                for b, (x, block) in enumerate(zip(items, blocks, strict=True)):
                    while page - 1 < len(starts) and starts[page - 1] <= b:
                        page += 1
                    at.append({"row_idx": x["row_idx"], "page": page, "n_lines": len(block.lines)})
                out.append(at)
            yield pa.array(out, kind)

    made = listed.select(*PAIR, F.arrow_udf(run, "array<struct<row_idx:int,page:int,n_lines:int>>")(F.col("rows")).alias("at"))
    return made.select(*PAIR, F.inline("at"))
