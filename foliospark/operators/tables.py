"""Tables without rules: lines whose tabbed pieces stand under each other.

A table is read from the lines of a page in order, so this is a small kernel for each page; pages are
independent rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fewer rows are no table; then, of the text size, how near starts of a column are, how far apart
# rows of one table and the lines inside a cell lie; then the space in points from a column's edge to its text.
MIN_ROWS = 3
SAME_COLUMN, ROW_STEP, CELL_STEP, BELOW = 0.3, 2.5, 1.5, 0.3
PADDING = 5.4
# Marks that a list item begins with, a lead that is only a label, and the dots of a line of contents.
LIST_MARK = re.compile(r"[•◦▪‣·–-]|\(?\d{1,3}(?:\.\d{1,3})*[.)]?|\(?(?:[A-Za-z]|[ivxlcdm]{1,7})[.)]")
LABEL = re.compile(r"[A-Za-z]|[ivxlcdm]{1,7}")
DOTS = re.compile(r"\.{4,}")

_CELL = pa.struct([("table", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())] + [(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")])
CELLS_DDL = "array<struct<table:int,row:int,col:int,text:string,x0:double,y0:double,x1:double,y1:double>>"


@dataclass
class Table:
    """Rows of a table; each is its tabbed line and the lines wrapped inside its cells, as (column, line)."""

    starts: list[float]
    size: float
    rows: list[tuple[dict, list[tuple[int, dict]]]] = field(default_factory=list)
    closed: bool = False

    def end(self) -> float:
        first, wrapped = self.rows[-1]
        return wrapped[-1][1]["y"] if wrapped else first["y"]

    def column(self, x: float) -> int | None:
        """The column that begins at x."""
        return next((k for k, start in enumerate(self.starts) if abs(x - start) <= SAME_COLUMN * self.size), None)

    def fits(self, line: dict) -> bool:
        """Whether a tabbed line is the next row."""
        return len(line["cols"]) == len(self.starts) and line["y"] - self.end() <= ROW_STEP * self.size and all(abs(c["x0"] - x) <= SAME_COLUMN * self.size for c, x in zip(line["cols"], self.starts, strict=True))

    def cells(self) -> list[list[list[dict]]]:
        """Rows of columns of lines."""
        out = []
        for first, wrapped in self.rows:
            cells = [[first | {"text": t.strip(), "x0": c["x0"], "x1": c["x1"], "cols": []}] for t, c in zip(first["text"].split("\t"), first["cols"], strict=True)]
            for k, line in wrapped:
                cells[k].append(line)
            out.append(cells)
        return out

    def edges(self) -> tuple[list[float], list[float]]:
        """Where columns and rows begin, and where the last ends: columns by the mean start, rows halfway between lines."""
        cells = self.cells()
        xs = [sum(row[k][0]["x0"] for row in cells) / len(cells) - PADDING for k in range(len(self.starts))]
        xs.append(max(line["x1"] for row in cells for line in row[-1]) + PADDING)
        spans = [[(line["y"] - line["size"], line["y"] + BELOW * line["size"]) for cell in row for line in cell] for row in cells]
        tops, bottoms = [min(t for t, _ in s) for s in spans], [max(b for _, b in s) for s in spans]
        return xs, [tops[0], *((b + t) / 2 for b, t in zip(bottoms, tops[1:], strict=False)), bottoms[-1]]


def begins_row(line: dict) -> bool:
    """Whether a line can be a row: pieces between tabs, no list item, no line of contents."""
    if len(line["cols"]) < 2 or DOTS.search(line["text"]):
        return False
    lead = line["text"].split("\t", 1)[0]
    return not LABEL.fullmatch(lead) and not LIST_MARK.fullmatch(lead.split(" ", 1)[0])


def find(lines: Sequence[dict]) -> list[Table]:
    """The tables among the lines of one page."""
    found: list[Table] = []
    for line in sorted((x for x in lines if x.get("grid") is None), key=lambda x: (x["y"], x["x0"])):
        table = found[-1] if found and not found[-1].closed else None
        if table is not None:
            if begins_row(line) and table.fits(line):
                table.rows.append((line, []))
                continue
            k = None if line["cols"] else table.column(line["x0"])
            if k and line["y"] - table.end() <= CELL_STEP * table.size:  # never the first column: that is text under the table
                table.rows[-1][1].append((k, line))
                continue
            table.closed = True
        if begins_row(line):
            found.append(Table([c["x0"] for c in line["cols"]], line["size"], [(line, [])]))
    return [t for t in found if len(t.rows) >= MIN_ROWS]


def with_cells(lines: Sequence[dict]) -> list[dict]:
    """Lines in order, with ``cell`` where they are in a table.

    Lines of tables without rules are cut into pieces, row by row; those of ruled tables (``grid``, ``grid_cell``) stay.
    """
    out: list[dict] = []
    for page, group in groupby(lines, key=lambda x: x["page"]):
        on_page = list(group)
        pieces: dict[int, list[dict]] = {}
        for t, table in enumerate(find(on_page)):
            for r, ((first, wrapped), row) in enumerate(zip(table.rows, table.cells(), strict=True)):
                pieces |= {id(line): [] for _, line in wrapped}
                pieces[id(first)] = [line | {"cell": (page, t, r, k)} for k, cell in enumerate(row) for line in cell]
        for line in on_page:
            ruled = line.get("grid") is not None
            out += [line | {"cell": (page, "ruled", line["grid"], line["grid_cell"])}] if ruled else pieces.get(id(line), [line])
    return out


def table_cells(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, table, row, col (from 0), text, x0, y0, x1, y1: cells of the tables without rules on each page.

    ``lines`` holds keys (a file and a page) and line, y, x0, x1, size, text and cols, as a file's page lines do.
    """

    def cells(page: list[dict]) -> list[dict]:
        out = []
        for t, table in enumerate(find(page)):
            xs, ys = table.edges()
            for r, row in enumerate(table.cells()):
                out += [{"table": t, "row": r, "col": k, "text": " ".join(x["text"] for x in cell), "x0": xs[k], "y0": ys[r], "x1": xs[k + 1], "y1": ys[r + 1]} for k, cell in enumerate(row)]
        return out

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([cells(x) for x in batch.to_pylist()], pa.list_(_CELL))

    free = lines.filter("grid IS NULL") if "grid" in lines.columns else lines
    pages = free.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line", "y", "x0", "x1", "size", "text", "cols"))).alias("_lines"))
    return pages.select(*keys, F.arrow_udf(run, CELLS_DDL)(F.col("_lines")).alias("_cells")).select(*keys, F.inline("_cells"))
