"""The merged document drawn with fixed metrics: lines of marked spans, change bars, one SVG a page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import escape_html, py_tokens
from foliospark.operators.compare import PAIR
from foliospark.operators.pages import ADVANCE, LEADING, Block, plan
from foliospark.operators.ranges import merge_touching

LINES = "array<struct<row_idx:int,page:int,line:int,changed:boolean,spans:array<struct<m:string,t:string,b:boolean>>>>"
#: Colours of inserted and deleted text in the two drawing styles.
STYLES = {"standard": {"ins": "fill:#0000ff;text-decoration:underline", "del": "fill:#ff0000;text-decoration:line-through"}, "black-and-white": {"ins": "text-decoration:underline", "del": "text-decoration:line-through"}}


def fill(segments: list[dict], most: int) -> list[list[dict]]:
    """Marked segments as lines of at most ``most`` characters, broken at white space where there is any."""
    lines, line, width = [], [], 0
    for s in segments:
        for token in py_tokens(s["t"]):
            while token:
                if width + len(token) > most and width:
                    lines.append(line)
                    line, width = [], 0
                    token = token.lstrip()
                    continue
                piece, token = token[:most], token[most:]
                if line and (line[-1]["m"], line[-1]["b"]) == (s["m"], s["b"]):
                    line[-1] = {**line[-1], "t": line[-1]["t"] + piece}
                else:
                    line.append({"m": s["m"], "t": piece, "b": s["b"]})
                width += len(piece)
    return [*lines, line] if line or not lines else lines


def layout(rows: DataFrame, width: float = 450.0, height: float = 650.0, size: float = 11.0, after: float = 8.0) -> DataFrame:
    """a, b, page, line (from 0 on its page), row_idx, changed, spans of the merged document of each pair."""
    listed = rows.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("row_idx", "type", "segments"))).alias("rows"))
    most = max(1, int(width / (ADVANCE * size)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.list_(pa.struct([("m", pa.string()), ("t", pa.string()), ("b", pa.bool_())]))
        kind = pa.list_(pa.struct([("row_idx", pa.int32()), ("page", pa.int32()), ("line", pa.int32()), ("changed", pa.bool_()), ("spans", span)]))
        for batch in batches:
            out = []
            for items in batch.to_pylist():
                filled = [fill(x["segments"], most) for x in items]
                breaks = set(plan([Block([LEADING * size] * len(f), after=after) for f in filled], height)[0])
                page, at, made = 1, 0, []
                for b, (x, lines) in enumerate(zip(items, filled, strict=True)):
                    for i, spans in enumerate(lines):
                        if (b, i) in breaks or (i == 0 and (b - 1, len(filled[b - 1])) in breaks):
                            page, at = page + 1, 0
                        made.append({"row_idx": x["row_idx"], "page": page, "line": at, "changed": any(s["m"] != "eq" for s in spans), "spans": spans})
                        at += 1
                out.append(made)
            yield pa.array(out, kind)

    made = listed.select(*PAIR, F.arrow_udf(run, LINES)(F.col("rows")).alias("lines"))
    return made.select(*PAIR, F.inline("lines"))


def change_bars(lines: DataFrame) -> DataFrame:
    """a, b, page, s, e: stretches of neighbouring changed lines."""
    bars = lines.filter("changed").select(*PAIR, "page", F.col("line").alias("s"), (F.col("line") + 1).alias("e"))
    return merge_touching(bars, [*PAIR, "page"])


def svg_pages(lines: DataFrame, style: str = "standard", size: float = 11.0, width: float = 450.0, height: float = 650.0) -> DataFrame:
    """a, b, page, svg: one drawing a page."""
    marks = STYLES[style]
    css = lambda s: F.when(s["m"] == "ins", F.lit(marks["ins"])).when(s["m"] == "del", F.lit(marks["del"])).otherwise(F.lit(""))
    weight = lambda s: F.when(s["b"], F.lit(' font-weight="bold"')).otherwise(F.lit(""))

    def piece(s: Column) -> Column:
        return F.concat(F.lit("<tspan"), weight(s), F.when(s["m"] != "eq", F.concat(F.lit(' style="'), css(s), F.lit('"'))).otherwise(F.lit("")), F.lit(">"), escape_html(s["t"]), F.lit("</tspan>"))

    y = F.round((F.col("line") + 1) * LEADING * size, 2).cast("string")
    text = F.concat(F.lit('<text xml:space="preserve" x="0" y="'), y, F.lit('">'), F.array_join(F.transform("spans", piece), ""), F.lit("</text>"))
    listed = lines.withColumn("t", text).groupBy(*PAIR, "page").agg(F.sort_array(F.collect_list(F.struct("line", "t"))).alias("l"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" font-size="{size:g}">'
    return listed.select(*PAIR, "page", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["t"]), ""), F.lit("</svg>")).alias("svg"))


def to_json(lines: DataFrame, size: float = 11.0, width: float = 450.0, height: float = 650.0) -> DataFrame:
    """a, b, json: the pages of each merged document with their lines and spans, measures to two places."""
    leading = LEADING * size
    line = F.struct(F.round(F.col("line") * leading, 2).alias("y"), F.lit(round(leading, 2)).alias("h"), F.col("row_idx").alias("row"), "changed", "spans")
    placed = lines.groupBy(*PAIR, "page").agg(F.sort_array(F.collect_list(F.struct(F.col("line").alias("k"), line.alias("l")))).alias("ls"))
    page = F.struct("page", F.lit(round(width, 2)).alias("w"), F.lit(round(height, 2)).alias("h"), F.transform("ls", lambda x: x["l"]).alias("lines"))
    return placed.groupBy(*PAIR).agg(F.sort_array(F.collect_list(page)).alias("pages")).select(*PAIR, F.to_json(F.struct("pages")).alias("json"))


def first_lines(lines: DataFrame, passages: DataFrame) -> DataFrame:
    """a, b, cid, page, line: where each numbered change begins: the first line of its row that is changed, else the row's first."""
    order = Window.partitionBy(*PAIR, "row_idx").orderBy(F.desc("changed"), "page", "line")
    firsts = lines.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*PAIR, "row_idx", "page", "line")
    return passages.join(firsts, [*PAIR, "row_idx"]).select(*PAIR, "cid", "page", "line")
