"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id). Splitters between the shards are found by counting the
exact bytes below candidate key boundaries: each round counts, over all partitions, the bytes in the
4,096 equal cells of the key intervals that still hold a target, and goes on in one cell of each until
every splitter is within the tolerance. Then the rows are exchanged once, to their shard and a bucket
in it, and numbered.

The text comes first in the key, so equal texts stand together and a splitter divides a group of them
only where the group is heavier than the tolerance; there the id decides. So no group, however large,
makes a shard heavier. Buckets split each shard by a hash of the row, not by the key, so that numbering
never puts a hot text in one task.

Defined cases: a null text has no bytes (its size is 1); a null id sorts first; rows equal in text and
id cannot be told apart and are kept on one side of a splitter; a text longer than a shard's part fills its
shard alone; an empty table gives an empty table; the output columns replace input columns of the same name,
and no other column is touched, whatever its name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import column, dropped, packed, unpacked, written

SHARDS = 16
#: Largest distance of a splitter from its target, as a part of a shard's bytes.
TOLERANCE = 0.0005
DIGIT = 12
ROWS_PER_BUCKET = 2_000
LOWEST = -(2**63)
#: (key column, bits below the digit) of each level: the hash of the text, then the id.
LEVELS = [(c, max(0, 64 - DIGIT * i)) for c in ("k", "id") for i in range(1, math.ceil(64 / DIGIT) + 1)]


@dataclass
class Probe:
    """A splitter that is not settled: the key prefix that holds its target, and the bytes below that prefix."""

    target: float
    text_key: int | None = None  # the whole hash, once known
    prefix: int = 0
    below: int = 0


def _cells(narrow: DataFrame, probes: list[Probe], level: int) -> dict[int, list[tuple[int, int]]]:
    """For each probe's place in the list: (value of the key so far, bytes) of the cells under its prefix, in key order."""
    column, shift = LEVELS[level]
    first = level == 0 or LEVELS[level - 1][0] != column
    value = F.shiftright(column, shift) if shift else F.col(column)
    which: Column = F.lit(None).cast("int")
    for i, p in enumerate(probes):
        under = F.lit(True) if first else F.shiftright(column, LEVELS[level - 1][1]) == F.lit(p.prefix)
        if column == "id":
            under &= F.col("k") == F.lit(p.text_key)
        which = F.when(under, F.lit(i)).otherwise(which)
    rows = narrow.select(which.alias("i"), value.alias("v"), "size").filter("i IS NOT NULL").groupBy("i", "v").agg(F.sum("size").alias("n")).collect()
    out: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(rows, key=lambda r: (r.i, r.v)):
        out.setdefault(r.i, []).append((r.v, r.n))
    return out


def splitters(narrow: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The least keys (hash, id) of shards 1 and on, over a table of k, id and size."""
    total = narrow.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    open_probes = {j: Probe(total * j / shards) for j in range(1, shards)} if total else {}
    found: dict[int, tuple[int, int]] = {}
    for level, (column, shift) in enumerate(LEVELS):
        if not open_probes:
            break
        # Probes with the same prefix share one count.
        groups: dict[tuple, list[int]] = {}
        for j, p in open_probes.items():
            groups.setdefault((p.text_key, p.prefix), []).append(j)
        cells = _cells(narrow, [open_probes[js[0]] for js in groups.values()], level)
        for i, js in enumerate(groups.values()):
            for j in js:
                p, below = open_probes[j], open_probes[j].below
                for value, n in cells[i]:
                    if below + n >= p.target or (value, n) == cells[i][-1]:
                        break
                    below += n
                start_off, end_off = p.target - below, below + n - p.target
                last = level == len(LEVELS) - 1
                if min(start_off, end_off) <= allowed or last:
                    bound = (value + (end_off < start_off)) << shift
                    found[j] = (bound, LOWEST) if column == "k" else (p.text_key, bound)
                    del open_probes[j]
                elif shift:
                    open_probes[j] = Probe(p.target, p.text_key, value, below)
                else:
                    open_probes[j] = Probe(p.target, value, 0, below)
    return [found[j] for j in sorted(found)]


def shard(df: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """df with size (bytes and 1), law, shard, slot (gapless from 0 in each shard) and grown_shard (null)."""
    text, key = F.coalesce(column(text_col), F.lit("")), F.coalesce(column(id_col).cast("long"), F.lit(LOWEST))
    sized = packed(df, k=F.xxhash64(text), id=key, size=F.octet_length(text).cast("long") + 1)
    narrow = written(sized.select("k", "id", "size"), "shard-keys")
    bounds = splitters(narrow, shards, tolerance)
    after = [(F.col("k") > k) | ((F.col("k") == k) & (F.col("id") >= i)) if k < 2**63 else F.lit(False) for k, i in bounds]
    place = sum((x.cast("int") for x in after), F.lit(0))
    buckets = max(1, math.ceil(narrow.count() / shards / ROWS_PER_BUCKET))
    bucket = F.pmod(F.xxhash64("id", "k", F.lit(7)), F.lit(buckets)).cast("int")
    counts = narrow.select(place.alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead")), "shard-offsets")
    dropped(narrow)
    inside = Window.partitionBy("shard", "bucket").orderBy("k", "id")
    # The rows lie by shard and bucket for the window already; the offsets come to them.
    dealt = sized.withColumns({"shard": place, "bucket": bucket}).withColumn("at", F.row_number().over(inside)).join(offsets.hint("merge"), ["shard", "bucket"])
    return unpacked(dealt, df.columns, size=F.col("size"), law=F.lit("bytes"), shard=F.col("shard"), slot=F.col("ahead") + F.col("at") - 1, grown_shard=F.lit(None).cast("int"))
