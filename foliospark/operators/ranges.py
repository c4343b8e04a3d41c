"""Ordered and interval operators: overlap joins, islands, fills, as-of joins, modes and order statistics.

All keep their work inside an equi-key (a pair, a document, a user), so every join is a hash or merge
join with a residual predicate and every window is bounded by its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], fmt: str = "fmt") -> DataFrame:
    """keys, s, e, fmt_a, fmt_b: the overlap of every two half-open spans [s, e) of a key."""
    left = a.select(*keys, F.col("s").alias("sa"), F.col("e").alias("ea"), F.col(fmt).alias("fmt_a"))
    right = b.select(*keys, F.col("s").alias("sb"), F.col("e").alias("eb"), F.col(fmt).alias("fmt_b"))
    both = left.join(right, list(keys)).filter((F.col("sa") < F.col("eb")) & (F.col("sb") < F.col("ea")))
    return both.select(*keys, F.greatest("sa", "sb").alias("s"), F.least("ea", "eb").alias("e"), "fmt_a", "fmt_b")


def merge_touching(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", gap: float = 0) -> DataFrame:
    """The union of the intervals of a key: those that overlap, or lie at most gap apart, are one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    island = F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = df.withColumn("_cut", cut).withColumn("_island", island)
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def span_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, s, e, change: where the formats of overlapping spans differ; touching ranges of one change are one."""
    both = overlaps(a, b, keys).filter(~F.col("fmt_a").eqNullSafe(F.col("fmt_b")))
    named = both.select(*keys, "s", "e", F.concat(F.coalesce("fmt_a", F.lit("null")), F.lit(" → "), F.coalesce("fmt_b", F.lit("null"))).alias("change"))
    return merge_touching(named, [*keys, "change"])


def runs(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """keys, run, value, first, last, n: maximal stretches of one value in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    turn = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    numbered = df.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(w))
    return numbered.groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def compress(df: DataFrame, keys: Sequence[str], number: str, dash: str = "-") -> DataFrame:
    """keys, ranges: distinct whole numbers as "1-3, 5"."""
    w = Window.partitionBy(*keys).orderBy(number)
    island = df.select(*keys, number).distinct().withColumn("_g", F.col(number) - F.row_number().over(w))
    ends = island.groupBy(*keys, "_g").agg(F.min(number).alias("_a"), F.max(number).alias("_b"))
    text = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat(F.col("_a").cast("string"), F.lit(dash), F.col("_b").cast("string")))
    listed = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_a", text.alias("_t")))).alias("_l"))
    return listed.select(*keys, F.array_join(F.transform("_l", lambda x: x["_t"]), ", ").alias("ranges"))


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The last value that is not null up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def fill_both(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Forward fill, then the first later value where none came before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = forward_fill(df, keys, order, value, "_before")
    return filled.withColumn(out, F.coalesce("_before", F.first(value, ignorenulls=True).over(after))).drop("_before")


def carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], pending: str, receiver: str, out: str) -> DataFrame:
    """A flag raised on or before a row goes to the next row that can receive it, once."""
    w = Window.partitionBy(*keys).orderBy(*order)
    done = F.coalesce(F.sum(F.col(receiver).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = df.withColumn("_group", done)
    inside = Window.partitionBy(*keys, "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grouped.withColumn(out, F.col(receiver) & F.max(pending).over(inside)).drop("_group")


def latest_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_left: Column, is_right: Column, value: str, out: str) -> DataFrame:
    """As-of join backward in one pass: each left row with the value of the last right row before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.filter(is_left | is_right).withColumn(out, F.last(F.when(is_right, F.col(value)), ignorenulls=True).over(w)).filter(is_left)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """keys, value, rank: distinct values numbered from 1 in the order of their first row."""
    at = F.min(F.struct(*order)).alias("_at")
    firsts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(at)
    return firsts.select(*keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy("_at")).alias("rank"))


def mode_least(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """The most frequent value, the least of equals."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), value)).alias(out))


def mode_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """The most frequent value, the first seen of equals."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_at"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), "_at")).alias(out))


def weighted_mode(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "mode") -> DataFrame:
    """The value with the largest sum of weights, the largest of equals."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct("_w", value)).alias(out))


def edges(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """keys, left, right: the least start that at least max(2, n/50) rows share, and the (n div 200 + 1)-th largest end."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = df.groupBy(*keys, start).agg(F.count(F.lit(1)).alias("_c")).join(sizes, list(keys))
    left = starts.filter(F.col("_c") >= F.greatest(F.lit(2.0), F.col("_n") / 50)).groupBy(*keys).agg(F.min(start).alias("left"))
    ranked = df.join(sizes, list(keys)).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(end))))
    right = ranked.filter(F.expr("_r = _n div 200 + 1")).select(*keys, F.col(end).alias("right"))
    return sizes.select(*keys).join(left, list(keys), "left").join(right, list(keys), "left")


def coverage(df: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, s, e, covered: the part of each whole interval that the intervals of its key cover."""
    merged = merge_touching(df, keys).select(*keys, F.col("s").alias("_s"), F.col("e").alias("_e"))
    part = F.greatest(F.lit(0), F.least("e", "_e") - F.greatest("s", "_s"))
    return whole.join(merged, list(keys), "left").groupBy(*keys, "s", "e").agg(F.coalesce(F.sum(part), F.lit(0)).alias("covered"))
