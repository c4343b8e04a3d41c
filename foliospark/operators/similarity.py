"""Similarity of paired token lists as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.alignment import common


def token_counts(df: DataFrame, keys: Sequence[str], tokens: Column) -> DataFrame:
    return df.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def upper_bound(pairs: DataFrame, keys: Sequence[str], a: Column, b: Column) -> DataFrame:
    """keys, n_a, n_b, n_both, bound: what lengths and shared tokens let the similarity reach."""
    both = token_counts(pairs, keys, a).withColumnRenamed("n", "na").join(token_counts(pairs, keys, b).withColumnRenamed("n", "nb"), [*keys, "token"])
    shared = both.groupBy(*keys).agg(F.sum(F.least("na", "nb")).alias("n_both"))
    out = pairs.select(*keys, F.size(a).alias("n_a"), F.size(b).alias("n_b")).join(shared, list(keys), "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    most = F.least(F.least("n_a", "n_b").cast("long"), "n_both")
    bound = F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), 1.0).otherwise(2 * most / (F.col("n_a") + F.col("n_b")))
    return out.withColumn("bound", F.round(bound, 6))


def kept(a: Column, b: Column) -> Column:
    """Elements that an alignment of two arrays of strings keeps."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([common(p or [], q or []) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return F.arrow_udf(run, "int")(a, b)


def kept_small(a: Column, b: Column) -> Column:
    """The same inside the JVM, as a fold over rows of the table: for short arrays."""
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def row(last: Column, x: Column) -> Column:
        at = F.transform(b, lambda y, j: F.greatest(F.get(last, j), F.when(y == x, F.get(last, j + 1) + 1).otherwise(F.lit(0))))
        best = F.aggregate(F.reverse(at), F.array(F.lit(0)), lambda acc, v: F.concat(F.array(F.greatest(F.get(acc, F.lit(0)), v)), acc))
        return best

    return F.get(F.aggregate(F.reverse(a), zero, row), F.lit(0))
