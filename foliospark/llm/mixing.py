"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: the copies its documents need on average for its part of the mix
to equal its target weight, at the size of the input. A document's copies follow a Poisson distribution
with that mean, inverted at a number in [0, 1) that a seeded hash of its id gives, so a rerun, a lost
executor or another partitioning makes the same copies. Copies are then dealt out by a hash of id and
copy, and ordered by it: a global shuffle.

Means above ``STEP`` are the sum of equal independent parts, so that no probability underflows. Sources
are broadcast only up to ``MAX_BROADCAST_SOURCES``; beyond it Spark joins by key and splits hot ones.

Defined cases: a null source is a source of its own; a source without a weight has weight 0 when
weights are given; a source without any character gets rate 0; a null text has no characters; rows
that repeat an id get equal copies; a very long text is one row like any other, and weighs by its length;
an empty table gives an empty table; the columns n_copies, copy, rate and shuffle_key replace input columns
of the same name, and no other column is touched, whatever its name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import column, packed, unpacked, written

STEP = 32.0
#: Terms of a distribution function with a mean up to STEP; the rest is below 2**-53.
TERMS = 140
MAX_BROADCAST_SOURCES = 20_000
HEX = 13


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of an MD5 over the parts."""
    text = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.conv(F.substring(text, 1, HEX), 16, 10).cast("double") / F.lit(float(1 << 4 * HEX))


def rates(df: DataFrame, weights: Mapping[str, float] | None = None, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: source, chars, rate, and the steps and distribution function (cdf) that copies are drawn by."""
    spark = df.sparkSession
    sizes = df.select(column(source_col).alias("source"), F.length(column(text_col)).alias("n")).groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, given double")
        weighed = sizes.join(given, F.col("source").cast("string").eqNullSafe(F.col("name")), "left").select("source", "chars", F.when(F.col("chars") > 0, F.coalesce("given", F.lit(0.0))).otherwise(F.lit(0.0)).alias("weight"))
    whole = weighed.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))  # one row
    out = weighed.join(F.broadcast(whole), F.lit(True)).withColumn(
        "rate", F.when((F.col("chars") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars")).otherwise(F.lit(0.0))
    )
    out = out.withColumn("steps", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")).withColumn("mean", F.col("rate") / F.col("steps"))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def term(a: Column, k: Column) -> Column:
        p = a["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, term, lambda a: a["cdf"])
    return out.select("source", "chars", "rate", "steps", cdf.alias("cdf"))


def replicate(df: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows as often as drawn (columns rate, n_copies, copy from 1, shuffle_key added), in a global random order."""
    by_source = written(rates(df, weights, text_col, source_col).withColumnRenamed("source", "of"), "rates")
    if by_source.count() <= MAX_BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    rows = packed(df, id=column(id_col), source=column(source_col))
    joined = rows.join(by_source, F.col("source").eqNullSafe(F.col("of")))
    joined = joined.withColumn("drawn", F.transform(F.sequence(F.lit(1), F.col("steps")), lambda s: uniform(F.lit(seed), F.col("id"), s)))
    n = F.aggregate("drawn", F.lit(0), lambda a, u: a + F.size(F.filter("cdf", lambda c: c <= u)))
    out = joined.select("row", "id", "rate", n.alias("n")).filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("copy"), F.lit("order")).cast("binary"))
    out = out.withColumn("key", key).repartition(F.col("key")).sortWithinPartitions("key")
    return unpacked(out, df.columns, rate=F.col("rate"), n_copies=F.col("n"), copy=F.col("copy"), shuffle_key=F.col("key"))
