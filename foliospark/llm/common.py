"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.tables import discard, dropped, fresh_path, passing, shared_dir, tidy, written

__all__ = ["WORD_BREAK", "column", "discard", "dropped", "fresh_path", "hot_join", "packed", "passing", "shared_dir", "table", "tidy", "unpacked", "words", "written"]

#: A word is a maximal run of other characters than these.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: A key with more than one in so many rows is hot: there are at most so many hot keys, whatever the size.
HOT = 500
#: Rows up to which a key is not hot.
COLD = 256
#: Parts that the rows of a hot key are dealt to.
SALTS = 32


def column(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **beside: Column) -> DataFrame:
    """All columns of df as one, ``row``, and the operator's own beside it: no name of df can clash with one of these."""
    return df.select(F.struct(*map(column, df.columns)).alias("row"), *[c.alias(name) for name, c in beside.items()])


def unpacked(df: DataFrame, names: list[str], **made: Column) -> DataFrame:
    """The columns (names) in ``row`` again, with those made in place of others of the same name, else after them."""
    same = {n.lower(): n for n in made}
    kept = [made[same[n.lower()]].alias(n) if n.lower() in same else F.col("row").getField(n).alias(n) for n in names]
    return df.select(*kept, *[c.alias(n) for n, c in made.items() if n.lower() not in {x.lower() for x in names}])


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread: Column, total: int) -> DataFrame:
    """rows joined with keyed (one row a key; ``count``: rows of the key), where hot keys are dealt to many tasks.

    ``total`` is the sum of all counts, so at most ``HOT`` keys are hot: their list is the only broadcast. A hot
    key's row in keyed is repeated for each part, and rows choose theirs by ``spread``. By merge at every size.
    """
    least = max(COLD, total // HOT)
    hot = keyed.filter(F.col(count) > least).select(key, F.lit(True).alias("_hot"))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_part", part).drop("_hot")
    parts = F.when(F.col(count) > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(keyed.withColumn("_part", F.explode(parts)).hint("merge"), [key, "_part"]).drop("_part")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
