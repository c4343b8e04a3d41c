"""Files of either kind as one table: Word documents and PDFs, told by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.functions.text import signature
from foliospark.sources import docx, pdf
from foliospark.tables import written

UNKNOWN = "not a Word document or a PDF"
MIXED = "a Word document and a PDF are not compared"


def _unit(text: Column, kind: StructType) -> Column:
    """A unit of plain body text: what a PDF tells of a paragraph."""
    known = {"text": text, "marker": F.lit(""), "stream": F.lit("body")}
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])


def parse(files: DataFrame) -> DataFrame:
    """path, modificationTime, kind, saved, n_revisions, error, units, comments of each file.

    ``files`` holds path, modificationTime and content. A file of neither kind, or a damaged one, is a row with
    an error and no units. The pages of PDFs are written once, since headers, tables and paragraphs read them.
    """
    told = files.select("path", "modificationTime", F.coalesce("content", F.lit(b"")).alias("content")).withColumn("_kind", docx.kind_of(F.col("content")))
    word = docx.parse(told.filter("_kind = 'docx'").drop("_kind"))
    columns = word.columns
    pages = written(pdf.parse(told.filter("_kind = 'pdf'").drop("_kind")), "pdf-pages")
    types = {f.name: f.dataType for f in word.schema.fields}
    lists = pdf.unit_lists(pages, signature(F.col("text"))).select("path", F.transform("units", lambda t: _unit(t, types["units"].elementType)).alias("units"))
    blank = lambda c: F.lit(None).cast(types[c]).alias(c)
    paper = pages.select("path", "modificationTime", "error").join(lists, "path", "left").withColumn("kind", F.lit("pdf"))
    paper = paper.select(*[F.col(c).cast(types[c]).alias(c) if c in paper.columns else blank(c) for c in columns])
    other = told.filter("_kind IS NULL").select("path", "modificationTime", F.lit(UNKNOWN).alias("error"))
    other = other.select(*[F.col(c) if c in other.columns else blank(c) for c in columns])
    return word.unionByName(paper).unionByName(other)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path, of either kind."""
    return parse(spark.read.format("binaryFile").load(path))


def paired(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """a, b, error, units_a, units_b: pairs of paths with their units; a pair of two kinds, or with an unread file, has an error."""
    side = lambda s: files.select(F.col("path").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("kind", "error", "units")])
    both = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    missing = lambda s: F.when(F.col(f"units_{s}").isNull(), F.coalesce(f"error_{s}", F.lit("no such file")))
    error = F.coalesce("error_a", "error_b", missing("a"), missing("b"), F.when(F.col("kind_a") != F.col("kind_b"), F.lit(MIXED)))
    return both.select("a", "b", error.alias("error"), "units_a", "units_b")
