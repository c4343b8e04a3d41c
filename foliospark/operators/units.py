"""Unit streams: the ordered, non-empty paragraphs of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import norm

#: A list marker at the start of a line.
MARKER = r"^((?:[0-9]+|[A-Za-z]|[ivxIVX]+)[.)]|[-*•])\s+\S"


def unit_lists(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, units: the normalised non-empty lines of a text as one array, without a shuffle."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: norm(x))
    return df.select(F.col(id_col).alias("doc_id"), F.filter(lines, lambda x: x != "").alias("units"))


def units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, idx (dense from 0), text."""
    return unit_lists(df, id_col, text_col).select("doc_id", F.posexplode("units").alias("idx", "text"))


def marker(text: Column) -> Column:
    return F.regexp_extract(text, MARKER, 1)


#: An opening tag of a unit, and the text up to the next tag.
HTML_TAGGED = r"(?i)<(p|li|td|th|h1|h2|h3|h4|h5|h6)(?:\s[^>]*)?>([^<]*)"


def html_units(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, idx, tag, text: paragraphs, headings, list items and table cells of a page in order."""
    both = F.arrays_zip(
        F.regexp_extract_all(html_col, F.lit(HTML_TAGGED), F.lit(1)).alias("tag"),
        F.regexp_extract_all(html_col, F.lit(HTML_TAGGED), F.lit(2)).alias("body"),
    )
    cells = F.transform(both, lambda x: F.struct(F.lower(x["tag"]).alias("tag"), norm(x["body"]).alias("text")))
    kept = F.filter(cells, lambda x: x["text"] != "")
    return df.select(F.col(id_col).alias("page_id"), F.posexplode(kept).alias("idx", "unit")).select("page_id", "idx", "unit.tag", "unit.text")

