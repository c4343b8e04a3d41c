"""Text functions as columns."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T

SIGNED = {
    "Chapter 9": "chapter #", "Chapter 10": "chapter #", "Page 3 of 12": "#", "page iv": "#", "xii": "#", "MMXIX": "#", "- 7 -": "#", "12/40": "#", "iiii": "iiii", "civil": "civil",
    "vivid": "vivid", "(3)": "(#)", "[3]": "[#]", "pagex": "#", "page": "page", "": "", "cd of x": "#", "٣": "#",
}


@pytest.mark.parametrize("normalized", [False, True])
def test_signatures(spark, normalized):
    df = spark.createDataFrame(list(SIGNED.items()), "text string, want string")
    got = df.select("text", "want", T.signature(F.col("text"), normalized).alias("got")).collect()
    assert [(r.text, r.got) for r in got] == [(r.text, r.want) for r in got]
