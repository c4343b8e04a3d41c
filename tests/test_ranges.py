"""Spans and intervals."""

import random

from foliospark.operators import ranges as R


def test_equal_spans_join_no_other_island(spark):
    """Spans with equal ends, which an order by start and end leaves open, stay together, and apart from the island before."""
    rng = random.Random(4)
    spans = [(k, s, s + n) for k in range(300) for s, n in ((rng.randrange(60), rng.randrange(1, 9)) for _ in range(6)) for _ in range(rng.randrange(1, 4))]
    rng.shuffle(spans)
    want = []
    for k, s, e in sorted(set(spans)):
        if want and want[-1][0] == k and s <= want[-1][2]:
            want[-1] = (k, want[-1][1], max(want[-1][2], e))
        else:
            want.append((k, s, e))
    schema = "k int, s int, e int, fmt string"
    a, b = (spark.createDataFrame([(*x, fmt) for x in spans], schema) for fmt in "AR")
    got = R.span_differences(a, b, ["k"]).collect()
    assert sorted((r.k, r.s, r.e) for r in got) == want and {r.change for r in got} == {"A → R"}
