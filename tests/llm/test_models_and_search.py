import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import quality as N
from foliospark.llm import topk as K


def brute(rows, k):
    whole = lambda v: [int(np.floor(1024 * float(np.float32(x)))) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize(("dim", "n", "block"), [(8, 700, 4096), (5, 320, 2), (3, 9, 4096)])
def test_search_against_brute_force(spark, monkeypatch, dim, n, block):
    monkeypatch.setattr(K, "QUERY_BLOCK", block)
    rng = random.Random(dim)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]
    hot = rows[5][1]
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows]
    rows += [(100, rows[7][1]), (9001, None), (9002, [None] + [0.5] * (dim - 1)), (9003, [float("nan")] * dim), (9004, [float("inf")] * dim), (None, hot), (9005, hot[:-1]), (9100, hot[:-1]), (9006, hot), (9006, hot)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine")).repartition(5)
    df = df.selectExpr("*", "1 AS id", "2 AS v", "3 AS row", "4 AS place")
    for depth in (10, 48):
        got = sorted(tuple(r) for r in K.search(df, F.col("vec_id") % 100 == 0, k=10, tile=(3, 50), depth=depth).collect())
        assert got == brute(rows, 10)


def test_lists_are_read_down_to_the_cutoff(spark):
    """Phase 2 reads a small part of the lists, and no vector is scored again where the lists are deep enough."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    x = centres[rng.integers(0, 20, 2000)] + 0.3 * rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    vectors = df.select(F.col("vec_id").alias("id"), K.quantized(F.col("embedding")).alias("v")).withColumn("row", F.monotonically_increasing_id())
    block = list(enumerate(df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), K.quantized(F.col("embedding")).alias("v")).collect()))
    found = vectors.mapInArrow(K._gather(K._block(block), 10, 4, 200, K.TILE), K.LIST).cache()
    read = K.collected(found, K.cutoffs(found, 10), 4).select("enough", F.size("taken").alias("n"))
    rows = read.collect()
    assert all(r.enough for r in rows) and len(rows) == 20 * 4 * 4
    assert 20 * 10 <= sum(r.n for r in rows) < 0.1 * 20 * 2000 * 4  # of all partial scores
    stored = found.select(F.sum(F.size("ids"))).first()[0]
    assert sum(r.n for r in rows) < 0.5 * stored


def test_search_of_empty_and_large_numbers(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.search(df, F.col("vec_id") % 100 == 0).count() == 0
    big = spark.createDataFrame([(0, [2.0**15, 1.0]), (1, [2.0**15, -3.0]), (2, [2.0**15 + 0.5, 7.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in K.search(big, F.col("vec_id") == 0).collect()}
    assert got == {1: 2**50 - 3 * 2**20, 2: 2**25 * (2**25 + 512) + 7 * 2**20}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 2
        words = [rng.choice(["river", "stone", "house", "walks", "under", "light"]) + rng.choice("abcdef") for _ in range(60)]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words[:30]) if i % 4 else "spam deal " * 25))
        labels.append((i, good))
    rows += [(500, None), (501, ""), (502, "y" * 200_000)]
    labels += [(1, 0), (7, None), (500, 1), (501, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality(labelled):
    docs, labels = labelled
    model = N.fit(docs, labels.filter("doc_id % 3 <> 0"), sample=60)
    got = {r.doc_id: r for r in N.score(docs.withColumn("score", F.lit("mine")), model).collect()}
    held = [i for i in range(0, 300, 3)]
    assert np.mean([(got[i].score >= 0.5) == (i % 2 == 1) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[500].score == got[501].score
    again = N.fit(docs.repartition(3), labels.filter("doc_id % 3 <> 0"), sample=60)
    assert (again.weight == model.weight).all() and (again.a, again.b) == (model.a, model.b)


def test_quality_without_two_labels(labelled):
    docs, labels = labelled
    assert {r.score for r in N.score(docs, N.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert min(r.score for r in N.score(docs, N.fit(docs, labels.filter("quality = 1 AND doc_id > 10"))).collect()) > 0.99
    assert N.score(docs.limit(0), N.train([], [])).count() == 0


def test_quality_with_clashing_columns_and_ids_of_text(labelled):
    docs, labels = labelled
    plain = N.fit(docs, labels, sample=40)
    odd = N.fit(docs.selectExpr("cast(doc_id as string) AS doc_id", "text", "1 AS _id", "2 AS id", "3 AS y", "4 AS _y"), labels.selectExpr("*", "5 AS id", "6 AS y"), sample=40)
    assert (odd.weight == plain.weight).all()


def test_quality_query(spark, labelled, tmp_path):
    from foliospark.llm.queries import QUERIES

    docs, labels = labelled
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op2_quality_classifier"](spark, str(tmp_path)).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert len(got) == 303 and all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(unseen) > 30 and np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in unseen]) > 0.95


def test_descent_solves_the_hinge_loss():
    """The weights are those that projected gradient steps on the dual of the same problem arrive at."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(30)]
    y = np.where(np.arange(30) % 3 > 0, 1, -1)
    rows = [np.unique(np.append(r, 50 if s > 0 else 51)) if i % 4 else r for i, (r, s) in enumerate(zip(rows, y, strict=True))]
    model = N._descend(rows, y)
    x = np.zeros((30, 61))
    for i, r in enumerate(rows):
        x[i, r] = model.scale[r] / np.linalg.norm(model.scale[r])
    x[:, 60] = 1  # the bias
    z = x * y[:, None]
    cost = np.where(y > 0, 30 / (2 * (y > 0).sum()), 30 / (2 * (y < 0).sum())) * N.COST
    alpha, step = np.zeros(30), 1 / np.linalg.norm(z @ z.T, 2)
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (z @ (z.T @ alpha) - 1), 0, cost)
    primal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - z @ w)).sum()
    best = primal(z.T @ alpha)
    own = primal(np.append(model.weight[:60], model.bias))
    assert best - 1e-9 <= own <= 1.01 * best


def test_scaling_and_descent():
    rows = [np.array([1, 2]), np.array([2, 3]), np.array([4, 2]), np.array([4, 5])]
    model = N.train(rows, [1, 1, 0, 0])
    assert model.margin(rows[0]) > 0 > model.margin(rows[3]) and model.scale[1] > 0 > model.scale[4] and model.scale[9] == 0
