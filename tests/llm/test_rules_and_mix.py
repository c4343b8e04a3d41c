import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import mixing as M
from foliospark.llm import quality_rules as Q
from foliospark.llm import sharding as H

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n ", "one two three", "a b c " * 40, "Zeile eins\n" * 9 + "x", "x" * 70_000, "é à #$%\n#$%\n\n#$%", "the cat sat on the cat sat on mats", "\x1cword\x85   next", "SHOUT " * 60]


def measure(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_ledger_against_brute_force(docs):
    df = docs(TEXTS).selectExpr("*", "'mine' AS fail_bits", "1 AS n_words", "'own' AS _n", "'own' AS words", "'own' AS sorted", "'own' AS row")
    judged = Q.apply_policy(Q.ledger(df)).collect()
    base = Q.rule_mask(Q.POLICIES["base"])
    for r in judged:
        n, chars, symbols, dup, repeats = measure(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeats), r.text and r.text[:30]
        assert (r.fail_bits & base != 0) == (n < 50 or 100 * repeats > 50 * n)
        assert r.kept == (r.fail_bits == 0) and r.lang == "en" and {r._n, r.words, r.sorted, r.row} == {"own"}
    assert Q.ledger(df.limit(0)).count() == 0


def test_policies_and_ablations(docs):
    judged = Q.ledger(docs(TEXTS)).cache()
    kept = {p: Q.apply_policy(judged, p).filter("kept").count() for p in Q.POLICIES}
    assert kept["base"] >= kept["v1"]
    rows = judged.collect()
    for r in Q.ablations(judged, "v1").collect():
        bit = Q.rule_mask([r.rule])
        assert r.n_failed == sum(x.fail_bits & bit != 0 for x in rows)
        assert r.n_failed_alone == sum(x.fail_bits == bit for x in rows)
        assert r.n_kept_without == sum(x.fail_bits & ~bit == 0 for x in rows)
        together = 0
        for x in rows:
            together |= x.fail_bits & ~bit if x.fail_bits & bit else 0
        assert r.together == together
    split = Q.ablations(judged.withColumn("half", F.col("doc_id") % 2), "v1", by=["half"]).groupBy("rule").agg(F.sum("n_failed").alias("n")).collect()
    assert {r.rule: r.n for r in split} == {r.rule: r.n_failed for r in Q.ablations(judged, "v1").collect()}
    assert [r.n_failed for r in Q.ablations(judged.limit(0), "base").collect()] == [0, 0]
    good = "many different words stand here " + " ".join(f"word{i}" for i in range(60))
    assert [tuple(r) for r in Q.filter_documents(docs([good, "bad"])).collect()] == [(0, good, "en", "a", len(good))]


def test_replication(spark, docs):
    n = 4000
    texts = ["x" * 10] * n
    sources = ["hot" if i % 3 else ("rare" if i % 2 else "half") for i in range(n)]
    df = docs(texts, sources).withColumnRenamed("lang", "copy").selectExpr("*", "1 AS _source", "2 AS of", "3 AS drawn", "4 AS id")
    got = M.replicate(df, seed=3).collect()
    again = M.replicate(df.repartition(7), seed=3).collect()
    key = lambda r: (r.doc_id, r.copy)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len({key(r) for r in got}) == len(got)
    assert {(r._source, r.of, r.drawn, r.id) for r in got} == {(1, 2, 3, 4)}
    counts = Counter(r.source for r in got)
    assert all(abs(counts[s] - n / 3) < 5 * (n / 3) ** 0.5 for s in ("hot", "rare", "half"))
    assert {r.copy for r in got if r.doc_id == got[0].doc_id} == set(range(1, got[0].n_copies + 1))
    weighed = Counter(r.source for r in M.replicate(df, {"rare": 1.0}, seed=3).collect())
    assert set(weighed) == {"rare"} and abs(weighed["rare"] - n) < 6 * n**0.5


def test_replication_cases(spark):
    rows = [(None, "abc", "s"), (1, None, "s"), (2, "abc", None), (3, "", "empty"), (4, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in M.rates(df).collect()}
    assert rates == {"s": 1.0, None: 1.0, "empty": 0.0}
    assert M.replicate(df.limit(0)).count() == 0 and {r.source for r in M.replicate(df, seed=1).collect()} <= {"s", None}
    big = spark.createDataFrame([(i, "a" * (1000 if i else 1), "b" if i else "a") for i in range(2)], "doc_id long, text string, source string")
    n = M.replicate(big, {"a": 1.0}).count()  # a mean far above one step
    assert abs(n - 1001) < 6 * 1001**0.5


def cumulative(rows):
    """Keys in order with the bytes below each, by a plain sort."""
    below, out = 0, []
    for k, i, n in sorted(rows):
        out.append((k, i, below))
        below += n
    return out, below


@pytest.mark.parametrize("tolerance", [0.0005, 0.2])
def test_shards(spark, docs, tolerance):
    texts = ["same text " * 5] * 300 + [f"text {i} " * (1 + i % 40) for i in range(500)] + [None, "", "z" * 5000, "y" * 300_000]
    df = docs(texts).withColumnRenamed("lang", "slot").selectExpr("*", "1 AS k", "2 AS id", "3 AS _size", "4 AS bucket", "5 AS ahead")
    got = H.shard(df, shards=8, tolerance=tolerance).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert {(r.k, r.id, r._size, r.bucket, r.ahead) for r in got} == {(1, 2, 3, 4, 5)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    key = lambda r: (signed(xxhash.xxh64((r.text or "").encode(), seed=42).intdigest()), r.doc_id)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in got)
    order, total = cumulative([(*key(r), r.size) for r in got])
    shard_of = {key(r): r.shard for r in got}
    shards = [shard_of[k, i] for k, i, _ in order]
    assert shards == sorted(shards)  # shards are ranges of the key
    for j in range(1, 8):  # each splitter is within the tolerance of its target, or as near as a whole row allows
        target, here = total * j / 8, next((below for (k, i, below), s in zip(order, shards, strict=True) if s >= j), total)
        nearest = min(abs(below - target) for below in [*(x[2] for x in order), total])
        assert abs(here - target) <= max(tolerance * total / 8, nearest) + 1e-6
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    again = {r.doc_id: (r.shard, r.slot) for r in H.shard(df.repartition(5), shards=8, tolerance=tolerance).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


def test_shards_by_many_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(H, "ROWS_PER_BUCKET", 3)
    got = H.shard(docs([f"t{i}" for i in range(300)]), shards=4).collect()
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_queries(spark, tmp_path, docs):
    from foliospark.llm.queries import QUERIES

    texts = ["a b " * 60, None, "é", "a b " * 60, "x " * 700]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op10_sharding"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (rows[i].size, rows[i].text_crc32, rows[i].law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
    assert sorted(r.doc_id for r in QUERIES["op9_quality_rules"](spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4]
    assert {r.doc_id for r in QUERIES["op8_source_mixing"](spark, str(tmp_path)).collect()} <= set(range(5))
    assert {r.rule for r in QUERIES["quality_ablations"](spark, str(tmp_path)).collect()} == set(Q.RULES)


def test_shards_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert H.shard(spark.createDataFrame([], schema)).count() == 0
    same = H.shard(spark.createDataFrame([(1, "a")] * 40 + [(None, None)], schema), shards=4).collect()
    assert sorted((r.shard, r.slot) for r in same) == sorted(set((r.shard, r.slot) for r in same)) and len(same) == 41
    one = H.shard(spark.createDataFrame([(-5, "a")], schema)).collect()
    assert one[0].slot == 0
