import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from foliospark.llm import substring_dedup as S

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """{row place: (n_words, kept words)} of (id, text) rows, by the definition."""
    part = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest()
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows}, key=lambda d: (*d[:2], signed(part(d[2]))))
    seen, out = {}, {}
    for place, doc in enumerate(order):
        w = WORDS.findall(doc[2])
        gone = set()
        for s in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[s : s + window]), (place, s)) != (place, s):
                gone |= set(range(s, s + window))
        out[doc] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return [out[r[0] is not None, r[0] or 0, r[1] or ""] for r in rows]


def check(spark, rows, window=20, **options):
    own = ("key", "part", "cut", "spans", "h", "words", "fp", "_key", "a`b")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS n_words", "monotonically_increasing_id() AS row")
    df = df.select("*", *[F.lit(n).alias(n) for n in own])
    got = sorted(S.remove_repeats(df, window=window, **options).collect(), key=lambda r: r.row)
    assert all(r[n] == n for r in got for n in own)
    for (_, text), r, (n, kept) in zip(rows, got, brute(rows, window), strict=True):
        assert (r.n_words, r.n_removed, WORDS.findall(r.text or "")) == (n, n - len(kept), kept)
        assert r.n_removed or r.text == text


@settings(max_examples=200, deadline=None)
@given(values=st.lists(st.integers(0, 5), min_size=1, max_size=40), n=st.integers(1, 20))
def test_sliding_argmin(values, n):
    got = S.sliding_argmin(np.array(values), n)
    assert got[: max(0, len(values) - n + 1)].tolist() == [i + int(np.argmin(values[i : i + n])) for i in range(len(values) - n + 1)] or len(values) < n


@pytest.mark.parametrize(("seed", "options"), [(1, {"batches": 1}), (2, {"batches": 3}), (3, {"batches": 5, "fanout": 2})])
def test_against_brute_force(spark, seed, options):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 90))] for _ in range(12)]
    for _ in range(40):
        t = list(rng.choice(texts))
        for _ in range(rng.randrange(3)):
            if t:
                t[rng.randrange(len(t))] = f"n{rng.randrange(9)}"
        if rng.random() < 0.4:
            a = rng.randrange(8)
            t[rng.randrange(len(t) + 1) : 0] = passage[a : rng.randrange(18, 31)]
        texts.append(t)
    texts += [["a", "b"] * 30, ["a", "b"] * 25, [str(i) for i in range(20)], [str(i) for i in range(19)], [str(i) for i in range(1, 21)]]
    rng.shuffle(texts)
    rows = [(i * 7 - 50, rng.choice([" ", "\n", "  \t"]).join(t)) for i, t in enumerate(texts)]
    rows += [(None, " ".join(passage)), (None, None), (4000, None), (4001, ""), (4002, " \n "), (4003, rows[5][1]), (4003, rows[5][1]), (4003, "é " * 45), (4004, "x" * 5000)]
    rng.shuffle(rows)
    check(spark, rows, **options)


def mixed(seed, n, first=0):
    """(id, text) rows that quote each other."""
    rng, quoting = random.Random(seed), random.Random(1)
    pool = [[f"q{quoting.randrange(10**6)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(n):
        t = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 60))]
        for _ in range(rng.randrange(3)):
            q, a = rng.choice(pool), rng.randrange(30)
            t[rng.randrange(len(t)) : 0] = q[a : a + rng.randrange(15, 30)]
        rows.append((first + i, " ".join(t)))
    return rows


def test_compaction_runs_in_production(spark, monkeypatch):
    made = []
    compact = S.Index.compact
    monkeypatch.setattr(S.Index, "compact", lambda self: (made.append(len(self.runs)), compact(self)))
    check(spark, mixed(3, 40))
    assert made == [S.FANOUT + 1]


def test_batches_into_a_stored_index(spark):
    batches = [mixed(k, 25, 100 * k) for k in range(5)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = S.Index(spark, fanout=2)
    got = S.remove_repeats(frame(batches[0]), index=index).collect()
    path = index.save()
    for k in range(1, 5):
        index = S.opened(spark, path)
        got += S.remove_later_repeats(frame(batches[k]), frame(sum(batches[:k], [])), index).collect()
        index.save()
    assert len(index.runs) <= 2
    rows = sum(batches, [])
    assert sum(r.n_removed for r in got) > 300
    for r, (n, kept) in zip(sorted(got, key=lambda r: r.doc_id), brute(rows, 20), strict=True):
        assert (r.n_words, WORDS.findall(r.text)) == (n, kept)
    with pytest.raises(ValueError, match="above"):
        index.add(frame(batches[0]).selectExpr("doc_id AS key", "0L AS part", "text"))
    index.drop()


def test_equal_hashes_are_told_apart_by_words(spark, monkeypatch):
    """With fingerprints that all collide, only the words decide."""
    monkeypatch.setattr(S, "windows", lambda hashes, n, seed=0: np.zeros(max(0, len(hashes) - n + 1), np.uint64))
    rows = mixed(7, 12)
    text = lambda r: r[1]
    import pyarrow as pa

    places = []
    for words in map(str.split, map(text, rows)):
        places.append(list(range(max(0, len(words) - S.ANCHOR + 1))))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows)), pa.array([r[1] for r in rows]), pa.array(places, pa.list_(pa.int32()))], names=["key", "part", "text", "places"])
    out = next(S._contexts(20, S.ANCHOR)(iter([batch]))).to_pylist()
    words = {r[0]: r[1].split() for r in rows}
    seen = set()
    for r in sorted(out, key=lambda r: (r["key"], r["pos"])):
        own = (r["pos"] - r["lo"], tuple(words[r["key"]][r["lo"] : r["hi"]]))
        assert r["is_first"] == (own not in seen) and (r["words"] == " ".join(own[1])) == r["is_first"]
        seen.add(own)


def test_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**7)}" for _ in range(300_000))
    check(spark, [(1, long), (2, "start " + long[: len(long) // 2].rpartition(" ")[0] + " end"), (3, "x" * 3_000_000)])


def test_small_windows_and_empty_table(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for i in range(60)]
    check(spark, rows, window=5, anchor=2, batches=2)
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, docs, tmp_path):
    from foliospark.llm.queries import QUERIES

    text = " ".join(f"w{i}" for i in range(25))
    docs([text, "b " + text, None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op5_substring_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == [(0, 25, 0, sha(text)), (1, 26, 25, sha("b")), (2, 0, 0, sha(""))]


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """Where all windows have one hash the words still decide."""
    monkeypatch.setattr(S, "_hashed", lambda words: F.lit(5).cast("long"))
    check(spark, mixed(11, 30))


def test_bounds_of_what_a_task_holds_drop_nothing(spark, monkeypatch):
    """A task sends on what it holds and starts anew; every anchor of every text is an entry, direct ones by their own fingerprint."""
    import pyarrow as pa

    rows = mixed(5, 40)
    batches = [pa.RecordBatch.from_pydict({"key": pa.array([k]), "part": pa.array([0]), "text": pa.array([t])}) for k, t in rows]
    every = lambda: sorted((r["of"] if r["direct"] else r["route"], r["key"], r["pos"]) for b in S._entries(20, S.ANCHOR)(iter(batches)) for r in b.to_pylist())
    whole = every()
    monkeypatch.setattr(S, "HELD", 10)
    assert every() == whole and len({r[0] for r in whole}) < len(whole)


def test_passage_in_more_texts_than_are_cold(spark):
    """One passage with its own words around it in each of many texts, in many runs and compactions."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(700):
        own, a = [f"w{rng.randrange(10**6)}" for _ in range(12)], rng.randrange(15)
        rows.append((i, " ".join(own[:6] + passage[a : a + rng.randrange(19, 26)] + own[6:])))
    check(spark, rows, batches=6, fanout=1)
