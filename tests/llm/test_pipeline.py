import random
import re
from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from foliospark.llm import byte_bpe, mixing, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(8)
    words = lambda n, tag: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    passage = " ".join(words(60, "pass"))
    texts = {}
    for i in range(40):
        texts[i] = " ".join(words(120, "w"))
    texts[40] = texts[3]  # an exact copy
    near = texts[5].split()
    near[50] = "changed"
    texts[41] = " ".join(near)
    texts[42] = passage + " " + " ".join(words(80, "x"))
    texts[43] = " ".join(words(80, "y")) + " " + passage
    texts[44] = "too short"
    texts[45] = "spam and more spam " * 60
    texts[46] = " ".join(f"LOUD{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(100))
    texts[47], texts[48] = None, ""
    rows = [(i, t, "en", ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in texts.items()]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, str(path))
        kept.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out.append((name, docs, {} if "text" not in docs.columns else {r.doc_id: r.text for r in docs.collect()}))
    return texts, out, str(path)


def test_columns(stages):
    _, out, _ = stages
    assert [name for name, _, _ in out] == ["quality_rules", "near_duplicates", "repeated_passages", "source_weights", "token_ids"]
    for _, docs, _ in out[:-1]:
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_decisions(stages):
    texts, out, _ = stages
    quality, near, cut = (x[2] for x in out[:3])
    assert set(texts) - set(quality) == {44, 45, 46, 47, 48}
    assert set(quality) - set(near) == {40, 41}
    assert cut[42] == texts[42] and WORDS.findall(cut[43]) == texts[43].split()[:80]
    assert all(cut[i] == texts[i] for i in near if i != 43)
    assert next(r.n_chars for r in out[2][1].collect() if r.doc_id == 43) == len(cut[43])


def test_mix_and_tokens(spark, stages):
    _, out, _ = stages
    cut, mixed, ids = out[2], out[3], out[4]
    wanted = Counter(r.doc_id for r in mixing.replicate(cut[1], seed=corpus_pipeline.MIX_SEED).collect())
    assert Counter(r.doc_id for r in mixed[1].collect()) == wanted
    encoding = byte_bpe.encoder(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    rows = ids[1].collect()
    assert Counter(r.doc_id for r in rows) == wanted and all(r.round_trip for r in rows)
    assert all(r.ids == encoding.encode_ordinary(cut[2][r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_run(spark, stages):
    _, out, path = stages
    assert corpus_pipeline.run(spark, path).count() == out[4][1].count()
    assert substring_dedup.WINDOW == 20


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_stages_with_nulls_repeats_and_more_columns(spark):
    text = " ".join(f"word{i}" for i in range(70))
    rows = [(1, text, None, None, None, 5, "mine"), (1, text, None, None, None, 5, "mine"), (None, text + " end", None, "s", None, 6, "mine"), (2, None, "en", "s", 0, 7, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_words int, spans string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert all(r.spans in ("mine", None) for r in out.collect())
    kept = {name: stage(spark, docs, "").count() for name, stage in corpus_pipeline.STAGES[:3]}
    assert kept == {"quality_rules": 3, "near_duplicates": 3, "repeated_passages": 4}
