import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliospark.llm import byte_bpe, token_files

ODD_TEXTS = [None, "", " ", "a  b   c\n\n d", "Straße ÅNGSTRÖM é  x\x1cy\x85z", "<|endoftext|> it's 12345", "x" * 3000, "日本語 テキスト   a", "tail  ", "퟿\U0001f600 ok"]
TEXT = st.text(st.sampled_from(list("ab 1'.,\n\t é́ßΣ\x1c|<>")), max_size=60)


@pytest.fixture(scope="module")
def encoding():
    return byte_bpe.encoder(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(text=TEXT, size=st.integers(1, 9))
def test_cut_texts_have_the_ids_of_the_whole(encoding, text, size):
    assert "".join(byte_bpe.pieces(text, size)) == text
    assert byte_bpe.encode_text(encoding, text, size) == encoding.encode_ordinary(text)


def test_encode_decode(spark, docs, encoding):
    df = docs([*ODD_TEXTS, "word. " * 30_000]).selectExpr("*", "'mine' AS ids", "1 AS _bpe", "2 AS row", "3 AS made")
    got = byte_bpe.encode_decode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(ODD_TEXTS) + 1 and {(r._bpe, r.row, r.made) for r in got} == {(1, 2, 3)}
    for r in got:
        assert r.ids == encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode_decode(df.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=80), block=st.integers(1, 20), percentile=st.floats(0, 1))
def test_blocks_round_trip(ids, block, percentile):
    payload, at = token_files.pack_blocks(np.array(ids, np.uint32), block, percentile)
    assert token_files.unpack_blocks(payload, at, block).tolist() == ids
    for i in range(len(at)):
        assert token_files.read_block(payload, at, i, block).tolist() == ids[i * block : (i + 1) * block]


def test_token_table(spark, docs):
    """Whole texts, by the tokenizer as its file defines it: strings of special tokens are those tokens."""
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [*ODD_TEXTS, "many words here " * 50, "many words here " * 50, "a <|startoftext|> b", "x<|endoftext|>", "word " * 60_000, "z" * 100_000]
    assert 49406 in tokenizer.encode(texts[-4], add_special_tokens=False).ids
    df = docs(texts).orderBy("text").withColumnRenamed("lang", "start").withColumnsRenamed({"source": "h", "n_chars": "segment"})
    got = {r.doc_id: r for r in token_files.tokens(df, path, chunk_tokens=40).collect()}
    before = 0
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens) == (before, len(ids))
        assert bytes(got[i].ids_le) == np.array(ids, "<u4").tobytes()
        before += len(ids)
    assert token_files.tokens(df.limit(0), path).count() == 0


def test_rows_with_equal_keys(spark):
    path = P.path("word_bpe_49k.json")
    rows = [(None, "first"), (5, "b"), (5, "a"), (5, "a"), (5, None), (4, "x y")]
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect())
    assert [x[1] for x in got] == [None, 4, 5, 5, 5, 5] and sorted(x[2] for x in got[2:]) == [1, 2, 2, 2]
    assert [x[0] for x in got] == [sum(y[2] for y in got[:i]) for i in range(6)]


def test_queries_digest_the_real_outputs(spark, tmp_path, docs, encoding):
    from foliospark.llm.queries import QUERIES

    docs(["one two", None]).write.parquet(f"{tmp_path}/documents.parquet")
    r = QUERIES["op7_byte_bpe"](spark, str(tmp_path)).orderBy("doc_id").collect()
    ids = encoding.encode_ordinary("one two")
    assert (r[0].n_tokens, r[0].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert r[0].decoded_sha256 == hashlib.sha256(b"one two").hexdigest() and r[1].n_tokens == 0 and r[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    r = QUERIES["op4_token_files"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (r[1].n_tokens, r[1].ids_crc32) == (1, zlib.crc32(np.array([2], "<u4").tobytes()))
