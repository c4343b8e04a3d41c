"""Token ids in patched frame-of-reference blocks.

A token table is a Parquet folder of chunks in ascending order of the key. A chunk holds the ids of
whole documents, one after another, in blocks of ``BLOCK`` ids:

    block  := minimum u32 | width u8 | exceptions u16 | ids u16 | packed | exceptions x (place u16, delta u32)
    packed := ids x width bits, least significant bit first, padded to a byte

A block subtracts its minimum, packs the differences at the width of a chosen percentile and stores
what is wider in its exception list (the packed field then holds the low bits). Columns: segment and
chunk (the order), ahead (ids of the segment before the chunk), n_tokens, keys and counts (per document), block_at (byte start of each block, so
that a reader can seek), payload. Chunks are rows, so a chunk is whole or absent, and Spark's commit
protocol decides which files count when an executor is lost.

Every text is encoded whole, by the tokenizers library, with the tokenizer as its file defines it: strings
of special tokens in a text become those tokens if the file says so.

Defined cases: a null text is an empty text, whose ids are the end id alone; rows with equal keys follow a
hash of their texts and then the texts, and each row counts; null keys come first; an empty table gives no chunk and reads
back as no row; extra input columns, whatever their names, are not stored. A very long text is encoded alone; what the library
needs for it is in proportion to it (about 50 bytes a byte of text), and its ids may fill more than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import column, fresh_path, passing, tidy

BLOCK = 1024
PERCENTILE = 0.9
CHUNK_TOKENS = 1 << 19
#: Characters of texts that are encoded together.
TOGETHER = 1 << 18
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("n_exceptions", "<u2"), ("n", "<u2")])
EXCEPTION = np.dtype([("place", "<u2"), ("delta", "<u4")])

CHUNK = "segment int, chunk int, ahead long, n_tokens long, keys array<long>, counts array<int>, block_at array<int>, payload binary"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, each packed at width bits into whole bytes."""
    if not width:
        return np.empty((len(values), 0), np.uint8)
    size = 16 if width <= 16 else 32
    raw = np.ascontiguousarray(values, f"<u{size // 8}").view(np.uint8)
    bits = np.unpackbits(raw.reshape(-1, size // 8), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first n values of each row of packed bytes: each is cut out of the bytes that it lies in."""
    if not width:
        return np.zeros((len(packed), n), np.uint32)
    at = np.arange(n) * width
    first, shift = at >> 3, at & 7
    near = (width + 14) // 8
    kind = np.uint32 if near <= 4 else np.uint64
    wide = np.zeros((len(packed), packed.shape[1] + near), np.uint8)
    wide[:, : packed.shape[1]] = packed
    out = np.zeros((len(packed), n), kind)
    for k in range(near):
        out |= wide[:, first + k].astype(kind) << kind(8 * k)
    return (out >> shift.astype(kind) & kind((1 << width) - 1)).astype(np.uint32)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each number below 2**32."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, list[int]]:
    """The payload of ids (below 2**32) and the byte start of each block."""
    n = len(ids)
    if not n:
        return b"", []
    ids = ids.astype(np.uint32)
    rows = np.append(ids, np.full(-n % block, ids[-1], np.uint32)).reshape(-1, block)
    low = rows.min(axis=1)
    delta = rows - low[:, None]
    at = min(block - 1, int(percentile * block))
    width = _bits(np.partition(delta, at, axis=1)[:, at])
    count = np.full(len(rows), block)
    count[-1] = n - (len(rows) - 1) * block
    parts: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        of = np.nonzero(width == w)[0]
        packed = _pack(delta[of], int(w))
        over = delta[of] >= np.uint64(1) << np.uint64(w)
        for k, i in enumerate(of):
            here = np.nonzero(over[k, : count[i]])[0]
            out = np.empty(len(here), EXCEPTION)
            out["place"], out["delta"] = here, delta[i, here]
            head = np.array([(low[i], w, len(here), count[i])], HEAD)
            parts[i] = head.tobytes() + packed[k, : (int(count[i]) * int(w) + 7) // 8].tobytes() + out.tobytes()
    return b"".join(parts), [0, *accumulate(map(len, parts))][:-1]


def unpack_blocks(payload: bytes, block_at: list[int], block: int = BLOCK) -> np.ndarray:
    """All ids of a payload (uint32)."""
    if not block_at:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    heads = np.concatenate([np.frombuffer(payload, HEAD, 1, at) for at in block_at])
    out = np.zeros((len(block_at), block), np.uint32)
    starts = np.array(block_at) + HEAD.itemsize
    for w in np.unique(heads["width"]):
        for n in np.unique(heads["n"][heads["width"] == w]):
            of = np.nonzero((heads["width"] == w) & (heads["n"] == n))[0]
            size = (int(n) * int(w) + 7) // 8
            packed = raw[starts[of][:, None] + np.arange(size)]
            out[of, : int(n)] = _unpack(packed, int(w), int(n))
    for i in np.nonzero(heads["n_exceptions"])[0]:
        at = int(starts[i]) + (int(heads["n"][i]) * int(heads["width"][i]) + 7) // 8
        wide = np.frombuffer(payload, EXCEPTION, int(heads["n_exceptions"][i]), at)
        out[i, wide["place"]] = wide["delta"]
    out += heads["low"][:, None]
    return out.reshape(-1)[: int(heads["n"].astype(np.int64).sum())]


def read_block(payload: bytes, block_at: list[int], i: int, block: int = BLOCK) -> np.ndarray:
    """The ids of block i alone."""
    end = block_at[i + 1] if i + 1 < len(block_at) else len(payload)
    return unpack_blocks(payload[block_at[i] : end], [0], block)


@lru_cache(1)
def tokenizer_of(definition: str):
    """The worker's tokenizer."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def encoded(tokenizer, texts: list[str], together: int = TOGETHER) -> Iterator[np.ndarray]:
    """The ids of each text, in order, a few texts at a time."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= together):
            size, j = size + len(texts[j]), j + 1
        for e in tokenizer.encode_batch(texts[i:j], add_special_tokens=False):
            yield np.array(e.ids, "<u4")
        i = j


def write_tokens(df: DataFrame, tokenizer_path: str, path: str, key_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, block: int = BLOCK, percentile: float = PERCENTILE, chunk_tokens: int = CHUNK_TOKENS) -> None:
    """Encode every text and write the token table at path, in ascending order of the key."""
    spark = df.sparkSession
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(column(key_col).cast("long").alias("key"), F.coalesce(column(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "key", "h").sortWithinPartitions("key", "h", "text").select("key", "text", F.spark_partition_id().alias("segment"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(definition)
        end = np.array([] if end_id is None else [end_id], "<u4")
        keys, counts, ids, size, ahead, chunk, segment = [], [], [], 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload, at = pack_blocks(np.concatenate(ids) if ids else np.empty(0, "<u4"), block, percentile)
            values = (segment, chunk, ahead, size, keys, counts, at, payload)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            names = ("segment", "chunk", "ahead", "n_tokens", "keys", "counts", "block_at", "payload")
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=list(names))

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for key, segment, got in zip(batch.column("key").to_pylist(), batch.column("segment").to_pylist(), encoded(tokenizer, texts), strict=True):
                ids += [got, end]
                keys.append(key)
                counts.append(len(got) + len(end))
                size += counts[-1]
                if size >= chunk_tokens:
                    yield flush()
                    keys, counts, ids, size, ahead, chunk = [], [], [], 0, ahead + size, chunk + 1
        if keys:
            yield flush()

    with tidy(spark):
        ordered.mapInArrow(pack, CHUNK).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """One row per document of a token table: key, start (ids before it), n_tokens, ids_le (u32, little-endian)."""
    chunks = spark.read.schema(CHUNK).parquet(path)
    # One number a segment: as many as the write had tasks, whatever the rows.
    totals = chunks.groupBy("segment").agg(F.sum("n_tokens").alias("n")).orderBy("segment").collect()
    before = list(zip((r.segment for r in totals), accumulate((r.n for r in totals), initial=0), strict=False))
    starts = spark.createDataFrame(before, "segment int, segment_start long")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack_blocks(row["payload"], row["block_at"], block).astype("<u4").tobytes()
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                offsets = pa.array(np.append(0, 4 * ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), row["segment"], np.int32)),
                        pa.array(row["keys"], pa.int64()),
                        pa.array(row["ahead"] + ends - counts),
                        pa.array(counts),
                        pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets.buffers()[1], pa.py_buffer(raw)]),
                    ],
                    names=["segment", "key", "place", "n_tokens", "ids_le"],
                )

    docs = chunks.mapInArrow(unpack, "segment int, key long, place long, n_tokens long, ids_le binary")
    return docs.join(F.broadcast(starts), "segment").select("key", (F.col("segment_start") + F.col("place")).alias("start"), "n_tokens", "ids_le")


def tokens(df: DataFrame, tokenizer_path: str, key_col: str = "doc_id", **options) -> DataFrame:
    """Write the token table of df into the shared folder and read it back: key_col, start, n_tokens, ids_le."""
    path = fresh_path(df.sparkSession, "tokens")
    write_tokens(df, tokenizer_path, path, key_col, **options)
    passing(df.sparkSession, path)
    return read_tokens(df.sparkSession, path).withColumnRenamed("key", key_col)
