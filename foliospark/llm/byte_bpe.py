"""Byte-level BPE encoding and raw-byte decoding with a local rank file.

The rank file is read once by the driver (its size is fixed by the vocabulary) and sent to the
executors with the function, so executors need no local copy. Long texts are cut at places where the
split pattern must end a match whatever surrounds it, so that no regex or merge runs over an unbounded
string; the ids are those of the whole text.

Defined cases: a null text is an empty text and has no ids; special tokens are ordinary text; repeated
rows are encoded alike, each by itself; a very long text is encoded piece by piece, and only one without
a space after a character is one piece; an empty table gives an empty table; the output columns replace
input columns of the same name, and no other column is touched, whatever its name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import column, packed, unpacked

#: Characters in a piece of a long text, before the search for the next safe boundary.
PIECE = 50_000
#: A space after a character that is no white space begins a match of the pattern, or a run of white
#: space that begins one: nothing before it can reach over it, and nothing after it looks back.
SAFE = re.compile(r"(?<=\S)(?= )")

ENCODED = "struct<ids:array<int>,decoded:binary>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in order, cut at safe boundaries only, each piece about size characters where the text allows it."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(encoding, text: str, size: int = PIECE) -> list[int]:
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    return [i for piece in pieces(text, size) for i in encoding.encode_ordinary(piece)]


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with the token ids (array<int>) of each text and the bytes that those ids decode to."""
    ranks = read_ranks(ranks_path)

    @F.arrow_udf(ENCODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        encoding = encoder(ranks, pattern)
        for batch in batches:
            flat, ends, raw = [], [0], []
            for text in batch.to_pylist():
                ids = encode_text(encoding, text or "")
                raw.append(encoding.decode_bytes(ids))
                flat.append(np.array(ids, dtype=np.int32))
                ends.append(ends[-1] + len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
            yield pa.StructArray.from_arrays([lists, pa.array(raw, pa.binary())], names=["ids", "decoded"])

    made = packed(df, text=column(text_col)).select("row", run("text").alias("made"))
    return unpacked(made, df.columns, **{ids_col: F.col("made.ids"), decoded_col: F.col("made.decoded")})
