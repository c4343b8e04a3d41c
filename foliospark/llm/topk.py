"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's score is the sum of its partial scores on m blocks of dimensions. Each partition of the
vectors holds a score list per query and block: its best ``DEPTH`` entries by partial score, in descending
order, each with the vector's whole score, and the partial score from which on entries were left out.

1. One pass over the vectors makes the lists and writes them. From the k best whole scores that stand in
   them comes a lower bound t of the k-th best score, and from t the cutoff t / m, the same for every
   block, which is broadcast. An entry below it in every list has a score below t, whatever the signs.
2. The lists are read down to the cutoff, and no further: those entries are the candidates. Vectors are not
   read again.
3. What remains are queries with a list that was left out from above the cutoff. Only for these the
   vectors are scored once more, and entries that reach t are kept. The k best of all are the answer.

Queries are taken in blocks of a fixed number of vectors (and of bytes), so what is broadcast has a
fixed bound; each block meets all vectors. Nothing holds all pairs: scores are made tile by tile.
Whole scores below t are dropped and those equal to it stay, so ties go to the smaller id exactly.

Defined cases: components are floor(1024 * x); a vector that is null, or holds a null or a non-finite
component, takes no part; a query meets only vectors of its own dimension; a query id in several rows
asks once, with the least of their vectors, and meets no row of its own id; a candidate id in several
rows counts as several candidates; a vector without components scores 0; null ids take no part; fewer
than k candidates are all returned; an empty table gives no row; other columns are ignored, whatever their
names. A very long vector needs memory for a tile of such. Scores must fit a long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import column, dropped, written

SCALE = 1024
LISTS = 4
#: Entries of a score list. A query that needs more of one is scored again, so it decides work, never results.
DEPTH = 48
#: Groups that a query's lists are gathered in first, so that no task gets those of all partitions.
GROUPS = 64
QUERY_BLOCK = 4096
QUERY_BYTES = 32 << 20
#: Queries and vectors whose scores are held at once.
TILE = (256, 4096)
#: Whole numbers below this are exact as doubles, and so are their small multiples.
EXACT = 2**48


def quantized(vector: Column) -> Column:
    """floor(1024 * x) of each component as longs; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def _matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, ids, rows of whole numbers, their places) for each dimension in a batch."""
    ids = np.asarray(ids)
    offsets, flat = np.asarray(vectors.offsets), np.asarray(vectors.values)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        of = np.nonzero(lengths == d)[0]
        yield int(d), ids[of], flat[offsets[of][:, None] + np.arange(d)].astype(np.int64), of


def _numbers(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where every sum is exact in them, else as whole numbers of any size."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT:
        return q.astype(np.float64), x.astype(np.float64)
    return (q.astype(object), x.astype(object)) if q.size and x.size else (q, x)


def _tiles(queries: tuple[np.ndarray, np.ndarray, list[int]], ids: np.ndarray, rows: np.ndarray, lists: int, tile: tuple[int, int]):
    """(first query, first row, partial scores of each block, places of a query's own id) of each tile."""
    q_ids, q_all, _ = queries
    q_all, rows = _numbers(q_all, rows)
    cuts = np.linspace(0, rows.shape[1], lists + 1).astype(int)
    for q0 in range(0, len(q_ids), tile[0]):
        q = q_all[q0 : q0 + tile[0]]
        for x0 in range(0, len(ids), tile[1]):
            x = rows[x0 : x0 + tile[1]]
            parts = [q[:, a:b] @ x[:, a:b].T if b > a else np.zeros((len(q), len(x)), q.dtype) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield q0, x0, parts, q_ids[q0 : q0 + tile[0], None] == ids[None, x0 : x0 + tile[1]]


class _Lists:
    """The score lists of some queries over the rows of a partition seen so far."""

    def __init__(self, n: int, lists: int, depth: int) -> None:
        self.depth, self.seen = depth, 0
        # Of each block: query, partial score, whole score, row and id of the entries, by query and descending partial score.
        self.held: list[tuple[np.ndarray, ...] | None] = [None] * lists
        self.least: list[np.ndarray | None] = [None] * lists  # the last partial score of a full list
        self.cut = np.zeros((lists, n), bool)  # whether entries were left out

    def add(self, parts: list[np.ndarray], own: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        whole = sum(parts)
        for j, part in enumerate(parts):
            wanted = ~own
            if self.least[j] is not None:
                above = part > self.least[j][:, None]
                self.cut[j] |= (wanted & ~above).any(axis=1)
                wanted &= above
            q, x = np.nonzero(wanted)
            new = (q, part[q, x], whole[q, x], rows[x], ids[x])
            if self.held[j] is not None:
                new = tuple(np.concatenate(pair) for pair in zip(self.held[j], new, strict=True))
            order = np.lexsort((new[3], -new[1], new[0]))
            q = new[0][order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < self.depth
            self.cut[j][q[~keep]] = True
            self.held[j] = new = tuple(c[order][keep] for c in new)
            full = place[keep] == self.depth - 1
            least = np.full(len(own), -np.inf) if part.dtype != object else np.full(len(own), -(2**200), object)
            least[new[0][full]] = new[1][full]
            self.least[j] = least

    def rows(self, places: list[int], k: int) -> Iterator[tuple]:
        """place, block, last partial where entries were left out, partials, scores, rows, ids, and with block 0 the k best scores."""
        for i, place in enumerate(places):
            best: dict[int, int] = {}
            for q, _, whole, row, _ in self.held:
                a, b = np.searchsorted(q, [i, i + 1])
                best.update(zip(row[a:b].tolist(), whole[a:b].tolist(), strict=True))
            top = sorted(map(int, best.values()), reverse=True)[:k]
            for j, (q, part, whole, row, ids) in enumerate(self.held):
                a, b = np.searchsorted(q, [i, i + 1])
                # All that was left out is at most the last entry's partial score.
                last = int(part[b - 1]) if self.cut[j][i] else None
                yield place, j, last, [int(x) for x in part[a:b]], [int(x) for x in whole[a:b]], row[a:b].tolist(), ids[a:b].tolist(), top if j == 0 else []


LIST = "place long, block int, last long, partials array<long>, scores array<long>, rows array<long>, ids array<long>, best array<long>"
_LONGS = pa.list_(pa.int64())
_LIST = pa.schema([("place", pa.int64()), ("block", pa.int32()), ("last", pa.int64()), ("partials", _LONGS), ("scores", _LONGS), ("rows", _LONGS), ("ids", _LONGS), ("best", _LONGS)])


def _gather(queries: dict[int, tuple], k: int, lists: int, depth: int, tile: tuple[int, int]):
    """Phase 1 in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], _Lists] = {}
        for batch in batches:
            places = np.asarray(batch.column(2))
            for d, ids, rows, at in _matrices(batch.column(0), batch.column(1)):
                if d not in queries:
                    continue
                for q0, x0, parts, own in _tiles(queries[d], ids, rows, lists, tile):
                    here = slice(x0, x0 + own.shape[1])
                    made.setdefault((d, q0), _Lists(len(own), lists, depth)).add(parts, own, ids[here], places[at][here])
        for (d, q0), found in made.items():
            out = list(found.rows(queries[d][2][q0 : q0 + tile[0]], k))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LIST, strict=True)], schema=_LIST)

    return run


def _rescore(queries: dict[int, tuple], least: dict[int, int | None], k: int, lists: int, tile: tuple[int, int]):
    """Phase 3 in a partition: the k best of each query, of the entries that reach its lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for d, ids, rows, _ in _matrices(batch.column(0), batch.column(1)):
                if d not in queries:
                    continue
                for q0, x0, parts, own in _tiles(queries[d], ids, rows, lists, tile):
                    whole = sum(parts)
                    bound = np.array([-(2**62) if least[p] is None else least[p] for p in queries[d][2][q0 : q0 + tile[0]]], whole.dtype)
                    q, x = np.nonzero((whole >= bound[:, None]) & ~own)
                    new = (q, ids[x0 + x], whole[q, x].astype(np.int64))
                    if (d, q0) in best:
                        new = tuple(np.concatenate(pair) for pair in zip(best[d, q0], new, strict=True))
                    order = np.lexsort((new[1], -new[2], new[0]))
                    asked = new[0][order]
                    keep = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
                    best[d, q0] = tuple(c[order][keep] for c in new)
        for (d, q0), (q, ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.array(queries[d][2][q0 : q0 + tile[0]], np.int64)[q]), pa.array(ids), pa.array(scores)], names=["place", "vec_id", "score"])

    return run


def _block(asked: list) -> dict[int, tuple[np.ndarray, np.ndarray, list[int]]]:
    """Queries by dimension: ids, vectors, places in the block."""
    by_dim = defaultdict(list)
    for place, r in asked:
        by_dim[len(r.v)].append((r.id, r.v, place))
    return {d: (np.array([x[0] for x in rows]), np.array([x[1] for x in rows], np.int64).reshape(len(rows), d), [x[2] for x in rows]) for d, rows in by_dim.items()}


def cutoffs(found: DataFrame, k: int) -> DataFrame:
    """place, t of each query with lists: its k-th best score is t at least (null: fewer than k entries)."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best")
    few = found.groupBy("place", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g")).agg(best)
    return few.groupBy("place").agg(best).select("place", F.get("best", F.lit(k - 1)).alias("t"))


def collected(found: DataFrame, bounds: DataFrame, lists: int) -> DataFrame:
    """Phase 2: place, t, enough (whether the list holds all from the cutoff on), taken (its entries down to the cutoff)."""
    both = found.join(F.broadcast(bounds), "place")  # a row per query of the block
    above = lambda p: F.col("t").isNull() | (F.lit(lists) * p >= F.col("t"))
    n = F.size(F.filter("partials", above))  # they descend, so these are the first
    taken = F.arrays_zip(*[F.slice(c, F.lit(1), n).alias(c) for c in ("rows", "ids", "scores")])
    return both.select("place", "t", (F.col("last").isNull() | ~above(F.col("last"))).alias("enough"), taken.alias("taken"))


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, tile: tuple[int, int] = TILE, depth: int = DEPTH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of each query row against all other rows."""
    spark = df.sparkSession
    depth = max(depth, k)
    good = lambda rows: rows.select(column(id_col).cast("long").alias("id"), quantized(column(vector_col)).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    vectors = good(df)
    asked = written(good(df.filter(is_query)).groupBy("id").agg(F.min("v").alias("v")), "queries")  # read once a block
    widest = asked.agg(F.max(F.size("v"))).first()[0] or 1
    size = max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, widest))))
    answers, last = None, None
    while True:
        rest = asked if last is None else asked.filter(F.col("id") > last)
        block = list(enumerate(rest.orderBy("id").limit(size).collect()))  # at most size rows
        if not block:
            break
        last = block[-1][1].id
        queries = _block(block)
        found = written(vectors.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_gather(queries, k, lists, depth, tile), LIST), "score-lists")
        bounds = written(cutoffs(found, k), "cutoffs")
        read = written(collected(found, bounds, lists), "collected")
        short = {r.place: r.t for r in read.filter("NOT enough").select("place", "t").distinct().collect()}  # at most size rows
        ids = spark.createDataFrame([(place, r.id) for place, r in block], "place long, query_id long")
        entries = read.select("place", "t", F.explode("taken").alias("e")).filter("t IS NULL OR e.scores >= t").select("place", "e.*").distinct()  # an entry may stand in each of its lists
        entries = entries.select("place", F.col("ids").alias("vec_id"), F.col("scores").alias("score"))
        if short:
            again = vectors.mapInArrow(_rescore(_block([x for x in block if x[0] in short]), short, k, lists, tile), "place long, vec_id long, score long")
            left = spark.createDataFrame([(p,) for p in short], "place long")
            entries = entries.join(F.broadcast(left), "place", "left_anti").unionByName(again)
        part = written(entries.join(F.broadcast(ids), "place").select("query_id", "vec_id", "score"), "resolved")
        dropped(found, bounds, read)
        answers = part if answers is None else answers.unionByName(part)
        if len(block) < size:
            break
    dropped(asked)
    if answers is None:
        answers = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
