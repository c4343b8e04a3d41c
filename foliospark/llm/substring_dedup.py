"""Substring dedup by a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of a document; a word goes if a window covers it whose words
also start earlier (smaller id, or same document and earlier start).

Index. Of each window only its anchor is indexed: the run of ``ANCHOR`` words in it with the least hash
(the first of equals). Equal windows have equal anchors at equal places, and neighbouring windows mostly
share theirs, so about one word in eight is an entry and no repeat is lost. Documents come in batches of
ascending ids. A batch becomes one immutable run: a table that is bucketed and sorted by fingerprint.
The new run is merge-joined with every earlier run (same buckets, no exchange); fingerprints on both
sides, or twice in the new run, make their entries shared. When there are more than ``FANOUT`` runs they
are compacted into one, which keeps an entry of each fingerprint; the others are known to be
shared and stay in the index's list of shared entries. An index can be saved, opened again, and take
further batches: ``remove_later_repeats`` judges a new batch against all that came before.

Verification, on the words. The texts that hold shared anchors are read again. An anchor's context is all
words of the windows that can hold it. Contexts are compared as strings: an anchor whose context occurred
earlier has all its windows repeated. For anchors with several contexts the windows of the first anchor of
each context are compared one by one, as strings too. So fingerprints only choose what is compared.

Copies are combined where they are made: a fingerprint or context that repeats within a task sends on
one entry, the others are known to be shared or repeated. So a passage that a third of all documents
hold adds at most a row per task to any group of equal fingerprints or contexts; different contexts around
one such passage are dealt to many tasks by a salt. Nothing is joined with itself without an aggregate
between, and no group is collected but the places within one document.

Defined cases: a null text has no words; a text under ``WINDOW`` words keeps all; a very long text is
hashed as a whole, in memory in proportion to it; null ids come first; rows that share an id are parts of
one document, in the order of a 64-bit hash of their texts, and equal rows are the same part (none removes
the other); an empty table gives an empty table; the output columns replace input columns of the same
name, and no other column is touched, whatever its name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import column, discard, dropped, fresh_path, hot_join, packed, passing, tidy, unpacked, written
from foliospark.llm.wordhash import BREAK, U, Texts, mix, slices, windows

WINDOW = 20
ANCHOR = 6
BATCHES = 3
FANOUT = 2
#: Entries, and contexts, that a task holds to combine copies; beyond it it sends them on and starts anew.
HELD = 1 << 19
HELD_CONTEXTS = 1 << 17
LOWEST = -(2**63)
SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
ENTRY = "route long, of long, key long, part long, pos int, shared boolean, direct boolean"
SHARED = "fp long, key long, part long, pos int"
CONTEXT = "is_first boolean, fp long, skip int, words string, key long, part long, pos int, lo int, hi int, begin int, n int"


def sliding_argmin(values: np.ndarray, n: int) -> np.ndarray:
    """For each i the first place of the least of values[i : i + n]."""
    if len(values) < n:
        return np.empty(0, np.int64)
    at, width = np.arange(len(values)), 1
    while 2 * width <= n:
        a, b = at[:-width], at[width:]
        at, width = np.where(values[b] < values[a], b, a), 2 * width
    if width < n:
        a, b = at[: len(values) - n + 1], at[n - width :]
        at = np.where(values[b] < values[a], b, a)
    return at


def anchors(words: Texts, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the text, fingerprint) of the anchors of all windows."""
    hashes = words.hashes()
    text_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    grams = windows(hashes, anchor)
    least = sliding_argmin(grams, window - anchor + 1)
    starts = np.arange(len(hashes) - window + 1)
    at = least[words.first[text_of[starts] + 1] >= starts + window]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    at = np.unique(at)
    return text_of[at], at - words.first[text_of[at]], grams[at]


def _entries(window: int, anchor: int):
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        fp, key, part, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first, which, count = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
        direct = np.ones(len(fp), bool)
        direct[first] = False
        # What is known to be shared goes anywhere; what must meet its like goes by its fingerprint.
        route = np.where(direct, mix(key.view(U) * U(31) + pos.astype(U)), fp).view(np.int64)
        columns = [pa.array(route), pa.array(fp.view(np.int64), mask=~direct)] + [pa.array(x) for x in (key, part, pos.astype(np.int32), count[which] > 1, direct)]
        yield pa.RecordBatch.from_arrays(columns, names=["route", "of", "key", "part", "pos", "shared", "direct"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys, parts = (np.asarray(batch.column(c)) for c in ("key", "part"))
            for first, _, words in slices(batch.column("text")):
                text, pos, fp = anchors(words, window, anchor)
                held.append((fp, keys[first + text], parts[first + text], pos))
                n += len(fp)
                if n > HELD:
                    yield from flush(held)
                    held, n = [], 0
        yield from flush(held)

    return run


def _spelled(words: Texts) -> tuple[bytes, np.ndarray]:
    """The words with one space after each, and the place of each word (and the end) in that."""
    size = words.end - words.start
    at = np.append(0, np.cumsum(size + 1))
    out = np.full(at[-1], 0x20, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = words.raw[~BREAK[words.raw]]
    return out.tobytes(), at


def _contexts(window: int, anchor: int):
    reach = window - anchor
    names = ("is_first", "fp", "skip", "words", "key", "part", "pos", "lo", "hi", "begin", "n")

    def flush(held: list[tuple], spelled: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        fp, skip, key, part, pos, lo, hi, begin, n = (np.concatenate([x[i] for x in held]) for i in range(9))
        is_first, again = np.zeros(len(fp), bool), np.zeros(len(fp), bool)
        first: dict[tuple[int, bytes], int] = {}
        places = list(zip(key.tolist(), part.tolist(), pos.tolist(), strict=True))
        skips = skip.tolist()
        order = np.lexsort((pos, part, key))
        for i in order.tolist():
            head = first.setdefault((skips[i], spelled[i]), i)
            if head == i:
                is_first[i] = True
            else:
                again[i] = places[i] != places[head]  # an equal row is neither first nor repeated
        # What is repeated already is only a range of words; ranges that meet in a text go as one.
        r = order[again[order]]
        new = np.ones(len(r), bool)
        new[1:] = (key[r][1:] != key[r][:-1]) | (part[r][1:] != part[r][:-1]) | (lo[r][1:] > hi[r][:-1])
        a = np.nonzero(new)[0]
        hi[r[a]] = hi[r[np.append(a[1:], len(r))[: len(a)] - 1]] if len(a) else hi[r[a]]
        kept = np.concatenate([np.nonzero(is_first)[0], r[a]])
        text = pa.array([spelled[i] if is_first[i] else None for i in kept.tolist()], pa.binary()).cast(pa.string())
        small = [x[kept].astype(np.int32) for x in (pos, lo, hi, begin, n)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (is_first[kept], fp[kept].view(np.int64), skip[kept].astype(np.int32))] + [text] + [pa.array(x) for x in (key[kept], part[kept], *small)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spelled = [], []
        for batch in batches:
            keys, parts, places = np.asarray(batch.column("key")), np.asarray(batch.column("part")), batch.column("places")
            offsets, flat = np.asarray(places.offsets), np.asarray(places.values).astype(np.int64)
            for first, end, words in slices(batch.column("text")):
                pos = flat[offsets[first] : offsets[end]]
                text = np.repeat(np.arange(end - first), np.diff(offsets[first : end + 1]))
                if not len(pos):
                    continue
                start, stop = words.first[text], words.first[text + 1]
                at = start + pos
                lo, hi = np.maximum(start, at - reach), np.minimum(stop, at + window)
                grams = windows(words.hashes(), anchor)
                # The windows that have this anchor: a range, as the place of the least never moves back.
                least = sliding_argmin(grams, reach + 1)
                begin = np.maximum(lo, np.searchsorted(least, at, "left"))
                n = np.maximum(0, np.minimum(hi - window + 1, np.searchsorted(least, at, "right")) - begin)
                held.append((grams[at], at - lo, keys[first + text], parts[first + text], pos, lo - start, hi - start, begin - start, n))
                raw, place = _spelled(words)
                spelled += [raw[a:b] for a, b in zip(place[lo].tolist(), (place[hi] - 1).tolist(), strict=True)]
                if len(spelled) > HELD_CONTEXTS:
                    yield from flush(held, spelled)
                    held, spelled = [], []
        yield from flush(held, spelled)

    return run


@contextmanager
def _sorted_runs(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside know that each bucket of a run is one sorted file, and merge runs without sorting them."""
    before = spark.conf.get(SORTED, None)
    spark.conf.set(SORTED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SORTED)
        else:
            spark.conf.set(SORTED, before)


class Index:
    """Immutable runs of fingerprints, each a table bucketed and sorted by fingerprint, and the entries that were found shared."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, anchor: int = ANCHOR, fanout: int = FANOUT, path: str | None = None) -> None:
        self.spark, self.window, self.anchor, self.fanout = spark, window, anchor, fanout
        self.path = path or fresh_path(spark, "fingerprints")
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[str] = []  # paths
        self.tables: dict[str, str] = {}  # path -> name in the catalog
        self.found: list[str] = []
        self.last: int | None = None
        self.compactions = 0

    def _run(self, entries: DataFrame, dealt: bool = False) -> str:
        """Write entries as a run; ``dealt``: they lie by fingerprint already."""
        path, name = f"{self.path}/run-{uuid.uuid4().hex}", f"fingerprints_{uuid.uuid4().hex}"
        with tidy(self.spark):
            (entries if dealt else entries.repartition("route")).write.bucketBy(self.buckets, "route").sortBy("route").option("path", path).saveAsTable(name)
        self.tables[path] = name
        return path

    def _read(self, path: str) -> DataFrame:
        if path not in self.tables:
            name = f"fingerprints_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet CLUSTERED BY (route) SORTED BY (route) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.tables[path] = name
        return self.spark.table(self.tables[path])

    def _forget(self, path: str) -> None:
        name = self.tables.pop(path, None)
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, path)

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch (key, part, text); the entries (fp, key, part, pos) that it shares with itself and what came before.

        Ids of the batch must be above all earlier ones, for what came first is known by its id.
        """
        least, most = docs.agg(F.min("key"), F.max("key")).first()
        if self.last is not None and least is not None and least <= self.last:
            raise ValueError(f"ids of a batch must be above those before it: {least} is not above {self.last}")
        entries = self._run(docs.select("key", "part", "text").mapInArrow(_entries(self.window, self.anchor), ENTRY))
        rows = self._read(entries)
        place = [F.coalesce("of", "route").alias("fp"), "key", "part", "pos"]
        keyed = rows.filter("NOT direct")
        twice = keyed.groupBy("route").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("route")
        found = rows.filter("shared").select(*place).unionByName(keyed.filter("NOT shared").join(twice, "route", "left_semi").select(*place))
        for run in self.runs:
            old = self._read(run).filter("NOT direct")
            found = found.unionByName(keyed.join(old, "route", "left_semi").select(*place)).unionByName(old.join(keyed, "route", "left_semi").select(*place))
        path = f"{self.path}/shared-{uuid.uuid4().hex}"
        with tidy(self.spark), _sorted_runs(self.spark):
            found.write.parquet(path)
        self.found.append(path)
        self.runs.append(entries)
        self.last = self.last if most is None else most
        if len(self.runs) > self.fanout:
            self.compact()
        return self.spark.read.schema(SHARED).parquet(path)

    def compact(self) -> None:
        """Merge all runs into one that has an entry of each fingerprint; the others have been found shared."""
        merged = None
        for run in self.runs:
            rows = self._read(run).filter("NOT direct").select("route", "key", "part", "pos")
            merged = rows if merged is None else merged.unionByName(rows)
        one = merged.groupBy("route").agg(*[F.first(c).alias(c) for c in ("key", "part", "pos")])
        new = self._run(one.select("route", F.lit(None).cast("long").alias("of"), "key", "part", "pos", F.lit(False).alias("shared"), F.lit(False).alias("direct")), dealt=True)
        for run in self.runs:
            self._forget(run)
        self.runs = [new]
        self.compactions += 1

    def drop(self) -> None:
        """Forget and delete all of the index."""
        for path in self.runs:
            self._forget(path)
        discard(self.spark, self.path)
        self.runs, self.found = [], []

    def shared(self, fingerprints: DataFrame | None = None) -> DataFrame:
        """key, part, places: the shared anchors of each text so far, all or those of some fingerprints (fp)."""
        found = self.spark.read.schema(SHARED).parquet(*self.found) if self.found else self.spark.createDataFrame([], SHARED)
        if fingerprints is not None:
            found = found.join(fingerprints.select("fp").distinct().hint("merge"), "fp", "left_semi")
        return written(found.groupBy("key", "part").agg(F.sort_array(F.collect_set("pos")).alias("places")), "places")

    def save(self) -> str:
        """Write what ``opened`` needs beside the runs; the folder."""
        state = {"window": self.window, "anchor": self.anchor, "fanout": self.fanout, "buckets": self.buckets, "last": self.last, "runs": [p.rpartition("/")[2] for p in self.runs], "found": [p.rpartition("/")[2] for p in self.found]}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/state")
        return self.path


def opened(spark: SparkSession, path: str) -> Index:
    """A saved index."""
    state = json.loads(spark.read.text(f"{path}/state").first()[0])
    index = Index(spark, state["window"], state["anchor"], state["fanout"], path)
    index.buckets, index.last = state["buckets"], state["last"]
    index.runs, index.found = ([f"{path}/{name}" for name in state[k]] for k in ("runs", "found"))
    return index


def repeats(docs: DataFrame, shared: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """key, part, spans: the word ranges of each text that repeated windows cover, verified on the words of the texts."""
    # By merge at every size: a plan that changes with the tables would hide what large ones cost.
    context = written(docs.join(shared.hint("merge"), ["key", "part"]).select("key", "part", "text", "places").mapInArrow(_contexts(window, anchor), CONTEXT), "contexts")
    span, place = ("key", "part", "lo", "hi"), F.struct("key", "part", "pos")
    # A context comes at most once a flush of a task, so its group is small; its hash only shortens the sort.
    equal = Window.partitionBy("h", "skip", "words")
    firsts = context.filter("is_first").withColumn("h", F.xxhash64("words")).withColumn("least", F.min(place).over(equal))
    order = F.when(place == F.col("least"), 0).when(place > F.col("least"), 1)
    judged = written(firsts.withColumn("order", order).select("fp", "order", "begin", "n", F.when(F.col("order") == 0, F.col("words")).alias("words"), "pos", *span), "judged")
    marks = [written(context.filter("NOT is_first").select(*span).unionByName(judged.filter("order = 1").select(*span)), "marks")]
    dropped(context)
    heads = judged.filter("order = 0")
    several = written(heads.groupBy("fp").agg(F.count(F.lit(1)).alias("heads")).filter("heads > 1"), "several")
    total = several.agg(F.coalesce(F.sum("heads"), F.lit(0))).first()[0]
    edges = written(hot_join(heads.filter("n > 0"), several, "fp", "heads", F.col("key"), total).select("key", "part", "pos", "lo", "begin", "n", "words"), "edges")
    dropped(judged, several)
    marks.append(_again(edges, window))
    spans = written(marks[0].unionByName(marks[1]).groupBy("key", "part").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    dropped(edges, *marks)
    return spans


def _window(words: str, lo: Column, start: Column, window: int) -> Column:
    """The window from a place on, of the words (an array) of the context that begins at lo."""
    return F.slice(words, start - lo + 1, window)


def _hashed(words: Column) -> Column:
    return F.xxhash64(words)


def _again(edges: DataFrame, window: int) -> DataFrame:
    """key, part, lo, hi of the windows of contexts (edges) that started earlier in another of them.

    A hash says which windows to compare; the words of both decide. Windows of a hash that stood for
    different words are grouped by their words in full.
    """
    spelled = edges.select("key", "part", "pos", "lo", "begin", "n", F.split("words", " ").alias("list"))
    starts = F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)
    own = lambda made: F.transform(starts, lambda at: F.struct(at.alias("start"), made(_window("list", F.col("lo"), at, window)).alias("h")))
    each = written(spelled.select("key", "part", "pos", F.inline(own(_hashed))), "windows")
    earliest = each.groupBy("h").agg(F.min(F.struct("key", "part", "start", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = each.join(earliest, "h").filter(F.struct("key", "part", "start") > F.struct("first.key", "first.part", "first.start"))
    # The windows of one context that first stood in one other context, by the same step, are compared together.
    head = F.struct("first.key", "first.part", "first.pos").alias("head")
    pairs = later.groupBy("key", "part", "pos", head, (F.col("start") - F.col("first.start")).alias("step")).agg(F.collect_list("start").alias("starts"))
    pairs = written(pairs, "window-pairs")
    counts = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("members"))
    heads = counts.join(edges.select(F.struct("key", "part", "pos").alias("head"), F.col("lo").alias("head_lo"), F.col("words").alias("head_words")).dropDuplicates(["head"]).hint("merge"), "head")
    mine = pairs.join(edges.select("key", "part", "pos", "lo", "words").dropDuplicates(["key", "part", "pos"]).hint("merge"), ["key", "part", "pos"])
    both = hot_join(mine, heads, "head", "members", F.col("key"), pairs.count())
    both = both.withColumns({"a": F.split("words", " "), "b": F.split("head_words", " ")})
    same = lambda at: _window("a", F.col("lo"), at, window) == _window("b", F.col("head_lo"), at - F.col("step"), window)
    compared = written(both.select("key", "part", F.explode(F.transform("starts", lambda at: F.struct(at.alias("start"), same(at).alias("same")))).alias("x")).select("key", "part", "x.*"), "compared")
    out = compared.filter("same")
    wrong = compared.filter("NOT same")
    if wrong.head(1):
        hashes = each.join(wrong.select("key", "part", "start"), ["key", "part", "start"]).select("h").distinct()
        unsure = spelled.select("key", "part", F.inline(own(lambda w: w))).withColumnRenamed("h", "w").withColumn("h", _hashed(F.col("w"))).join(hashes, "h")
        least = unsure.groupBy("w").agg(F.min(F.struct("key", "part", "start")).alias("least"))
        out = out.select("key", "part", "start").unionByName(unsure.join(least, "w").filter(F.struct("key", "part", "start") > F.col("least")).select("key", "part", "start"))
    out = written(out.select("key", "part", F.col("start").alias("lo"), (F.col("start") + window).alias("hi")), "marks")
    dropped(each, pairs, compared)
    return out


def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, marks in batches:
        offsets, lo, hi = np.asarray(marks.offsets), *(np.asarray(marks.values.field(c)) for c in ("lo", "hi"))
        n_words, n_removed, kept = [], [], []
        for first, end, words in slices(texts):
            for i in range(end - first):
                a, b = int(words.first[i]), int(words.first[i + 1])
                n_words.append(b - a)
                begin, stop = int(words.offsets[i]), int(words.offsets[i + 1])
                raw = words.raw[begin:stop]
                own = slice(offsets[first + i], offsets[first + i + 1])
                if own.start == own.stop:
                    n_removed.append(0)
                    kept.append(raw.tobytes())
                    continue
                edge = np.bincount(lo[own], minlength=b - a + 1) - np.bincount(hi[own], minlength=b - a + 1)
                gone = np.cumsum(edge)[:-1] > 0
                n_removed.append(int(gone.sum()))
                # A word that goes takes the white space after it along.
                starts = np.append(words.start[a:b], stop) - begin
                stays = np.concatenate([np.ones(starts[0], bool), np.repeat(~gone, np.diff(starts))])
                kept.append(raw[stays].tobytes())
        text = pa.array(kept, pa.binary()).cast(pa.string())
        text = pa.compute.if_else(texts.is_valid(), text, pa.scalar(None, pa.string())) if texts.null_count else text
        yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), text], names=["n_words", "n_removed", "text"])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, key (the id; null is the lowest), part (tells texts of one id apart) and text of each row."""
    text = column(text_col)
    return packed(df, key=F.coalesce(column(id_col).cast("long"), F.lit(LOWEST)), part=F.xxhash64(F.coalesce(text, F.lit(""))), text=text)


def _texts(keyed: DataFrame) -> DataFrame:
    return keyed.select("key", "part", F.coalesce("text", F.lit("")).alias("text"))


def _without(keyed: DataFrame, spans: DataFrame, names: list[str], text_col: str) -> DataFrame:
    joined = keyed.join(spans.hint("merge"), ["key", "part"], "left").withColumn("cut", F.arrow_udf(_cut, "struct<n_words:long,n_removed:long,text:string>")(F.col("text"), F.col("spans")))
    return unpacked(joined, names, **{text_col: F.col("cut.text"), "n_words": F.col("cut.n_words"), "n_removed": F.col("cut.n_removed")})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, fanout: int = FANOUT, index: Index | None = None) -> DataFrame:
    """df with the text without its repeated words, and n_words and n_removed of the text that was.

    ``index``: an empty one that is to hold df's windows afterwards; else one is made and goes.
    """
    keyed = _keyed(df, id_col, text_col)
    docs = _texts(keyed)
    own = index or Index(df.sparkSession, window, anchor, fanout)
    bounds = docs.agg(F.percentile_approx("key", F.array(*[F.lit(i / batches) for i in range(1, batches)]), F.lit(10_000))).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(bounds or [])), None]
    try:
        for low, high in zip(edges, edges[1:], strict=False):
            batch = docs if low is None else docs.filter(F.col("key") > low)
            own.add(batch if high is None else batch.filter(F.col("key") <= high))
        shared = own.shared()
    finally:
        if index is None:
            own.drop()
    spans = repeats(docs, shared, own.window, own.anchor)
    dropped(shared)
    return _without(keyed, spans, df.columns, text_col)


def remove_later_repeats(df: DataFrame, history: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for a new batch whose ids are above all before: words go whose windows start earlier in history or in df.

    ``index`` holds the windows of history, and of df afterwards. Of history only texts that share
    fingerprints with df are read.
    """
    keyed = _keyed(df, id_col, text_col)
    found = index.add(_texts(keyed))
    shared = index.shared(found)
    docs = _texts(_keyed(history, id_col, text_col)).unionByName(_texts(keyed))
    spans = repeats(docs, shared, index.window, index.anchor)
    dropped(shared)
    return _without(keyed, spans, df.columns, text_col)
