"""Naive Bayes support vectors for document quality.

A document's features are indicators of its words, word pairs and byte triples, hashed into a fixed
number of places, and of the steps that its share of repeated three-word windows reaches. Each place is
scaled by the log-count ratio of the classes, rows are scaled to length 1, and a linear hinge-loss model
is fitted by dual coordinate descent. A logistic curve over the margins of folds left out turns margins
into scores.

The model is fitted on a bounded sample: for each label the ``sample`` documents with the smallest
hashes of their ids. The sample's feature places go to the driver (at most 2 * sample rows of at most
``PLACES`` numbers); scoring is one pass over all texts.

Defined cases: a null text is an empty text and is scored; labels that are null, or that contradict each
other for one id, are left out; an id in several rows gives its least text to the sample; without two
labels every score is the known label, or 0.5; extra columns stay; a column named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import column
from foliospark.llm.wordhash import U, mix, slices, windows

PLACES = 1 << 20
SAMPLE = 3_000
REPEAT_STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 15
FOLDS = 4


@dataclass
class Model:
    """scale: log-count ratio of each place; weight: of the scaled indicators; a, b: the logistic curve."""

    scale: np.ndarray
    weight: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, places: np.ndarray) -> float:
        r = self.scale[places]
        length = float(np.sqrt(r @ r))
        return float(r @ self.weight[places]) / length + self.bias if length else self.bias


class Features:
    """The distinct feature places of texts."""

    def __init__(self) -> None:
        self.seen = np.zeros(PLACES, np.int64)

    def distinct(self, places: np.ndarray) -> np.ndarray:
        at = np.arange(len(places))
        self.seen[places] = at
        return places[self.seen[places] == at]  # the last of each

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        bits = U(64 - PLACES.bit_length() + 1)
        for first, end, words in slices(texts):
            one = words.hashes()
            two, three = windows(one, 2), windows(one, 3)
            raw = words.raw.astype(U)
            triples = (mix((raw[:-2] << U(16) | raw[1:-1] << U(8) | raw[2:]) + U(1 << 24)) >> bits).astype(np.int64) if len(raw) > 2 else np.empty(0, np.int64)
            one, two = (one >> bits).astype(np.int64), (two >> bits).astype(np.int64)
            for k in range(end - first):
                a, b = words.first[k], words.first[k + 1]
                c, d = words.offsets[k], words.offsets[k + 1]
                n = max(0, b - a - 2)
                share = 1 - len(np.unique(three[a : a + n])) / n if n else 0.0
                steps = np.arange(np.searchsorted(REPEAT_STEPS, share, "right"))
                yield self.distinct(np.concatenate([one[a:b], two[a : max(a, b - 1)], triples[c : max(c, d - 2)], steps]))


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(y))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _descend(rows: list[np.ndarray], y: np.ndarray, seed: int = 0) -> Model:
    """Log-count ratios and hinge-loss weights of one training set."""
    counts = [np.full(PLACES, SMOOTHING), np.full(PLACES, SMOOTHING)]
    for places, label in zip(rows, y, strict=True):
        counts[int(label > 0)][places] += 1
    scale = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scale[(counts[0] == SMOOTHING) & (counts[1] == SMOOTHING)] = 0
    weight, bias, alpha = np.zeros(PLACES), 0.0, np.zeros(len(rows))
    scaled = [scale[p] / max(1e-12, np.linalg.norm(scale[p])) for p in rows]
    norm = np.array([x @ x + 1 for x in scaled])
    share = {s: (y == s).sum() for s in (-1, 1)}
    cost = np.array([COST * len(y) / (2 * share[s]) for s in y])
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            g = y[i] * (weight[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[rows[i]] += step * scaled[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return Model(scale, weight, bias, 1.0, 0.0)


def train(rows: list[np.ndarray], labels: list[int]) -> Model:
    """The model of feature places and labels (0 or 1)."""
    y = np.where(np.array(labels) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        known = 30.0 * y[0] if len(y) else 0.0
        return Model(np.zeros(PLACES), np.zeros(PLACES), 0.0, 0.0, known)
    folds = min(FOLDS, (y > 0).sum(), (y < 0).sum())
    model = _descend(rows, y)
    if folds > 1:
        fold = np.empty(len(y), int)
        for s in (-1, 1):  # equal parts of both labels
            fold[y == s] = np.arange((y == s).sum()) % folds
        margins = np.empty(len(y))
        for k in range(folds):
            part = _descend([r for r, f in zip(rows, fold, strict=True) if f != k], y[fold != k])
            for i in np.nonzero(fold == k)[0]:
                margins[i] = part.margin(rows[i])
        model.a, model.b = _curve(margins, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the sample of labelled documents. Ids may be of any type; the two tables' are compared as strings."""
    named = labels.select(column(id_col).cast("string").alias("id"), column(label_col).alias("y")).filter("y IN (0, 1) AND id IS NOT NULL")
    known = named.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most")
    chosen = []
    for y in (0, 1):
        chosen += known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "y").collect()
    if not chosen:
        return train([], [])
    # At most 2 * sample ids.
    small = docs.sparkSession.createDataFrame([(r.id, int(r.y)) for r in chosen], "id string, y int")
    texts = docs.select(column(id_col).cast("string").alias("id"), column(text_col).alias("text")).join(F.broadcast(small), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            places = [p.astype("<i4").tobytes() for p in features.of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(places, pa.binary())], names=["id", "y", "places"])

    got = sorted(texts.select("id", "y", "text").mapInArrow(featured, "id string, y int, places binary").collect(), key=lambda r: r.id)
    return train([np.frombuffer(r.places, "<i4") for r in got], [r.y for r in got])


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """df with the score (0 to 1) of each text."""
    spark = df.sparkSession
    slim = Model(model.scale.astype(np.float32), model.weight.astype(np.float32), model.bias, model.a, model.b)
    sent = spark.sparkContext.broadcast(slim)  # two numbers a place

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, own = Features(), sent.value
        for texts in batches:
            margins = np.array([own.margin(p) for p in features.of(texts)])
            yield pa.array(1 / (1 + np.exp(-np.clip(own.a * margins + own.b, -30, 30))), pa.float64())

    return df.withColumn(out, run(column(text_col)))
