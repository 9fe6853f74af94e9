"""Quality classifier: Naive Bayes support vectors (operator 7).

A text's features are the n-grams of its bytes, and of whether each word is the
one before it again, present or not, hashed to ``2 ** BITS`` columns.  Each indicator is scaled by its class log-count ratio,
ln((a + p) / |a + p|) - ln((a + q) / |a + q|) with the class's smoothed counts,
and a linear hinge-loss model is fitted to the scaled rows by dual coordinate
descent.  The final weights are interpolated with their mean magnitude, as is
usual for this model.  Margins are mapped to (0, 1) by a logistic curve fitted
on margins of folds that the model hasn't seen.

The classifier is fitted on at most ``PER_CLASS`` labelled rows of each class,
chosen by the hash of their id (the documented bound of its sample): these go
to the driver as sorted feature arrays, or as bit maps where those are smaller,
so ``2 * PER_CLASS`` rows take 2 ** BITS / 8 bytes each at most, 256 MB in all
(measured: 3 KB a row).  Scoring covers all rows, and its state
is one dense array of weights, whose size is fixed.

Defined results: null text counts as empty; an empty text has no features and
scores the model's intercept; rows without a label, or with one that is not 0
or 1, don't teach; repeated label rows of one id teach by the greatest label;
if a class has no rows, scores are constant: 1.0 if only label 1 was seen, 0.0
if only label 0, 0.5 if none.  Columns of other names are ignored by ``score``
and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import bounded_batches, free_name, release, texts

BITS = 18
ORDERS = (1, 2, 3)
PER_CLASS = 4096
FOLDS = 3
_MUL = np.uint32(0x9E3779B1)
#: n-grams of "the word before again": one, two, four and sixteen in a row.
_SAME = [b"\1" * n for n in (1, 2, 4, 16)]


def features(text: bytes, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Sorted distinct columns of a text's byte n-grams."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    seen = np.zeros(1 << bits, dtype=bool)
    words = text.split()
    same = bytes(map(eq, words, words[1:]))
    for k, run in enumerate(_SAME):
        if run in same:
            seen[((k + 11) * int(_MUL) & 0xFFFFFFFF) >> (32 - bits)] = True
    for n in orders:
        if len(data) < n:
            break
        code = np.full(len(data) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + data[k : len(data) - n + 1 + k]
        seen[(code * _MUL) >> np.uint32(32 - bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


def packed(columns: np.ndarray, bits: int = BITS) -> bytes:
    """Sorted columns as they are or, where that is shorter, as a bit map (one
    byte more than a whole number of words tells which)."""
    if columns.nbytes <= 1 << (bits - 3):
        return columns.tobytes()
    seen = np.zeros(1 << bits, dtype=bool)
    seen[columns] = True
    return np.packbits(seen).tobytes() + b"\1"


def unpacked(data: bytes) -> np.ndarray:
    if len(data) % 4 == 0:
        return np.frombuffer(data, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, len(data) - 1))).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None
    info: dict = field(default_factory=dict)

    def margin(self, columns: np.ndarray) -> float:
        return float(self.weights[columns].sum(dtype=np.float64)) + self.intercept

    def score(self, columns: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        z = self.slope * self.margin(columns) + self.offset
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, size), smooth)
    for columns, label in zip(rows, labels, strict=True):
        counts[int(label), columns] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Linear hinge loss (L1-SVM) with a penalised intercept: the box-constrained
    dual is solved one example at a time, its weight vector kept up to date."""
    weights, intercept = np.zeros(len(ratios)), 0.0
    values = [ratios[c] for c in rows]
    norms = np.array([1.0 + float(v @ v) for v in values])
    sign = np.where(labels == 1, 1.0, -1.0)
    each = np.where(labels == 1, 1.0, (labels == 1).sum() / max(1, (labels == 0).sum())) * cost
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        widest = 0.0
        for i in rng.permutation(len(rows)):
            columns, v = rows[i], values[i]
            gradient = sign[i] * (float(weights[columns] @ v) + intercept) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), each[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                widest = max(widest, abs(step))
                weights[columns] += step * v
                intercept += step
                alpha[i] = new
        if widest < 1e-6:
            break
    return weights, intercept


def fit_margins(rows: list[np.ndarray], labels: np.ndarray, size: int, cost: float, epochs: int, mix: float) -> tuple[np.ndarray, float]:
    ratios = log_count_ratios(rows, labels, size)
    weights, intercept = dual_descent(rows, labels, ratios, cost, epochs)
    weights = (1 - mix) * np.abs(weights).mean() + mix * weights
    return weights * ratios, intercept


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1), by Newton steps on smoothed targets."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.abs(margins).mean() or 1.0
    x = margins / scale
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6) / scale, b


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int = 1 << BITS, cost: float = 0.1, epochs: int = 30, mix: float = 0.9) -> Model:
    if len(labels) == 0 or len(set(labels.tolist())) == 1:
        return Model(np.zeros(size, np.float32), 0.0, constant=float(labels[0]) if len(labels) else 0.5)
    fold = np.arange(len(labels)) % FOLDS
    unseen = np.zeros(len(labels))
    for k in range(FOLDS):
        train = np.flatnonzero(fold != k)
        if len(set(labels[train].tolist())) < 2:
            train = np.arange(len(labels))
        w, b = fit_margins([rows[i] for i in train], labels[train], size, cost, epochs, mix)
        for i in np.flatnonzero(fold == k):
            unseen[i] = w[rows[i]].sum() + b
    slope, offset = logistic(unseen, labels)
    w, b = fit_margins(rows, labels, size, cost, epochs, mix)
    return Model(w.astype(np.float32), b, slope, offset, info={"rows": len(rows)})


# -- tables --------------------------------------------------------------------


def crc_of(key: Column) -> Column:
    """crc32 of the decimal id; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = PER_CLASS,
) -> Model:
    """Fit on a bounded, hash-chosen sample of the labelled rows for which
    ``learn`` (a column of the key) holds."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("_k"),
        F.col(label).cast("int").alias("_y"),
    ).groupBy("_k").agg(F.max("_y").alias("_y"))
    known = known.withColumnRenamed("_k", key).where(learn).withColumnRenamed(key, "_k")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class ids: a bounded broadcast, so texts aren't shuffled
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [packed(features(t)) for t in texts(b, "_t")]
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_y"), pa.array(made, pa.binary())], names=["k", "y", "f"])

    kind = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(extract, f"k {kind}, y int, f binary").toArrow()
    keys, blobs = found.column("k").to_pylist(), found.column("f").to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (keys[i], blobs[i]))
    labels = found.column("y").to_numpy()
    return fit([unpacked(blobs[i]) for i in order], labels[np.array(order, dtype=np.int64)])


def score(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None, out: str = "score") -> DataFrame:
    """``columns`` of ``docs`` (default all but ``out``) and ``out`` double."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [c for c in (docs.columns if columns is None else columns) if c != out]
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("quality")
        own = shared.value
        for b in batches:
            made = pa.array([own.score(features(t)) for t in texts(b, "_text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], made], names=[*b.schema.names[1:], "score"])

    return rows.mapInArrow(run, StructType(rows.schema.fields[1:]).add("score", "double")).toDF(*names, out)


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows that the classifier doesn't reject, columns unchanged."""
    own = free_name("_quality", docs)
    return score(docs, model, text, out=own).where(F.col(own) >= least).drop(own)
