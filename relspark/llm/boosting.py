"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are binned by quantiles; trees are grown level by level
from histograms of gradients, and flattened into arrays that numpy walks for a batch
of documents at once. Trees are fitted on the driver from at most TRAIN_ROWS labelled
documents, chosen by the hash of their id; the flattened model (a few
kilobytes) goes to the executors.

Only statistics of the text are inputs: never id, language, source or label. Nulls: a
null text is an empty one; null labels, labels but 0 and 1 and labels of unknown documents
teach nothing; a null id is scored but never learned from. Repeated rows are scored each;
an id teaches once, by the row whose statistics' bytes are smallest, and as 0 if it is labelled both
ways. Without any label every score is 0.5. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm import textkit as tk
from relspark.llm.common import cut, hashed_share, in_class

TRAIN_ROWS = 20_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
LAMBDA = 1.0
LEAST_GAIN = 1e-3
LEAST_WEIGHT = 5.0

NAMES = (
    "log_words", "word_bytes", "symbols", "capitals", "digits", "marks", "line_ends", "non_ascii",
    "distinct_words", "distinct_pairs", "distinct_fives", "top_word", "distinct_lines", "word_bytes_spread",
)

_CLASS = np.zeros((6, 256), np.uint8)
for _row, _chars in enumerate((b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?", b"\n", bytes(range(128, 256)))):
    _CLASS[_row, list(_chars)] = 1


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of NAMES for each text."""
    data, offsets = tk.join_texts(texts)
    starts, ends = tk.word_spans(data)
    words = tk.word_hashes(data, starts, ends)
    first = tk.words_per_text(starts, offsets)
    out = np.zeros((len(texts), len(NAMES)), np.float32)
    if not len(texts):
        return out
    sizes = (ends - starts).astype(np.float64)
    n = np.diff(first)
    some = np.maximum(n, 1)
    counts = np.stack([np.add.reduceat(row[data], offsets[:-1], dtype=np.int64) for row in _CLASS], 1)
    counts[:, 4] -= 1  # the line feed that join_texts adds
    total = np.zeros(len(words) + 1)
    np.cumsum(sizes, out=total[1:])
    squares = np.zeros(len(words) + 1)
    np.cumsum(sizes**2, out=squares[1:])
    inside = total[first[1:]] - total[first[:-1]]
    mean = inside / some
    out[:, 0] = np.log1p(n)
    out[:, 1] = mean
    out[:, 2] = counts[:, 0] / some
    out[:, 3] = counts[:, 1] / np.maximum(inside, 1)
    out[:, 4] = counts[:, 2] / np.maximum(inside, 1)
    out[:, 5] = counts[:, 3] / some
    out[:, 6] = counts[:, 4] / some
    out[:, 7] = counts[:, 5] / np.maximum(inside, 1)
    out[:, 13] = np.sqrt(np.maximum((squares[first[1:]] - squares[first[:-1]]) / some - mean**2, 0))
    pairs = tk.mix64(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
    fives = tk.mix64(pairs[:-3] * np.uint64(5) + pairs[2:-1] * np.uint64(7) + words[4:]) if len(words) > 4 else words[:0]
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b == a:
            out[i, 8:13] = 1
            out[i, 11] = 0
            continue
        _, often = np.unique(words[a:b], return_counts=True)
        out[i, 8] = len(often) / (b - a)
        out[i, 11] = often.max() / (b - a)
        out[i, 9] = len(np.unique(pairs[a : b - 1])) / (b - a - 1) if b - a > 1 else 1
        out[i, 10] = len(np.unique(fives[a : b - 4])) / (b - a - 4) if b - a > 4 else 1
        lines = [x for x in (texts[i] or "").split("\n") if x]
        out[i, 12] = len(set(lines)) / max(len(lines), 1) if lines else 1
    return out


# ---- trees ------------------------------------------------------------------


@dataclass
class Model:
    """Complete binary trees, node k's children at 2k + 1 and 2k + 2. feature -1: go
    left. value holds the leaves, which are the last 2**depth nodes."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray  # trees x leaves
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, f] > threshold[node]))
            out += value[node - len(feature)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Second-order boosting of the logistic loss on histograms."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(x):
        return Model(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), 0.0)
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Model(np.full((trees, inner), -1), np.zeros((trees, inner), np.float32), np.zeros((trees, leaves)), float(np.log(rate / (1 - rate))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: x <= edge b
    margin = np.full(len(y), model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            at = node - base
            gs, hs = np.bincount(at, g, width), np.bincount(at, h, width)
            best = np.full(width, LEAST_GAIN)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = at * BINS + binned[:, j]
                left_g = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)[:, : len(e)]
                left_h = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)[:, : len(e)]
                right_g, right_h = gs[:, None] - left_g, hs[:, None] - left_h
                gain = left_g**2 / (left_h + LAMBDA) + right_g**2 / (right_h + LAMBDA) - (gs**2 / (hs + LAMBDA))[:, None]
                gain[(left_h < LEAST_WEIGHT / 4) | (right_h < LEAST_WEIGHT / 4)] = 0
                cut_at = gain.argmax(1)
                found = gain[np.arange(width), cut_at]
                better = found > best
                best[better] = found[better]
                model.feature[t, base : base + width][better] = j
                model.threshold[t, base : base + width][better] = e[cut_at[better]]
            f = model.feature[t, node]
            node = 2 * node + 1 + ((f >= 0) & (x[np.arange(len(x)), f] > model.threshold[t, node]))
        leaf = node - inner
        model.value[t] = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + LAMBDA)
        margin += model.value[t, leaf]
    return model


# ---- over tables ---------------------------------------------------------------


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            x = statistics(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, len(NAMES))


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(texts.mapInArrow(_measure, "doc_id long, x binary"), "statistics").withColumn("held_out", in_class(F.col("doc_id"), 4, 2))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    labelled = rows.where("not held_out and doc_id is not null").join(known, "doc_id").select("doc_id", "x", "y")
    share = train_rows / max(1, known.where(~in_class(F.col("doc_id"), 4, 2)).count())
    # One row of an id, so that what comes to the driver is bounded by the sample's ids.
    sample = labelled.where(hashed_share(F.col("doc_id"), share)).groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    taught = sample.toArrow().sort_by("doc_id").slice(0, train_rows)
    model = fit(_matrix(taught.column("x")), taught.column("y").to_numpy().astype(float)) if taught.num_rows else fit(np.zeros((0, len(NAMES))), np.zeros(0))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
