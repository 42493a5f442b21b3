"""Histogram gradient-boosted trees over document statistics, scored by traversing flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .text import Words, grams, slices, utf8

#: Labelled documents that a fit sees at most.
TRAIN_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "mean_word", "word_spread", "long_words", "upper", "lower", "digit", "symbol", "sentence_end", "comma", "pipe", "bang", "beyond_ascii", "space", "newline",
    "words_per_line", "distinct_words", "top_word", "same_as_previous", "distinct_pairs", "repeated_lines", "byte_entropy", "capitalised",
)


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_CLASSES = [
    _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("0123456789"), _bytes("#*$%&<>@^~=+_{}[]\\/"), _bytes(".?;:"), _bytes(","), _bytes("|"), _bytes("!"), np.arange(256) >= 128, _bytes(" "), _bytes("\n"),
]


def statistics(batch: pa.RecordBatch) -> np.ndarray:
    """One row of FEATURES for each text of a batch; an empty or null text has zeros."""
    data, offsets = utf8(batch.column("text"))
    words, n = Words(data, offsets), batch.num_rows
    hashes, out = words.hashes(), np.zeros((batch.num_rows, len(FEATURES)))
    if not len(data):
        return out
    lines = Words(data, offsets, _bytes("\n"))
    line_hashes, pairs = lines.hashes(), grams(hashes, 2) if len(hashes) > 1 else np.zeros(0, np.uint64)
    lengths = (words.ends - words.starts).astype(float)
    capital = _CLASSES[0][data[words.starts]]
    for k in range(n):
        a, b = int(offsets[k]), int(offsets[k + 1])
        if a == b:
            continue
        counts = np.bincount(data[a:b], minlength=256)
        share = [counts[c].sum() / (b - a) for c in _CLASSES]
        p = counts[counts > 0] / (b - a)
        f, g = int(words.first[k]), int(words.first[k + 1])
        row = [np.log1p(b - a), np.log1p(g - f)]
        if f < g:
            own, size = hashes[f:g], lengths[f:g]
            _, times = np.unique(own, return_counts=True)
            line = line_hashes[lines.first[k] : lines.first[k + 1]]
            n_pairs = g - f - 1
            row += [size.mean(), size.std(), (size > 15).mean(), *share, (g - f) / max(1, len(line)), len(times) / (g - f), times.max() / (g - f)]
            row += [(own[1:] == own[:-1]).mean() if n_pairs else 0, len(np.unique(pairs[f : g - 1])) / n_pairs if n_pairs else 1, 1 - len(np.unique(line)) / max(1, len(line)), -(p * np.log2(p)).sum(), capital[f:g].mean()]
        else:
            row += [0, 0, 0, *share] + [0] * 8
        out[k] = row
    return out


@dataclass
class Trees:
    """A forest as flat arrays: at node i go to child[i] + (x[feature[i]] > threshold[i]); leaves lead to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = self.child[at] + (x[rows, self.feature[at]] > self.threshold[at])
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 8) -> Trees:
    """Newton boosting of the logistic loss; features are binned once, at quantiles, and splits are sought on histograms."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)] if n else [np.zeros(0)] * m
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1) if n else np.zeros((0, m), int)
    mean = np.clip((y.sum() + 0.5) / (n + 1), 0.01, 0.99)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    feature, threshold, child, value, roots = [], [], [], [], []

    def leaf(v: float = 0.0) -> int:
        feature.append(0)
        threshold.append(np.inf)
        child.append(len(child))
        value.append(v)
        return len(child) - 1

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(leaf())
        open_ = [(roots[-1], np.arange(n), 0)]
        while open_:
            node, rows, level = open_.pop()
            G, H = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if level < depth and len(rows) >= 2 * least:
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    own, size = binned[rows, j], len(edges[j]) + 1
                    gs, hs, c = (np.bincount(own, w, size).cumsum()[:-1] for w in (g[rows], h[rows], None))
                    gain = gs**2 / (hs + l2) + (G - gs) ** 2 / (H - hs + l2) - G**2 / (H + l2)
                    gain[(c < least) | (len(rows) - c < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] is None:
                value[node] = -rate * G / (H + l2)
                margin[rows] += value[node]
                continue
            _, j, k = best
            low = leaf()
            high = leaf()
            feature[node], threshold[node], child[node] = j, edges[j][k], low
            right = binned[rows, j] > k
            open_ += [(low, rows[~right], level + 1), (high, rows[right], level + 1)]
    return Trees(np.array(feature, int), np.array(threshold, float), np.array(child, int), np.array(value, float), np.array(roots, int), depth, base)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(statistics(batch)), pa.list_(pa.float64()))], ["label", "x"])


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Trees = shared.value
        for whole in batches:
            for batch in slices(whole):
                score = model.score(statistics(batch))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], ["id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", bound: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most ``bound`` labelled documents (:func:`labelled.sample`).

    Executors compute the statistics; the driver gets bound * len(FEATURES) numbers. With no
    labels, or of one kind only, the model is the constant share of label 1 (1/2 with none).
    """
    rows = labelled.sample(docs, labels, label, bound, id, text).select("label", "text").mapInArrow(_features, "label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums of floats shouldn't depend on it
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for each row of ``docs``: the probability of label 1, from its whole text alone.

    Null counts as empty text, whose statistics are zeros. Rows of a repeated or null id are
    scored each for itself; other columns are not read.
    """
    key = docs.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scores(shared), f"id {key}, score double").withColumnRenamed("id", id)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score under ``least``; all columns stay, rows of null id or text are judged alike."""
    model = train(docs, labels, label, id, text)
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                own = pa.RecordBatch.from_arrays([batch.column(text)], ["text"])
                yield batch.filter(pa.array(shared.value.score(statistics(own)) >= least))

    return docs.mapInArrow(run, columns)
