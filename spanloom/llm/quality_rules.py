"""Quality rules: fixed thresholds on counts, then a calibrated logistic regression on hashed n-grams."""

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
TRAIN_ROWS = 3_000
#: Cells that n-grams are hashed into.
CELLS = 1 << 16
#: Lengths of word and of character n-grams.
WORD_GRAMS, CHAR_GRAMS = (1, 2), (3, 4)
#: Fixed thresholds.
LEAST_WORDS, MOST_REPEATED_PERCENT, LEAST_PROBABILITY, REPEAT_WINDOW = 10, 20, 0.5, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def counts(data: np.ndarray, offsets: np.ndarray, words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    out = {"n_words": np.diff(words.first), "word_chars": _sums(words.inside & (data & 0xC0 != 0x80), offsets), "n_symbols": _sums(_SYMBOL[data], offsets), "n_dup_lines": np.zeros(n, np.int64), "n_repeat_words": np.zeros(n, np.int64)}
    lines = Words(data, offsets, _LINE)
    line_hashes = lines.hashes()
    has_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    windows = grams(hashes, REPEAT_WINDOW) if len(hashes) >= REPEAT_WINDOW else np.zeros(0, np.uint64)
    for k in range(n):
        own = line_hashes[lines.first[k] : lines.first[k + 1]][has_word[lines.first[k] : lines.first[k + 1]]]
        out["n_dup_lines"][k] = len(own) - len(np.unique(own))
        a, b = int(words.first[k]), int(words.first[k + 1])
        if b - a > REPEAT_WINDOW:
            _, which, times = np.unique(windows[a : b - REPEAT_WINDOW + 1], return_inverse=True, return_counts=True)
            again = np.zeros(b - a + 1, np.int64)
            starts = np.flatnonzero(times[which] > 1)
            np.add.at(again, starts, 1)
            np.add.at(again, starts + REPEAT_WINDOW, -1)
            out["n_repeat_words"][k] = (np.cumsum(again)[:-1] > 0).sum()
    return out


def cells_of(batch: pa.RecordBatch, words: Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, documents) of each kind of n-gram of a batch's texts; none crosses texts."""
    shift = np.uint64(64 - CELLS.bit_length() + 1)
    for n in WORD_GRAMS:
        if len(hashes) >= n:
            inside = words.doc[: len(hashes) - n + 1] == words.doc[n - 1 :]
            yield (grams(hashes + np.uint64(n), n)[inside] >> shift).astype(np.int64), words.doc[n - 1 :][inside]
    texts = [t or "" for t in batch.column("text").to_pylist()]
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) if any(texts) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for n in CHAR_GRAMS:
        if len(chars) >= n:
            inside = doc[: len(chars) - n + 1] == doc[n - 1 :]
            yield (grams(chars + np.uint64(n << 24), n)[inside] >> shift).astype(np.int64), doc[n - 1 :][inside]


@dataclass
class Regression:
    """P(label 1) = 1 / (1 + exp(-(slope * raw + offset))), raw being the mean weight of a text's n-grams, kind by kind."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def raw(self, batch: pa.RecordBatch, words: Words, hashes: np.ndarray) -> np.ndarray:
        out = np.full(batch.num_rows, self.bias)
        for cells, doc in cells_of(batch, words, hashes):
            out += np.bincount(doc, self.weights[cells], batch.num_rows) / np.maximum(np.bincount(doc, minlength=batch.num_rows), 1)
        return out

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -500, 500)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            data, offsets = utf8(batch.column("text"))
            words = Words(data, offsets)
            kinds = [(cells, doc, np.bincount(doc, minlength=batch.num_rows)) for cells, doc in cells_of(batch, words, words.hashes())]
            cells: list = []
            shares: list = []
            for k in range(batch.num_rows):
                own = [(c[slice(*np.searchsorted(d, (k, k + 1)))], m[k]) for c, d, m in kinds]
                all_cells = np.concatenate([c for c, _ in own]) if own else np.zeros(0, np.int64)
                share = np.concatenate([np.full(len(c), 1 / max(m, 1)) for c, m in own]) if own else np.zeros(0)
                kind, which = np.unique(all_cells, return_inverse=True)
                cells.append(kind.astype(np.int32))
                shares.append(np.bincount(which, share, len(kind)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(cells, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["id", "label", "cells", "shares"])


def _descend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam."""
    x, m, v = start, np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x


def fit(cells: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, steps: int = 60, rate: float = 1.0, l2: float = 1e-6) -> Regression:
    """Weights on three quarters of the rows, then slope and offset (Platt's calibration) on the fourth."""
    n = len(y)
    mean = (y.sum() + 1) / (n + 2)
    if not 0 < y.sum() < n:
        return Regression(np.zeros(CELLS), 0.0, 0.0, float(np.log(mean / (1 - mean))))
    flat, value = np.concatenate(cells).astype(np.int64), np.concatenate(shares).astype(float)
    row = np.repeat(np.arange(n), [len(c) for c in cells])
    fold = np.arange(n) % 4 != 3
    weight = np.where(fold, 1 / fold.sum(), 0)

    def gradient(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat] * value, n) + w[-1], -50, 50)))
        d = weight * (p - y)
        return np.append(np.bincount(flat, d[row] * value, CELLS) + l2 * w[:-1], d.sum())

    w = _descend(gradient, np.zeros(CELLS + 1), steps, rate)
    raw = np.bincount(row, w[flat] * value, n) + w[-1]
    z, rest = raw, ~fold
    target = np.where(y == 1, (y[rest].sum() + 1) / (y[rest].sum() + 2), 1 / ((1 - y[rest]).sum() + 2))

    def platt(x: np.ndarray) -> np.ndarray:
        d = (1 / (1 + np.exp(-np.clip(x[0] * z + x[1], -50, 50))) - target)[rest]
        return np.array([(d * z[rest]).mean(), d.mean()])

    slope, offset = _descend(platt, np.array([1.0, 0.0]), 400, 0.05)
    return Regression(w[:-1], float(w[-1]), max(float(slope), 1e-3), float(offset))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", bound: int = TRAIN_ROWS) -> Regression:
    """A regression fitted on at most ``bound`` labelled documents (:func:`labelled.sample`).

    The driver gets their hashed counts, a bounded number of sparse rows. With no labels, or of
    one kind only, the probability is the constant share of label 1 (1/2 with none).
    """
    taken = labelled.sample(docs, labels, label, bound, id, text)
    kind = taken.schema["id"].dataType.simpleString()
    rows = taken.mapInArrow(_features, f"id {kind}, label int, cells array<int>, shares array<float>").toArrow().sort_by("id")
    lists = {c: [x.values.to_numpy(zero_copy_only=False) for x in rows.column(c)] for c in ("cells", "shares")}
    return fit(lists["cells"], lists["shares"], np.array(rows.column("label").to_pylist(), float))


def _judge(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Regression = shared.value
        for whole in batches:
            for batch in slices(whole):
                data, offsets = utf8(batch.column("text"))
                words = Words(data, offsets)
                hashes = words.hashes()
                base = counts(data, offsets, words, hashes)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"])
                p = model.probability(model.raw(batch, words, hashes))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v) for v in base.values()), pa.array(failed), pa.array(~failed & (p >= least)), pa.array(p)], ["id", *base, "base_failed", "kept", "probability"])

    return run


def judge(docs: DataFrame, model: Regression, id: str = "doc_id", text: str = "text", least: float = LEAST_PROBABILITY) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) for each row.

    base_failed: fewer than 10 words, or over 20 % of the words in five-word windows found twice
    or more. kept: not base_failed, and the calibrated probability reaches ``least``. A null or
    empty text has no words, so fails. Rows of a repeated or null id are judged each for itself;
    other columns are not read. One pass over whole texts in Arrow batches, without a shuffle.
    """
    key = docs.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_judge(shared, least), f"id {key}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double").withColumnRenamed("id", id)
