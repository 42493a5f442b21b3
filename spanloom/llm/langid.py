"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .shared import small
from .text import slices, utf8

#: Longest context, in bytes.
ORDER = 4
#: Documents of a language that its statistics are counted on, about.
TRAIN_DOCS = 3_000

_U = np.uint64


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of the texts in lower case, so that capitals don't look like another language."""
    return utf8(pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string()))


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, documents): each byte with its up to ``order`` bytes of context, as a number; no context crosses documents.

    The last context length is in the key's top byte; before a text lie that many zero bytes.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.zeros(len(data) + n * order, np.uint64)
    doc = np.repeat(np.arange(n), lengths)
    at = np.arange(len(data)) + (doc + 1) * order
    padded[at] = data
    key = padded[at]
    for k in range(1, order + 1):
        key = key | padded[at - k] << _U(8 * k)
    return key, doc


def at_order(keys: np.ndarray, order: int) -> np.ndarray:
    """The keys cut to a context of ``order`` bytes."""
    return keys & _U((1 << 8 * (order + 1)) - 1) | _U(order + 1) << _U(56)


class Table:
    """Vectorised look-up of 64-bit keys: cells of several hash tables, each key in the first with room for it."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.cells = np.append(keys, _U(0)), []
        self.bits = max(4, int(2 * len(keys)).bit_length())
        left, factor = np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(left):
            cell, multiplier = np.full(1 << self.bits, len(keys), np.int32), _U(factor)
            slot = keys[left] * multiplier >> _U(64 - self.bits)
            cell[slot] = left
            self.cells.append((multiplier, cell))
            left = left[cell[slot] != left]
            factor = factor * 0xD6E8FEB86659FD93 & (1 << 64) - 1 | 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row; the number of keys where it isn't in the table."""
        missing = len(self.keys) - 1
        out, open_ = np.full(len(keys), missing, np.int64), np.arange(len(keys))
        for multiplier, cell in self.cells:
            own = keys[open_]
            row = cell[own * multiplier >> _U(64 - self.bits)]
            hit = (row != missing) & (self.keys[row] == own)
            out[open_[hit]] = row[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class Model:
    """Frozen statistics: the bits that each language's context tree needs for a byte after its context.

    Escape method C: after a context seen n times with q different continuations a language gives
    a continuation seen c times c / (n + q) and the escape to the context shorter by a byte
    q / (n + q); below the empty context all 256 bytes are alike. A context that a language never saw is
    left without cost. ``cost[row]`` is the complete cost (escapes included) of a
    continuation that some language saw; where none did, ``escape[context]`` is paid and the next
    shorter context asked.
    """

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], order: int):
        """counts: for each order from 0, keys of :func:`at_order` and an array of counts by language."""
        self.languages, self.order, self.levels = languages, order, []
        n_langs, below = len(languages), None
        for k, (keys, seen) in enumerate(counts):
            context = keys >> _U(8) & _U((1 << 48) - 1)
            names, row = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(names), n_langs)), np.zeros((len(names), n_langs))
            np.add.at(total, row, seen)
            np.add.at(kinds, row, seen > 0)
            known = total > 0
            escape = np.where(known, -np.log2(np.where(known, kinds / np.maximum(total + kinds, 1), 1)), 0)
            shorter = np.full((len(keys), n_langs), 8.0) if below is None else below(at_order(keys, k - 1))
            own = seen > 0
            cost = np.where(own, -np.log2(np.where(own, seen / np.maximum(total + kinds, 1)[row], 1)), escape[row] + shorter)
            self.levels.append((Table(keys), cost.astype(np.float32), Table(names | _U(k + 1) << _U(56)), escape.astype(np.float32)))
            below = self.costs_to(k)

    def costs_to(self, order: int):
        def costs(keys: np.ndarray) -> np.ndarray:
            out, open_ = np.zeros((len(keys), len(self.languages)), np.float32), np.arange(len(keys))
            for k in range(order, -1, -1):
                table, cost, contexts, escape = self.levels[k]
                own = at_order(keys[open_], k)
                row = table.find(own)
                hit = row < len(cost)
                out[open_[hit]] += cost[row[hit]]
                open_, own = open_[~hit], own[~hit]
                if not len(open_):
                    return out
                row = contexts.find(own >> _U(8) & _U((1 << 48) - 1) & _U((1 << 8 * k) - 1) | _U(k + 1) << _U(56))
                known = row < len(escape)
                out[open_[known]] += escape[row[known]]
            out[open_] += 8
            return out

        return costs

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if len(data):
            keys, doc = grams_of(data, offsets, self.order)
            # repeated grams of a slice are looked up once
            kinds, which = np.unique(keys, return_inverse=True)
            costs = self.costs_to(self.order)(kinds)
            for j in range(len(self.languages)):
                out[:, j] = np.bincount(doc, costs[which, j], len(offsets) - 1)
        return out


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, offsets = folded(batch.column("text"))
                keys, doc = grams_of(data, offsets, order)
                lang = np.array(batch.column("lang").to_pylist(), object)
                for name in sorted(set(lang)):
                    own = keys[np.isin(doc, np.flatnonzero(lang == name))]
                    kinds, count = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(kinds), pa.string()), pa.array(kinds.view(np.int64)), pa.array(count, pa.int64())], ["lang", "gram", "n"])

    return run


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, docs_per_language: int = TRAIN_DOCS) -> Model:
    """Statistics of each language in ``lang``, counted on the executors.

    Only rows with id, text and lang outside the held-out third (:func:`labelled.held_out`)
    count; of a language with more than ``docs_per_language`` such rows about that many do, chosen
    by the hash of the id. All their counts are kept, those of 1 too, as the escapes rest on them: the driver
    gets the distinct (order + 1)-byte strings of the sample, whose number its size bounds. An empty
    table, or one without languages, gives a model that knows none.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id is not null and text is not null and lang is not null").where(~labelled.held_out("id"))
    share = rows.groupBy("lang").agg((F.lit(float(docs_per_language)) / F.count("*")).alias("share"))
    chosen = rows.join(small(share, 64), "lang").where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    counted = chosen.select("lang", "text").mapInArrow(_counts(order), "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    gram = got.column("gram").to_numpy().view(np.uint64)
    column = np.searchsorted(names, got.column("lang").to_numpy().astype(str)) if names else np.zeros(0, int)
    n, counts = got.column("n").to_numpy(), []
    for k in range(order + 1):
        keys, row = np.unique(at_order(gram, k), return_inverse=True)
        seen = np.zeros((len(keys), len(names)))
        np.add.at(seen, (row, column), n)
        counts.append((keys, seen))
    return Model(names, counts, order)


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for whole in batches:
            for batch in slices(whole):
                data, offsets = folded(batch.column("text"))
                bits = model.bits(data, offsets)
                latin = np.concatenate(([0], np.cumsum(_LETTER[data])))[offsets]
                texts = batch.column("text")
                letters = [b > a or any(map(str.isalpha, texts[k].as_py() or "")) for k, (a, b) in enumerate(zip(latin[:-1], latin[1:], strict=True))]
                names, scores = [], []
                for k, has in enumerate(letters):
                    if not has or not model.languages:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    best = int(bits[k].argmin())
                    names.append(model.languages[best])
                    scores.append(float(1 / np.exp2(np.minimum(bits[k].min() - bits[k], 0)).sum()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of ``docs``, from its whole text alone.

    lang_pred is the language with the shortest code (the first by name of equals) and score its
    posterior probability with all languages alike before. A null text or one without a letter is
    ``und`` with score 0, as is every text if no language was learned. Rows of a repeated or null id
    are judged each for itself; other columns are not read.
    """
    key = docs.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(shared), f"id {key}, lang_pred string, score double").withColumnRenamed("id", id)
