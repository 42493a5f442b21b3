"""Benchmark decontamination with an FM-index over each shard of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, save, unused
from .text import LOWER, Words, slices, utf8

#: Bytes that aren't part of a word: all of ASCII but digits and lower-case letters (texts are lower-cased before).
APART = np.ones(256, bool)
APART[48:58] = APART[97:123] = APART[128:] = False
#: Bytes of benchmark text searched in one pass; a larger benchmark is searched in several.
BLOCK_BYTES = 4 << 20
#: Text positions whose place in the suffix order an index keeps: one in so many.
SAMPLED = 8
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20


class Phrases:
    """The windows of benchmark items, in packed arrays: for each window length the distinct windows, as numbers of the items' distinct words, and the items that have them."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        raw = [text.encode() for _, text in items]
        words = Words(LOWER[np.frombuffer(b"".join(raw), np.uint8)], np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))), APART)
        self.vocabulary, number = np.unique(words.hashes(), return_inverse=True)
        number = number.astype(np.int32)
        lengths = np.diff(words.first)
        self.names, self.windows = [name for name, _ in items], []
        for n in np.unique(np.minimum(lengths[lengths > 0], size)).tolist():
            own = lengths >= size if n == size else lengths == n
            places = np.where(own, lengths - n + 1, 0)
            item = np.repeat(np.arange(len(items), dtype=np.int32), places)
            at = np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(places)[:-1])), places) + np.arange(int(places.sum()))
            rows = np.ascontiguousarray(number[at[:, None] + np.arange(n)])
            _, first, which = np.unique(rows.view(f"V{4 * n}").ravel(), return_index=True, return_inverse=True)
            pair = np.unique(which.astype(np.int64) * len(items) + item)
            self.windows.append((n, rows[first], np.searchsorted(pair // len(items), np.arange(len(first) + 1)), (pair % len(items)).astype(np.int32)))


class WaveletRanks:
    """Occurrences of a symbol before a position, from one bit vector per binary digit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(size - 1).bit_length())
        for k in reversed(range(self.bits)):
            bit = (symbols >> k & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 - len(bit) % 64, bool))), bitorder="little").view(np.uint64)
            self.levels.append((packed, np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        self.base = self.move(np.arange(size), np.zeros(size, np.int64))

    @staticmethod
    def ones(level: tuple, at: np.ndarray) -> np.ndarray:
        packed, before = level
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(packed[at >> 6] & below).astype(np.int64)

    def move(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = self.ones(level, at)
            at = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.move(symbol, at) - self.base[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit = (level[0][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self.ones(level, at)
            at = np.where(bit, zeros + ones, at - ones)
            symbol = symbol * 2 + bit
        return symbol, at - self.base[symbol]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that begin there; the last symbol occurs once and is the smallest.

    Prefix doubling: suffixes in order by their first h symbols are put in order by 2h with the ranks
    of the suffixes h further on. Only those that still share a rank are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank, sorted_by = np.empty(n, np.int64), 1
    head = np.concatenate(([True], symbols[order][1:] != symbols[order][:-1]))
    while True:
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(open_):
            return order
        at = order[open_]
        behind = at + sorted_by
        key = rank[at] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[open_], key = at[by], key[by]
        head[open_] = np.concatenate(([True], key[1:] != key[:-1]))
        sorted_by *= 2


class FMIndex:
    """An FM-index of a symbol sequence whose last symbol occurs once and is the smallest."""

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        order = suffix_order(symbols)
        self.n, self.ranks = n, WaveletRanks(symbols[order - 1], size)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size))))
        kept = order % SAMPLED == 0
        packed = np.packbits(np.concatenate((kept, np.zeros(64 - n % 64, bool))), bitorder="little").view(np.uint64)
        self.marks = packed, np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
        self.places = order[kept].astype(np.int32)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``patterns`` the range of suffixes that begin with it."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in reversed(range(patterns.shape[1])):
            symbol, open_ = patterns[:, k], np.flatnonzero(low < high)
            if not len(open_):
                break
            s = symbol[open_]
            low[open_] = self.before[s] + self.ranks.rank(s, low[open_])
            high[open_] = self.before[s] + self.ranks.rank(s, high[open_])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back until a row whose position is kept."""
        out, steps, at = np.full(len(rows), -1, np.int64), 0, rows.copy()
        left, packed = np.arange(len(rows)), self.marks[0]
        while len(left):
            known = (packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out[left[known]] = self.places[WaveletRanks.ones(self.marks, at[known])] + steps
            left, at = left[~known], at[~known]
            if len(left):
                symbol, rank = self.ranks.access(at)
                at, steps = self.before[symbol] + rank, steps + 1
        return out


class Shard:
    """A shard of texts with an FM-index over all its words, which any set of phrases can be searched in.

    Symbols are the numbers (from 2) of the shard's distinct words; a 1 stands behind each text, so
    that no occurrence spans two.
    """

    def __init__(self, words: Words):
        self.vocabulary, number = np.unique(words.hashes(), return_inverse=True)
        ends = words.first[1:]
        self.index = FMIndex(np.append(np.insert(number + 2, ends, 1), 0).astype(np.int32), len(self.vocabulary) + 2)
        self.word_at = np.append(np.insert(np.arange(len(number)), ends, -1), -1)

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of words, phrase) of every occurrence of a window."""
        none = np.zeros(0, np.int64)
        starts, sizes, rows, base = [none], [none], [none], 0
        symbol = np.zeros(len(phrases.vocabulary), np.int64)
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, phrases.vocabulary), len(self.vocabulary) - 1)
            symbol = np.where(self.vocabulary[at] == phrases.vocabulary, at + 2, 0)
        for n, windows, _, _ in phrases.windows:
            patterns = symbol[windows]
            whole = np.flatnonzero((patterns > 0).all(1))  # a word that the shard lacks has no occurrence
            low, high = self.index.search(patterns[whole])
            found = np.flatnonzero(low < high)
            count = (high - low)[found]
            suffix = np.repeat(low[found], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            starts.append(self.word_at[self.index.locate(suffix)])
            sizes.append(np.full(len(suffix), n))
            rows.append(np.repeat(whole[found], count) + base)
            base += len(windows)
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(rows)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _found(phrases: Phrases, shard: Shard, words: Words, spans: dict[int, list], items: dict[int, set]) -> None:
    """Add the occurrences of a block of items in a shard to each text's ``spans`` and the item ids in ``items``."""
    # of the windows of all lengths in a row, the range of each one's items
    items_of = np.concatenate([np.zeros(0, np.int32), *(items for *_, items in phrases.windows)])
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(first) for _, _, first, _ in phrases.windows)])
    ends = np.cumsum(sizes)
    start, size, row = shard.occurrences(phrases)
    for d, a, n, r in zip(words.doc[start].tolist(), start.tolist(), size.tolist(), row.tolist(), strict=True):
        spans.setdefault(d, []).append((a, a + n))
        items.setdefault(d, set()).update(phrases.names[k] for k in items_of[ends[r] - sizes[r] : ends[r]].tolist())


def _hits(shared: list):
    """Spans and items of each text: an index is built once a shard and searched for all blocks of ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=SHARD_BYTES):
                data, offsets = utf8(batch.column("text"))
                words = Words(LOWER[data], offsets, APART)
                shard, spans, items = Shard(words), {}, {}
                for block in shared:
                    _found(block.value, shard, words, spans, items)
                    if len(shared) > 1:  # a worker holds one block at a time, and reads it again from its own disk
                        vars(block).pop("_value", None)
                columns = {k: [] for k in ("word_spans", "byte_spans", "items")}
                for d in range(batch.num_rows):
                    merged = _merge(spans.get(d, []))
                    first, zero = int(words.first[d]), int(offsets[d])
                    columns["word_spans"].append([{"a": a - first, "b": b - first} for a, b in merged])
                    columns["byte_spans"].append([{"a": int(words.starts[a]) - zero, "b": int(words.ends[b - 1]) - zero} for a, b in merged])
                    columns["items"].append(sorted(items.get(d, ())))
                span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.diff(words.first), pa.int64()), pa.array(columns["word_spans"], span), pa.array(columns["byte_spans"], span), pa.array(columns["items"], pa.list_(pa.string()))],
                    ["id", "n_words", *columns],
                )

    return run


def blocks(benchmark: DataFrame, id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of at most ``limit`` bytes of text (or of one longer item)."""
    block, size = [], 0
    for row in benchmark.select(F.col(id).cast("string"), F.col(text)).where(F.col(id).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        own = len(row[1].encode())
        if block and size + own > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += own
    yield block


def hits(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, spans, items) for each row of ``docs``.

    Words are maximal runs of digits, lower-cased A-Z and characters beyond ASCII. A window is
    ``window`` consecutive words of an item, or a shorter item as a whole. ``spans`` has the
    merged byte ranges [a, b) of all occurrences, n_hit the words in them, ``items`` the sorted
    ids of the items that occur. Null or empty texts have no words; items of null id or text are no items; with no
    items nothing is hit. Other columns of either table are not read.

    A task builds an FM-index over all words of its documents, shard by shard, and searches it backwards for all
    windows of a block of items, which reaches it as a broadcast of bounded size (packed arrays of some 60 bytes a
    word, so 4 MB of text make about 50 MB). A benchmark of more than one block is searched block by block in
    the same index, one block in memory at a time; ``docs`` is read once and never shuffled.
    """
    key = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    span, context = "array<struct<a:bigint,b:bigint>>", docs.sparkSession.sparkContext
    shared = [context.broadcast(Phrases(block, window)) for block in blocks(benchmark, item_id, item_text, block_bytes)]
    out = rows.mapInArrow(_hits(shared), f"id {key}, n_words bigint, word_spans {span}, byte_spans {span}, items array<string>")
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    return out.select(F.col("id").alias(id), "n_words", n_hit.alias("n_hit"), F.col("byte_spans").alias("spans"), "items")


def contaminated(found: DataFrame):
    """The contamination rule: a hit, and at least one word in twenty hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that the rule calls contaminated; a null id is compared as a value.

    Rows that repeat an id go together if one of them is contaminated. A null or empty text stays, as does every
    document without a benchmark; columns of any name stay as they are. The ids that go are written before anything is
    joined: as long as they are few enough for a broadcast, no document is shuffled.
    """
    found, name = hits(docs, benchmark, id, text), unused(docs, "_gone")
    gone = save(found.where(contaminated(found)).select(F.col(id).alias(name)).distinct(), "gone")
    size = gone.select(F.sum(F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 64)).first()[0] or 0
    return docs.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, F.col(id).eqNullSafe(F.col(name)), "left_anti")
