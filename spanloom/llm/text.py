"""Vectorised word handling over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; one longer text is a pass of its own.
SLICE_BYTES = 2 << 20
#: Bytes of text that are hashed at a time, as that takes some 40 bytes for each; one longer word is hashed alone.
HASH_BYTES = 256 << 10

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_WEIGHTS = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) * _U(2) + _U(1)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by bytes of ``column``, so that working memory doesn't follow the batch's size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(sizes):
        base = total[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(first, end - first)
        first = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of several texts: maximal runs of bytes outside ``apart``; none spans two texts.

    ``starts``/``ends`` are byte positions, ``doc`` the text of each word, ``first`` has for each
    text its first word's number (and the total at its end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE):
        inside = ~apart[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(data) else inside
        after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(data) else inside
        self.data, self.offsets, self.inside = data, offsets, inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.zeros(len(self.starts), np.uint64)
        edges = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.data), HASH_BYTES)), len(out))).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            span = slice(self.starts[a], self.ends[b - 1])
            lengths = self.ends[a:b] - self.starts[a:b]
            heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            at = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
            weight = _WEIGHTS[at & 4095]
            if lengths.max() > 4096:
                weight = weight * (_U(2) * (at >> 12).astype(np.uint64) + _U(1))
            total = np.add.reduceat((self.data[span][self.inside[span]].astype(np.uint64) + _U(1)) * weight, heads)
            out[a:b] = mix(total + lengths.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position (the last n - 1 positions have none)."""
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def shingle_sets(words: Words, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-word shingles; with fewer words the whole sequence is one, without words none."""
    all_grams, sets = grams(hashes, n) if len(hashes) >= n else np.zeros(0, np.uint64), []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            sets.append(np.unique(all_grams[a : b - n + 1]))
        elif b > a:
            sets.append(grams(hashes[a:b], int(b - a)) + _U(b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
