"""Byte-level BPE: exact ids by backtracking over longest matches, and text again through an offset table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import byte_alphabet
from .text import slices

#: Units that are encoded one by one (fixed value of the public vocabulary), with white space as Unicode has it.
_S = r"\p{White_Space}"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?![^{_S}])|{_S}+"
#: A task remembers so many units of up to so many bytes, and so many pairs of tokens; beyond them its memories start anew.
UNITS, UNIT_BYTES, PAIRS = 800_000, 48, 1_000_000


class Vocabulary:
    """Tokens of a tokenizers .json file whose ids are 256 bytes, then one id a merge in the order of merges.

    An Aho-Corasick automaton over reversed tokens finds, in one pass over a reversed text, the longest token that
    begins at each byte. ``shorter`` holds for each token the longest token that is a proper start of it, ``halves`` the two
    tokens that it was merged from.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        ids = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for piece, i in ids.items():
            self.tokens[i] = piece
        for piece, i in self.special.items():
            self.tokens[i] = piece.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.halves = [(i, i) for i in range(len(self.tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            pair = tuple(ids[bytes(alphabet[c] for c in half)] for half in (left, right))
            made = ids[self.tokens[pair[0]] + self.tokens[pair[1]]]
            if made != 256 + rank:
                raise ValueError("ids have to follow the order of merges")
            self.merged[pair], self.halves[made] = made, pair
        self.shorter = [next((ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in ids), -1) for piece in self.tokens]
        self.longest = ahocorasick.Automaton()
        for piece, i in ids.items():
            self.longest.add_word(piece[::-1].decode("latin-1"), i)
        self.longest.make_automaton()
        self.unit = regex.compile(PATTERN)
        self.sizes = [*map(len, self.tokens)]
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._compatible: dict[tuple[int, int], bool] = {}
        self.memory = _Memory(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves both tokens as they are when one follows the other.

        Undoes the merges on both sides of their border, the latest first: a merge across it that comes before the last one undone
        would have taken place.
        """
        a, b, limit, fits = left, right, len(self.tokens), True
        while True:
            if self.merged.get((a, b), limit) < limit:
                fits = False
                break
            # the younger token was made last, of equal ones the right; a merge across of the right one's own kind stands left of it, so came first
            if a > b and a >= 256:
                limit, a = a, self.halves[a][1]
            elif b >= 256:
                limit, b = b + 1, self.halves[b][0]
            else:
                break
        if len(self._compatible) >= PAIRS:
            self._compatible.clear()
        self._compatible[left, right] = fits
        return fits

    def encode_unit(self, data: bytes) -> list[int]:
        """Ids of one unit's bytes, in time linear in their number.

        The longest token at each place is tried and shortened until it fits beside the token before it; a place from which no
        token fits is marked, and the token that led there shortened. No place is marked twice.
        """
        n, sizes, pairs = len(data), self.sizes, self._compatible
        # of the matches at one place the longest comes first, so written last it stays
        at = dict([*self.longest.iter(data[::-1].decode("latin-1"))][::-1])
        dead, out, place, token, last = set(), [], 0, at[n - 1] if n else -1, -1
        while place < n:
            while token >= 0:
                end = place + sizes[token]
                if end not in dead and (last < 0 or (pairs[last, token] if (last, token) in pairs else self.compatible(last, token))):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                place, last = end, token
                token = at[n - 1 - place] if place < n else -1
            else:
                dead.add(place)
                token = out.pop()
                place -= sizes[token]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers; strings of special tokens in it are those tokens."""
        out, known = [], self.memory
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += map(known.__getitem__, self.unit.findall(part))
        return np.frombuffer(b"".join(out), "<u4")

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum([0, *self.sizes])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included: bytes between the offsets of each id in one table; what isn't UTF-8 becomes U+FFFD."""
        data, offsets = self._table
        ids = np.asarray(ids, np.int64)
        lengths = offsets[ids + 1] - offsets[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[ids] - ends + lengths, lengths)
        return data[at].tobytes().decode("utf-8", "replace")


class _Memory(dict):
    """Encoded units: text to the bytes of its ids."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, unit: str) -> bytes:
        data = unit.encode("utf-8", "surrogatepass")
        ids = np.array(self.vocabulary.encode_unit(data), "<u4").tobytes()
        if len(data) <= UNIT_BYTES:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = ids
        return ids


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once a worker."""
    return Vocabulary(path)


def _coded(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text in batch.column("text").to_pylist():
                    ids = known.encode(text or "")
                    rows.append((len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(known.decode(ids).encode()).hexdigest(), ids if with_ids else None))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return run


def encode(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Each row's token ids and digests of them and of the text that they decode to: (id, n_tokens, ids_sha256, decoded_sha256, ids).

    Nothing is shuffled; a task holds the vocabulary, its two bounded memories and 2 MB of text or one longer text. A null or empty
    text has no ids. Rows of a repeated or null id are encoded each for itself, very long words in linear time; other
    columns are not read, and an empty table gives no rows.
    """
    key = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(_coded(tokenizer, with_ids), f"id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<long>")
    out = out.withColumnRenamed("id", id)
    return out if with_ids else out.drop("ids")


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            texts = [None if ids is None else known.decode(np.array(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode(encoded: DataFrame, tokenizer: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give a null text, none an empty one."""
    key = encoded.schema[id].dataType.simpleString()
    return encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids")).mapInArrow(_texts(tokenizer), f"id {key}, text string").withColumnRenamed("id", id)
