"""Exact token counts at every prefix of a text, by dynamic programming over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

#: Prefixes and words whose counts are remembered before the memory starts anew.
KEPT_PREFIXES = 1_500_000
#: Words up to this length have every prefix encoded by the model; in longer ones, where that takes the square of the length, the counts are built up character by character. Both are exact.
ENCODED_LENGTH = 48
_PART = re.compile(r" ( *[^ ]*)")


class PrefixCounter:
    """Token counts of a text's prefixes for a BPE model in which no piece has a space after another character.

    Then no merge crosses from a word to the space behind it, so counts add up over words:
    count(prefix) = count(words wholly in it) + count(rest of the prefix in its last word).
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size())):
            raise ValueError("pieces cross words; prefix counts don't add up")
        ids = [i for i in range(self.model.get_piece_size()) if not (self.model.is_unknown(i) or self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.pieces = {self.model.id_to_piece(i): self.model.get_score(i) for i in ids}
        self.longest_piece = max(map(len, self.pieces))
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Each known prefix's number, its tokens behind a space, and the number of the prefix a character shorter.
        self.node: dict[str, int]
        self.forget()

    def merged(self, text: str) -> list[str]:
        """The model's merges on ``text`` alone: the best-scored adjacent pair first, the leftmost of equals."""
        out = list(text)
        while True:
            pairs = [(-score, k) for k in range(len(out) - 1) if (score := self.pieces.get(out[k] + out[k + 1])) is not None]
            if not pairs:
                return out
            k = min(pairs)[1]
            out[k : k + 2] = [out[k] + out[k + 1]]

    def beside(self, a: str, b: str) -> bool:
        """Whether the model leaves the tokens ``a`` and ``b`` apart where they meet (without ``a``: whether ``b`` is a token)."""
        n = self.pairs.get((a, b))
        if n is None:
            if len(self.pairs) >= KEPT_PREFIXES:
                self.pairs.clear()
            n = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return n

    def inside(self, part: str) -> np.ndarray:
        """Tokens of a space and then ``part[:j]``, for each j from 0 to the length of ``part``, for a long word.

        A row of tokens is the model's own if each two neighbours are, so a prefix's last token is
        the one that its start's last token may stand beside: one step for each character.
        """
        text = "▁" + part.replace(" ", "▁")
        last, counts = [""], [0]
        for i in range(1, len(text) + 1):
            for n in range(min(self.longest_piece, i), 0, -1):
                token = text[i - n : i]
                if (n == 1 or token in self.pieces) and self.beside(last[i - n], token):
                    last.append(token)
                    counts.append(counts[i - n] + (1 if token in self.pieces else len(token.encode())))
                    break
            else:
                break
        if len(counts) <= len(text) or counts[-1] != len(self.model.encode(part)):  # not merges alone (a character that the model changes): each prefix by itself
            return np.array([1, *(len(self.model.encode(part[:j])) for j in range(1, len(part) + 1))], np.int32)
        return np.array(counts[1:], np.int32)

    def learn(self, words: list[str]) -> None:
        """Enter short words and all their prefixes, with the model's own counts, each different prefix encoded once."""
        if len(self.node) > KEPT_PREFIXES:
            self.forget()
        node, wanted, ends, roots = self.node, [], [], []
        first = len(node)
        for w in words:
            if w in node:
                continue
            for j in range(len(w), -1, -1):
                prefix = w[:j]
                if prefix in node:
                    break
                node[prefix] = first + len(wanted)
                wanted.append(prefix)
            ends.append(len(wanted) - 1)
            roots.append(node[prefix])
        if wanted:
            shorter = np.arange(first + 1, first + len(wanted) + 1)
            shorter[ends] = roots
            counts = [len(ids) for at in range(0, len(wanted), 2000) for ids in self.model.encode(wanted[at : at + 2000], num_threads=1)]
            self.count = np.concatenate((self.count, np.array(counts, np.int32)))
            self.shorter = np.concatenate((self.shorter, shorter))

    def forget(self) -> None:
        """Start anew: only the empty prefix, which is a space and counts 1."""
        self.node, self.count, self.shorter = {"": 0}, np.ones(1, np.int32), np.zeros(1, np.int64)

    def tables(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cells, ends): for each word, by how much a space and each of its characters change the count; a word's cells end at ``ends``."""
        short = np.array([len(w) <= ENCODED_LENGTH for w in words], bool)
        self.learn([w for w, s in zip(words, short, strict=True) if s])
        ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
        cells = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        at, node = ends[short] - 1, np.fromiter((self.node[w] for w, s in zip(words, short, strict=True) if s), np.int64, int(short.sum()))
        while len(at):
            cells[at] = self.count[node]
            at, node = at[node > 0] - 1, self.shorter[node[node > 0]]
        for k in np.flatnonzero(~short):
            cells[ends[k] - len(words[k]) - 1 : ends[k]] = self.inside(words[k])
        steps = np.diff(cells, prepend=np.int32(0))
        steps[ends[:-1]] = cells[ends[:-1]]
        return steps, ends

    def steps(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the token count of its prefix of 0 characters, and by how much each further character changes the count."""
        parts = [_PART.findall(" " + text.replace("▁", " ")) if text else [] for text in texts]
        kinds = {w: k for k, w in enumerate(set().union(*parts))}
        cells, ends = self.tables(list(kinds))
        sizes = np.diff(ends, prepend=0)
        out = []
        for words in parts:
            if not words:
                out.append(np.zeros(1, np.int32))
                continue
            kind = np.fromiter(map(kinds.__getitem__, words), np.int64, len(words))
            size = sizes[kind]
            found = cells[np.arange(int(size.sum())) + np.repeat(ends[kind] - np.cumsum(size), size)]
            found[1:2] += found[0]  # the model puts a space before a text, but none before an empty one
            found[0] = 0
            out.append(found)
        return out


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _counts(path: str, budget: int, store: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for whole in batches:
            for batch in slices(whole):
                total, fits, tables = [], [], []
                texts = [text or "" for text in batch.column("text").to_pylist()]
                for text, steps in zip(texts, count.steps(texts), strict=True):
                    counts = np.cumsum(steps, dtype=np.int32)
                    total.append(int(counts[-1]))
                    fits.append(int(np.flatnonzero(counts <= budget)[-1]))
                    tables.append(steps if store == "steps" else counts if store == "char" else None)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(total, pa.int64()), pa.array(fits, pa.int64()), pa.array(tables, pa.list_(pa.int32()))], ["id", "n_bytes", "n_tokens", "fit_chars", name])

    return run


def prefix_counts(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", budget: int = 4096, store: str = "steps") -> DataFrame:
    """(id, n_bytes, n_tokens, fit_chars, and the table) for each row of ``docs``.

    The table of exact counts at all of the text's length + 1 prefixes is made for every text and
    answers both questions: n_tokens is its last count, fit_chars the longest prefix in characters
    of at most ``budget`` tokens. It is stored as store="steps", by how much each character changes
    the count (small numbers that Parquet keeps in a few bits each; :func:`tokens_in_prefix` adds them
    up), as "char", the counts themselves, or not at all ("none", a column of nulls).
    Null or empty text has 0 tokens. Every row, also of a repeated or null id, gets its own; very long
    texts and words are counted whole; other columns are not read. There is no shuffle; an empty table gives no rows.
    """
    if store not in ("steps", "char", "none"):
        raise ValueError("store is steps, char or none")
    key = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    name = {"steps": "steps", "char": "counts", "none": "counts"}[store]
    return rows.mapInArrow(_counts(model, budget, store, name), f"id {key}, n_bytes long, n_tokens long, fit_chars long, {name} array<int>").withColumnRenamed("id", id)


def tokens_in_prefix(counted: DataFrame, n_chars) -> DataFrame:
    """Adds ``prefix_tokens``: the count of the first ``n_chars`` characters (of the whole text if it is shorter), from the stored table."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    if "steps" in counted.columns:
        return counted.withColumn("prefix_tokens", F.aggregate(F.slice("steps", F.lit(1), n + 1), F.lit(0).cast("long"), lambda t, s: t + s))
    return counted.withColumn("prefix_tokens", F.get("counts", F.least(n, F.size("counts") - 1)))
