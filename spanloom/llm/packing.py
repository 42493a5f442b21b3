"""Packing token ids into sequences by power-of-two pieces."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

#: Splits text into the units that a byte-level BPE encodes one by one (fixed value of the public vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: tiktoken's pattern engine keeps a state for every white-space character of a run and gives up near a million of them.
_LONG_SPACE = re.compile(r"\s{1000}")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level BPE's vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@cache
def library(path: str) -> tokenizers.Tokenizer:
    """The tokenizers library's own model of the file."""
    out = tokenizers.Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """A byte-level BPE of a tokenizers .json file, whose ids are its merge ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, special = byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids that the tokenizers library gives ``text``, without added special tokens.

    tiktoken merges by the same ranks in a quarter of the time; texts with a run of a thousand
    white-space characters, on which its pattern may fail, go to the library itself.
    """
    if _LONG_SPACE.search(text):
        return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return encoder(path).encode_to_numpy(text, allowed_special="all")


def piece_lengths(n: int, limit: int) -> np.ndarray:
    """n as full pieces of ``limit`` (a power of two) and the binary digits of the rest, longest first."""
    rest = n % limit
    return np.array([limit] * (n // limit) + [1 << k for k in reversed(range(limit.bit_length())) if rest >> k & 1], np.int64)


def _pieces(path: str, limit: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out: dict[str, list] = {k: [] for k in ("id", "start", "length", "crc", "total", "ids")}
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.append(token_ids(path, text or ""), np.uint32(end_id)).astype("<u4")
                    start = 0
                    for n in piece_lengths(len(ids), limit).tolist():
                        piece = ids[start : start + n]
                        for k, v in zip(out, (key, start, n, zlib.crc32(piece.tobytes()), len(ids), piece if with_ids else None), strict=True):
                            out[k].append(v)
                        start += n
                kinds = (batch.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                for at in range(0, len(out["id"]), 20000):
                    yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 20000], kind) for v, kind in zip(out.values(), kinds, strict=True)], list(out))

    return run


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", limit: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of every document's ids, each of them a sequence of its own whose length is a power of two.

    A document's ids (``end_id`` after the last; null text counts as empty, so has that id alone)
    are cut into full pieces of ``limit`` and the binary digits of the rest: no sequence needs
    padding or crosses documents, and a document has at most log2(limit) short pieces. Every task
    lays its sequences of one length together, as the bucket of that length: rows come out bucket by
    bucket, so that whole batches of equal length can be cut from each partition. There is no
    shuffle (the sort spills), and memory follows the longest document. Very long texts and long runs of
    white space are packed whole. Rows with a repeated or null id are packed each for itself; other
    columns are not read; an empty table gives no pieces.

    Returns id, start, length, ids_crc32, doc_tokens, sequence_id (unique), offset (0), bucket (the
    length) and, with ``with_ids``, the ids.
    """
    if limit & (limit - 1):
        raise ValueError("limit is a power of two")
    key = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, limit, end_id, with_ids), f"id {key}, start long, length long, crc long, total long, ids array<long>")
    out = rows.sortWithinPartitions("length").select(F.col("id").alias(id), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"), "ids")
    return out if with_ids else out.drop("ids")
