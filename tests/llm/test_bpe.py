"""Ids and texts of the backtracking encoder against the tokenizers library, and against merging by rank."""

import hashlib
import random

import corpus
import numpy as np
import pytest
import tokenizers
from spanloom.llm import bpe, queries

PATH = queries.vocabulary(queries.PACKING_VOCABULARY)
HOSTILE = ["", " ", "\x00\x1c\x1d ", "<|endoftext|>x <|endoftext|>", "<|endoftext|", "'s't've'll'd'S", "é‍﻿", "\U0001f468‍\U0001f469‍\U0001f467", "   \n\n\t x", "漢字かな交じり文 ١٢٣", "a" * 60_000, " " * 30_000, "ab" * 30_000, "\r\n" * 2000 + "!?" * 2000]


@pytest.fixture(scope="module")
def known():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def merged_by_rank(known, data):
    """The definition: the pair of the least rank, the leftmost first, is merged as long as there is one."""
    out = [known.encode_unit(bytes([b]))[0] for b in data]
    while True:
        found = [(known.merged[p], k) for k, p in enumerate(zip(out, out[1:], strict=False)) if p in known.merged]
        if not found:
            return out
        made, k = min(found)
        out[k : k + 2] = [made]


def test_every_token_is_its_own_encoding(known):
    special = set(known.special.values())
    assert all(known.encode_unit(piece) == [i] for i, piece in enumerate(known.tokens) if i not in special)


@pytest.mark.parametrize("alphabet", ["ab", "thetion", "0123456789", "aA!?'", "éèñü", "漢字かな", "xyz\x00\x7f"])
def test_units_against_merging_by_rank(known, alphabet):
    rng = random.Random(alphabet)
    for _ in range(300):
        data = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 24))).encode()
        assert known.encode_unit(data) == merged_by_rank(known, data)


def test_texts_against_the_library(known, library):
    rng = random.Random(5)
    texts = HOSTILE + ["".join(rng.choice("abc the\n é!?12'漢\U0001f600") for _ in range(rng.randint(0, 80))) for _ in range(2000)] + [corpus.prose(rng, 300)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert known.encode(text).tolist() == ids
        assert known.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False) == text


def test_code_points_are_cut_as_by_the_library(known, library):
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20_000):
        text = "".join(f"a{chr(c)} {chr(c)}1{chr(c)}" for c in points[k : k + 20_000])
        assert known.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_that_are_no_text(known, library):
    rng = random.Random(9)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 12))]
        assert known.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_memories_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "UNITS", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    fresh, rng = bpe.Vocabulary(PATH), random.Random(2)
    for _ in range(20):
        text = corpus.prose(rng, 30)
        assert fresh.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(fresh.memory) <= 5 and len(fresh._compatible) <= 5


def test_rows(spark, library):
    rows = [(k, t, 1) for k, t in enumerate(HOSTILE)] + [(i, t, 2) for i, t in corpus.ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    encoded = bpe.encode(docs, PATH)
    want = {(i, t or "") for i, t, _ in rows}
    found = encoded.collect()
    assert len(found) == len(rows)
    by_digest = {(i, hashlib.sha256(t.encode()).hexdigest()): library.encode(t, add_special_tokens=False).ids for i, t in want}
    for r in found:
        ids = by_digest[r.doc_id, r.decoded_sha256]
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert {(r.doc_id, r.text) for r in bpe.decode(encoded, PATH).collect()} == want
    names = spark.createDataFrame([("x", "one two"), (None, None)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_tokens) for r in bpe.encode(names, PATH, with_ids=False).collect()) == [("", 0), ("x", 2)]
    assert bpe.encode(names.limit(0), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<long>"), PATH).orderBy("doc_id").collect() == [(1, None), (2, "")]
