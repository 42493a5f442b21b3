"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import corpus
import pytest
from spanloom.llm import spelling


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows):
    n = counted(rows)
    close = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(close[w]), form[w] and n[form[w]]) for w in n}


def corpus_of(seed, documents=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 12))) for _ in range(40)]
    rows = []
    for i in range(documents):
        picked = []
        for w in rng.choices(base, [1 / (1 + k) for k in range(40)], k=200):
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k:], w[:k] + rng.choice("abÉ") + w[k + 1 :]])
            picked.append(rng.choice([w, w.upper(), w.capitalize()]))
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(picked)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus_of(seed) + corpus.ODD + [(None, "Straßen×÷Strassen " * 9)]
    rows.append((5000, "zzabcdef " * 150 + "zzabcdex " * 30 + "zzabcdexy " * 6))  # a form of a form
    found = spelling.variants(spark.createDataFrame(corpus.clashing(rows), corpus.CLASHING)).collect()
    want = brute(rows)
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] not in (None, w[2]) for w in want)


@pytest.mark.parametrize("frequent", [set(), {"aa", "ab", "ba"}, {x + y for x in "ab" for y in "ab"}])
def test_words_one_edit_apart_share_a_list(frequent):
    """Every pair of near words over two letters; with lists that no edit can have touched."""
    rng = random.Random(4)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 12)))
        k = rng.randrange(len(a) + 1)
        b = rng.choice([a[:k] + rng.choice("ab") + a[k:], a[:k] + rng.choice("abc") + a[k + 1 :]])
        if len(b) >= 6 and one_edit(a, b):
            shared = spelling.unaffected(a, frequent) & spelling.unaffected(b, frequent)
            assert any(size == max(len(a), len(b)) and (before or behind) for size, before, behind in shared)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 12)))
        assert all(before or behind for _, before, behind in spelling.unaffected(a, frequent))


def test_grams():
    assert spelling.grams("abcdef", set()) == [(0, 2), (1, 3), (2, 4), (3, 5), (4, 6)]
    assert spelling.grams("abcdef", {"ab", "cd", "ef"}) == [(0, 3), (2, 5), (4, 6)]


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    found = spelling.variants(spark.createDataFrame([("x", "lonelyword " * 5), ("y", None)], "doc_id string, text string"))
    assert [tuple(r) for r in found.collect()] == [("lonelyword", None, "lonelyword", 5, 0, None)]
