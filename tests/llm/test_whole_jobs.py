"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
from spanloom.llm import passages, tokencount
from spanloom.llm.queries import COUNTING_VOCABULARY, vocabulary


def test_equal_paragraphs_meet_behind_a_common_head(spark):
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(0, 4000, 100):
        start = some(14)
        rows += [(k + j, start + some(4)) for j in range(20)]
        copy = start + some(4)
        rows += [(k + 50, copy), (k + 60, copy), (k + 70, copy[:-1] + ["last"])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = {(r.doc_id, r.first_word, r.n_words, r.kept_id) for r in passages.repeated(docs).collect()}
    assert got == {(k + j, 0, 18, k + 50) for k in range(0, 4000, 100) for j in (60, 70)}


def test_near_copied_and_short_lines_are_found_whole(spark):
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(0, 2000, 100):
        long, short, block = some(60), some(20), [some(12) for _ in range(5)]
        other, wrapped = list(long), [list(x) for x in block]
        other[30], wrapped[2][6] = "changed", "changed"
        for i, parts in ((k, (long, short)), (k + 1, (other,)), (k + 2, (short,))):
            rows.append((i, "\n".join(" ".join(x) for x in (some(25), *parts, some(25)))))
        rows += [(k + j, "\n\n".join((" ".join(some(25)), "\n".join(map(" ".join, x)), " ".join(some(25))))) for j, x in ((3, block), (4, wrapped))]
        want |= {(k + 1, 25, 60, k), (k + 2, 25, 20, k), (k + 4, 25, 60, k + 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # an 18-word paragraph that ends one word behind a passage is a near copy too
    got = {(r.doc_id, r.first_word, r.n_words - (r.n_words in (21, 61)), r.kept_id) for r in passages.repeated(docs).collect()}
    assert got == want


def test_long_words_are_counted_at_every_prefix():
    rng = random.Random(5)
    count = tokencount.PrefixCounter(vocabulary(COUNTING_VOCABULARY))
    pieces = sorted(p for p in count.pieces if p.isascii() and p.isalpha())
    words = ["".join(rng.choices(pieces, k=30)) for _ in range(40)] + ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(80)) for _ in range(40)]
    words += ["a" * 100, "ab" * 60, "é😀" * 40, " " * 60 + "x" * 60, "<s>" * 30, "1234567890" * 8]
    for word in words:
        for text in (word, "some words " + word):
            library = [len(count.model.encode(text[:j])) for j in range(len(text) + 1)]
            assert np.cumsum(count.steps([text])[0]).tolist() == library


def test_fit_chars_of_long_words_is_the_longest_prefix_that_fits(spark):
    rng = random.Random(6)
    vocabulary_ = vocabulary(COUNTING_VOCABULARY)
    model = tokencount.counter(vocabulary_).model
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(40, 150))) for _ in range(100)]
    docs = spark.createDataFrame([(k, "so " * (k % 3) + t) for k, t in enumerate(texts)], "doc_id long, text string")
    library = {r.doc_id: [len(model.encode(r.text[:j])) for j in range(len(r.text) + 1)] for r in docs.collect()}
    for budget in (3, 17, 33):
        counted = tokencount.prefix_counts(docs, vocabulary_, budget=budget)
        assert all(r.fit_chars == max(j for j, n in enumerate(library[r.doc_id]) if n <= budget) for r in counted.collect())
    assert all(r.prefix_tokens == library[r.doc_id][min(60, len(library[r.doc_id]) - 1)] for r in tokencount.tokens_in_prefix(counted, 60).collect())


def test_recall_of_planted_paragraphs(spark):
    """Exact copies inside lines, near copies and short paragraphs, each behind a variant of smaller id that is no copy."""
    rng = random.Random(7)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    jaccard = lambda x, y: len(x & y) / len(x | y)
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, want, shared = [], {"inside": [], "near": [], "short": []}, {}
    for k in range(0, 30_000, 100):
        passage = some(60)
        rows.append((k, " ".join(some(30) + passage[:25] + some(40))))
        rows += [(k + j, " ".join(some(rng.randint(0, 60)) + passage + some(rng.randint(0, 60)))) for j in (1, 2)]
        want["inside"].append((k + 2, set(passage)))
        shared[k + 1] = set(passage[:25])  # that much document k has as well
        near, n = some(rng.randint(60, 160)), 0
        other = list(near)
        while jaccard(shingles(near), shingles(other)) > 0.89 or n == 0:
            other[rng.randrange(5, len(near) - 5)], n = some(1)[0], n + 1
        if jaccard(shingles(near), shingles(other)) >= 0.8:
            rows += [(k + 3, "\n".join(map(" ".join, (some(20), near)))), (k + 4, "\n".join(map(" ".join, (some(20), other, some(20)))))]
            want["near"].append((k + 4, set(other)))
        short = some(rng.randint(18, 48))
        rows += [(k + j, "\n".join(map(" ".join, (some(22), short, some(19))))) for j in (5, 6)]
        want["short"].append((k + 6, set(short)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, gone = {i: t.split() for i, t in rows}, {}
    for r in passages.repeated(docs).collect():
        gone.setdefault(r.doc_id, []).extend(text[r.doc_id][r.first_word : r.first_word + r.n_words])
    share = {kind: sum(len(words & set(gone.get(i, []))) for i, words in found) / sum(len(words) for _, words in found) for kind, found in want.items()}
    print(share, {kind: len(found) for kind, found in want.items()})
    assert share["inside"] == 1 and share["near"] >= 0.99 and share["short"] == 1
    # nothing but planted words goes
    planted = shared | {i: words for found in want.values() for i, words in found}
    extra = sum(len(set(words) - planted.get(i, set())) for i, words in gone.items())
    assert extra <= 0.02 * sum(map(len, gone.values()))
