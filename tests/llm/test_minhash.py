import random
import re
from collections import Counter

import pytest

from spanloom.llm import minhash

SCHEMA = "doc_id long, text string, component long, bucket string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) >= n:
        return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows, n, percent=80):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    where = {}
    for k, (i, s) in enumerate(sets):
        for j, both in Counter(j for g in s for j in where.get(g, ())).items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = root(i), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            where.setdefault(g, []).append(k)
    return {i: root(i) for i in parent}


def crowd():
    """A common text, copies with more and more edits (a crowd of components), chains and exact copies."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(120), k // 4):
            words[at] = rng.choice(vocabulary)
        rows.append((1000 - k * 3, " ".join(words)))
    chain = [rng.choice(vocabulary) for _ in range(60)]
    for k in range(30):
        rows.append((2000 + k, " ".join(chain)))
        chain[rng.randrange(60)] = rng.choice(vocabulary)
    rows += [(3000 + k, "Some SHORT text") for k in range(40)] + [(3100, "some short text"), (3101, "text"), (3102, "TEXT")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_components_equal_brute_force(spark, n):
    rows = crowd()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)  # columns named as the operator's own
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=n).collect()}
    want = brute(rows, n)
    assert len(set(want.values())) > 20
    assert got == {i: (len(shingles(t, n)), want[i]) for i, t in rows}


def test_crowd_pairs_are_all_that_reach_the_threshold(spark):
    rows = crowd()
    sets = spark.createDataFrame(rows, "id long, text string").mapInArrow(minhash._sets(2), "id long, n int, shingles binary").selectExpr("*", "id as component")
    got = {(r.a, r.b) for r in minhash._across_components(sets, 80).collect()}
    own = {i: shingles(t, 2) for i, t in rows}
    want = {(i, j) for i in own for j in own if i > j and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])}
    assert want <= got and len(got) < 2 * len(want)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (4, "a b c"), (5, "A b  c"), (5, "other words here"), (6, "other words here"), (7, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=2).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 2, None), (4, 2, 4), (5, 2, 4), (5, 2, 4), (6, 2, 4), (7, 1, 7)], key=str)
    assert {r.doc_id for r in minhash.keep_first(docs, shingle=2).collect()} == {1, 2, 3, 4, 7, None}


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
