"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from spanloom.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, size string"


def brute(rows):
    """Nodes by their prefixes, each with totals over all prefixes that begin with it."""
    talks = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in talks.items()}
    own = {}
    for c, t in turns.items():
        h, first = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        own[c] = tuple(turns.get(first, [])[:h] + t[h:])
    members = {}
    for c in sorted(own):
        for d in range(len(own[c]) + 1):
            members.setdefault(own[c][:d], []).append(c)
    out = set()
    for k, m in members.items():
        under = [x for x in members if x[: len(k)] == k]
        parents = {x[:-1] for x in under if x}
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = ",".join(str(c) for c in m if len(own[c]) == len(k))
        children = sum(1 for x in members if x and x[:-1] == k)
        out.add((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children, sum(x not in parents for x in under), sum((len(members[x]) - 1) * words(x) for x in under), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks(seed, convs=60, vocabulary=3):
    rng = random.Random(seed)
    texts = [None, "", "a b", "a  b\tc", "é è"][:vocabulary]
    rows = []
    for c in rng.sample(range(-30, 90), convs):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(texts), 1, "x"))
    return rows


def check(spark, rows, **options):
    found = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert len({tuple(r) for r in found}) == len(found)
    assert {tuple(r) for r in found} == brute(rows)


@pytest.mark.parametrize("seed, local", [(1, 20_000), (2, 7), (3, 2), (4, 1)])
def test_against_brute_force(spark, seed, local):
    check(spark, talks(seed), local=local)


def test_odd_rows(spark):
    rows = [(5, None, "user", "x", 1, ""), (5, 1, None, None, 1, ""), (5, 1, None, None, 1, ""), (5, 1, "b", "y", 1, ""), (None, 1, "user", "x", 1, ""), (20, 1, "user", "w " * 5000, 1, ""), (21, 1, "user", "w " * 5000, 1, ""), (21, 2, "q\n", "", 1, ""), (22, 2, "q", "\n", 1, ""), (10**15, 0, "user", "far", 1, "")]
    check(spark, rows)
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_chain_and_crowd(spark):
    """One conversation with most of the turns, and copies of a short one; split at centroids over many rounds."""
    chain = [(1, t, "user", f"t{t}", 0, "") for t in range(150)]
    crowd = [(c, t, "user", f"same {t}", 0, "") for c in range(100, 180) for t in range(3)]
    check(spark, chain + crowd, local=10)


def test_local_totals():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(0, 40)
        parent = np.array([-1 if k == 0 or rng.random() < 0.1 else rng.randint(max(0, k - rng.choice([1, 40])), k - 1) for k in range(n)], np.int64)
        values, size = np.array([[rng.randint(0, 9), 1] for _ in range(n)], np.int64).reshape(n, 2), np.ones(n, np.int64)
        want = values.copy()
        for k in reversed(range(n)):
            if parent[k] >= 0:
                size[parent[k]] += size[k]
                want[parent[k]] += want[k]
        assert (prefix_trie.component_totals(parent, size, values) == want).all()
