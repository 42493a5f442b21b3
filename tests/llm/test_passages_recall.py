"""Repeated passages wherever they stand: recall of planted kinds, and brute force."""

import random

from spanloom.llm import passages


def some(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, gone = {i: t.split() for i, t in rows}, {}
    for r in passages.repeated(docs).collect():
        assert r.kept_id < r.doc_id and 0 <= r.first_word and r.first_word + r.n_words <= len(text[r.doc_id])
        gone.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    return gone


def test_recall_of_passages_inside_other_text(spark):
    """Exact 30-word passages in lines, paragraphs of three 10-word lines between short lines, near copies in lines and as lines."""
    rng = random.Random(21)
    rows, want, planted = [], {"inside": [], "lines": [], "near": [], "edited": [], "near line": []}, {}

    def plant(kind, i, lines, mark):
        words = [w for x in lines for w in x]
        rows.append((i, "\n".join(map(" ".join, lines))))
        if kind:
            at = {k for k, w in enumerate(words) if w in mark}
            want[kind].append((i, at))
            planted[i] = at

    for k in range(150):
        base = 100 * k
        passage = some(rng, 30)
        for j, kind in ((0, None), (1, "inside")):
            plant(kind, base + j, [some(rng, rng.randint(5, 50)) + passage + some(rng, rng.randint(5, 50))], set(passage))
        block = [some(rng, 10) for _ in range(3)]
        for j, kind in ((2, None), (3, "lines")):
            around = [[some(rng, rng.randint(3, 12)) for _ in range(rng.randint(1, 4))] for _ in range(2)]
            plant(kind, base + j, around[0] + block + around[1], {w for x in block for w in x})
        near = some(rng, 60)
        for kind, j in (("near", 4), ("edited", 6), ("near line", 8)):
            other, at = list(near), rng.randrange(5, 55)
            if kind != "edited":
                other[at] = some(rng, 1)[0]
            elif k % 2:
                other.insert(at, some(rng, 1)[0])
            else:
                del other[at]
            head, tail = ([some(rng, 20)], [some(rng, 20)]) if kind == "near line" else (some(rng, 25), some(rng, 25))
            for i, body in ((base + j, near), (base + j + 1, other)):
                lines = [*head, body, *tail] if kind == "near line" else [some(rng, 25) + body + some(rng, 25)]
                plant(kind if i > base + j else None, i, lines, set(body))
            near = some(rng, 60)
    gone = removed(spark, rows)
    share = {kind: sum(len(at & gone.get(i, set())) for i, at in found) / sum(len(at) for _, at in found) for kind, found in want.items()}
    print(share)
    assert min(share.values()) >= 0.99 and share["inside"] == share["lines"] == 1
    # unplanted words go only where head and tail of a near line are copies too
    kinds = {i for i, _ in want["near line"]}
    assert all(i in kinds or at <= planted.get(i, set()) for i, at in gone.items())


def test_repeats_of_200_documents_equal_brute_force(spark):
    """Words of every 30-word repeat go; only words go that a stretch of 18 repeated words or a linked line explains."""
    rng = random.Random(22)
    pool = [some(rng, rng.randint(8, 70)) for _ in range(60)]
    rows = [(i, " ".join(w for _ in range(rng.randint(1, 6)) for w in (rng.choice(pool) if rng.random() < 0.4 else some(rng, rng.randint(1, 40))))) for i in range(200)]
    gone = removed(spark, rows)
    seen = {n: {} for n in (18, 30)}
    for i, t in rows:
        words = t.split()
        for n, first in seen.items():
            for k in range(len(words) - n + 1):
                first.setdefault(tuple(words[k : k + n]), i)
    for i, t in rows:
        words = t.split()
        least, most = ({k + j for k in range(len(words) - n + 1) if seen[n][tuple(words[k : k + n])] < i for j in range(n)} for n in (30, 18))
        assert least <= gone.get(i, set())
        # near copies can add what lies within reach of such a stretch, and nothing far from one
        assert all(any(abs(k - m) <= passages.REACH for m in most) for k in gone.get(i, set()) - most)
