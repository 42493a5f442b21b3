"""Classifiers and language models: held-out accuracy, odd rows, empty tables."""

import random
import re
from collections import Counter

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F
from spanloom.llm import gbt, langid, quality_rules


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus.labelled_corpus()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache(), spark.createDataFrame([*labels, (1, None), (None, 1), (2, 0), (7000, 1)], "doc_id long, quality int"), dict(labels)


def test_trees_predict_held_out_documents(spark, tables):
    docs, labels, truth = tables
    model = gbt.train(docs, labels)
    scores = {r.doc_id: r.score for r in gbt.score(docs, model).collect()}
    out = [i for i in truth if corpus.held_out(i)]
    assert sum((scores[i] >= 0.5) == truth[i] for i in out) / len(out) > 0.95
    again = gbt.train(docs.repartition(5), labels)
    assert np.array_equal(again.threshold, model.threshold) and np.array_equal(again.value, model.value)


def test_flat_arrays_equal_walking_the_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = gbt.fit(x, y, trees=20)

    def walk(row, node):
        while model.child[node] != node:
            node = model.child[node] + int(row[model.feature[node]] > model.threshold[node])
        return model.value[node]

    want = [model.base + sum(walk(row, r) for r in model.roots) for row in x]
    assert np.allclose(model.margin(x), want) and ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_trees_odd_rows_and_empty_tables(spark, tables):
    docs, labels, _ = tables
    odd = spark.createDataFrame(corpus.clashing(corpus.ODD), corpus.CLASHING)
    got = gbt.score(odd, gbt.train(docs, labels)).collect()
    assert len(got) == len(corpus.ODD) and all(0 <= r.score <= 1 for r in got)
    empty = odd.limit(0)
    constant = gbt.train(empty, labels)
    assert {round(r.score, 9) for r in gbt.score(odd, constant).collect()} == {0.5}
    assert gbt.score(empty, constant).collect() == []
    kept = gbt.keep_good(odd, labels, least=0.0)
    assert kept.columns == odd.columns and kept.count() == len(corpus.ODD)


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, double = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            double += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), double, len(repeated)


def test_quality_rules(spark, tables):
    docs, labels, truth = tables
    model = quality_rules.train(docs, labels)
    extra = corpus.ODD + [(910, "a b c d e f\n\na b c d e f\na b c d e f x y é|é"), (911, "one two three four five one two three four five"), (912, "l\nl\n l\nl ")]
    odd = spark.createDataFrame(corpus.clashing(extra), corpus.CLASHING)
    rows = quality_rules.judge(odd, model).collect()
    want = Counter((i, *base_counts(t)) for i, t in extra)
    assert Counter(tuple(r)[:6] for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    scored = {r.doc_id: r for r in quality_rules.judge(docs, model).collect()}
    out = [i for i in truth if corpus.held_out(i)]
    assert sum((scored[i].probability >= 0.5) == truth[i] for i in out) / len(out) > 0.95
    p = np.array([scored[i].probability for i in out])
    assert abs(p.mean() - np.mean([truth[i] for i in out])) < 0.1  # calibrated in the large
    names = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    named = quality_rules.judge(names(docs), quality_rules.train(names(docs), names(labels)))
    assert named.schema["doc_id"].dataType.simpleString() == "string" and {r.doc_id for r in named.collect()} == {f"d{i}" for i in scored}
    nothing = quality_rules.train(docs.limit(0), labels)
    assert {r.probability for r in quality_rules.judge(odd, nothing).collect()} == {0.5}


SYLLABLES = {"xx": ("ka", "to", "mi", "ru"), "yy": ("schl", "ung", "ö", "ver"), "zz": ("que", "ère", "oui", "eau")}


def language_rows(n=60):
    rng = random.Random(9)
    return [(k, corpus.prose(rng, rng.randint(4, 40), SYLLABLES[lang]), lang) for k, lang in enumerate(sorted(SYLLABLES) * n)]


def test_language_id(spark):
    rows = language_rows()
    docs = spark.createDataFrame([*rows, (5000, "Kato miru", None), (5001, None, "xx")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["xx", "yy", "zz"]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    out = [(i, lang) for i, _, lang in rows if corpus.held_out(i)]
    assert sum(got[i].lang_pred == lang for i, lang in out) / len(out) > 0.97
    assert got[5000].lang_pred == "xx" and (got[5001].lang_pred, got[5001].score) == ("und", 0)
    odd = spark.createDataFrame(corpus.clashing(corpus.ODD), corpus.CLASHING)
    found = langid.predict(odd, model).collect()
    assert len(found) == len(corpus.ODD) and all(0 <= r.score <= 1 for r in found) and {r.doc_id for r in found if r.lang_pred == "und"} == {900, 901, 902, 905}
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def code_length(text, seen, order):
    """Escape method C over nested dictionaries of counts, context by context."""
    raw = b"\0" * order + text.lower().encode()
    bits = 0.0
    for at in range(order, len(raw)):
        for k in range(order, -1, -1):
            nexts = seen.get((k, raw[at - k : at]), {})
            if not nexts:
                continue
            total = sum(nexts.values()) + len(nexts)
            if raw[at] in nexts:
                bits -= np.log2(nexts[raw[at]] / total)
                break
            bits -= np.log2(len(nexts) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_plain_context_trees(spark):
    rows = language_rows(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    texts = ["Katomi schlung!", "quère", "中文 und", "a", ""]
    raw = [t.lower().encode() for t in texts]
    bits = model.bits(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    for j, lang in enumerate(model.languages):
        seen = {}
        for i, t, name in rows:
            if name == lang and not corpus.held_out(i):
                own = b"\0" * model.order + t.lower().encode()
                for at in range(model.order, len(own)):
                    for k in range(model.order + 1):
                        bucket = seen.setdefault((k, own[at - k : at]), Counter())
                        bucket[own[at]] += 1
        assert np.allclose(bits[:, j], [code_length(t, seen, model.order) for t in texts], atol=1e-2)
