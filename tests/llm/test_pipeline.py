"""The stages of the pipeline on planted documents."""

import random
import tracemalloc

import corpus
import corpus_pipeline
import numpy as np
import pytest
from spanloom.llm import queries
from spanloom.llm.text import Words


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    rng = random.Random(11)
    docs, labels = corpus.labelled_corpus(150)
    item = corpus.prose(rng, 40, ("bench", "mark", "ed"))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs]
    good = [i for i, label in labels if label]
    clean = corpus.prose(rng, 80)
    more = [(500, clean), (501, clean), (502, clean.replace(clean.split()[40], "changed", 1)), (503, item + " " + clean[:100]), (504, corpus.prose(rng, 80) + "\nCommon line")]
    more += [(510 + k, corpus.prose(rng, 60) + "\nCommon line") for k in range(8)] + [(530, None)]
    rows += [(i, t, None, "s9", None) for i, t in more]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), set(good)


def test_stages(spark, sf_dir):
    base, good = sf_dir
    docs = spark.read.parquet(f"{base}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, base)
        assert new.columns == docs.columns and new.dtypes == docs.dtypes
        docs = spark.createDataFrame(new.collect(), new.schema)
        found[name] = {r.doc_id: r for r in docs.collect()}
    assert len(good - set(found["quality_classifier"])) <= 2 and len(set(found["quality_classifier"]) & (set(range(150)) - good)) <= 2
    assert set(found["line_dedup"]) == set(found["quality_classifier"])
    assert all("Common line" not in (r.text or "") for r in found["line_dedup"].values())
    assert {500, 501, 502} & set(found["minhash_dedup"]) == {500}
    assert 503 in found["minhash_dedup"] and 503 not in found["decontamination"] and set(found["minhash_dedup"]) - set(found["decontamination"]) == {503}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, base).collect()
    assert {r.doc_id for r in pieces} == set(found["decontamination"])


@pytest.mark.parametrize("pages", [2, 10, 15])
def test_copies_on_small_sites_keep_one_text(spark, pages):
    """Two equal documents and a near copy, of one line or of several, among others of a site, with and without a common line."""
    rng = random.Random(pages)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for lines in (1, 5):
        for common in ("", "\nCommon line"):
            clean = "\n".join(corpus.prose(rng, 100 // lines) for _ in range(lines))
            rows = [(0, clean + common), (1, clean + common)] + [(2, clean.replace(clean.split()[50], "changed", 1) + common)] * (pages > 2)
            rows += [(3 + k, corpus.prose(rng, 60) + common) for k in range(pages - 3)]
            docs = spark.createDataFrame([(i, t, None, "site", len(t)) for i, t in rows], schema)
            cut = corpus_pipeline.drop_boilerplate_lines(spark, docs, "")
            kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, cut, "").collect()}
            assert set(kept) == {0, *range(3, pages)} and kept[0].split("\nCommon")[0] == clean
            assert not common or pages == 2 or not any("Common" in t for t in kept.values())


def test_stages_on_odd_tables(spark, sf_dir):
    """Empty tables, nulls, repeated rows, ties, clashing columns and a very long word pass every stage; n_chars follows the text."""
    base, _ = sf_dir
    rows = [(i, t, None, "s", 0, "x", "y", 1) for i, t in corpus.ODD] + [(950, "w" * 200_000 + " and ten words more to be kept as they are here", "en", None, 1, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lines string, host string, label int")
    for given in (docs.limit(0), docs):
        now = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            new = stage(spark, now, base)
            assert new.dtypes == docs.dtypes
            now = spark.createDataFrame(new.collect(), new.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, base).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}
    assert [r.n_chars for r in corpus_pipeline.drop_boilerplate_lines(spark, docs.where("doc_id = 903"), base).collect()] == [200_000]


def test_run_and_registration(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir[0]).count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_documents_are_not_shuffled_to_drop_the_contaminated(spark, sf_dir):
    """The ids that go are a table of their own, which reaches the documents by a broadcast even where Spark would not broadcast by itself."""
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.decontamination(spark, docs, sf_dir[0])
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        assert set(r.doc_id for r in docs.collect()) - {r.doc_id for r in kept.collect()} == {503}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hashing_words_takes_no_memory_by_the_byte_of_a_shard():
    """The same hashes as words one by one, in a few MB beside the result's."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(1000)] + ["x" * 600_000, "y" * 5000]
    picked = [rng.choice(words[:1000]) for _ in range(400_000)] + words[1000:] + words[:1000]
    data = " ".join(picked).encode()
    every = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    tracemalloc.start()
    found = every.hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(picked) and peak - found.nbytes < 40e6
    one = {w: int(Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hashes()[0]) for w in words}
    assert found.tolist() == [one[w] for w in picked]
