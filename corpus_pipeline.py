"""A training-text pipeline over ``documents``: each stage's result is written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, gbt, line_dedup, minhash, packing
from spanloom.llm.queries import PACKING_VOCABULARY, table, vocabulary
from spanloom.llm.shared import save


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees, trained on ``labels``, score under 1/2 go."""
    return gbt.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over 10 % of a source's documents are cut; every document stays, and n_chars is that of the new text."""
    kept = line_dedup.drop_boilerplate(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return minhash.keep_first(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words lies in windows of ``benchmark`` go; the others stay as they are."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids; each is a sequence of its own."""
    return packing.pack(docs, vocabulary(PACKING_VOCABULARY))


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", drop_boilerplate_lines), ("minhash_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: The classifier's verdicts and the token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
