"""From raw documents to packed training sequences.

Each stage takes what the one before kept.  SQL cannot express learned models and
tokenisation, so ORACLE_SQL is None; tests/llm holds the run against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontamination, language_id, ngram_join, packing, toxicity
from flowloom.llm.common import fresh, table
from flowloom.session import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    model = language_id.train(docs, ~language_id.held_out(F.col("doc_id")))
    names = fresh(docs.columns, "_lang"), fresh(docs.columns, "_lang_score")
    return language_id.predict(docs, model, names).where(F.col(names[0]) != language_id.UNKNOWN).select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls toxic."""
    names = fresh(docs.columns, "_toxicity"), fresh(docs.columns, "_toxic")
    judged = toxicity.predict(docs, toxicity.fitted(spark, docs, sf_dir), names)
    return judged.where(F.col(names[1]) == 0).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked texts."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover half of a benchmark item or more."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return packing.pack(docs, packing.tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
