"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`.
Null and empty texts have no letter and go in the first stage. Repeated rows lose all their
lines to the first occurrence in the second, which drops documents left without a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import common, decontaminate, language_id, line_dedup, packing, simhash
from foliospark.llm.tokens import default_path

#: A text less like every learned language than this is rejected; unrelated letter vectors stay near 0.
MIN_LANGUAGE_SCORE = 0.05
#: Near-duplicates differ in at most so many of 64 bits (a similarity of over 0.9) of fingerprints over five words.
NEAR_RADIUS, NEAR_SHINGLE = 3, 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in."""
    prototypes = language_id.learn(docs.select("text", "lang"))
    plain = docs.toDF(*[c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)])  # no name that the result has too
    found = language_id.predict(plain, prototypes)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(plain.columns).toDF(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that another line repeats; documents with no line left go."""
    rest = [c for c in docs.columns if c != "text"]
    found = line_dedup.dedup_lines(docs.select(F.struct(*rest).alias("doc_id"), "text"), order=F.col("doc_id.doc_id"))
    left = found.where("n_lines > n_removed").select("doc_id.*", "text")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the least doc_id."""
    return simhash.one_of_each(docs, NEAR_RADIUS, NEAR_SHINGLE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold neither a full window of a benchmark item nor parts of two items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_rows(docs, items)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 2048."""
    return packing.pack(docs, default_path())


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("best_fit_packing", packed),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.stage_alone(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if hasattr(before, "staged_at"):
            common.unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
