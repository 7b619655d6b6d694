"""The corpus pipeline: documents in, packed token sequences out.

Every stage is a function of (session, documents, folder of the other tables) and works on all that the one before it kept. Stages
but the last return the columns of their input. Rows without an id pass the stages that decide by id: they can be neither a copy's
first nor a listed pair.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finescale.llm import decontaminate, language, neardup, packing, quality
from finescale.llm.shared import new_path, written

QUALITY = 0.7                   # documents that score less go
LANGUAGE = 0.5                  # so do those without a letter and those whose set of languages is less certain; their shares do not matter
OWN = "__corpus_pipeline_"      # before the names of columns that a stage adds for itself


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, OWN + "score").filter(F.col(OWN + "score") >= QUALITY).select(docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.predict(docs, language.fit(docs), OWN)
    certain = F.col(OWN + "score") >= LANGUAGE * F.array_max(OWN + "proportions")         # the score is certainty times the largest share
    return found.filter((F.col(OWN + "lang_pred") != "und") & certain).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = neardup.groups(docs).filter("is_first").groupBy("doc_id").count()
    keep = written(rows, "keep")
    kept = docs.join(keep.filter("count = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    again = keep.filter("count > 1").select("doc_id")                            # rows that repeat an id
    if not again.isEmpty():
        kept = kept.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pairs = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality), ("language ID", known_language), ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark), ("packing", packed)]

ORACLE_SQL = None               # trained models, sampled shingles and alignment have no SQL form; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
