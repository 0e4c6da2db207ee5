"""The corpus pipeline: language ID, quality, near duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All stages but the last keep the columns of documents.
A row is named by its id and the hash of its text, so rows that share an id are judged apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import common, decontamination, langid, near_duplicates, pieces, quality
from loomwork.session import checkpoint_folder

#: least posterior of the predicted language
LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognized language; texts without letters or with too low a score go."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    predicted = langid.predict(docs.withColumnRenamed("score", "_score") if "score" in docs.columns else docs, model)
    kept = predicted.filter(
        (F.col("lang_pred") != langid.UNDEFINED) & (F.col("score") >= LANGUAGE_SCORE)
    ).drop("lang_pred", "score")
    return kept.withColumnRenamed("_score", "score") if "score" in docs.columns else kept


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and every rule of the cascade."""
    rules = quality.order_rules(docs)
    counted = quality.base_counts(docs.select(F.struct("*").alias("_row"), "text"))
    return counted.filter(quality.verdict(rules)).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    found = near_duplicates.classes(docs.select("doc_id", "text"))
    named = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("h").eqNullSafe(F.col("class_h"))
    # columns without nulls name a row, so that the join leaves rows where their copies are dropped
    kind = docs.schema["doc_id"].dataType
    name = {
        "_null": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id"), F.lit(0).cast(kind)),
    }
    firsts = found.filter(named).withColumns({**name, "_hash": F.col("h")}).select("_null", "_id", "_hash").distinct()
    rows = docs.withColumns({**name, "_hash": F.xxhash64("text")})
    kept = rows.join(firsts, ["_null", "_id", "_hash"], "left_semi")
    # rows with the same id and text are one class: one of them stays
    return kept.dropDuplicates(["_null", "_id", "_hash"]).select(*docs.columns)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no verified benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.leaks(docs.select("doc_id", "text"), items)
    found = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    named = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    return docs.join(found, named, "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document."""
    encoded = pieces.encode(docs.select("doc_id", "text", "lang", "source"))
    return encoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: models and banding cannot be said in SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.mode("errorifexists").parquet(path)
        docs = spark.read.parquet(path)
    return docs
