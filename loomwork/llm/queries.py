"""The registered queries of this subpackage."""

from __future__ import annotations

import uuid

from loomwork.llm import (
    common, decontamination, langid, lm_scoring, mixing, near_duplicates, packing, periods, pieces, quality,
    repair, sharding, token_counts, toxicity,
)
from loomwork.plans.common import Registry
from loomwork.session import checkpoint_folder

registry = Registry()


def registries():
    return [registry]


def stage_folder(spark, name: str) -> str:
    """A new folder for a written table, in the shared folder of the session."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


QUALITY_SQL = "with docs as (select doc_id, text from documents)," + quality.SQL


@registry.add("op8_quality_rules", QUALITY_SQL)
def op8(spark, sf_dir):
    return quality.judge(common.documents(spark, sf_dir).select("doc_id", "text")).drop("text")


@registry.add("op4_sharding", sharding.sql())
def op4(spark, sf_dir):
    docs, path = common.documents(spark, sf_dir), stage_folder(spark, "shards")
    sharding.write_shards(docs, path)
    return sharding.read_digests(spark, path, docs.schema)


@registry.add("op6_packed_ids")
def op6(spark, sf_dir):
    path = stage_folder(spark, "packed")
    packing.write_packed(common.documents(spark, sf_dir), path)
    return packing.read_digests(spark, path)


@registry.add("op7_token_counts")
def op7(spark, sf_dir):
    return token_counts.count_tokens(common.documents(spark, sf_dir))


@registry.add("op3_language_id")
def op3(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    held_out = common.remainder("doc_id", 4) == 2
    model = langid.fit(docs.filter(~held_out))
    predicted = langid.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@registry.add("op2_toxicity")
def op2(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = common.remainder("doc_id", 3) == 1
    scored = toxicity.fit_and_score(docs, labels.filter(~held_out), learn=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@registry.add("op5_ngram_jaccard_join", near_duplicates.SQL)
def op5(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return near_duplicates.classes(docs).select("doc_id", "class_id", "n_links")


@registry.add("op10_lm_scoring")
def op10(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    held_out = common.remainder("doc_id", 7) == 2
    return lm_scoring.score(docs, held_out, stage_folder(spark, "lm"))


@registry.add("op9_decontamination")
def op9(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.leaks(common.documents(spark, sf_dir), items).drop("h")


@registry.add("op1_sentencepiece")
def op1(spark, sf_dir):
    return pieces.digests(common.documents(spark, sf_dir))


@registry.add("op11_conversation_repair")
def op11(spark, sf_dir):
    return repair.digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@registry.add("op12_source_mix", mixing.SQL)
def op12(spark, sf_dir):
    return mixing.Mix(common.documents(spark, sf_dir)).taken()


@registry.add("op13_periodic_runs")
def op13(spark, sf_dir):
    return periods.digests(common.documents(spark, sf_dir))


@registry.add("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
