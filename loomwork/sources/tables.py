"""Script tables: current scripts, unseen records and their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomwork.functions.ordered import dense_index


def _current(scripts: DataFrame, versions: DataFrame) -> DataFrame:
    return (
        scripts.filter("Id is not null").withColumnRenamed("Id", "__script")
        .join(versions.withColumnRenamed("Id", "script_id"),
              F.col("CurrentScriptVersionId") == F.col("script_id"))
    )


def _in_languages(rows: DataFrame, languages: DataFrame, names: list[str]) -> DataFrame:
    wanted = languages.filter(F.col("Name").isin(names)).select(
        F.col("Id").alias("ScriptLanguageId")
    )
    return rows.join(wanted, "ScriptLanguageId", "left_semi")


def current_scripts(
    scripts: DataFrame, versions: DataFrame, languages: DataFrame, language: str
) -> DataFrame:
    """Current scripts of one language, one row (smallest id) per distinct content.

    Contents are compared by digest: only digest and id are aggregated, so a content with
    very many copies is combined before the shuffle and texts move once.
    """
    rows = _in_languages(_current(scripts, versions), languages, [language]).select(
        F.col("AuthorUserId").alias("user_id"), F.col("ScriptProjectId").alias("project_id"),
        "script_id", F.col("ForkParentScriptVersionId").alias("parent_id"),
        F.col("ScriptContent").alias("script"),
    )
    first = rows.groupBy(F.sha2("script", 256).alias("__digest")).agg(
        F.min("script_id").alias("script_id")
    )
    return rows.join(first.select("script_id"), "script_id", "left_semi")


def distinct_contents(
    scripts: DataFrame, versions: DataFrame, languages: DataFrame, names: list[str]
) -> DataFrame:
    """Distinct contents of current scripts in any of the named languages."""
    rows = _in_languages(_current(scripts, versions), languages, names)
    return rows.select(F.col("ScriptContent").alias("content")).distinct()


def multi_language_scripts(
    scripts: DataFrame,
    versions: DataFrame,
    languages: DataFrame,
    names: tuple[str, ...] = ("Python", "IPython Notebook"),
) -> DataFrame:
    """Existing code in several languages: (id, content), one row per content."""
    rows = _in_languages(_current(scripts, versions), languages, list(names)).select(
        F.col("__script").alias("id"), F.col("ScriptContent").alias("content")
    )
    first = rows.groupBy(F.sha2("content", 256).alias("__digest")).agg(F.min("id").alias("id"))
    return rows.join(first.select("id"), "id", "left_semi")


def new_records(
    crawled: DataFrame, existing: DataFrame, null_aware: bool = False
) -> DataFrame:
    """Crawled rows with a language and a code that `existing` (column content) lacks.

    null_aware=True keeps the SQL rule of NOT IN: one null in `existing` rejects every row.
    Duplicates among the crawled rows stay.
    """
    rows = crawled.filter("language is not null and code is not null")
    if null_aware and not existing.filter("content is null").isEmpty():
        return rows.limit(0)
    known = existing.select(F.sha2("content", 256).alias("__digest")).distinct()
    return (
        rows.withColumn("__digest", F.sha2("code", 256))
        .join(known, "__digest", "left_anti").drop("__digest")
    )


def assign_dense_ids(rows: DataFrame, existing_ids: DataFrame, order: list[str]) -> DataFrame:
    """Add `id`: the largest existing id + 1 + position in the given order."""
    largest = existing_ids.agg(F.max(existing_ids.columns[0])).first()[0]
    return dense_index(rows, order, "id", (largest or 0) + 1)


def resolve_language_ids(rows: DataFrame, languages: DataFrame) -> DataFrame:
    """Left join of the language name to its id."""
    info = languages.select(F.col("Name").alias("language"), F.col("Id").alias("lang_id"))
    return rows.join(info, "language", "left")


def version_rows(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("id").alias("Id"), F.col("lang_id").cast("int").alias("ScriptLanguageId"),
        F.col("code").alias("ScriptContent"),
    )


def script_rows(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("id").alias("CurrentScriptVersionId"), F.col("votes").cast("int").alias("TotalVotes")
    )


def append_records(records: DataFrame, versions_path: str, scripts_path: str) -> int:
    """Append one version row and one script row per record; returns the number of records."""
    version_rows(records).write.mode("append").parquet(versions_path)
    script_rows(records).write.mode("append").parquet(scripts_path)
    return records.count()
