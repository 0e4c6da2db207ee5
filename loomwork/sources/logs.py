"""Execution logs: status, work selection, timing files, trace files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomwork import schemas
from loomwork.functions.ordered import dense_index

# fixed values: exit statuses of an executed script
STATUS_NAMES = {0: "ok", 2: "compile", 3: "exec", 4: "no data", 124: "timeout"}
OK, TIMEOUT = 0, 124


def read_status_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line_no, script_id, status) of `id:status` lines; blank lines are skipped.

    line_no counts the lines that are left from 0, in the order of each file and, before that, of
    file names; the rows have the types of `schemas.STATUS_LOG`.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    ).filter(F.length(F.trim("value")) > 0)
    parts = F.split("value", ":")
    known = lines.select(
        "file", "start", "at",
        F.try_to_number(F.trim(parts[0]), F.lit("S999999999999999999")).cast("long").alias(
            "script_id"),
        F.try_to_number(F.trim(parts[1]), F.lit("S999999999")).cast("int").alias("status"),
    ).filter("script_id is not null")
    return dense_index(known, ["file", "start", "at"], "line_no").select(
        "line_no", "script_id", "status"
    )


def latest_status(log: DataFrame) -> DataFrame:
    """The last line of each id wins."""
    return log.groupBy("script_id").agg(F.max_by("status", "line_no").alias("status"))


def append_status_log(statuses: DataFrame, path: str) -> None:
    """Append `id:status` lines."""
    statuses.select(
        F.concat_ws(":", F.col("script_id").cast("string"), F.col("status").cast("string"))
    ).write.mode("append").text(path)


def load_times(spark: SparkSession, folder: str) -> DataFrame:
    """(script, time) from files `script_<id>_..time.txt` holding one number each."""
    files = (
        spark.read.option("pathGlobFilter", "script*time.txt").text(folder, wholetext=True)
        .select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("base"))
    )
    return files.select(
        F.get(F.split("base", "_"), F.lit(1)).alias("script"),
        F.expr("try_cast(trim(regexp_replace(value, '\\\\s', '')) as double)").alias("time"),
    )


def load_trace_events(spark: SparkSession, root: str, fmt: str = "json") -> DataFrame:
    """Call events of all `project_*/scripts/*` files, with script path and project number.

    Files that cannot be read are skipped.
    """
    reader = spark.read.schema(schemas.CALL_EVENTS).option("ignoreCorruptFiles", "true")
    rows = reader.format(fmt).load(f"{root}/project_*/scripts/*")
    path = F.col("_metadata.file_path")
    return rows.select(
        "*", path.alias("__path")
    ).withColumns(
        {
            "script": F.col("__path"),
            "project": F.regexp_extract("__path", r"project_(\d+)", 1).cast("int"),
        }
    ).drop("__path").filter("call_id is not null")


def save_trace(events: DataFrame, path: str) -> None:
    """Write events partitioned by project, so one project can be read alone."""
    events.write.mode("append").partitionBy("project").parquet(path)


def write_ratios(ratios: DataFrame, path: str) -> None:
    ratios.write.mode("overwrite").csv(path, header=True)


def of_projects(traces: DataFrame, project_ids: list[int]) -> DataFrame:
    """Traces of the given projects."""
    return traces.filter(F.col("project_id").isin(project_ids))


def project_counts(traces: DataFrame, project_ids: list[int]) -> DataFrame:
    """Scripts per project; the rows themselves stay partitioned by project on write."""
    return of_projects(traces, project_ids).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("scripts")
    )


def uses_library(imports, prefix: str):
    """True when any import name starts with the prefix."""
    return F.exists(imports, lambda name: name.startswith(prefix))


def select_work(
    traces: DataFrame,
    status: DataFrame,
    per_project: int,
    script_ids: DataFrame | None = None,
    quota: bool | None = None,
) -> DataFrame:
    """Scripts still to run: (project_id, script_id).

    Logged scripts are left out, except timeouts, which run again. Successes in the log count
    toward the quota per project. As in the original tool the quota holds only when script
    ids are given; pass quota=True or False to decide it.
    """
    quota = (script_ids is not None) if quota is None else quota
    rows = traces.select("project_id", "script_id")
    if script_ids is not None:
        rows = rows.join(script_ids.select("script_id").distinct(), "script_id", "left_semi")
    finished = status.filter(F.col("status") != TIMEOUT).select("script_id")
    open_rows = rows.join(finished, "script_id", "left_anti")
    if not quota:
        return open_rows.select("project_id", "script_id")
    done = (
        rows.join(status.filter(F.col("status") == OK), "script_id", "left_semi")
        .groupBy("project_id").agg(F.count(F.lit(1)).alias("done"))
    )
    # at most per_project rows of a project are needed: the rank filter is pushed below the
    # shuffle as a per-task top-n
    order = Window.partitionBy("project_id").orderBy("script_id")
    ranked = open_rows.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= per_project
    )
    return (
        ranked.join(done, "project_id", "left")
        .filter(F.col("rank") <= per_project - F.coalesce("done", F.lit(0)))
        .select("project_id", "script_id")
    )


def status_summary(traces: DataFrame, status: DataFrame) -> DataFrame:
    """Scripts per project and named status."""
    name = F.element_at(
        F.create_map(*[F.lit(x) for kv in STATUS_NAMES.items() for x in kv]), F.col("status")
    )
    return (
        traces.select("project_id", "script_id").join(status, "script_id")
        .withColumn("outcome", F.coalesce(name, F.lit("other")))
        .groupBy("project_id", "outcome").agg(F.count(F.lit(1)).alias("scripts"))
    )


def succeeded(status: DataFrame) -> DataFrame:
    """Ids whose last status is ok; they feed a second run."""
    return status.filter(F.col("status") == OK).select("script_id")
