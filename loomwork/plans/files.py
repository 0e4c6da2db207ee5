"""Queries that write the given tables as the files of a collection run and read them back.

Files go to new folders beside the checkpoints, which all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.plans.common import Registry, table
from loomwork.plans.traces import CALLS_SQL, trace_calls
from loomwork.session import checkpoint_folder
from loomwork.sources import logs

registry = Registry()

PROJECTS = 3


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _statuses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("script_id"),
        F.when(F.col("event_type") == "error", 124).otherwise(0).alias("status"),
    )


@registry.add(
    "status_log_file",
    """select script_id, status, lines, line_no from (select event_id as script_id,
  case when event_type = 'error' then 124 else 0 end as status, (select count(*) from events) as lines,
  row_number() over (order by event_id) - 1 as line_no from events)""",
)
def status_log_file(spark: SparkSession, sf: str) -> DataFrame:
    """The log after two appends; each line has a number of its own, in file order."""
    path = new_folder(spark, "status")
    statuses = _statuses(spark, sf)
    for batch in (0, 1):
        logs.append_status_log(statuses.filter(F.col("script_id") % 2 == batch), path)
    read = logs.read_status_log(spark, path)
    numbers = read.agg(
        F.count_distinct("line_no").alias("lines"), F.min("line_no").alias("a"), F.max("line_no").alias("b")
    ).first()
    # which file is first depends on its name: ids are numbered anew, from the first number read
    ranks = logs.dense_index(read.select("script_id", "status"), ["script_id"], "line_no", numbers["a"])
    return ranks.withColumn("lines", F.lit(numbers["lines"]).cast("long")).filter(
        F.col("line_no") <= numbers["b"]
    )


@registry.add(
    "latest_logged_status",
    """select event_id % 997 as script_id, 0 as status, min(event_id) as first_line from events group by all""",
)
def latest_logged_status(spark: SparkSession, sf: str) -> DataFrame:
    """A log in files by range of time, whose last line for every id says 0: the last line wins."""
    path = new_folder(spark, "status")
    runs = table(spark, sf, "events").select((F.col("event_id") % 997).alias("script_id"), "event_id")
    last = runs.groupBy("script_id").agg(F.max("event_id").alias("last"))
    lines = runs.join(last, "script_id").select(
        "event_id", "script_id", F.when(F.col("event_id") == F.col("last"), 0).otherwise(3).alias("status")
    )
    logs.append_status_log(lines.orderBy("event_id"), path)
    firsts = runs.groupBy("script_id").agg(F.min("event_id").alias("first_line"))
    return logs.latest_status(logs.read_status_log(spark, path)).join(firsts, "script_id")


def _project(script: str):
    return F.pmod(F.col(script).cast("long"), F.lit(PROJECTS)).cast("int")


_PROJECT_SQL = f"(script::bigint % {PROJECTS})::int as project"


@registry.add(
    "trace_files",
    f"""with {CALLS_SQL} select {_PROJECT_SQL}, call_id, func_module, func_name,
  array_to_string(list_sort(dependencies), ',') as dependencies, count(*) as n from named group by all""",
)
def trace_files(spark: SparkSession, sf: str) -> DataFrame:
    """Call events written as JSON of several projects and loaded with their project numbers."""
    root = new_folder(spark, "traces")
    calls = trace_calls(spark, sf).withColumn("project", _project("script"))
    for number in range(PROJECTS):
        part = calls.filter(F.col("project") == number).select(
            "call_id", "func_module", "func_name", "dependencies"
        )
        part.write.json(f"{root}/project_{number}/scripts/run")
    events = logs.load_trace_events(spark, root)
    return events.groupBy(
        "project", "call_id", "func_module", "func_name",
        F.array_join(F.sort_array("dependencies"), ",").alias("dependencies"),
    ).agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "saved_traces", f"with {CALLS_SQL} select {_PROJECT_SQL}, script, call_id, func_name from named"
)
def saved_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Traces saved by project and read one project at a time."""
    path = new_folder(spark, "saved")
    calls = trace_calls(spark, sf).withColumn("project", _project("script"))
    logs.save_trace(calls.select("project", "script", "call_id", "func_name"), path)
    read = [
        spark.read.parquet(path).filter(F.col("project") == n).select(
            "project", F.col("script").cast("string").alias("script"), "call_id", "func_name"
        )
        for n in range(PROJECTS)
    ]
    return read[0].unionByName(read[1]).unionByName(read[2])


@registry.add(
    "ratio_file",
    """select o_orderkey as script, round(o_totalprice / (1 + o_orderkey % 7), 4) as ratio from orders""",
)
def ratio_file(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios written as CSV with a header and read back."""
    path = new_folder(spark, "ratios")
    ratios = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("script"),
        (F.col("o_totalprice") / (1 + F.col("o_orderkey") % 7)).alias("ratio"),
    )
    logs.write_ratios(ratios, path)
    read = spark.read.csv(path, header=True, schema="script long, ratio double")
    return read.select("script", F.round("ratio", 4).alias("ratio"))
