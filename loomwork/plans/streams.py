"""Streaming queries: tables written as files, read back as streams until done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork import schemas
from loomwork.functions.ordered import running
from loomwork.plans.common import Registry, table
from loomwork.plans.corpora import CRAWLED_SQL, crawled_rows
from loomwork.plans.traces import _DEPS_SQL, _REPEAT_SQL, raw_events
from loomwork.session import checkpoint_folder, cut_lineage
from loomwork.streaming.events import latest_status_stream, reduce_events_stream
from loomwork.streaming.ingest import ingest_stream

registry = Registry()


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


@registry.add(
    "reduce_events_stream",
    f"""with recursive {_REPEAT_SQL}, {_DEPS_SQL}
select k.script, k.call_id, site, current_loop, k.func_module, k.func_name,
  array_to_string(coalesce(d, []), ',') as dependencies
from kept k left join deps using (script, seq)""",
)
def reduce_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive in two waves, odd positions first, so half of them have to wait."""
    base = _folder(spark)
    rows = raw_events(spark, sf)
    counted = running(rows, ["script"], "seq", sums={"n": F.lit(1).cast("long")})
    dense = cut_lineage(counted.withColumn("seq", F.col("n") - 1).drop("n"))
    for wave in (1, 0):
        dense.filter(F.col("seq") % 2 == wave).write.mode("append").parquet(f"{base}/in")
    stream = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8)
        .parquet(f"{base}/in")
    )
    query = (
        reduce_events_stream(stream).writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "script", "call_id", F.col("static_instr_id").alias("site"),
        F.col("static_loop_id").alias("current_loop"), "func_module", "func_name",
        F.array_join("dependencies", ",").alias("dependencies"),
    )


@registry.add(
    "ingest_stream",
    f"""with {CRAWLED_SQL}
select link, "user", votes, language from crawled where code is not null and language is not null""",
)
def ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Every crawled row arrives twice."""
    base = _folder(spark)
    for _ in range(2):
        crawled_rows(spark, sf).write.mode("append").parquet(f"{base}/in")
    stream = (
        spark.readStream.schema(schemas.CRAWLED).option("maxFilesPerTrigger", 2)
        .parquet(f"{base}/in")
    )
    ingest_stream(
        stream, f"{base}/target", f"{base}/failed", f"{base}/state", contents=False
    ).awaitTermination()
    return spark.read.parquet(f"{base}/target").select("link", "user", "votes", "language")


@registry.add(
    "ingest_stream_contents",
    f"""with {CRAWLED_SQL}
select md5(code) as code_md5, count(distinct code)::bigint as records from crawled
where code is not null and language is not null group by 1""",
)
def ingest_contents(spark: SparkSession, sf: str) -> DataFrame:
    """As above, with records refused whose code came under another link; one is left of each."""
    base = _folder(spark)
    for _ in range(2):
        crawled_rows(spark, sf).write.mode("append").parquet(f"{base}/in")
    stream = (
        spark.readStream.schema(schemas.CRAWLED).option("maxFilesPerTrigger", 2)
        .parquet(f"{base}/in")
    )
    ingest_stream(stream, f"{base}/target", f"{base}/failed", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/target").groupBy(F.md5("code").alias("code_md5")).agg(
        F.count(F.lit(1)).alias("records")
    )


@registry.add(
    "latest_status_stream",
    """select event_id % 4001 as script_id, arg_max(user_id % 5, event_id) as status
from events group by all""",
)
def status_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = _folder(spark)
    log = table(spark, sf, "events").select(
        F.col("event_id").alias("line_no"), (F.col("event_id") % 4001).alias("script_id"),
        (F.col("user_id") % 5).cast("int").alias("status"),
    )
    log.repartition(4, "line_no").write.parquet(f"{base}/in")
    stream = (
        spark.readStream.schema(schemas.STATUS_LOG).option("maxFilesPerTrigger", 2)
        .parquet(f"{base}/in")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = (
        latest_status_stream(stream).writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
