"""Incremental ingestion of crawled records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork import schemas
from loomwork.session import cut_lineage


class IngestSink:
    """Batch function for `foreachBatch` over a target that other jobs fill too.

    It compares with the stored tables instead of state, which reads them every batch.

    Every batch owns one folder per table and overwrites it, and compares only with earlier
    batches; a batch that runs again after a lost driver or executor gives the same rows.
    With `contents` a record whose code is stored already under another key is left out too.
    """

    def __init__(self, target: str, failed: str, by: str = "link", contents: bool = False):
        self.target, self.failed, self.by, self.contents = target, failed, by, contents

    def _before(self, spark: SparkSession, path: str, batch: int) -> DataFrame:
        schema = f"{schemas.CRAWLED}, batch_id BIGINT"
        try:
            rows = spark.read.schema(schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], schema)
        return rows.filter(F.col("batch_id") < batch)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = F.sha2(F.col(self.by), 256)
        # one row per key, chosen by value so that a rerun chooses the same
        row = F.struct("link", "user", "votes", "language", "code")
        fresh = batch.groupBy(key.alias("__key")).agg(F.min(row).alias("row"))
        for path in (self.target, self.failed):
            seen = self._before(spark, path, batch_id).select(key.alias("__key")).distinct()
            fresh = fresh.join(seen, "__key", "left_anti")
        fresh = fresh.select("row.*").persist()
        try:
            good = F.col("code").isNotNull() & F.col("language").isNotNull()
            stored = fresh.filter(good)
            if self.contents:
                code = F.sha2("code", 256).alias("__code")
                seen = self._before(spark, self.target, batch_id).select(code).distinct()
                stored = stored.groupBy(code).agg(F.min(row).alias("row")).join(
                    seen, "__code", "left_anti"
                ).select("row.*")
            for path, rows in ((self.target, stored),
                               (self.failed, fresh.filter(~good))):
                rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            fresh.unpersist()


#: the state of links and digests lives on disk and only its changes are written with a batch
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def unseen(crawled: DataFrame, by: str = "link", contents: bool = True) -> DataFrame:
    """Rows of a stream whose key, and whose code if `contents`, did not come before.

    Keys and digests are kept as state, so a batch reads no stored row. A row without code or
    language counts by its key alone: it takes the key, but no content.
    """
    names = crawled.columns
    key = F.sha2(F.coalesce(F.concat(F.lit("k"), by), F.lit("")), 256)
    fresh = crawled.withColumn("__key", key).dropDuplicates(["__key"])
    if contents:
        good = F.col("code").isNotNull() & F.col("language").isNotNull()
        digest = F.when(good, F.concat(F.lit("c"), F.sha2("code", 256)))
        fresh = fresh.withColumn(
            "__content", F.coalesce(digest, F.concat(F.lit("k"), "__key"))
        ).dropDuplicates(["__content"])
    return fresh.select(*names)


class SplitSink:
    """Batch function for `foreachBatch`: complete rows to one table, failed ones to another.

    Every batch owns one folder per table and overwrites it, so it may run again.
    """

    def __init__(self, target: str, failed: str):
        self.target, self.failed = target, failed

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        good = F.col("code").isNotNull() & F.col("language").isNotNull()
        # stored once, so that both tables see the same choice among equal keys
        batch = cut_lineage(batch)
        for path, rows in ((self.target, batch.filter(good)), (self.failed, batch.filter(~good))):
            rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def ingest_stream(
    crawled: DataFrame, target: str, failed: str, checkpoint: str, by: str = "link",
    contents: bool = True, **trigger,
) -> StreamingQuery:
    """Start ingesting a stream of crawled rows; trigger defaults to what is available now.

    A record whose code is stored already under another key is left out unless `contents` is False.
    """
    spark = crawled.sparkSession
    provider = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)  # a started query keeps the settings it began with
    try:
        return (
            unseen(crawled, by, contents).writeStream.foreachBatch(SplitSink(target, failed))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        spark.conf.set(_PROVIDER, provider)
