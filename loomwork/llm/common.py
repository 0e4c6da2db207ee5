"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def let(value: Column, body) -> Column:
    """Evaluate a column once and give it a name inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_share(key: Column, rows: int, total: int, seed: int = 0) -> Column:
    """True for about `rows` of `total` rows, chosen by a hash of their key."""
    bound = int(1_000_000 * min(1.0, rows / max(total, 1)))
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < bound
