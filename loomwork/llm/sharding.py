"""Sharding by extendible hashing, in DataFrame expressions only.

A shard is a hash prefix: the shallowest one whose rows fit the byte limit. The directory holds
2^depth entries per round, each pointing to its shard; rows meet it by an equi-join on their
prefix. Prefixes that are still too large at the depth of a round are split by more bits in the
next one. The directory is made from hashes and sizes alone; then each text moves once, to the
task that writes its shard. A shard is a folder of Parquet files, one for each page.

A shard above the limit holds one key only. Its different rows are counted before they move, laid
out one after the other by size, and cut into pages; copies are unfolded where their page is
written, so a hot key is dealt over as many tasks as it has pages.

Defined cases: null text has 0 bytes; a null key hashes like an empty text; rows with equal keys
stay together while they fit and are dealt over numbered pages of the shard otherwise; a row above
the limit gets a page of its own and is marked by `fits`; rows that share an id, or are equal in
all columns, are each written; ties in size go by key, then by content; an empty table has no
shards. All columns of a row are written as one struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from loomwork.functions import ordered
from loomwork.session import cut_lineage

#: bits of the hash: 15 hexadecimal digits of an md5
HASH_BITS = 60
#: bytes of a shard
LIMIT = 16 << 20
#: a writing task sorts one shard on average, or this many bytes of small ones
TASK_BYTES = 4 << 20
#: texts vary in length, so the size of a page is looked at often; zstd compresses it as a stream,
#: where the default needs buffers outside the heap as large as the page
PARQUET = {"compression": "zstd", "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "64"}
#: hot keys that may be broadcast, of four numbers each
BROADCAST_KEYS = 100_000
#: copies of a row that one task unfolds
COPIES = 1 << 16


def key_hash(key: Column) -> Column:
    """60 hash bits of the key as text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by.cast("int"))


def _prefix(h: Column, bits: int) -> Column:
    return _shift(h, F.lit(HASH_BITS - bits))


def directory(sizes: DataFrame, depth: int, bits: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Directory entries (entry, prefix, depth) of one round, and entries that need more bits.

    `sizes` has one row for each entry of `bits` hash bits with its bytes and distinct keys.
    Depths up to `depth` were tried in earlier rounds.
    """
    tried = F.explode(F.sequence(F.lit(depth), F.lit(bits))).alias("depth")
    levels = sizes.select("entry", "bytes", "keys", tried)
    prefix = _shift(F.col("entry"), F.lit(bits) - F.col("depth"))
    levels = levels.withColumn("prefix", prefix)
    sums = levels.groupBy("depth", "prefix").agg(
        F.sum("bytes").alias("bytes"), F.sum("keys").alias("keys")
    )
    fitting = sums.filter(
        (F.col("bytes") <= limit) | (F.col("keys") == 1) | (F.col("depth") == HASH_BITS)
    )
    entries = (
        levels.select("entry", "depth", "prefix")
        .join(fitting.select("depth", "prefix"), ["depth", "prefix"])
        .groupBy("entry")
        .agg(F.min_by(F.struct("prefix", "depth"), "depth").alias("at"))
        .select("entry", "at.prefix", "at.depth")
    )
    return entries, sizes.join(entries, "entry", "left_anti").select("entry")


def find_shards(hashes: DataFrame, total: int, limit: int) -> DataFrame:
    """(h, prefix, depth, bytes) of every hash, from (h, bytes)."""
    # some entries more than shards: one round is enough unless a shard is far from the mean
    bits, depth, rest, found = min(HASH_BITS, max(4, (total // limit).bit_length() + 3)), 0, hashes, None
    while True:
        sizes = rest.groupBy(_prefix(F.col("h"), bits).alias("entry")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("keys")
        )
        entries, larger = directory(sizes, depth, bits, limit)
        entries = cut_lineage(entries)
        placed = rest.withColumn("entry", _prefix(F.col("h"), bits)).join(entries, "entry")
        placed = placed.select("h", "prefix", "depth", "bytes")
        found = placed if found is None else found.unionByName(placed)
        if bits == HASH_BITS or not larger.head(1):
            return found
        rest = cut_lineage(
            rest.withColumn("entry", _prefix(F.col("h"), bits))
            .join(entries.select("entry"), "entry", "left_anti").select("h", "bytes")
        )
        depth, bits = bits + 1, min(HASH_BITS, bits + 8)


def _pages(groups: DataFrame, limit: int) -> DataFrame:
    """(h, n_bytes, content, page, times, block) of the rows of hot keys.

    `groups` has one row for each different row of a hot key, with its number of copies.
    """
    half = max(1, limit // 2)
    n, copies = F.col("n_bytes"), F.col("copies")
    is_small = n <= half
    at = F.struct("n_bytes", "key", "content").alias("at")
    laid = ordered.running(
        ordered.ranked(groups.select("h", "n_bytes", "content", "copies", at), ["h"], "at", "place"),
        ["h"], "place", exclusive=True,
        sums={
            "small": F.when(is_small, n * copies).otherwise(F.lit(0)),
            "large": F.when(is_small, F.lit(0)).otherwise(copies),
        },
    )
    first = F.when(is_small, F.floor(F.col("small") / half)).otherwise(
        F.ceil(F.col("small") / half) + F.col("large")
    )
    last = F.when(
        is_small, F.floor((F.col("small") + (copies - 1) * n) / half)
    ).otherwise(first + copies - 1)
    paged = laid.select("*", F.explode(F.sequence(first, last)).alias("page"))

    def before(page: Column) -> Column:
        # copies that begin before a page
        return F.least(copies, F.greatest(F.lit(0), F.ceil((page * half - F.col("small")) / n)))

    times = F.when(n == 0, copies).when(~is_small, F.lit(1)).otherwise(
        before(F.col("page") + 1) - before(F.col("page"))
    ).cast("long")
    paged = paged.withColumn("times", times)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {COPIES}")))
    return paged.select("h", "n_bytes", "content", "page", "times", block.alias("block")).withColumn(
        "times", F.least(F.lit(COPIES), F.col("times") - F.col("block") * COPIES)
    )


def place(
    docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", size: Column | None = None,
) -> DataFrame:
    """(document, n_bytes, shard, page, shard_bytes) of every row; rows of a page lie together.

    `shard` is the prefix in bits, '' for a single shard.
    """
    n = F.coalesce(F.octet_length("text") if size is None else size, F.lit(0)).cast("long")
    rows = docs.select(
        F.struct(*docs.columns).alias("document"), n.alias("n_bytes"), key_hash(F.col(key)).alias("h")
    )
    hashes = cut_lineage(rows.groupBy("h").agg(F.sum("n_bytes").alias("bytes")))
    total = hashes.agg(F.sum("bytes")).first()[0] or 0
    found = cut_lineage(find_shards(hashes, total, limit))
    shards = found.groupBy("prefix", "depth").agg(F.sum("bytes").alias("shard_bytes"))
    shards = cut_lineage(shards)
    over = F.col("shard_bytes") > limit
    seen = shards.agg(
        F.min(F.when(~over, F.col("depth"))), F.count_if(over),
        F.sum(F.when(over, F.col("shard_bytes"))),
    ).first()
    coarse, n_hot, hot_bytes = seen[0] or 0, seen[1], seen[2] or 0
    per_task = max(TASK_BYTES, limit)
    hot = found.join(shards.filter(over), ["prefix", "depth"]).select("h", "prefix", "depth", "shard_bytes")
    if 0 < n_hot <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    cold = rows.join(hot.select("h"), "h", "left_anti") if n_hot else rows
    # no shard is shallower than `coarse` bits, so a task that holds such a prefix holds whole shards
    cold = cold.withColumn("coarse", _prefix(F.col("h"), coarse))
    cold = cold.repartition(max(1, min(1 << coarse, -(-(total - hot_bytes) // per_task))), "coarse")
    fitting = shards.filter(~over).withColumn(
        "coarse", _shift(F.col("prefix"), F.col("depth") - F.lit(coarse))
    )
    inside = _shift(F.col("h"), F.lit(HASH_BITS) - F.col("depth")) == F.col("prefix")
    out = ["document", "n_bytes", "prefix", "depth", "page", "shard_bytes"]
    placed = (
        cold.join(fitting.hint("shuffle_hash").withColumnRenamed("coarse", "_coarse"),
                  (F.col("coarse") == F.col("_coarse")) & inside)
        .withColumn("page", F.lit(0).cast("long")).select(*out)
    )
    if n_hot:
        content = F.md5(F.to_json(F.struct("document")))
        rows = rows.join(hot.select("h"), "h").select("*", content.alias("content"))
        named = F.coalesce(F.col(f"document.{key}").cast("string"), F.lit("")).alias("key")
        counted = rows.groupBy("h", "n_bytes", "content", named).agg(F.count(F.lit(1)).alias("copies"))
        texts = rows.groupBy("h", "n_bytes", "content").agg(F.first("document").alias("document"))
        tasks = max(1, -(-hot_bytes // per_task))
        unfolded = (
            _pages(counted, limit).join(texts, ["h", "n_bytes", "content"])
            .repartition(tasks, "h", "page", "block")
            .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        )
        placed = placed.unionByName(unfolded.join(hot, "h").select(*out))
    bits_text = F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))
    shard = F.when(F.col("depth") == 0, "").otherwise(bits_text).alias("shard")
    return placed.select("document", "n_bytes", shard, "page", "shard_bytes")


def assign_shards(
    docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", size: Column | None = None,
) -> DataFrame:
    """One row per row of `docs`: key, n_bytes, shard, page, fits and shard_bytes; writes nothing."""
    return place(docs, limit, key, size).select(
        F.col(f"document.{key}").alias(key), "n_bytes", "shard", "page",
        (F.col("n_bytes") <= limit).alias("fits"), "shard_bytes",
    )


def write_shards(
    docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", size: Column | None = None,
) -> None:
    """Write every row of `docs` into the folder of its shard and page under `path`."""
    placed = place(docs, limit, key, size)
    # the name of a folder may not be empty
    named = placed.select(
        "document", "n_bytes", F.concat(F.lit("b"), "shard").alias("shard"), "page"
    )
    named.write.mode("errorifexists").options(**PARQUET).partitionBy("shard", "page").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(document, n_bytes, shard, page) of the written rows; `schema` is that of the documents."""
    fields = StructType().add("document", schema).add("n_bytes", LongType())
    fields = fields.add("shard", StringType()).add("page", LongType())
    rows = spark.read.schema(fields).parquet(path)
    return rows.withColumn("shard", F.substring("shard", 2, HASH_BITS))


def read_digests(spark: SparkSession, path: str, schema: StructType, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard, page, fits and shard_bytes of the rows in the files under `path`."""
    n = F.coalesce(F.octet_length("document.text"), F.lit(0)).cast("long")
    rows = read_shards(spark, path, schema).select(
        F.col("document.doc_id").alias("doc_id"), n.alias("n_bytes"), "shard", "page"
    )
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return rows.join(sums, "shard").select(
        "doc_id", "n_bytes", "shard", "page", (F.col("n_bytes") <= limit).alias("fits"), "shard_bytes"
    )


def sql(limit: int = LIMIT) -> str:
    half = max(1, limit // 2)
    return f"""
    with h as (select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
        ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h,
        row_number() over () as rid from documents),
    k as (select h, sum(n_bytes)::bigint as bytes from h group by h),
    l as (select h, d, h >> (60 - d)::int as p, bytes from k, generate_series(0, 60) as s(d)),
    s as (select d, p, sum(bytes)::bigint as shard_bytes from l group by d, p
        having sum(bytes) <= {limit} or count(*) = 1 or d = 60),
    m as (select l.h, min(l.d) as d from l join s using (d, p) group by l.h),
    c as (select *, coalesce(sum(case when n_bytes <= {half} then n_bytes else 0 end) over w, 0) as small,
        coalesce(sum(case when n_bytes > {half} then 1 else 0 end) over w, 0) as large from h
        window w as (partition by h order by n_bytes, rid rows between unbounded preceding and 1 preceding))
    select doc_id, n_bytes,
        case when m.d = 0 then '' else right(bin(h.h + (1::bigint << 60)), 60)[1:m.d] end as shard,
        (case when shard_bytes <= {limit} then 0 when n_bytes <= {half} then small // {half}
            else ceil(small / {half}) + large end)::bigint as page,
        n_bytes <= {limit} as fits, shard_bytes
    from c as h join m using (h) join s on s.d = m.d and s.p = h.h >> (60 - m.d)::int
    """
