"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

The bands and rows of the signature are the cheapest that reach the target recall at the
threshold. Texts with equal n-gram sets become one representative first, by a 128-bit digest of
the sorted set. Representatives are shuffled on band hashes; each bucket links its members to its
smallest one only, and the components of these stars are the candidate groups. No pair is ever
a row: a group of up to `TILE` representatives is compared in one task by counting common
n-grams of all its members at once; a larger one is cut into layers by set size (sets whose sizes
differ by more than the threshold allows can't be similar) and tiles inside layers, and each pair
of tiles of equal or neighbouring layers is a task. Tasks return a count of links and a root for
each member, so classes are components of verified links and counts are exact for every pair that
shares a candidate group.

Defined cases: n-grams are of `n` words between ASCII white space, as they stand; a text with
fewer words has all of them as its only n-gram; null texts, empty texts and texts without words
have no links and are classes of their own; rows with equal texts link to each other, also those
with equal ids; null ids order after all others; an empty table gives an empty result. Only
doc_id and text are read; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import vocab
from loomwork.operators.graph import connected_components
from loomwork.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: representatives compared in one task, on each side
TILE = 512
#: cells of a block of the membership matrix
CELLS = 8_000_000


#: all links of five-word n-grams by an inverted join, and classes as their closure
SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then
    list_transform(generate_series(1, len(ws) - 4), lambda k: array_to_string(ws[k:k + 4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as i, b.doc_id as j, count(*) as c from s a join s b
    on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select i, j from p join n x on x.doc_id = i join n y on y.doc_id = j
    where 5 * c >= 4 * (x.n + y.n - c)),
r as (select doc_id as i, doc_id as j from documents
    union select r.i, l.j from r join l on r.j = l.i),
k as (select i, count(*) as links from l group by i)
select r.i as doc_id, min(r.j) as class_id, coalesce(max(k.links), 0)::bigint as n_links
from r left join k on k.i = r.i group by r.i
"""


def bands_and_rows(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most selective (bands, rows) within `most` hashes that reach the recall."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > vocab.MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all texts, one text after the other, and their numbers."""
    hashes = vocab.held(_Hashes)
    words = [t.encode().split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.concatenate(
        [np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w in words]
        or [np.zeros(0, np.uint64)]
    )
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    starts = np.cumsum(lengths) - lengths
    firsts = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    grams = np.repeat(np.minimum(lengths, n).astype(np.uint64), counts)
    sizes = np.repeat(np.minimum(lengths, n), counts)
    for k in range(n):
        inside = sizes > k
        at = np.where(inside, firsts + k, 0)
        grams = np.where(inside, _mixed(grams * _MIX + flat[at]), grams) if len(at) else grams
    return grams, counts


def signatures(
    texts: list[str], bands: int, rows: int, n: int = WORDS, seed: int = 11
) -> tuple[list, list, list]:
    """Digest of the n-gram set, its size and the band hashes of each text."""
    grams, counts = shingles(texts, n)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    random = np.random.default_rng(seed)
    factors = random.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
    shifts = random.integers(0, 1 << 32, bands * rows, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    hashes = np.zeros((len(full), bands), np.uint64)
    for band in range(bands):
        mixed = np.full(len(full), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            values = short * factors[k]
            values += shifts[k]
            mixed = _mixed(mixed * _MIX + np.minimum.reduceat(values, starts)) if len(full) else mixed
        hashes[:, band] = mixed
    keys: list = [None] * len(texts)
    sizes, lists = [0] * len(texts), [[]] * len(texts)
    for at, i in enumerate(full):
        own = np.unique(grams[starts[at] : starts[at] + counts[i]])
        keys[i] = hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest()
        sizes[i] = len(own)
        lists[i] = hashes[at].view(np.int64)
    return keys, sizes, lists


def sign(docs: DataFrame, threshold: float, recall: float, n: int) -> DataFrame:
    """doc_id, h (hash of the text), key, size and bands of every row."""
    vocab.small_batches(docs.sparkSession)
    bands, rows = bands_and_rows(threshold, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in vocab.steps(texts):
                keys, sizes, lists = signatures(texts[start:end], bands, rows, n)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("h"), pa.array(keys, pa.string()),
                        pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "h", "key", "size", "bands"],
                )

    rows_in = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows_in.mapInArrow(run, f"doc_id {kind}, h long, key string, size long, bands array<long>")


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(node, component) of the representatives that share a bucket with another one."""
    rows = reps.select("node", F.explode("bands").alias("bucket"))
    lowest = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    lowest = lowest.filter("low <> high").select("bucket", "low")
    stars = rows.join(lowest, "bucket").filter("node <> low")
    return connected_components(stars.select(F.col("node").alias("src"), F.col("low").alias("dst")))


def _tiles(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Members with the tile pairs they take part in: layer, x, y, kind and side."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("in_component"))
    members = members.join(sizes, "component").withColumn(
        "layer", F.floor(F.log(F.col("size")) / -math.log(threshold)).cast("int")
    )
    one = F.struct(
        F.lit(-1).alias("layer"), F.lit(0).alias("x"), F.lit(0).alias("y"),
        F.lit("one").alias("kind"), F.lit(0).alias("side"),
    )
    small = members.filter(F.col("in_component") <= tile).withColumn("at", one)
    large = members.filter(F.col("in_component") > tile)
    layers = large.groupBy("component", "layer").agg(
        F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")
    )
    large = (
        large.join(layers, ["component", "layer"])
        .join(
            layers.select("component", (F.col("layer") - 1).alias("layer"), F.col("tiles").alias("up")),
            ["component", "layer"], "left",
        )
        .join(
            layers.select("component", (F.col("layer") + 1).alias("layer"), F.col("tiles").alias("down")),
            ["component", "layer"], "left",
        )
        .withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    )

    def pair(layer, x, y, kind, side):
        return F.struct(
            layer.cast("int").alias("layer"), x.cast("int").alias("x"), y.cast("int").alias("y"),
            F.lit(kind).alias("kind"), side.cast("int").alias("side"),
        )

    def upto(count):
        numbers = F.sequence(F.lit(0), F.coalesce(count, F.lit(0)))
        return F.filter(numbers, lambda b: b < F.coalesce(count, F.lit(0)))

    own, layer = F.col("own"), F.col("layer")
    pairs = F.concat(
        F.transform(
            upto(F.col("tiles")),
            lambda b: pair(layer, F.least(own, b), F.greatest(own, b), "in", (own > b).cast("int")),
        ),
        F.transform(upto(F.col("up")), lambda b: pair(layer, own, b, "up", F.lit(0))),
        F.transform(upto(F.col("down")), lambda b: pair(layer - 1, b, own, "up", F.lit(1))),
    )
    large = large.withColumn("at", F.explode(pairs))
    columns = ["component", "key", "copies", "rep", "at"]
    return small.select(columns).unionByName(large.select(columns)).select(
        "component", "key", "copies", "rep", "at.*"
    )


def common_counts(grams: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common n-grams of each of the `left` sets with each of the `right` ones."""
    counts = np.zeros((len(left), len(right)), np.float32)
    _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    at, owner = at[shared], owner[shared]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    n = int(owner.max()) + 1 if len(owner) else 0
    width = max(1, CELLS // max(1, n))
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [first, first + width])
        block = np.zeros((max(n, int(max(left.max(), right.max())) + 1), width), np.float32)
        block[owner[a:b], at[a:b] - first] = 1
        counts += block[left] @ block[right].T
    return counts


def _compare(threshold: float, n: int):
    def run(table: pa.Table) -> pa.Table:
        first = {k: i for i, k in reversed(list(enumerate(table.column("key").to_pylist())))}
        table = table.take(sorted(first.values()))
        keys = table.column("key").to_pylist()
        side = np.array(table.column("side").to_pylist())
        kind, x, y = (table.column(c)[0].as_py() for c in ("kind", "x", "y"))
        copies = np.array(table.column("copies").to_pylist(), np.int64)
        grams, counts = shingles(table.column("text").to_pylist(), n)
        ends = np.cumsum(counts)
        sets = [np.unique(grams[e - c : e]) for e, c in zip(ends, counts, strict=True)]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        whole = kind == "one" or (kind == "in" and x == y)
        left = np.arange(len(sets)) if whole else np.flatnonzero(side == 0)
        right = left if whole else np.flatnonzero(side == 1)
        links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
        if len(left) and len(right):
            same = common_counts(np.concatenate(sets), owner, left, right)
            union = sizes[left][:, None] + sizes[right][None, :] - same
            near = same >= threshold * union - 1e-6
            if whole:
                np.fill_diagonal(near, False)
            links[left] += near @ copies[right]
            if not whole:
                links[right] += near.T @ copies[left]
            a, b = np.nonzero(near)
            a, b = left[a], right[b]
            while len(a):  # smallest member of each component
                before = root.copy()
                np.minimum.at(root, a, root[b])
                np.minimum.at(root, b, root[a])
                root = root[root]
                if (root == before).all():
                    break
        return pa.table(
            {
                "key": keys, "links": links, "root": [keys[r] for r in root],
                "final": [kind == "one"] * len(keys),
            },
            schema=pa.schema(
                [("key", pa.string()), ("links", pa.int64()), ("root", pa.string()), ("final", pa.bool_())]
            ),
        )

    return run


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of `docs`: doc_id, h, class_id, class_h and n_links.

    (doc_id, h) names a row and its text; the class's first row is (class_id, class_h).
    """
    signed = cut_lineage(sign(docs, threshold, recall, n))
    name = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    reps = signed.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min(name).alias("rep"),
        F.first("size").alias("size"), F.first("bands").alias("bands"),
    )
    node = F.conv(F.substring("key", 1, 15), 16, 10).cast("long")
    reps = reps.withColumn("node", node)
    groups = candidate_groups(reps)
    reps = cut_lineage(reps.drop("bands"))
    members = cut_lineage(reps.join(groups, "node"))
    texts = (
        docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
        .groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    )
    wanted = members.select("key", F.col("rep.doc_id").alias("_id"), F.col("rep.h").alias("_h"))
    found = texts.join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    ).select("key", "text")
    tiles = _tiles(members, threshold, tile).drop("rep").join(found, "key")
    compared = cut_lineage(
        tiles.groupBy("component", "layer", "x", "y", "kind").applyInArrow(
            _compare(threshold, n), "key string, links long, root string, final boolean"
        )
    )
    links = compared.groupBy("key").agg(F.sum("links").alias("links"))
    linked = compared.filter("key <> root").select("key", "root", "final").distinct()
    roots = linked.filter("final").select("key", "root").unionByName(
        connected_components(
            linked.filter("not final").select(F.col("key").alias("src"), F.col("root").alias("dst"))
        ).select(F.col("node").alias("key"), F.col("component").alias("root"))
    )
    found = reps.select("key", "copies", "rep").join(links, "key", "left").join(roots, "key", "left")
    found = found.withColumn("root", F.coalesce("root", "key"))
    firsts = found.groupBy("root").agg(F.min("rep").alias("first"))
    found = found.join(firsts, "root").select(
        "key", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return signed.select("doc_id", "h", "key").join(found, "key", "left").select(
        "doc_id", "h",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(F.col("key").isNull(), F.col("h")).otherwise(F.col("first.h")).alias("class_h"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
