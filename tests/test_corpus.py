import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as tx
from loomwork.operators import corpus, similarity as sim
from loomwork.sources import tables

from .conftest import rows


def ratio(a, b):
    if not a and not b:
        return 1.0
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


@pytest.mark.parametrize(
    "a, b", [("abc", "abd"), ("abcd", "abce"), ("", ""), ("", "x"), ("a\U0001F600b", "\U0001F600a")]
)
def test_quick_ratio(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(
        tx.quick_ratio(tx.char_counts(F.col("a")), tx.char_counts(F.col("b")), F.length("a"),
                       F.length("b"))
    ).first()[0]
    assert got == pytest.approx(ratio(a, b))


def test_code_lines(spark):
    source = "x = 1\n\n# c\n's'\n  y\n\"d\"\n"
    df = spark.createDataFrame([(source,)], "text string")
    assert corpus.count_loc(df).first()["loc"] == 2
    blank = spark.createDataFrame([(None,)], "text string")
    assert corpus.count_loc(blank).first()["loc"] == 0


def test_strip_takes_unicode_space(spark):
    df = spark.createDataFrame([("\u00a0\u3000 a b\x1c\t",)], "s string")
    assert df.select(tx.strip(F.col("s"))).first()[0] == "a b"


def test_standardize_code_drops_unparsable(spark):
    df = spark.createDataFrame(
        [(1, "if  x :\n\n   y=1 # c"), (2, "def ("), (3, "# only")], "id int, script string"
    )
    got = rows(corpus.standardize(df, code=True))
    assert got == [(1, "if x:\ny = 1")]


def brute_components(items):
    root = {i: i for i, _, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for i, k, a in items:
        for j, m, b in items:
            if i < j and k == m and ratio(a, b) > sim.THRESHOLD:
                linked |= {i, j}
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in linked}


def make_items(n, seed):
    """One group holds most rows; texts come in families of very different sizes."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "zzz", "qqq", "0123", "----"]
    items = []
    for i in range(n):
        family = rng.randrange(5)
        size = rng.choice([3, 8, 20, 60])
        text = "".join(rng.choice(words[family:family + 2]) for _ in range(size))
        items.append((i, "hot" if rng.random() < 0.7 else rng.choice("xyz"), text))
    items += [(n + j, "hot", items[0][2]) for j in range(5)]
    return items


@pytest.mark.parametrize("tile", [4, 1024])
def test_similarity_of_hot_group_matches_brute_force(spark, tile):
    items = make_items(70, tile)
    df = spark.createDataFrame(items, "id long, k string, script string")
    counted = sim.with_char_counts(df)
    want = {
        (i, j) for i, k, a in items for j, m, b in items
        if i < j and k == m and ratio(a, b) > sim.THRESHOLD
    }
    got = sim.similar_pairs(counted, ["k"], tile_rows=tile).collect()
    assert len(got) == len(want) and {(r["id1"], r["id2"]) for r in got} == want
    comps = dict(rows(sim.similar_components(counted, ["k"], tile_rows=tile)))
    assert comps == brute_components(items)


def test_null_keys_form_no_group(spark):
    df = spark.createDataFrame(
        [(1, None, "abc"), (2, None, "abc")], "id long, k string, script string"
    )
    assert sim.similar_pairs(sim.with_char_counts(df), ["k"]).count() == 0


def test_clean_keeps_largest_and_drops_fork(spark):
    data = [
        (1, None, "u", "aaaa bbbb cccc"),
        (2, 1, "v", "aaaa bbbb cccd"),  # resembles its parent: dropped
        (3, None, "w", "xyz" * 5),
        (4, None, "w", "xyz" * 6),  # longest of its set: kept
        (5, None, "w", "entirely different, 0123456789"),
        (6, None, "w", "  \n "),  # empty after standardizing
    ]
    df = spark.createDataFrame(data, "id long, parent_id long, k string, script string")
    kept = corpus.clean(df, ["k"])
    assert [r["id"] for r in kept.orderBy("id").collect()] == [1, 4, 5]
    assert corpus.conserved(kept, df).first() == (3, 6)


def test_new_records_null_rule(spark):
    crawled = spark.createDataFrame([("l", "u", 1, "Python", "b")],
                                    "link string, user string, votes int, language string, code string")
    existing = spark.createDataFrame([(None,), ("a",)], "content string")
    assert tables.new_records(crawled, existing).count() == 1
    assert tables.new_records(crawled, existing, null_aware=True).count() == 0


def test_append_records(spark, tmp_path):
    records = spark.createDataFrame([(5, 2, "c", 3)], "id long, lang_id int, code string, votes int")
    v, s = str(tmp_path / "v"), str(tmp_path / "s")
    assert tables.append_records(records, v, s) == 1
    tables.append_records(records, v, s)
    assert spark.read.parquet(v).count() == 2
    assert rows(spark.read.parquet(s)) == [(5, 3), (5, 3)]


def test_edit_distance_sample_is_bounded(spark):
    df = spark.range(500).select("id", F.concat(F.lit("t"), "id").alias("text"))
    got = corpus.sampled_edit_distances(df, batches=2, batch_size=5)
    assert got.count() == 2 * 10
    distances = [r["distance"] for r in got.collect()]
    assert distances == sorted(distances)


def clustered(spark, clusters, rng):
    """Texts of about one length; only those of the same cluster share most of their letters."""
    texts = []
    for c in range(clusters):
        letters = [chr(0x4E00 + 40 * c + i) for i in range(8)]
        for _ in range(12):
            texts.append("".join(rng.choices(letters, k=rng.randint(90, 110))))
    rng.shuffle(texts)
    return spark.createDataFrame(
        [(i, "g", t) for i, t in enumerate(texts)], "id long, k string, script string"
    ).repartition(4), texts


def test_cells_keep_all_pairs_and_skip_distant_ones(spark):
    rng = random.Random(3)
    compared = []
    for clusters in (12, 48):
        df, texts = clustered(spark, clusters, rng)
        items = sim.with_char_counts(df)
        banded = sim._banded(items, sim.THRESHOLD).withColumn("comp", F.col("id"))
        spread, pairs = sim.tile_pairs(banded, ["k"], sim.THRESHOLD, 32, forest=False)
        place = ["__band", "__node", "__tile"]
        sizes = {tuple(r[c] for c in place): r["count"] for r in spread.groupBy(*place).count().collect()}
        compared.append(
            sum(
                sizes[r["__band1"], r["__node1"], r["__tile1"]] * sizes[r["__band2"], r["__node2"], r["__tile2"]]
                for r in pairs.collect()
            )
        )
    got = {(r["id1"], r["id2"]) for r in sim.similar_pairs(items, ["k"], tile_rows=32).collect()}
    counts = [Counter(t) for t in texts]
    want = {
        (i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))
        if 2 * sum((counts[i] & counts[j]).values()) / (len(texts[i]) + len(texts[j])) > sim.THRESHOLD
    }
    assert got == want and want
    # four times the texts: 16 times the pairs, but about four times the compared ones
    assert compared[1] < 6 * compared[0]
    assert compared[1] < 0.2 * len(texts) ** 2 / 2


def test_packed_tiles_are_small_and_exact_beyond_short_counts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("etaoin shrdlu", k=rng.randint(400, 600))) for _ in range(200)]
    counted = sim.with_char_counts(spark.createDataFrame([(t,) for t in texts], "script string"))
    maps = sim._Maps.read(counted.toArrow().column("chars"))
    letters, data = maps.packed()
    again = sim._Maps.unpacked(letters, data)
    every = [dict(zip(again.letters, m)) for m in again.dense(np.arange(200), np.int32).T.tolist()]
    assert [{c: n for c, n in m.items() if n} for m in every] == [dict(Counter(t)) for t in texts]
    # as maps of one row each, a tile took several hundred bytes a row
    assert len(data) < 60 * len(texts)
    # more than 32,767 of one character, and texts of very different alphabets
    long = ["a" * 40000 + "b" * 9000, "a" * 50000, "a" * 33000 + "c" * 20000, "b" * 49000]
    items = [(i, "g", t) for i, t in enumerate(long)]
    counted = sim.with_char_counts(spark.createDataFrame(items, "id long, k string, script string"))
    got = {(r["id1"], r["id2"]): r["ratio"] for r in sim.similar_pairs(counted, ["k"]).collect()}
    want = {
        (i, j): ratio(a, b) for i, _, a in items for j, _, b in items
        if i < j and ratio(a, b) > sim.THRESHOLD
    }
    assert got == want and want


def shuffle_files(spark):
    """Sizes of the session's shuffle files by name."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def test_all_pairs_write_little_to_disk(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("etaoin shrdlucmfwyp", k=rng.randint(300, 360))) for _ in range(1500)]
    items = spark.createDataFrame(
        [(i, "g", t) for i, t in enumerate(texts)], "id long, k string, script string"
    ).repartition(4)
    counted = sim.cut_lineage(sim.with_char_counts(items))
    before = shuffle_files(spark)
    # one large band, whose cells are all near each other: nearly all pairs match
    got = sim.similar_pairs(counted, ["k"], tile_rows=96).count()
    counts = [Counter(t) for t in texts]
    some = range(0, 1500, 50)
    assert got > 0.9 * 1500 * 1499 / 2
    assert all(
        2 * sum((counts[i] & counts[j]).values()) > 0.75 * (len(texts[i]) + len(texts[j])) for i in some for j in some
    )
    written = sum(n for name, n in shuffle_files(spark).items() if name not in before)
    # each tile to each partner took several kilobytes a row
    assert written < 1200 * len(texts)


def test_equal_texts_fill_many_tiles_and_repeated_ids_stay(spark):
    items = [(i // 2, "g", "abc" * 5) for i in range(60)] + [(100 + i, "h", "xyz") for i in range(3)]
    counted = sim.with_char_counts(spark.createDataFrame(items, "id long, k string, script string"))
    got = Counter((r["id1"], r["id2"]) for r in sim.similar_pairs(counted, ["k"], tile_rows=4).collect())
    want = Counter(
        (min(i, j), max(i, j)) for a, (i, k, _) in enumerate(items) for j, m, _ in items[:a] if k == m
    )
    assert got == want
    every = sim.similar_pairs(counted.drop("k"), [], tile_rows=4)
    assert every.count() == 60 * 59 // 2 + 3


def test_maps_as_bytes_are_exact(spark):
    texts = ["", "a", "é" * 300 + "z", "\u4e2d\u6587\U0001F600" * 70000, None, "b" * 256, "plain text"]
    column = sim.with_char_counts(spark.createDataFrame([(t,) for t in texts], "script string")).toArrow()["chars"]
    maps = sim._Maps.read(column)
    coded = pa.chunked_array([maps.row_bytes()])
    # a slice begins within its buffers
    for chars, some in ((coded, texts), (coded.slice(2, 4), texts[2:6])):
        again = sim._Maps.read(chars)
        assert [dict(x) for x in again.row_maps().to_pylist()] == [dict(Counter(t or "")) for t in some]
    assert len(coded[6].as_py()) == 1 + 2 * len(set("plain text"))
    large = sim._Maps(np.array(["a"], object), np.array([1]), np.array([0]), np.array([2**30 + 5]))
    assert sim._Maps.read(pa.chunked_array([large.row_bytes()])).counts.tolist() == [2**30 + 5]


def test_standard_form_drops_rows_of_white_space_only(spark):
    texts = ["\x1c \u2003\n\t", "", None, " a\u2028\n \x1f\nb \u3000", "\u0085x y\x1d", "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, script string")
    assert rows(corpus.standardize(df)) == [(3, "a\nb"), (4, "x y"), (5, "z")]
