import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions.ordered import CHUNK_ROWS, dense_index, previous, ranked, running
from loomwork.operators import graph

from .conftest import rows


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_running_does_not_depend_on_chunks(spark, chunk):
    rng = random.Random(4)
    data = [(k, i, rng.choice([None, 1, -2, 5])) for k in "ab" for i in rng.sample(range(40), 15)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    got = running(
        df, ["k"], "i", sums={"s": F.col("v")}, minima={"m": F.col("v")},
        lasts={"l": F.col("v")}, chunk_rows=chunk,
    )
    want = []
    for k in "ab":
        total, low, last = 0, None, None
        for _, i, v in sorted(r for r in data if r[0] == k):
            if v is not None:
                total, last = total + v, v
                low = v if low is None else min(low, v)
            want.append((k, i, v, total, low, last))
    key = lambda t: t[:2]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 16])
def test_previous_crosses_chunks(spark, chunk):
    data = [("a", i, f"v{i}") for i in (0, 1, 2, 5, 6, 13, 14)] + [("b", 3, "x")]
    df = spark.createDataFrame(data, "k string, i long, v string")
    got = {
        (r["k"], r["i"]): list(r["p"])
        for r in previous(df, ["k"], "i", F.col("v"), 3, "p", chunk).collect()
    }
    seq = [v for k, _, v in data if k == "a"]
    for n, (k, i, _) in enumerate(data[:7]):
        assert got[k, i] == seq[max(0, n - 3):n]
    assert got["b", 3] == []


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = rows(dense_index(df, ["x"], "n", 10))
    assert sorted(got) == [(i, i + 10) for i in range(1000)]
    ties = spark.createDataFrame([("a",)] * 50, "x string").repartition(3)
    assert sorted(r["n"] for r in dense_index(ties, ["x"], "n").collect()) == list(range(50))


def test_merge_sets_example(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 5), (2, 4), (6, 5), (7, 8)], "src int, dst int")
    got = {}
    for node, component in rows(graph.connected_components(pairs)):
        got.setdefault(component, set()).add(node)
    assert sorted(got.values(), key=min) == [{1, 2, 4}, {3, 5, 6}, {7, 8}]


def test_components_of_long_chain_and_star(spark):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(1001, 1400).select(F.lit(5000).alias("src"), F.col("id").alias("dst"))
    got = dict(rows(graph.connected_components(chain.unionByName(star))))
    assert {got[i] for i in range(301)} == {0}
    assert {got[i] for i in range(1001, 1400)} == {1001} and got[5000] == 1001
    assert len(got) == 301 + 400


def test_components_twice_change_nothing(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 9), (4, 5)], "src int, dst int")
    once = graph.connected_components(pairs)
    again = graph.connected_components(
        once.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    )
    assert rows(once) == rows(again)


def test_rounds_over_few_edges_write_few_files(spark, monkeypatch):
    keep = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keep}
    stored, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
        assert graph.connected_components(edges).filter("component = 0").count() == 61
        parts = [df.rdd.getNumPartitions() for df in stored]
        assert len(parts) > 2 and set(parts[1:]) == {1}
        # more edges than a task takes go on in more tasks
        monkeypatch.setattr(graph, "TASK_EDGES", 20)
        assert graph.connected_components(edges).filter("component = 0").count() == 61
        assert stored[len(parts) + 1].rdd.getNumPartitions() == 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sparse_order_values_give_few_chunks(spark):
    df = spark.range(20_000).select(
        F.lit("k").alias("k"), (F.col("id") * F.col("id") * 1_000_003).alias("i"), F.lit(1).alias("v")
    ).repartition(3)
    placed = ranked(df, ["k"], "i", "place")
    chunks = placed.select(F.expr(f"place div {CHUNK_ROWS}")).distinct().count()
    assert chunks <= 4  # one for each range of the sort
    got = running(placed, ["k"], "place", sums={"n": F.col("v")}).orderBy("i").select("n").collect()
    assert [r["n"] for r in got] == list(range(1, 20_001))


def closure(seeds, edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    want = set()
    for s in seeds:
        work = [s]
        while work:
            for b in out.get(work.pop(), []):
                if (s, b) not in want:
                    want.add((s, b))
                    work.append(b)
    return want


def random_graph(seed):
    rng = random.Random(seed)
    if seed % 4 == 0:  # a long chain with a cycle and random edges
        edges = {(i, i + 1) for i in range(30)} | {(12, 9)}
        return edges | {(rng.randrange(40), rng.randrange(40)) for _ in range(20)}
    if seed % 4 == 1:  # a ladder: each node leads to the next two
        return {(i, i + d) for i in range(60) for d in (1, 2)}
    if seed % 4 == 2:  # descending edges
        return {(a, rng.randrange(max(0, a - 9), a)) for a in range(1, 80) for _ in range(2)}
    return {(rng.randrange(25), rng.randrange(25)) for _ in range(40)}


@pytest.mark.parametrize("seed", range(8))
def test_reachable_both_ways(spark, seed):
    edges = random_graph(seed)
    starts = (0, 5, 20, 59)
    e = spark.createDataFrame([("s", a, b) for a, b in edges], "k string, src int, dst int")
    seeds = spark.createDataFrame([("s", a, a) for a in starts], "k string, seed int, node int")
    got = {(r["seed"], r["node"]) for r in graph.reachable(seeds, e, ["k"]).collect()}
    assert got == closure(starts, edges)
    chains = graph.Chains(e, ["k"])
    states = graph.walk(chains.starts(seeds, True), chains.crossings(True), ["k"])
    got = {(r["seed"], r["node"]) for r in chains.expand(states, True).collect()}
    assert got == closure(starts, {(b, a) for a, b in edges})


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    stored = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or stored(df))
    e = spark.range(800).select(
        F.lit("s").alias("k"), (F.col("id") + 1).alias("src"), F.col("id").alias("dst")
    )
    seeds = spark.createDataFrame([("s", 800, 800), ("s", 400, 400)], "k string, seed long, node long")
    found = graph.reachable(seeds, e, ["k"]).groupBy("seed").count()
    assert rows(found) == [(400, 400), (800, 800)]
    assert len(rounds) <= 10


def test_reachable_without_edges(spark):
    none = spark.createDataFrame([], "k string, src int, dst int")
    seeds = spark.createDataFrame([("s", 1, 1)], "k string, seed int, node int")
    assert graph.reachable(seeds, none, ["k"]).count() == 0
