"""Iterative graph operators: connected components and reachability over chains.

Each round is stored with a checkpoint, so lineage stays short and a lost executor costs one
round at most. Neighbour lists are never collected: every step is a grouped minimum or an
equi-join, which adaptive execution can split where one node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomwork.session import cut_lineage

#: edges that a task of a round takes at least
TASK_EDGES = 20_000


def _state(edges: DataFrame) -> tuple:
    """Size and an order-free hash sum, enough to see that a round changed nothing."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an undirected edge table (src, dst).

    component is the smallest node of the component. Alternating large-star and small-star
    steps (Kiveris et al., 2014) need a logarithmic number of rounds in practice, also on
    long chains, and keep the number of edges from growing. What joins leave goes on in as few
    tasks as its edges need, so that a round over few edges does not write a file for each
    partition of the session.
    """
    e = cut_lineage(
        edges.filter("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    before = _state(e)
    while True:
        tasks = max(1, -(-before[0] // TASK_EDGES))
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("low"))
        large = (
            both.join(lowest, "u").filter("v > u")
            .select(F.col("v").alias("u"), F.col("low").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        paired = large.join(lowest, "u")
        small = (
            paired.filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(lowest.select("u", F.col("low").alias("v"))).coalesce(tasks).distinct()
        )
        e = cut_lineage(small.coalesce(tasks))
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


class Chains:
    """A directed graph cut into chains, for reachability in few rounds.

    Each node hands on to its nearest successor in id order, and a successor takes its nearest
    predecessor; these links form vertex-disjoint chains. Pointer doubling gives every node its
    chain (named by the first node) and its position, in a number of rounds that is logarithmic in
    the longest chain. All other edges cross between chains. Who reaches a position of a chain
    reaches all later ones, so a walk keeps the earliest position for each seed and chain, and
    takes as many rounds as it changes chains, not as it passes nodes. Ids only shape the chains:
    edges against their order, and cycles, are crossings.

    nodes: (keys..., node, chain, pos); cross: (keys..., chain, i, to, j).
    """

    def __init__(self, edges: DataFrame, keys: list[str]) -> None:
        self.keys = keys
        e = cut_lineage(edges.select(*keys, "src", "dst").distinct())
        down, up = e.agg(
            F.count(F.when(F.col("dst") < F.col("src"), 1)), F.count(F.when(F.col("dst") > F.col("src"), 1))
        ).first()
        near_dst, near_src = (F.max, F.min) if down >= up else (F.min, F.max)
        along = F.col("dst") < F.col("src") if down >= up else F.col("dst") > F.col("src")
        links = e.filter(along).groupBy(*keys, "src").agg(near_dst("dst").alias("dst"))
        links = links.groupBy(*keys, "dst").agg(near_src("src").alias("src"))
        nodes = e.select(*keys, F.col("src").alias("node")).unionByName(
            e.select(*keys, F.col("dst").alias("node"))
        ).distinct()
        first = nodes.join(links.withColumnRenamed("dst", "node"), [*keys, "node"], "left")
        pointers = first.select(
            *keys, "node", F.coalesce("src", "node").alias("chain"),
            F.when(F.col("src").isNull(), 0).otherwise(1).cast("long").alias("pos"),
        )
        self.nodes = self._folded(pointers)
        a = self.nodes.select(*keys, F.col("node").alias("src"), "chain", F.col("pos").alias("i"))
        b = self.nodes.select(
            *keys, F.col("node").alias("dst"), F.col("chain").alias("to"), F.col("pos").alias("j")
        )
        crossing = e.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).filter(
            (F.col("chain") != F.col("to")) | (F.col("j") <= F.col("i"))
        )
        self.cross = self._shortened(
            cut_lineage(crossing.groupBy(*keys, "chain", "i", "to").agg(F.min("j").alias("j")))
        )

    def _shortened(self, cross: DataFrame, doublings: int = 4, growth: int = 6) -> DataFrame:
        """Crossings with those that two of them make, up to `doublings` times.

        The degrees of the chains bound the pairs beforehand; a doubling that might yield more than
        `growth` of them for each crossing is not done, and walks take more rounds instead.
        """
        keys = self.keys
        for _ in range(doublings):
            out = cross.groupBy(*keys, "chain").agg(F.count(F.lit(1)).alias("o"))
            into = cross.groupBy(*keys, F.col("to").alias("chain")).agg(F.count(F.lit(1)).alias("n"))
            pairs, total = out.join(into, [*keys, "chain"], "left").agg(
                F.sum(F.col("n") * F.col("o")), F.sum("o")
            ).first()
            if not pairs or pairs > growth * total:
                break
            first = cross.select(
                *keys, F.col("chain").alias("from"), F.col("i").alias("at"), F.col("to").alias("chain"),
                F.col("j").alias("by"),
            )
            second = first.join(cross, [*keys, "chain"]).filter("i >= by").select(
                *keys, F.col("from").alias("chain"), F.col("at").alias("i"), "to", "j"
            )
            both = cross.unionByName(second.filter("chain <> to or j <= i"))
            cross = cut_lineage(both.groupBy(*keys, "chain", "i", "to").agg(F.min("j").alias("j")))
        return cross

    def _folded(self, pointers: DataFrame, hops: int = 3) -> DataFrame:
        """Pointers followed to the first node of each chain; `hops` self-joins a stored round."""
        keys = self.keys
        while True:
            base = pointers
            for _ in range(hops):
                step = base.select(
                    *keys, F.col("node").alias("chain"), F.col("chain").alias("_to"), F.col("pos").alias("_d")
                )
                pointers = pointers.join(step, [*keys, "chain"]).select(
                    *keys, "node", F.col("_to").alias("chain"), (F.col("pos") + F.col("_d")).alias("pos"),
                    F.col("_d").alias("_moved"),
                )
            pointers = cut_lineage(pointers)
            if not pointers.agg(F.max("_moved")).first()[0]:
                return pointers.drop("_moved")
            pointers = pointers.drop("_moved")

    def crossings(self, against: bool = False) -> DataFrame:
        """The crossing edges; against=True reverses them, with positions counted downwards."""
        if not against:
            return self.cross
        return self.cross.select(
            *self.keys, F.col("to").alias("chain"), (-F.col("j")).alias("i"), F.col("chain").alias("to"),
            (-F.col("i")).alias("j"),
        )

    def starts(self, seeds: DataFrame, against: bool = False) -> DataFrame:
        """(keys..., seed, chain, at): what seeds (keys..., seed, node) reach over one edge."""
        sign = -1 if against else 1
        at = seeds.join(self.nodes, [*self.keys, "node"]).select(
            *self.keys, "seed", "chain", (F.lit(sign) * F.col("pos")).alias("at")
        )
        return first_steps(at, self.crossings(against), self.keys)

    def expand(self, states: DataFrame, against: bool = False) -> DataFrame:
        """(keys..., seed, node) of all nodes that states cover."""
        sign = -1 if against else 1
        met = states.join(self.nodes, [*self.keys, "chain"])
        return met.filter(F.lit(sign) * F.col("pos") >= F.col("at")).select(*self.keys, "seed", "node")


def first_steps(at: DataFrame, cross: DataFrame, keys: list[str]) -> DataFrame:
    """States behind (keys..., seed, chain, at), which themselves are not counted as reached."""
    on = at.join(cross, [*keys, "chain"]).filter(F.col("i") == F.col("at"))
    along = at.withColumn("at", F.col("at") + 1)
    return along.unionByName(on.select(*keys, "seed", F.col("to").alias("chain"), F.col("j").alias("at")))


def walk(starts: DataFrame, cross: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., seed, chain, at): the earliest position that each seed reaches on each chain.

    Semi-naive: a round follows only crossings between a position found in the last round and
    the earlier best one, so no crossing is followed twice for a seed.
    """
    at = [*keys, "seed", "chain"]
    frontier = cut_lineage(
        starts.groupBy(*at).agg(F.min("at").alias("at")).withColumn("old", F.lit(None).cast("long"))
    )
    found = frontier
    while not frontier.isEmpty():
        opened = frontier.join(cross, [*keys, "chain"]).filter(
            (F.col("i") >= F.col("at")) & (F.col("old").isNull() | (F.col("i") < F.col("old")))
        )
        offered = opened.groupBy(*keys, "seed", F.col("to").alias("chain")).agg(F.min("j").alias("at"))
        known = found.groupBy(*at).agg(F.min("at").alias("old"))
        better = offered.join(known, at, "left").filter(F.col("old").isNull() | (F.col("at") < F.col("old")))
        frontier = cut_lineage(better.select(*at, "at", "old"))
        found = found.unionByName(frontier)
    return found.groupBy(*at).agg(F.min("at").alias("at"))


def reachable(seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., seed, node) for all nodes reachable over one or more edges.

    seeds has (keys..., seed, node) where node is the start; edges has (keys..., src, dst). A seed
    is reached by itself only over a cycle.
    """
    chains = Chains(edges, keys)
    states = walk(chains.starts(seeds), chains.cross, keys)
    return chains.expand(states).distinct()
