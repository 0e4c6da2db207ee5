"""The mix of sources against the contract, computed plainly."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.llm import mixing
from tests.llm.data import frame, messy


def plain_targets(sizes: dict) -> dict:
    """Share, cut at three times the size and share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        of = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / of for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s] * (1 + 1e-12)]
        if not above:
            return {**share, **fixed}
        fixed.update({s: float(3 * sizes[s]) for s in above})


def plain_taken(rows: list[tuple]) -> Counter:
    """(doc_id, size, source_size, target, taken) of all rows."""
    docs = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, _, s, _ in rows]
    sizes = Counter()
    for _, n, s in docs:
        sizes[s] += n
    target = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    out = Counter()
    for s, z in sizes.items():
        mine = [d for d in docs if d[2] == s]
        mine.sort(key=lambda d: (hashlib.md5(str(" " if d[0] is None else d[0]).encode()).hexdigest(), d[1]))
        line = [i for i, (_, n, _) in enumerate(mine) for _ in range(n)] * 3
        got = Counter(line[: min(math.floor(target[s] + 0.5), 3 * z)])
        for i, (doc, n, _) in enumerate(mine):
            out[(doc, n, z, round(target[s], 6), got[i])] += 1
    return out


def spread_sources():
    rows = []
    for i in range(160):
        source = ["a", "b", "c", None, "é", "a", "a", "tiny"][i % 8]
        n = 1 if source == "tiny" else (i * 37) % 200
        rows.append((i % 90, "word " * n, None, source, None))
    rows.append((500, "long " * 9000, None, "b", None))
    return rows


@pytest.mark.parametrize("rows", [messy(), spread_sources(), [(1, None, None, "s", 0), (2, " ", None, None, 0)]])
@pytest.mark.parametrize("block", [1024, 7])
def test_taken_words(spark, rows, block):
    mix = mixing.Mix(frame(spark, rows, clash=block == 7), block=block)
    got = Counter(
        (r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])
        for r in mix.taken().collect()
    )
    assert got == plain_taken(rows)
    assert all(taken <= 3 * size for _, size, _, _, taken in got)


def test_every_prefix_of_the_schedule_is_near_the_weights(spark):
    sizes = spark.createDataFrame([(f"s{i}", 50_000 * (i + 1)) for i in range(5)], "source string, size long")
    plan = mixing.targets(sizes, block=100)
    quota = {r["number"]: r["slots"] for r in plan.collect()}
    slots = mixing.schedule(plan, block=100, piece=512).orderBy("slot").collect()
    assert Counter(r["number"] for r in slots) == quota
    steps, places = 1 << (sum(quota.values()) - 1).bit_length(), sum(quota.values())
    seen, done = Counter(), set()
    for r in slots:
        # ranks ascend with time, until the quota is reached
        assert r["rank"] == seen[r["number"]]
        seen[r["number"]] += 1
        if seen[r["number"]] == quota[r["number"]]:
            done.add(r["number"])
        for number, of in quota.items():
            if number not in done and r["slot"] < places:
                due = (r["slot"] + 1) * of / places
                assert abs(seen[number] - due) <= 2 * math.log2(steps) + 2


def test_fragments_fill_the_blocks(spark):
    mix = mixing.Mix(frame(spark, spread_sources()), block=16)
    filled = mix.fragments.groupBy("slot").agg(F.sum(F.col("last") - F.col("first")).alias("words"))
    want = {r["slot"]: r["last"] - r["first"] for r in mix.slots.collect()}
    assert {r["slot"]: r["words"] for r in filled.collect()} == want
    bad = mix.fragments.join(mix.documents.select("row", "size"), "row").filter(
        "first < 0 or last > size or first >= last"
    )
    assert bad.count() == 0


def test_empty_table_and_reruns(spark):
    docs = frame(spark, spread_sources())
    assert mixing.Mix(docs.limit(0)).taken().count() == 0
    runs = [
        sorted(map(repr, mixing.Mix(d, block=64).taken().collect()))
        for d in (docs, docs.repartition(5, "text"))
    ]
    assert runs[0] == runs[1]
