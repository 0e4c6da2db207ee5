r"""Mixing sources to target weights, by a low-discrepancy schedule of equal blocks of words.

Sources in code point order (null last) weigh 5, 2, 1, 5, ... and share as many words as all
documents have. No target exceeds `EPOCHS` times its source; what is above is shared by weight
among the others until none is above: the targets are min(EPOCHS * size, x * weight) for one x,
found by prefix sums over the sources by size per weight.

A source with a target of L words gets ceil(L / BLOCK) slots, the last one shorter. The slots of all
sources lie one after the other on a line of N places, which is cumulative weight in slots. The van
der Corput points of 2^m >= N time steps (bit-reversed step numbers) are mapped through that line,
so each place is met once or twice, and between any two times each source is met in proportion to its
weight, up to the logarithm of N. A source's slots are ranked by time, ranks beyond its quota fall out, and slot r
takes the words from r * BLOCK on of the source's line: its documents in an order shuffled by a
hash, repeated up to `EPOCHS` times. Blocks meet documents by an equi-join on (source, rank).

At scale: texts are read once, for their sizes; all further tables hold numbers. Global order is a
range-partitioned sort, prefix sums run over chunks, the slots of a hot source are made in pieces,
and a long document has one row for each block it crosses. The driver sees three rows of totals.

Defined cases: null text has no words; null ids are shuffled like the id of one space; documents
with the same source, id and size are interchangeable, and repeated rows are each taken by
themselves; documents without words are never taken; an empty table, or one without words, gives
targets of 0; further columns are ignored. Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import ordered
from loomwork.session import cut_lineage

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: words of a slot
BLOCK = 1024
#: places of the schedule that one row is expanded to at most
PIECE = 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def weight(number: Column, weights: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK
) -> DataFrame:
    """source, number, source_size, target, quota (whole words), slots and first_slot.

    `sizes` has source and size; there is one row for each source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = ordered.dense_index(each, [F.asc_nulls_last("source")], "number")
    weighed = numbered.withColumns(
        {"one": F.lit(1), "weight": weight(F.col("number"), weights).cast("long"),
         "most": F.col("source_size") * epochs}
    )
    ranked = ordered.dense_index(weighed, [F.col("most") / F.col("weight"), "number"], "by_ratio")
    ranked = ordered.running(
        ranked, ["one"], "by_ratio", sums={"capped": F.col("most"), "gone": F.col("weight")}, exclusive=True
    )
    total, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weight = total or 0, all_weight or 0

    def exact(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    left, rest = F.lit(total) - F.col("capped"), F.lit(all_weight) - F.col("gone")
    fits = exact(F.col("most")) * exact(rest) >= exact(left) * exact(F.col("weight"))
    first = ranked.filter(fits).agg(F.min(F.struct("by_ratio", left.alias("left"), rest.alias("rest")))).first()[0]
    at, left, rest = first or (0, 0, 1)
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(rest))
    target = F.when(F.col("by_ratio") < at, F.col("most").cast("double")).otherwise(share)
    quota = F.least(F.floor(F.col("target") + 0.5), F.col("most"))
    planned = ranked.withColumn("target", target).withColumn("quota", quota)
    planned = planned.withColumn("slots", F.expr(f"(quota + {block - 1}) div {block}"))
    return ordered.running(
        planned, ["one"], "number", sums={"first_slot": F.col("slots")}, exclusive=True
    ).select("source", "number", "source_size", "target", "quota", "slots", "first_slot")


def schedule(sources: DataFrame, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """slot (a time), number (of a source), rank, first and last (exclusive) word of each block.

    `sources` are rows of `targets`; slots in ascending order are the order of the mix.
    """
    places = sources.agg(F.sum("slots")).first()[0] or 0
    bits = max(0, places - 1).bit_length()
    line = sources.filter("slots > 0").select(
        "number", "slots", "quota", "first_slot",
        F.explode(
            F.expr(f"sequence(first_slot div {piece}, (first_slot + slots - 1) div {piece})")
        ).alias("piece"),
    ).repartition("number", "piece")
    line = line.select(
        "number", "slots", "quota",
        F.explode(
            F.expr(
                f"sequence(greatest(first_slot, piece * {piece}),"
                f" least(first_slot + slots, (piece + 1) * {piece}) - 1)"
            )
        ).alias("place"),
    )
    # points v with place = floor(v * places / 2^bits)
    scale, n = f"cast({1 << bits} as decimal(19,0))", f"cast({max(places, 1)} as decimal(19,0))"

    def least_point(place: str) -> str:
        return f"cast((cast({place} as decimal(19,0)) * {scale} + {n} - 1) div {n} as bigint)"

    points = F.expr(f"sequence({least_point('place')}, {least_point('place + 1')} - 1)")
    timed = line.select("number", "slots", "quota", F.explode(points).alias("point"))
    reverse = F.conv(F.reverse(F.lpad(F.bin("point"), max(bits, 1), "0")), 2, 10).cast("long")
    timed = timed.select("number", "slots", "quota", reverse.alias("slot"))
    ranked = ordered.running(timed, ["number"], "slot", sums={"rank": F.lit(1)}, exclusive=True)
    return ranked.filter("rank < slots").select(
        "slot", "number", "rank", (F.col("rank") * block).alias("first"),
        F.least((F.col("rank") + 1) * block, F.col("quota")).alias("last"),
    )


class Mix:
    """A mix of documents; `documents`, `sources`, `slots` and `fragments` are its tables."""

    def __init__(
        self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK
    ) -> None:
        sizes = cut_lineage(sized(docs))
        self.epochs, self.block = epochs, block
        #: one row for each source
        self.sources = cut_lineage(targets(sizes, weights, epochs, block))
        #: one row for each block taken, in the order of `slot`
        self.slots = schedule(self.sources, block)
        key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(" ")).cast("binary"))
        placed = ordered.dense_index(
            sizes.withColumn("key", key), [F.asc_nulls_last("source"), "key", "size"], "row"
        )
        facts = self.sources.select(F.col("source").alias("_s"), "number", "source_size", "target", "quota")
        known = placed.join(facts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "key")
        #: row, doc_id, source, size, source_size, target and offset in the source's line
        self.documents = cut_lineage(
            ordered.running(known, ["number"], "row", sums={"offset": F.col("size")}, exclusive=True)
        )

    @property
    def fragments(self) -> DataFrame:
        """slot, row, doc_id, first and last (exclusive) word of each document inside each block."""
        turns = F.explode(F.sequence(F.lit(0), F.lit(self.epochs - 1))).alias("epoch")
        line = self.documents.select("*", turns).withColumn(
            "begin", F.col("epoch") * F.col("source_size") + F.col("offset")
        )
        line = line.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
        blocks = f"sequence(begin div {self.block}, (end - 1) div {self.block})"
        pieces = line.filter("end > begin").select(
            "row", "doc_id", "number", "begin", "end", F.explode(F.expr(blocks)).alias("rank")
        )
        met = pieces.join(self.slots, ["number", "rank"])
        return met.select(
            "slot", "row", "doc_id",
            (F.greatest("begin", "first") - F.col("begin")).alias("first"),
            (F.least("end", "last") - F.col("begin")).alias("last"),
        )

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and taken words of every document."""
        sums = self.fragments.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
        return self.documents.join(sums, "row", "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            "source",
        )


#: the same numbers in closed form: whole turns of a source's line, and the part of the last one
SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
s as (
  select source, sum(size)::bigint as z, row_number() over (order by source nulls last) - 1 as n
  from d group by source),
w as (select *, case n % 3 when 0 then 5 when 1 then 2 else 1 end as w, sum(z) over () as t from s),
r as (
  select *, row_number() over (order by ({EPOCHS} * z)::double / w, n) as j,
    t - coalesce(sum({EPOCHS} * z) over (
      order by ({EPOCHS} * z)::double / w, n rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over (order by ({EPOCHS} * z)::double / w, n rows between current row and unbounded following) as v
  from w),
x as (
  select min(j) as j, arg_min(rest, j) as rest, arg_min(v, j) as v from r where {EPOCHS} * z * v >= rest * w),
q as (
  select source, z,
    case when r.j < x.j then ({EPOCHS} * z)::double else (w * x.rest)::double / x.v::double end as target
  from r, x),
p as (
  select d.doc_id, d.size, d.source, q.z, q.target, least(floor(q.target + 0.5)::bigint, {EPOCHS} * q.z) as l,
    coalesce(sum(d.size) over (
      partition by d.source order by md5(coalesce(d.doc_id::varchar, ' ')), d.size
      rows between unbounded preceding and 1 preceding), 0)::bigint as o
  from d join q on d.source is not distinct from q.source)
select doc_id, size, z as source_size, target, source,
  ({" + ".join(f"greatest(0, least(l, {e} * z + o + size) - ({e} * z + o))" for e in range(EPOCHS))})::bigint
    as taken
from p
"""
