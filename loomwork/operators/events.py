"""Reduction of recorded call events, in batch.

Input rows: script, seq (distinct integers per script), kind ('call', 'dep', 'enter',
'exit'), static_instr_id, loop_id, func_module, func_name, value_ids, lhs_ids. All sequential
rules are running sums, minima and last values, which `functions.ordered` computes without
putting one script into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.functions.ordered import CHUNK_ROWS, ranked, running
from loomwork.functions.text import first_segment
from loomwork.session import cut_lineage

# fixed values: libraries whose calls are recorded by default
RELEVANT_MODULES = ("sklearn", "xgboost")
UNKNOWN = -1


#: name of the places that `ranked` gives to rows
PLACE = "__place"


def placed(events: DataFrame, whole: bool = False) -> DataFrame:
    """The rows with their place in the order of all scripts; sequence numbers may have gaps.

    whole=True is for scripts that a task held whole before: the events are made once, and each
    script goes to one task.
    """
    return events if PLACE in events.columns else ranked(events, ["script"], "seq", PLACE, whole)


def _finished(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Without the places, unless the caller brought them."""
    return rows if PLACE in events.columns else rows.drop(PLACE)


def number_calls(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add call_id: calls so far, from 0, counted whether recorded later or not.

    Other kinds of rows carry the id of the latest call, -1 before the first.
    """
    is_call = (F.col("kind") == "call").cast("long")
    numbered = running(placed(events), ["script"], PLACE, sums={"__n": is_call}, chunk_rows=chunk_rows)
    return _finished(numbered.withColumn("call_id", F.col("__n") - 1).drop("__n"), events)


def filter_relevant(calls: DataFrame, modules=RELEVANT_MODULES) -> DataFrame:
    """Calls whose module belongs to one of the libraries; modules=False keeps all."""
    if modules is False:
        return calls
    return calls.filter(first_segment(F.col("func_module")).isin(list(modules)))


def balance(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `depth` (open loops after the row) and `stray` (an exit with no open loop)."""
    step = (
        F.when(F.col("kind") == "enter", 1).when(F.col("kind") == "exit", -1).otherwise(0)
    ).cast("long")
    summed = running(placed(events), ["script"], PLACE, sums={"__raw": step}, chunk_rows=chunk_rows)
    floored = running(
        summed, ["script"], PLACE, minima={"__low": F.col("__raw")}, chunk_rows=chunk_rows,
        exclusive=True,
    )
    low = F.least(F.coalesce("__low", F.lit(0)), F.lit(0))
    stray = (F.col("kind") == "exit") & (F.col("__raw") < low)
    depth = F.col("__raw") - F.least(low, F.col("__raw"))
    leveled = floored.withColumns({"depth": depth, "stray": stray}).drop("__raw", "__low")
    return _finished(leveled, events)


def _in_loops(
    rows: DataFrame, chunk_rows: int, sums: dict[str, Column] | None = None
) -> DataFrame:
    """Add depth, stray, episode, current_loop, and running sums, to rows that have places.

    Only entries and exits change the state, so the passes that find it run over these alone; all
    other rows take the state of the last one before them in a single pass.
    """
    turning = F.coalesce(F.col("kind").isin("enter", "exit"), F.lit(False))
    leveled = balance(cut_lineage(rows.filter(turning)), chunk_rows)
    entered = F.when(F.col("kind") == "enter", F.col("loop_id"))
    outermost = ((F.col("kind") == "enter") & (F.col("depth") == 1)).cast("long")
    counted = running(
        leveled, ["script"], PLACE, sums={"episode": outermost}, chunk_rows=chunk_rows
    )
    # the innermost open loop is the last one entered at the current depth
    named = running(
        counted, ["script", "depth"], PLACE, lasts={"__loop": entered}, chunk_rows=chunk_rows
    )
    state = F.struct(
        "depth", "stray", "episode", F.when(F.col("depth") > 0, F.col("__loop")).alias("current_loop")
    )
    both = named.select(*rows.columns, state.alias("__state")).unionByName(
        rows.filter(~turning), allowMissingColumns=True
    )
    carried = running(
        both, ["script"], PLACE, sums=sums, lasts={"__last": F.col("__state")}, chunk_rows=chunk_rows
    )
    zero = F.lit(0).cast("long")
    return carried.withColumns(
        {
            "depth": F.coalesce("__last.depth", zero),
            "stray": F.coalesce("__state.stray", F.lit(False)),
            "episode": F.coalesce("__last.episode", zero),
            "current_loop": F.col("__last.current_loop"),
        }
    ).drop("__state", "__last")


def loop_context(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add depth, stray, episode (number of the outermost loop run) and current_loop."""
    return _finished(_in_loops(placed(events), chunk_rows), events)


def suppress_loop_repeats(calls: DataFrame) -> DataFrame:
    """Inside one outermost loop run keep the first call per (loop, call site).

    Calls outside loops all stay. First means smallest seq: a grouped minimum, combined
    before the shuffle, however often the loop ran.
    """
    inside = calls.filter("depth > 0")
    first = inside.groupBy("script", "episode", "current_loop", "static_instr_id").agg(
        F.min("seq").alias("seq")
    )
    kept = inside.join(first.select("script", "seq"), ["script", "seq"], "left_semi")
    return calls.filter("depth = 0").unionByName(kept)


def dependency_pairs(numbered: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(script, reader, origin): the call ids that the values of each row came from, -1 unknown.

    Rows must have places (`placed`); `reader` is the place of the reading row. A 'dep' row gives its lhs
    values either the latest call (value_ids null) or whatever the values in value_ids depend on
    at that moment. The last write before a read is found as a running last value per (script,
    value). Chains of plain copies are then shortened by pointer doubling, so a chain of length n
    takes log2(n) rounds.
    """
    # a row has one place, so its repeated values are dropped where they stand
    writes = numbered.filter("kind = 'dep'").select(
        "script", F.explode(F.array_distinct("lhs_ids")).alias("value"),
        (F.col(PLACE) * 2 + 1).alias("at"),
        F.struct(
            F.col(PLACE).alias("place"), F.when(F.col("value_ids").isNull(), F.col("call_id")).alias("origin")
        ).alias("write"),
    )
    reads = numbered.filter("kind in ('call', 'dep') and value_ids is not null").select(
        "script", F.explode(F.array_distinct("value_ids")).alias("value"),
        (F.col(PLACE) * 2).alias("at"), F.lit(None).cast(writes.schema["write"].dataType).alias("write"),
    )
    found = running(
        writes.unionByName(reads), ["script", "value"], "at", lasts={"source": F.col("write")},
        chunk_rows=2 * chunk_rows,
    ).filter("write is null")
    links = found.select(
        "script", (F.col("at") / 2).cast("long").alias("reader"),
        F.when(F.col("source.origin").isNull(), F.col("source.place")).alias("next"),
        F.when(F.col("source").isNull(), F.lit(UNKNOWN).cast("long"))
        .otherwise(F.col("source.origin")).alias("origin"),
    ).distinct()
    state = cut_lineage(links)
    while True:
        open_links = state.filter("next is not null")
        if open_links.isEmpty():
            break
        onward = state.select(
            "script", F.col("reader").alias("next"), F.col("next").alias("__next"),
            F.col("origin").alias("__origin"),
        )
        moved = open_links.select("script", "reader", "next").join(
            onward, ["script", "next"]
        ).select("script", "reader", F.col("__next").alias("next"),
                 F.col("__origin").alias("origin"))
        state = cut_lineage(
            state.filter("next is null").unionByName(moved).distinct()
        )
    return state.select("script", "reader", "origin")


def resolve_dependencies(numbered: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(script, seq, dependencies) for every call: the call ids its values came from.

    The array is what a recorded call holds; `dependency_pairs` gives the same in long form.
    """
    rows = placed(numbered)
    sets = dependency_pairs(rows, chunk_rows).groupBy("script", F.col("reader").alias(PLACE)).agg(
        F.sort_array(F.collect_set("origin")).alias("dependencies")
    )
    calls = rows.filter("kind = 'call'").select("script", "seq", PLACE)
    return calls.join(sets, ["script", PLACE], "left").select(
        "script", "seq",
        F.coalesce("dependencies", F.array().cast("array<bigint>")).alias("dependencies"),
    )


def reduce_events(
    events: DataFrame, modules=RELEVANT_MODULES, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Recorded calls with call_id, loop, and dependencies (all rules in order)."""
    is_call = (F.col("kind") == "call").cast("long")
    # calls are numbered in the pass that gives rows their loops
    counted = _in_loops(placed(events), chunk_rows, sums={"__n": is_call})
    numbered = cut_lineage(counted.withColumn("call_id", F.col("__n") - 1).drop("__n"))
    recorded = suppress_loop_repeats(
        filter_relevant(numbered.drop("value_ids", "lhs_ids").filter("kind = 'call'"), modules)
    )
    return recorded.join(resolve_dependencies(numbered, chunk_rows), ["script", "seq"]).select(
        "script", "seq", "call_id", "static_instr_id",
        F.col("current_loop").alias("static_loop_id"),
        *[c for c in ("caller_type_module", "caller_type_name") if c in events.columns],
        "func_module", "func_name", "dependencies",
    )


def attach_arg_features(
    calls: DataFrame, features: DataFrame, args: str = "arg_ids"
) -> DataFrame:
    """Long rows (script, call_id, arg, feature, num, str) of the positional arguments.

    features has (value_id, feature, num, str), one profile per value.
    """
    positions = calls.select(
        "script", "call_id", F.posexplode(args).alias("arg", "value_id")
    )
    return positions.join(features, "value_id").select(
        "script", "call_id", "arg", "feature", "num", "str"
    )
