"""Incremental reduction of recorded call events, one state per script.

Gives the rows `operators.events.reduce_events` gives, as the events arrive. seq must count
from 0 without gaps per script; rows that arrive early wait in the state until the gap is
filled. An event of kind 'end' closes its script and drops the state, so finished scripts
cost nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwork.operators.events import RELEVANT_MODULES, UNKNOWN

OUTPUT = (
    "script STRING, seq BIGINT, call_id BIGINT, static_instr_id INT, static_loop_id INT, "
    "caller_type_module STRING, caller_type_name STRING, func_module STRING, func_name STRING, "
    "dependencies ARRAY<BIGINT>"
)
_CALLER = ["caller_type_module", "caller_type_name"]
_EVENT = ["kind", "static_instr_id", "loop_id", *_CALLER, "func_module", "func_name",
          "value_ids", "lhs_ids"]
#: an event, and the calls that a script yields, cross to and from Python as one text: a frame
#: of a script costs by its columns


class _Script:
    """What has to be remembered of one script between batches."""

    def __init__(self, saved: dict | None = None):
        saved = saved or {}
        self.next = saved.get("next", 0)
        self.call_id = saved.get("call_id", -1)
        self.stack = saved.get("stack", [])
        self.seen = {k: set(v) for k, v in saved.get("seen", {}).items()}
        self.deps = saved.get("deps", {})
        self.waiting = {int(k): v for k, v in saved.get("waiting", {}).items()}
        self.closed = False

    def saved(self) -> str:
        return json.dumps(
            {
                "next": self.next, "call_id": self.call_id, "stack": self.stack,
                "seen": {k: sorted(v) for k, v in self.seen.items()}, "deps": self.deps,
                "waiting": self.waiting,
            }
        )

    def sources(self, values: list[int]) -> list[int]:
        return sorted({d for v in values for d in self.deps.get(str(v), [UNKNOWN])})

    def repeats(self, site: int) -> bool:
        """Whether this call site was recorded already in the innermost open loop."""
        if not self.stack:
            return False
        sites = self.seen.setdefault(str(self.stack[-1]), set())
        if site in sites:
            return True
        sites.add(site)
        return False

    def step(self, event: str | list, modules) -> tuple | None:
        kind, site, loop, owner_module, owner, module, name, values, lhs = _fields(event)
        if kind == "call":
            self.call_id += 1
            relevant = modules is False or str(module).split(".")[0] in modules
            if relevant and not self.repeats(site):
                current = self.stack[-1] if self.stack else None
                return (
                    self.call_id, site, current, owner_module, owner, module, name,
                    self.sources(values or []),
                )
        elif kind == "dep":
            known = [self.call_id] if values is None else self.sources(values)
            self.deps.update({str(v): known for v in lhs or []})
        elif kind == "enter":
            self.stack.append(loop)
        elif kind == "exit":
            if self.stack:
                self.stack.pop()
            if not self.stack:
                self.seen = {}
        elif kind == "end":
            self.closed = True
        return None


def _fields(event: str | list) -> list:
    """The fields of an event; one in JSON lacks those that are null."""
    if isinstance(event, list):  # as states of earlier versions hold them
        return event
    known = json.loads(event)
    return [known.get(c) for c in _EVENT]


def _typed(columns: str) -> str:
    """The columns as fields of a struct."""
    return ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", "))


def reduce_events_stream(events: DataFrame, modules=RELEVANT_MODULES) -> DataFrame:
    """Recorded calls of a stream of raw events; callers are null where events have none."""
    for column in _CALLER:
        if column not in events.columns:
            events = events.withColumn(column, F.lit(None).cast("string"))
    chosen = modules if modules is False else frozenset(modules)
    columns = [c.split()[0] for c in OUTPUT.split(", ")][1:]

    def advance(
        key: tuple, frames: Iterable[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        script = _Script(json.loads(state.get[0]) if state.exists else None)
        for pdf in frames:
            for seq, event in zip(pdf["seq"].tolist(), pdf["event"].tolist(), strict=True):
                if int(seq) >= script.next:
                    script.waiting[int(seq)] = event
        out = []
        while script.next in script.waiting:
            seq = script.next
            found = script.step(script.waiting.pop(seq), chosen)
            script.next += 1
            if found is not None:
                out.append(dict(zip(columns, (seq, *found), strict=True)))
        if script.closed:
            state.remove()
        else:
            state.update((script.saved(),))
        if out:  # scripts whose rows all wait make no frame
            yield pd.DataFrame({"script": [key[0]], "calls": [json.dumps(out)]}, dtype=object)

    made = events.select("script", "seq", F.to_json(F.struct(*_EVENT)).alias("event")).groupBy("script").applyInPandasWithState(
        advance, "script STRING, calls STRING", "saved STRING", "append", GroupStateTimeout.NoTimeout
    )
    call = OUTPUT.split(", ", 1)[1]
    return made.select("script", F.inline(F.from_json("calls", f"array<struct<{_typed(call)}>>")))


def latest_status_stream(lines: DataFrame) -> DataFrame:
    """Running last status per id of a stream of (line_no, script_id, status)."""
    return lines.groupBy("script_id").agg(F.max_by("status", "line_no").alias("status"))
