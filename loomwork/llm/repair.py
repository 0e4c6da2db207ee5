r"""Conversation structure repair by iterative-deepening A*.

A conversation in turn order is edited until its role initials read `(s?(ua)+)?`. Edits and costs:
Delete 2 (blank rows and repetitions must go), Insert an empty user or assistant row 5, Keep 0, Rerole
to user or assistant 1; a truncated row that stays costs 5 more. Of the cheapest edits the
ASCII-least string of initials counts.

The search goes depth first through (row, state of the pattern) in the order D, I, K, R under a
cost bound, which starts at a lower bound of what the rows must cost and rises to the least cost
that was cut off. A table keeps for each failed (row, state) the least cost it is now known to
need, so nothing fails twice under the same budget. Under the first bound that succeeds every
accepting path is a cheapest one, so the first of them is the answer.

At scale: rows are thin (hashes instead of texts) and equal rows are counted before they move. A
range-partitioned sort orders them, so a huge conversation lies in several tasks; each task cuts it
into chunks of `CHUNK` tokens. For a chunk the search gives the cost from each of the four states
to each, and the order of these paths as strings; such tables multiply associatively, because each
chunk's paths end with an edit of its last row and so none is the beginning of another. The
tables of a task's share are multiplied there, one product a task and conversation crosses tasks,
and chunks are then searched once more with known ends. A conversation of one chunk is searched
once. Texts join by hash at the end and are hashed in order as a stream.

Defined cases: a null role or text is one space, a null id or turn stays null and comes first; rows with equal
turns are ordered by role, then by SHA-256 of role and text; a row with a role other than system,
user or assistant counts by its first character; empty tables give empty results; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.session import cut_lineage

#: tokens of a chunk
CHUNK = 64
#: chunks of one conversation that a task holds before it sends them on unsolved
HELD_CHUNKS = 256

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLANKS = " \t\n\x0b\x0c\r"
INFINITE = 1 << 60

# states of the pattern: start, after s, after u, after a
STATES = 4
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: state and role that Insert and Rerole lead to
NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: edits after the last row
END = ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}


class Search:
    """Cheapest edits of a list of tokens.

    A token is (kind, count): kind `x` stands for `count` rows that must go, else it is the role's
    initial (`o` for any other), in upper case if the row is truncated. `goal` is a state to reach
    with the last token, or None for the end of the conversation.
    """

    def __init__(self, tokens: list[tuple[str, int]], goal: int | None) -> None:
        self.tokens, self.goal = tokens, goal
        self.needed: dict[tuple[int, int], int] = {}
        self.least = [0]
        for kind, count in reversed(tokens):
            low = kind.lower()
            cost = DELETE * count if kind == "x" else DELETE if kind != low else REROLE if kind == "o" else 0
            self.least.append(self.least[-1] + cost)
        self.least.reverse()
        self.path: list[str] = []

    def hopeless(self, state: int) -> bool:
        """States that never lead to the goal: nothing returns to the start or to `after s`."""
        return self.goal is not None and self.goal < 2 and state > self.goal

    def from_state(self, start: int) -> tuple[int, str] | None:
        if self.hopeless(start) or (
            self.goal == 1 and start == 0 and not any(k in "sS" for k, _ in self.tokens)
        ):
            return None
        bound = self.least[0]
        while bound < INFINITE:
            self.path = []
            found = self.descend(0, start, bound)
            if found == 0:
                return bound, "".join(reversed(self.path))
            bound = found
        return None

    def descend(self, at: int, state: int, budget: int) -> int:
        """0 if an accepting path within the budget exists, else a lower bound above the budget."""
        if at == len(self.tokens):
            if self.goal is None:
                rest = INSERT * len(END[state])
                if rest <= budget:
                    self.path.extend(END[state])
                    return 0
                return rest
            return 0 if state == self.goal else INFINITE
        if self.hopeless(state):
            return INFINITE
        needed = self.needed.get((at, state), self.least[at])
        if needed > budget:
            return needed
        kind, count = self.tokens[at]
        after = NEXT[state][0]
        edits = [("D", DELETE * count if kind == "x" else DELETE, at + 1, state), ("I", INSERT, at, after)]
        if kind != "x":
            extra = TRUNCATED if kind.isupper() else 0
            kept = KEEP[state].get(kind.lower())
            if kept is not None:
                edits.append(("K", extra, at + 1, kept))
            if kept != after:
                edits.append(("R", extra + REROLE, at + 1, after))
        best = INFINITE
        for letter, cost, to, then in edits:
            if cost > budget:
                best = min(best, cost + self.needed.get((to, then), self.least[to]))
                continue
            found = self.descend(to, then, budget - cost)
            if found == 0:
                self.path.append(letter)
                return 0
            best = min(best, cost + found)
        self.needed[at, state] = best
        return best


def table(tokens: list[tuple[str, int]]) -> list[int]:
    """Costs of a chunk from each state to each, then the order of its paths from each state."""
    costs, paths = [[INFINITE] * STATES for _ in range(STATES)], {}
    for goal in range(STATES):
        search = Search(tokens, goal)
        for start in range(STATES):
            found = search.from_state(start)
            if found:
                costs[start][goal], paths[start, goal] = found
    ranks = []
    for start in range(STATES):
        order = sorted(range(STATES), key=lambda q: paths.get((start, q), "~"))
        ranks.extend(order.index(q) for q in range(STATES))
    return [c for row in costs for c in row] + ranks


def product(a: list[int], b: list[int]) -> list[int]:
    """The table of two neighbouring stretches."""
    costs, ranks = [], []
    n = STATES * STATES
    for p in range(STATES):
        keys = []
        for q in range(STATES):
            cost, rank, mid = min(
                (min(INFINITE, a[STATES * p + r] + b[STATES * r + q]), a[n + STATES * p + r], r)
                for r in range(STATES)
            )
            costs.append(cost)
            keys.append((cost >= INFINITE, rank, b[n + STATES * mid + q], q))
        order = sorted(keys)
        ranks.extend(order.index(k) for k in keys)
    return costs + ranks


def ends(tables: list[list[int]], start: int, goal: int | None) -> list[tuple[int, int]]:
    """State before and after each stretch on the ASCII-least cheapest way through all of them."""
    if goal is None:
        value = [INSERT * len(e) for e in END]
    else:
        value = [0 if q == goal else INFINITE for q in range(STATES)]
    values = [value]
    for t in reversed(tables[1:]):
        value = [min(t[STATES * p + q] + value[q] for q in range(STATES)) for p in range(STATES)]
        values.append(value)
    values.reverse()
    out = []
    for t, after in zip(tables, values, strict=True):
        n = STATES * STATES
        goal = min(
            range(STATES), key=lambda q: (t[STATES * start + q] + after[q], t[n + STATES * start + q])
        )
        out.append((start, goal))
        start = goal
    return out


class Chunk:
    """Tokens of consecutive rows of one conversation; only rows that may stay have a key."""

    def __init__(self) -> None:
        self.tokens: list[tuple[str, int]] = []
        self.turns, self.roles, self.keys = [], [], []
        self.illegal = 0

    def gone(self, count: int) -> None:
        if self.tokens and self.tokens[-1][0] == "x":
            count += self.tokens.pop()[1]
        self.tokens.append(("x", count))

    def row(self, role: str, truncated: bool, turn, key: bytes) -> None:
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        self.tokens.append((kind.upper() if truncated else kind, 1))
        self.turns.append(turn)
        self.roles.append(role)
        self.keys.append(key)

    def solved(self, path: str, start: int) -> tuple[str, list[dict]]:
        """The edits of all rows, and the rows that stay or are inserted."""
        audit, rows, state, at, row = [], [], start, 0, 0
        for letter in path:
            kind, count = self.tokens[at] if at < len(self.tokens) else ("", 0)
            if letter == "I":
                state, role = NEXT[state]
                rows.append({"edit": "I", "role": role, "turn": None, "key": None})
                audit.append("I")
                continue
            at += 1
            audit.append("D" * count if kind == "x" else letter)
            if kind == "x":
                continue
            if letter != "D":
                if letter == "R":
                    state, role = NEXT[state]
                else:
                    state, role = KEEP[state][kind.lower()], self.roles[row]
                rows.append({"edit": letter, "role": role, "turn": self.turns[row], "key": self.keys[row]})
            row += 1
        return "".join(audit), rows

    def searched(self, start: int, goal: int | None) -> tuple[int, str, list[dict]]:
        cost, path = Search(self.tokens, goal).from_state(start)
        return cost, *self.solved(path, start)


KEPT = pa.list_(
    pa.struct([("edit", pa.string()), ("role", pa.string()), ("turn", pa.int64()), ("key", pa.binary())])
)
CHUNKS = [
    ("part", pa.int32()), ("no", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()),
    ("tail", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("kept", KEPT),
    ("kinds", pa.string()), ("counts", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64())),
    ("roles", pa.list_(pa.string())), ("keys", pa.list_(pa.binary())),
    ("costs", pa.list_(pa.int64())), ("total", pa.list_(pa.int64())),
]
CHUNKS_SQL = (
    "part int, no long, illegal long, head string, tail string, cost long, audit string,"
    " kept array<struct<edit:string,role:string,turn:long,key:binary>>, kinds string,"
    " counts array<long>, turns array<long>, roles array<string>, keys array<binary>,"
    " costs array<long>, total array<long>"
)


class Share:
    """What one task holds of one conversation."""

    def __init__(self, conv, part: int, open_: bool, size: int, held: int) -> None:
        self.conv, self.part, self.size, self.held = conv, part, size, held
        #: True if rows of the conversation may lie in other tasks, or there are too many here
        self.open = open_
        self.chunks, self.no, self.total = [Chunk()], 0, None
        self.head = self.tail = None

    def add(self, turn, role, blank, truncated, repeated, copies, key) -> Iterator[dict]:
        chunk = self.chunks[-1]
        if len(chunk.tokens) >= self.size:
            if self.open or len(self.chunks) >= self.held:
                self.open = True
                yield from self.flush()
            chunk = Chunk()
            self.chunks.append(chunk)
        initial = role[:1]
        chunk.illegal += copies - 1
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            chunk.illegal += 1
        self.tail = initial
        if blank or repeated:
            chunk.gone(copies)
        else:
            chunk.row(role, truncated, turn, key)
            if copies > 1:
                chunk.gone(copies - 1)

    def record(self, chunk: Chunk, **more) -> dict:
        self.no += 1
        base = dict.fromkeys(name for name, _ in CHUNKS)
        return {**base, "conv_id": self.conv, "part": self.part, "no": self.no, "illegal": chunk.illegal, **more}

    def flush(self) -> Iterator[dict]:
        """Send the chunks on with their tables."""
        for chunk in self.chunks:
            costs = table(chunk.tokens)
            self.total = product(self.total, costs) if self.total else costs
            yield self.record(
                chunk, kinds="".join(k for k, _ in chunk.tokens), counts=[c for _, c in chunk.tokens],
                turns=chunk.turns, roles=chunk.roles, keys=chunk.keys, costs=costs,
                head=self.head, tail=self.tail, total=self.total,
            )
        self.chunks = []

    def close(self, last: bool) -> Iterator[dict]:
        if self.open or last:
            yield from self.flush()
            return
        if len(self.chunks) == 1:
            bounds = [(0, None)]
        else:
            bounds = ends([table(c.tokens) for c in self.chunks], 0, None)
            bounds[-1] = (bounds[-1][0], None)
        for chunk, (start, goal) in zip(self.chunks, bounds, strict=True):
            cost, audit, kept = chunk.searched(start, goal)
            yield self.record(chunk, cost=cost, audit=audit, kept=kept)
        self.chunks = []


def _hash(*columns: Column) -> Column:
    """SHA-256 of columns, each with its length in front; null has its own mark."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _prepared(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, copies and hashes, without nulls in role and text."""
    named = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
    )
    named = named.withColumn("content", _hash(F.col("role"), F.col("text")))
    return named.withColumn("key", _hash(F.col("conv_id"), F.col("turn"), F.hex("content")))


def _rows(prepared: DataFrame) -> DataFrame:
    """One thin row for each different (conv_id, turn, role, text), with its faults."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    thin = prepared.select(
        "conv_id", "turn", "role", "copies", "key", "content",
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    keys = ["conv_id", "turn", "role", "key", "content", "blank", "truncated"]
    counted = cut_lineage(thin.groupBy(*keys).agg(F.sum("copies").alias("copies")))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    firsts = counted.groupBy(F.col("conv_id").alias("_c"), F.col("content").alias("_h")).agg(
        F.min(when).alias("_first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("content") == F.col("_h"))
    return counted.join(firsts, same).withColumn("repeated", when > F.col("_first")).drop("_c", "_h", "_first")


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate and truncated of every conversation with rows."""

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0)))

    blank, repeated, n = F.col("blank"), F.col("repeated"), F.col("copies")
    by_turn = rows.groupBy("conv_id", "turn").agg(
        total(blank, n).alias("blank"),
        total(~blank, F.when(repeated, n).otherwise(n - 1)).alias("duplicate"),
        total(~blank & ~repeated & F.col("truncated"), F.lit(1)).alias("truncated"),
    )
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return by_turn.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
    )


def _chunked(rows: DataFrame, kind: T.DataType, size: int, held: int) -> DataFrame:
    """Chunks in order; solved ones have an audit, open ones their tables."""
    content = F.expr("hex(content)")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "_content"]
    ordered = (
        rows.withColumn("_content", content)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "turn", "role", "blank", "truncated", "repeated", "copies", "key")
    )
    schema = T.StructType([T.StructField("conv_id", kind)]).simpleString()[len("struct<"):-1].replace(":", " ", 1)

    def run(batches):
        part, share = TaskContext.get().partitionId(), None
        for batch in batches:
            fields = pa.schema([batch.schema.field("conv_id"), *CHUNKS])
            out = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, *row in zip(*columns, strict=True):
                if share is None or conv != share.conv:
                    first = share is None
                    if share:
                        out.extend(share.close(last=False))
                    share = Share(conv, part, first, size, held)
                out.extend(share.add(*row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
        if share:
            yield pa.RecordBatch.from_pylist(list(share.close(last=True)), schema=fields)

    return cut_lineage(ordered.mapInArrow(run, f"{schema}, {CHUNKS_SQL}"))


def _close_open(chunks: DataFrame, kind: T.DataType) -> DataFrame:
    """Open chunks solved; conversations that cross tasks are joined by one product a task."""
    fields = [T.StructField("conv_id", kind), T.StructField("part", T.IntegerType())]

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        bounds = ends([list(t) for t in rows["total"]], 0, None)
        border = [
            int(a + b not in LEGAL) for a, b in zip(["s", *rows["tail"][:-1]], rows["head"], strict=True)
        ]
        return pd.DataFrame(
            {
                "conv_id": rows["conv_id"], "part": rows["part"], "start": [a for a, _ in bounds],
                "goal": [b for _, b in bounds[:-1]] + [-1], "border": [0, *border[1:]],
            }
        )

    ends_schema = T.StructType(
        [*fields, *[T.StructField(n, T.IntegerType()) for n in ("start", "goal", "border")]]
    )
    shares = chunks.filter("costs is not null").groupBy("conv_id", "part").agg(
        F.min_by("head", "no").alias("head"), F.max_by("tail", "no").alias("tail"),
        F.max_by("total", "no").alias("total"),
    )
    joined = shares.groupBy("conv_id").applyInPandas(across, ends_schema)
    joined = joined.withColumnRenamed("conv_id", "_c").withColumnRenamed("part", "_p")

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        start, goal, border = (int(rows[c].iloc[0]) for c in ("start", "goal", "border"))
        bounds = ends([list(t) for t in rows["costs"]], start, None if goal < 0 else goal)
        if goal < 0:
            bounds[-1] = (bounds[-1][0], None)
        out = []
        for row, (a, b) in zip(rows.itertuples(), bounds, strict=True):
            chunk = Chunk()
            chunk.tokens = list(zip(row.kinds, map(int, row.counts), strict=True))
            chunk.turns = [None if pd.isna(t) else int(t) for t in row.turns]
            chunk.roles, chunk.keys = list(row.roles), list(row.keys)
            cost, audit, kept = chunk.searched(a, b)
            out.append((row.conv_id, row.part, row.no, int(row.illegal) + border, cost, audit, kept))
            border = 0
        return pd.DataFrame(out, columns=["conv_id", "part", "no", "illegal", "cost", "audit", "kept"])

    solved_schema = chunks.select("conv_id", "part", "no", "illegal", "cost", "audit", "kept").schema
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))
    return (
        chunks.filter("costs is not null").join(joined, same)
        .select(
            "conv_id", "part", "no", "illegal", "kinds", "counts", "turns", "roles", "keys", "costs",
            "start", "goal", "border",
        )
        .groupBy("conv_id", "part").applyInPandas(inside, solved_schema)
    )


class Repair:
    """The cheapest repair of every conversation of `turns` (conv_id, turn, role, text).

    `copies` is an optional column with the number of times each row occurs.
    """

    def __init__(
        self, turns: DataFrame, copies: Column | None = None, size: int = CHUNK, held: int = HELD_CHUNKS
    ) -> None:
        self.prepared = _prepared(turns, copies)
        kind = self.prepared.schema["conv_id"].dataType
        rows = cut_lineage(_rows(self.prepared))
        #: conv_id, gaps, blank, duplicate and truncated of conversations with rows
        self.faults = _faults(rows)
        chunks = _chunked(rows, kind, size, held)
        solved = ["conv_id", "part", "no", "illegal", "cost", "audit", "kept"]
        closed = chunks.filter("costs is null").select(*solved)
        self.chunks = cut_lineage(closed.unionByName(_close_open(chunks, kind)))

    @property
    def audits(self) -> DataFrame:
        """conv_id, illegal, cost and audit of conversations with rows."""
        pieces = F.array_sort(F.collect_list(F.struct("part", "no", "audit")))
        return self.chunks.groupBy("conv_id").agg(
            F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
            F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"),
        )

    @property
    def repaired(self) -> DataFrame:
        """Rows of the repaired conversations: conv_id, place, edit, turn, role and text.

        `place` is a struct that orders the rows of a conversation.
        """
        rows = self.chunks.select("conv_id", "part", "no", F.posexplode("kept").alias("at", "row")).select(
            "conv_id", F.struct("part", "no", "at").alias("place"), "row.*"
        )
        texts = self.prepared.select(F.col("key").alias("_key"), "text").dropDuplicates(["_key"])
        held = rows.filter("key is not null").join(texts, F.col("key") == F.col("_key"))
        added = rows.filter("key is null").withColumn("text", F.lit(""))
        columns = ["conv_id", "place", "edit", "turn", "role", "text"]
        return held.select(*columns).unionByName(added.select(*columns))

    def checksums(self) -> DataFrame:
        """conv_id and SHA-256 of the lines `role:text`, for conversations with repaired rows."""
        lines = self.repaired.select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line"))
        lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")
        kind = self.prepared.schema["conv_id"].dataType.simpleString()

        def run(batches):
            conv, digest = None, None
            for batch in batches:
                done_ids, done = [], []
                for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if digest is None or c != conv:
                        if digest is not None:
                            done_ids.append(conv)
                            done.append(digest.hexdigest())
                        conv, digest = c, hashlib.sha256(line.encode())
                    else:
                        digest.update(b"\n")
                        digest.update(line.encode())
                field = batch.schema.field(0).type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(done_ids, field), pa.array(done, pa.string())], ["conv_id", "sha"]
                )
            if digest is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv], field), pa.array([digest.hexdigest()])], ["conv_id", "sha"]
                )

        return lines.mapInArrow(run, f"conv_id {kind}, sha string")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with planted faults by crc32 of `conv_id:turn` modulo 20, and their number of copies."""
    name = F.concat_ws(
        ":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    )
    fault = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.filter(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("_copies"),
    )
    return rows, F.col("_copies")


def digests(conversations: DataFrame, **sizes: int) -> DataFrame:
    """Faults, cost, audit and checksum of the repair of every damaged conversation."""
    repair = Repair(*damaged(conversations), **sizes)
    out = conversations.select("conv_id").distinct()
    for number, found in enumerate((repair.faults, repair.audits, repair.checksums())):
        found = found.withColumnRenamed("conv_id", f"_c{number}")
        out = out.join(found, F.col("conv_id").eqNullSafe(F.col(f"_c{number}")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
