"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text is a lattice of pieces. The state at a position is the piece that starts before it and
ends at it or after it; the matrix of a chunk holds, for each state at its start and at its end,
the best weight of the pieces between them, and matrices combine by the max-plus product. Giant
documents are cut into chunks of characters, each chunk yields its matrix, matrices are combined
by spans and then by documents, which fixes the states at all borders, and every chunk is traced
back by itself. Only matrices and states of giant documents are shuffled, and their text once.

Both kinds of model run on the same lattice. In a unigram model a piece weighs its score. In a
byte-pair model (such as the default file) a piece weighs nothing, but two pieces may be neighbours only if merging
their joined text gives exactly these two; the merges of a text keep to both sides of a final
border and tie-breaks are local, so exactly one path has weight 0 and it is the merged encoding.

Where no piece of the vocabulary holds two adjacent characters in this order, every path has a
border (before white space, for instance). Such cuts split chunks into short stretches whose
encodings are kept for the rest of a worker's tasks; the weight between two cuts is the same for
all paths and left out of matrices.

Defined cases: null and empty texts have no ids; characters without a piece become byte pieces
(or the unknown id where the model has none); U+2581 is the white-space mark and decodes to a
space; very long texts are scanned in chunks, also without any cut; rows with equal id and text
are encoded once when giant and returned each; empty tables give empty results; further columns
are kept, a column `ids` is replaced. Models with a normalization other than identity are refused.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import vocab
from loomwork.session import cut_lineage

FILE = "piece_bpe_32k.model"
#: characters of a chunk; longer texts than GIANT are cut
CHUNK = 32_768
GIANT = 65_536
SPAN = 64
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: names of characters without an id begin here, above all ids; names of pairs are left * PAIR + right
CHARACTER = 1 << 20
PAIR = 1 << 22

State = tuple[int, int]  # characters before the border and length of the piece across it
START: State = (0, 0)


class Model:
    def __init__(self, content: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(content)
        norm, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only models with identity normalization are supported")
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and byte-pair models are supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.merging = model.trainer_spec.model_type == 2
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes = [-1] * 256
        self.unknown = 0
        self.spelled: list[bytes] = []
        for i, p in enumerate(model.pieces):
            spelled = p.piece.replace(SPACE, " ").encode()
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.bytes[value], spelled = i, bytes([value])
            elif p.type == kinds.UNKNOWN:
                self.unknown, spelled = i, " ⁇ ".encode()
            elif p.type == kinds.CONTROL:
                spelled = b""
            else:
                raise ValueError("user-defined and unused pieces are not supported")
            self.spelled.append(spelled)
        self.longest = max(map(len, self.ids))
        self.begun = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.unknown_weight = min(self.score.values()) - UNKNOWN_PENALTY
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        inner = {p for p in self.pairs if p[1] == SPACE and p[0] != SPACE}
        lines = {p for p in self.pairs if "\n" in p}
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n") if not inner | lines else None
        self.may_follow: dict[tuple[str, str], bool] = {}
        self.memo = vocab.Memo(self.encode_stretches)
        self.parts: dict[str, list[int]] = {}
        if self.merging:
            self.merges = self._merges()
            self.of_character = np.full(0x110000, -1, np.int64)
            for piece, i in self.ids.items():
                if len(piece) == 1:
                    self.of_character[ord(piece)] = i

    # --- the lattice -----------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging as defined: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                (self.score[a + b], -i)
                if a + b in self.score else (-np.inf, -i)
                for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
            )
            if best[0] == -np.inf:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of neighbours that merge (left * PAIR + right), what they give, and the scores.

        Pieces are named by id, single characters without an id by CHARACTER + code point.
        """
        def named(part: str) -> int | None:
            known = self.ids.get(part)
            return known if known is not None or len(part) > 1 else CHARACTER + ord(part)

        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = named(piece[:k]), named(piece[k:])
                if left is not None and right is not None:
                    pairs[left * PAIR + right] = (i, self.score[piece])
        keys = np.array(sorted(pairs), np.int64)
        made = np.array([pairs[k][0] for k in keys.tolist()], np.int64)
        return keys, made, np.array([pairs[k][1] for k in keys.tolist()])

    def merged_stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Names of the pieces of many texts, by merging as `merge` does, and the text of each name.

        Every round merges the best pair of each text that still has one.
        """
        keys, made, scores = self.merges
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        names = self.of_character[codes]
        names = np.where(names < 0, CHARACTER + codes, names)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        done = []
        while len(names):
            pair = names[:-1] * PAIR + names[1:]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            can = np.flatnonzero((keys[at] == pair) & (owner[:-1] == owner[1:]))
            active = np.zeros(len(texts), bool)
            active[owner[can]] = True
            going = active[owner]
            done.append((owner[~going], names[~going]))
            if not len(can):
                break
            # candidates are in order, so those of one text are neighbours
            first = np.flatnonzero(np.diff(owner[can], prepend=-1))
            value = scores[at[can]]
            best = np.repeat(np.maximum.reduceat(value, first), np.diff(first, append=len(can)))
            top = can[value == best]
            top = top[np.flatnonzero(np.diff(owner[top], prepend=-1))]
            names[top] = made[at[top]]
            going[top + 1] = False
            names, owner = names[going], owner[going]
        owner = np.concatenate([o for o, _ in done] or [owner])
        names = np.concatenate([n for _, n in done] or [names])
        order = np.argsort(owner, kind="stable")
        return names[order], owner[order]

    def encode_stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many stretches, and the number of ids of each."""
        if not self.merging:
            return vocab.flattened([self.encode_stretch(t) for t in texts])
        names, owner = self.merged_stretches(texts)
        counts = np.bincount(owner, minlength=len(texts))
        strange = np.flatnonzero(names >= CHARACTER)
        if not len(strange):
            return names.astype(np.int32), counts
        spelled = [self.to_ids([chr(c)]) for c in (names[strange] - CHARACTER).tolist()]
        sizes = np.ones(len(names), np.int64)
        sizes[strange] = np.fromiter(map(len, spelled), np.int64, len(spelled))
        out = np.repeat(names, sizes)
        starts = (np.cumsum(sizes) - sizes)[strange]
        for start, ids in zip(starts.tolist(), spelled, strict=True):
            out[start : start + len(ids)] = ids
        return out.astype(np.int32), np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)

    def follows(self, before: str, piece: str) -> bool:
        if not self.merging:
            return True
        key = (before, piece)
        known = self.may_follow.get(key)
        if known is None:
            if len(self.may_follow) > vocab.MEMO_WORDS:
                self.may_follow.clear()
            known = self.merge(before + piece) == ([before, piece] if before else [piece])
            self.may_follow[key] = known
        return known

    def starting(self, text: str, at: int, end: int) -> list[tuple[str, float]]:
        """Pieces at a position and their weights; a lone character is always one."""
        found = []
        for n in range(1, min(self.longest, end - at) + 1):
            piece = text[at : at + n]
            score = self.score.get(piece)
            if score is not None:
                found.append((piece, 0.0 if self.merging else score))
            elif n == 1:
                found.append((piece, 0.0 if self.merging else self.unknown_weight))
            if piece not in self.begun:
                break
        return found

    def short_path(self, text: str) -> list[str]:
        """Pieces of a whole stretch; in a byte-pair model at most one piece is valid at each end."""
        if not self.merging:
            return self.path(text, 0, len(text), len(text), "", None)
        score, begun, known = self.score, self.begun, self.may_follow
        size = len(text)
        last: list[str | None] = [""] + [None] * size
        for at in range(size):
            before = last[at]
            if before is None:
                continue
            for to in range(at + 1, size + 1):
                piece = text[at:to]
                if last[to] is None and (piece in score or to == at + 1):
                    ok = known.get((before, piece))
                    if ok or (ok is None and self.follows(before, piece)):
                        last[to] = piece
                if piece not in begun:
                    break
        pieces, at = [], size
        while at:
            pieces.append(last[at])
            at -= len(last[at])
        return pieces[::-1]

    def is_piece(self, text: str) -> bool:
        return len(text) == 1 or text in self.score

    def path(self, text: str, lo: int, hi: int, end: int, before: str, exit_length: int | None) -> list[str]:
        """Pieces that start in [lo, hi) after the piece `before`; the last one ends at `end`."""
        reach: list[dict | None] = [None] * (end - lo + 1)
        reach[0] = {before: (0.0, None, None)}
        for at in range(lo, hi):
            here = reach[at - lo]
            if here is None:
                continue
            for piece, weight in self.starting(text, at, end):
                to = at + len(piece)
                if to > hi and (to != end or len(piece) != exit_length):
                    continue
                for last, (value, *_) in here.items():
                    if self.follows(last, piece):
                        slot = reach[to - lo]
                        if slot is None:
                            slot = reach[to - lo] = {}
                        name = piece if self.merging else ""
                        if name not in slot or value + weight > slot[name][0]:
                            slot[name] = (value + weight, piece, last)
        pieces, at = [], end
        ends = reach[end - lo]
        if exit_length is not None and self.merging:
            name = text[end - exit_length : end]
        else:
            name = max(ends, key=lambda k: ends[k][0])
        while at > lo:
            _, piece, last = reach[at - lo][name]
            pieces.append(piece)
            at, name = at - len(piece), last
        return pieces[::-1]

    def cuts(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last position in (lo, hi) that no piece can cross."""
        pairs = self.pairs
        first = next((i for i in range(lo + 1, hi) if text[i - 1 : i + 1] not in pairs), None)
        if first is None:
            return None
        return first, next(i for i in range(hi - 1, lo, -1) if text[i - 1 : i + 1] not in pairs)

    def entries(self, text: str, border: int) -> list[State]:
        """All states at a border inside a text."""
        return [
            (o, n)
            for o in range(1, min(self.longest, border) + 1)
            for n in range(o, min(self.longest, len(text) - border + o) + 1)
            if self.is_piece(text[border - o : border - o + n])
        ]

    def sweep(self, text: str, lo: int, hi: int, entries: list[State]) -> tuple[list[State], np.ndarray]:
        """States at `hi` and the matrix of best weights from each entry state at `lo`."""
        reach: dict[int, dict[str, np.ndarray]] = {}
        for k, (o, n) in enumerate(entries):
            unit = np.full(len(entries), -np.inf)
            unit[k] = 0.0
            slot = reach.setdefault(lo - o + n, {})
            name = text[lo - o : lo - o + n] if self.merging else ""
            slot[name] = np.maximum(slot[name], unit) if name in slot else unit
        exits: dict[State, np.ndarray] = {}
        for at in range(lo, hi):
            here = reach.pop(at, None)
            if not here:
                continue
            for piece, weight in self.starting(text, at, len(text)):
                fitting = [v for last, v in here.items() if self.follows(last, piece)]
                if not fitting:
                    continue
                value = np.max(fitting, axis=0) + weight
                to = at + len(piece)
                if to >= hi:
                    state = (hi - at, len(piece))
                    exits[state] = np.maximum(exits[state], value) if state in exits else value
                else:
                    slot = reach.setdefault(to, {})
                    name = piece if self.merging else ""
                    slot[name] = np.maximum(slot[name], value) if name in slot else value
        states = sorted(exits)
        return states, np.array([exits[s] for s in states]).reshape(len(states), len(entries)).T

    def matrix(self, text: str, lo: int, hi: int, first: bool) -> tuple:
        """(entry states, exit states, weights) of the chunk [lo, hi) with its margins."""
        entries = [START] if first else self.entries(text, lo)
        cuts = self.cuts(text, lo, hi)
        if cuts is None:
            exits, weights = self.sweep(text, lo, hi, entries)
            return entries, exits, weights
        _, head = self.sweep(text[: cuts[0]], lo, cuts[0], entries)
        head = head.max(axis=1, initial=-np.inf)
        head[[k for k, (o, n) in enumerate(entries) if lo - o + n == cuts[0]]] = 0.0
        exits, tail = self.sweep(text, cuts[1], hi, [START])
        return entries, exits, head[:, None] + tail[0][None, :]

    # --- encoding --------------------------------------------------------------------------

    def to_ids(self, pieces: list[str]) -> list[int]:
        ids = []
        for piece in pieces:
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            else:
                found = [self.bytes[b] for b in piece.encode()]
                ids += found if min(found) >= 0 else [self.unknown]
        return ids

    def encode_stretch(self, text: str) -> list[int]:
        """Ids of a stretch between two cuts; its own cuts split it further."""
        ids, start = [], 0
        for at in range(1, len(text) + 1):
            if at == len(text) or text[at - 1 : at + 1] not in self.pairs:
                part = text[start:at]
                found = self.parts.get(part)
                if found is None:
                    found = self.to_ids(self.short_path(part))
                    if len(self.parts) > vocab.MEMO_WORDS // 2:
                        self.parts.clear()
                    if len(part) <= vocab.MEMO_CHARS:
                        self.parts[part] = found
                ids += found
                start = at
        return ids

    def encode_between_cuts(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return self.memo.encoded(self.stretch.findall(text) if self.stretch else [text])[0]

    def normalized(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> np.ndarray:
        return self.encode_between_cuts(self.normalized(text))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the stretches of all are looked up together."""
        normal = map(self.normalized, texts)
        lists = [self.stretch.findall(t) if self.stretch else [t] * bool(t) for t in normal]
        ids, lengths = self.memo.encoded([w for ws in lists for w in ws])
        words = np.cumsum([0] + [len(ws) for ws in lists])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return np.split(ids, upto[words[1:-1]]) if lists else []

    def trace(self, text: str, lo: int, hi: int, entry: State, exit: State) -> np.ndarray:
        """Ids of the pieces that start in the chunk [lo, hi), between two states."""
        o, n = entry
        before, start = text[lo - o : lo - o + n], lo - o + n
        end = hi - exit[0] + exit[1]
        cuts = self.cuts(text, lo, hi)
        if cuts is None:
            return np.array(self.to_ids(self.path(text, start, hi, end, before, exit[1])), np.int32)
        head = self.to_ids(self.path(text, start, cuts[0], cuts[0], before, None)) if start < cuts[0] else []
        tail = self.to_ids(self.path(text, cuts[1], hi, end, "", exit[1]))
        middle = self.encode_between_cuts(text[cuts[0] : cuts[1]])
        return np.concatenate([np.array(head, np.int32), middle, np.array(tail, np.int32)])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def combine(a: tuple, b: tuple) -> tuple:
    """Max-plus product of two matrices with named states; associative."""
    rows = {state: i for i, state in enumerate(b[0])}
    pairs = [(k, rows[s]) for k, s in enumerate(a[1]) if s in rows]
    left, right = (np.array(x, int) for x in zip(*pairs, strict=True))
    weights = (a[2][:, left, None] + b[2][None, right, :]).max(axis=1)
    return a[0], b[1], weights


def resolve(matrices: list[tuple], entry: State = START, exit: State | None = None) -> list[tuple[State, State]]:
    """Entry and exit state of each matrix on the best path."""
    weight, back = {entry: 0.0}, []
    for entries, exits, weights in matrices:
        v = np.array([weight.get(s, -np.inf) for s in entries])
        through = v[:, None] + weights
        best = through.argmax(axis=0)
        back.append({s: entries[best[j]] for j, s in enumerate(exits)})
        weight = {s: through[best[j], j] for j, s in enumerate(exits)}
    state = exit if exit is not None else max(weight, key=weight.get)
    states = []
    for step in reversed(back):
        states.append((step[state], state))
        state = step[state]
    return states[::-1]


_KEY = ["_key", "_span"]


def _giant_ids(giant: DataFrame, shared, chunk: int) -> DataFrame:
    """(_key, ids, n_chunks) of distinct giant texts."""

    def split(batches):
        model = vocab.once(shared, Model)
        margin = model.longest
        for batch in batches:
            for key, text in zip(
                batch.column("_key").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                t = model.normalized(text)
                for i, at in enumerate(range(0, len(t), chunk)):
                    end = min(at + chunk, len(t))
                    if 0 < len(t) - end < margin:  # the last chunk is not shorter than a piece
                        end = len(t)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "_key": [key], "_span": pa.array([i // SPAN], pa.int64()),
                            "chunk": pa.array([i], pa.int64()), "before": [t[max(0, at - margin) : at]],
                            "body": [t[at:end]], "after": [t[end : end + margin]],
                        }
                    )
                    if end == len(t):
                        break

    chunks = giant.select("_key", "text").mapInArrow(
        split, "_key string, _span long, chunk long, before string, body string, after string"
    )
    chunks = cut_lineage(chunks.repartition("_key", "chunk"))

    def matrices(batches):
        model = vocab.once(shared, Model)
        for batch in batches:
            found = [
                pickle.dumps(
                    model.matrix(
                        r["before"] + r["body"] + r["after"], len(r["before"]),
                        len(r["before"]) + len(r["body"]), r["chunk"] == 0,
                    )
                )
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*_KEY, "chunk")), pa.array(found, pa.binary())],
                [*_KEY, "chunk", "matrix"],
            )

    mats = cut_lineage(chunks.mapInArrow(matrices, "_key string, _span long, chunk long, matrix binary"))

    def ordered(table: pa.Table, by: str) -> tuple[list[int], list[tuple]]:
        table = table.sort_by(by)
        return table.column(by).to_pylist(), [pickle.loads(m) for m in table.column("matrix").to_pylist()]

    def product(table: pa.Table) -> pa.Table:
        _, found = ordered(table, "chunk")
        whole = found[0]
        for m in found[1:]:
            whole = combine(whole, m)
        return pa.table(
            {"_key": table.column("_key")[:1], "_span": table.column("_span")[:1], "matrix": [pickle.dumps(whole)]}
        )

    def spans(table: pa.Table) -> pa.Table:
        numbers, found = ordered(table, "_span")
        states = [pickle.dumps(s) for s in resolve(found)]
        return pa.table({"_key": [table.column("_key")[0].as_py()] * len(numbers), "_span": numbers, "ends": states})

    def inside(own: pa.Table, ends: pa.Table) -> pa.Table:
        numbers, found = ordered(own, "chunk")
        states = resolve(found, *pickle.loads(ends.column("ends")[0].as_py()))
        return pa.table(
            {
                "_key": [own.column("_key")[0].as_py()] * len(numbers), "chunk": numbers,
                "states": [pickle.dumps(s) for s in states],
            }
        )

    of_span = mats.groupBy(*_KEY).applyInArrow(product, "_key string, _span long, matrix binary")
    ends = of_span.groupBy("_key").applyInArrow(spans, "_key string, _span long, ends binary")
    states = mats.groupBy(*_KEY).cogroup(ends.groupBy(*_KEY)).applyInArrow(
        inside, "_key string, chunk long, states binary"
    )

    def trace(batches):
        model = vocab.once(shared, Model)
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                lo = len(r["before"])
                text = r["before"] + r["body"] + r["after"]
                found.append(model.trace(text, lo, lo + len(r["body"]), *pickle.loads(r["states"])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("chunk"), pa.array(found, pa.list_(pa.int32()))],
                ["_key", "chunk", "ids"],
            )

    traced = chunks.join(states, ["_key", "chunk"]).mapInArrow(
        trace, "_key string, chunk long, ids array<int>"
    )
    parts = F.sort_array(F.collect_list(F.struct("chunk", "ids")))
    return traced.groupBy("_key").agg(parts.alias("parts")).select(
        "_key", F.flatten("parts.ids").alias("ids"), F.size("parts").alias("n_chunks")
    )


def encode(
    docs: DataFrame, file: str = FILE, chunk: int = CHUNK, giant: int = GIANT,
) -> DataFrame:
    """The documents with `ids` (array of int) and `n_chunks`."""
    shared = vocab.shipped(docs.sparkSession, file)
    rest = docs.drop("ids", "n_chunks")

    def run(batches):
        model = vocab.once(shared, Model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in vocab.steps(texts):
                found = model.encode_all(texts[start:end])
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns, pa.array(found, pa.list_(pa.int32())),
                        pa.array([1] * len(found), pa.int32()),
                    ],
                    [*batch.schema.names, "ids", "n_chunks"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    size = F.coalesce(F.length("text"), F.lit(0))
    small = rest.filter(size <= giant).mapInArrow(run, f"{schema}, ids array<int>, n_chunks int")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"))
    large = rest.filter(size > giant).select(F.struct("*").alias("_row"), key.alias("_key"))
    distinct = large.groupBy("_key").agg(F.first("_row.text").alias("text"))
    ids = _giant_ids(distinct, shared, chunk)
    return small.unionByName(large.join(ids, "_key").select("_row.*", "ids", "n_chunks"))


def _row(ids: pa.ListScalar) -> np.ndarray:
    """The ids of one row; no ids for a missing list."""
    return ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)


def decode(encoded: DataFrame, file: str = FILE) -> DataFrame:
    """The rows with `decoded`, the text of `ids`."""
    shared = vocab.shipped(encoded.sparkSession, file)
    rest = encoded.drop("decoded")

    def run(batches):
        model = vocab.once(shared, Model)
        for batch in batches:
            texts = [model.decode(_row(x)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{schema}, decoded string")


def digests(docs: DataFrame, file: str = FILE) -> DataFrame:
    """doc_id, n_tokens, n_chunks, ids_crc32 and round_trip (decoded ids give the text)."""
    encoded = encode(docs.select("doc_id", "text"), file)
    shared = vocab.shipped(docs.sparkSession, file)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = vocab.once(shared, Model)
        for batch in batches:
            rows = [_row(x) for x in batch.column("ids")]
            texts = batch.column("text")
            same = [model.decode(r) == (t.as_py() or "") for r, t in zip(rows, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()),
                    batch.column("n_chunks"),
                    pa.array([zlib.crc32(r.astype("<u4")) for r in rows], pa.int64()), pa.array(same),
                ],
                ["doc_id", "n_tokens", "n_chunks", "ids_crc32", "round_trip"],
            )

    return encoded.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_chunks int, ids_crc32 long, round_trip boolean"
    )
