"""Language-model scores by prediction by partial matching over bytes.

The model holds every byte context of up to `ORDER` bytes with the counts of what followed it in
all training documents. A symbol that a context has seen has its share of the count; the context's
escape share (as many as it has different symbols) goes to the next shorter context, where the
symbols already excluded are left out of all counts; after the empty context the rest of the
alphabet is uniform. A symbol's code length depends on the `ORDER` symbols before it only, so it
is computed once for each n-gram that occurs: n-grams are counted by block of documents, summed
over blocks, joined level by level to their suffixes, and the code lengths return to the blocks:
broadcast if there are at most `HELD_LOGS` of them, else by a join, so that neither the driver nor
a task holds a large model. A caller may ask for the
`max_contexts` most frequent contexts only; `Trie` is that bounded model as an automaton.

The base score is a smoothed unigram model of words, exact over the corpus: documents are dealt
to blocks of about `BLOCK_BYTES`, each block sends its distinct words once, the counts come back
to the block, and documents are scored there. Neither a word nor a block is one task's group of
unbounded size: a word has one row for each block.

Defined cases: null text counts as empty, that is one end token; very long texts are taken in
pieces; repeated rows are learned from and scored each; without training rows all counts are
zero and the models uniform; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm import vocab
from loomwork.session import cut_lineage

ORDER = 4
BLOCK_BYTES = 8 << 20
#: symbols: bytes and the end of a document, which also fills the contexts before its start
END = 256
SYMBOLS = 257
BITS = 9
#: symbols of one stretch of an automaton's walk
STRETCH = 512
#: characters handled at a time; different n-grams a task holds before it merges and before it sends
STEP_CHARS = 500_000
#: code lengths that every task may hold (16 bytes each); more of them return to the blocks by a join
HELD_LOGS = 2_000_000
MERGE_AT, SEND_AT = 1_500_000, 750_000


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, each with its end, and their numbers of symbols."""
    flat = np.frombuffer(b"\x00".join([*texts, b""]), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    flat[np.cumsum(lengths) - 1] = END
    return flat, lengths


def _merged(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def gram_counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each symbol with the `order` symbols before it, and how often they occur."""
    flat, lengths = symbols(texts)
    starts = np.cumsum(lengths) - lengths
    within = np.arange(len(flat)) - np.repeat(starts, lengths)
    code = flat.copy()
    for k in range(1, order + 1):
        before = np.full(len(flat), END, np.int64)
        before[k:] = flat[:-k]
        code |= np.where(within >= k, before, END) << (BITS * k)
    return np.unique(code, return_counts=True)


def coded(texts: list[bytes], order: int, size: int = STEP_CHARS) -> Iterator[tuple[int, np.ndarray]]:
    """The n-gram codes of all symbols in order, `size` at a time, and where each part begins."""
    total = sum(map(len, texts)) + len(texts)
    flat = np.full(order + total, END, np.int16)
    flat[order:] = np.frombuffer(b"\x00".join([*texts, b""]), np.uint8)
    flat[order - 1 + np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)] = END
    for at in range(0, total, size):
        end = min(total, at + size)
        code = flat[order + at : order + end].astype(np.int64)
        ended = np.zeros(end - at, bool)
        for k in range(1, order + 1):
            # before the start of a document there are only ends
            before = np.where(ended, END, flat[order + at - k : order + end - k])
            ended = before == END
            code |= before.astype(np.int64) << (BITS * k)
        yield at, code


def train(docs: DataFrame, order: int = ORDER, max_contexts: int = 24_000) -> bytes:
    """A bounded trie of the documents' texts as (contexts, symbols, counts)."""

    def count(batches):
        vocab.release()
        codes, counts, held = [], [], 0

        def rows():
            code, times = _merged(codes, counts)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(times)], ["gram", "n"])

        for batch in batches:
            texts = [(t or "").encode().lower() for t in batch.column("text").to_pylist()]
            for start, end in vocab.steps(texts, STEP_CHARS):
                code, times = gram_counts(texts[start:end], order)
                codes.append(code)
                counts.append(times)
                held += len(code)
                if held > MERGE_AT:
                    code, times = _merged(codes, counts)
                    codes, counts, held = [code], [times], len(code)
                    if held > SEND_AT:
                        yield rows()
                        codes, counts, held = [], [], 0
        if held:
            yield rows()

    vocab.small_batches(docs.sparkSession)
    grams = docs.select("text").mapInArrow(count, "gram long, n long")
    grams = grams.groupBy("gram").agg(F.sum("n").alias("n")).persist()
    try:
        lengths = F.explode(F.array(*[F.lit(k) for k in range(order + 1)])).alias("k")
        parts = grams.select("gram", "n", lengths).select(
            "k", "n", F.col("gram").bitwiseAND((1 << BITS) - 1).alias("symbol"),
            # the k symbols before the last one
            F.expr(f"shiftright(gram, {BITS}) & (shiftleft(1L, {BITS} * k) - 1)").alias("context"),
        )
        contexts = parts.groupBy("k", "context").agg(F.sum("n").alias("total"))
        # a suffix is at least as frequent and shorter, so kept contexts have kept suffixes
        kept = contexts.orderBy(F.desc("total"), "k", "context").limit(max_contexts)
        kept = kept.select("k", "context").toArrow()
        kept = docs.sparkSession.createDataFrame(kept)  # at most max_contexts rows
        rows = (
            parts.join(F.broadcast(kept), ["k", "context"])
            .groupBy("k", "context", "symbol").agg(F.sum("n").alias("n")).toArrow()
        )
    finally:
        grams.unpersist()
    columns = [rows.column(c).to_numpy() for c in ("k", "context", "symbol", "n")]
    return pickle.dumps((order, *columns))


def _distributions(states: np.ndarray, counts: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """log10 of the probability of each symbol after each of the contexts, with exclusion."""
    out = np.zeros((len(states), SYMBOLS))
    excluded = np.zeros((len(states), SYMBOLS), bool)
    escape = np.zeros(len(states))
    at, going = states.copy(), np.ones(len(states), bool)
    while going.any():
        c = np.where(excluded | ~going[:, None], 0.0, counts[at])
        seen = c > 0
        kinds = seen.sum(axis=1)
        # without a symbol left to escape to, the seen ones share everything
        more = kinds + excluded.sum(axis=1) < SYMBOLS
        total = c.sum(axis=1) + np.where(more, kinds, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.log10(c / total[:, None])
            out = np.where(seen, escape[:, None] + share, out)
            escape = np.where((kinds > 0) & more, escape + np.log10(kinds / total), escape)
        excluded |= seen
        going &= at > 0
        at = suffix[at]
    rest = (~excluded).sum(axis=1)
    uniform = escape - np.log10(np.maximum(rest, 1))
    return np.where(excluded, out, uniform[:, None]).astype(np.float32)


class Trie:
    """Code lengths and next states of every (context, symbol)."""

    def __init__(self, content: bytes) -> None:
        order, k, context, symbol, n = pickle.loads(content)
        self.order = order
        names = sorted({(0, 0), *zip(k.tolist(), context.tolist(), strict=True)})
        states = {name: state for state, name in enumerate(names)}
        self.states = states
        length = np.array([name[0] for name in names])
        counts = np.zeros((len(names), SYMBOLS), np.float32)
        counts[[states[x] for x in zip(k.tolist(), context.tolist(), strict=True)], symbol] = n
        suffix = np.array([self._longest(j - 1, code) for j, code in names])
        self.logs = np.concatenate(
            [
                _distributions(np.arange(at, min(at + 2048, len(names))), counts, suffix)
                for at in range(0, len(names), 2048)
            ]
        )
        # a symbol leads to the context it lengthens, or to where the next shorter one leads
        self.next = np.zeros((len(names), SYMBOLS), np.int32)
        parent = np.array([states.get((j - 1, code >> BITS), -1) for j, code in names])
        last = np.array([code & ((1 << BITS) - 1) for _, code in names])
        for j in range(order + 1):
            own = np.flatnonzero(length == j)
            if j:
                self.next[own] = self.next[suffix[own]]
            longer = np.flatnonzero((length == j + 1) & (parent >= 0))
            self.next[parent[longer], last[longer]] = longer
        self.start = self._longest(order, sum(END << (BITS * j) for j in range(order)))
        self.next[:, END] = self.start

    def _longest(self, length: int, code: int) -> int:
        """The state of the longest kept suffix of up to `length` symbols."""
        for j in range(length, 0, -1):
            state = self.states.get((j, code & ((1 << (BITS * j)) - 1)))
            if state is not None:
                return state
        return 0

    def score(self, texts: list[bytes], stretch: int = STRETCH) -> np.ndarray:
        """log10 probability of each text with its end."""
        flat, lengths = symbols(texts)
        if not len(flat):
            return np.zeros(0)
        parts = -(-len(flat) // stretch)
        padded = np.full(parts * stretch + self.order, END, np.int16)
        padded[self.order : self.order + len(flat)] = flat
        grid = np.lib.stride_tricks.sliding_window_view(padded, stretch + self.order)[::stretch]
        grid = np.ascontiguousarray(grid.T)
        state = np.full(parts, 0, np.int64)
        logs, following = self.logs.reshape(-1), self.next.reshape(-1)
        out = np.zeros((stretch, parts), np.float32)
        for t in range(stretch + self.order):
            at = state * SYMBOLS + grid[t].astype(np.int64)
            if t >= self.order:
                out[t - self.order] = logs[at]
            state = following[at].astype(np.int64)
        values = out.T.reshape(-1)[: len(flat)].astype(np.float64)
        return np.add.reduceat(values, np.cumsum(lengths) - lengths)


def _lowered(table) -> list[bytes]:
    return [(t or "").encode().lower() for t in table.column("text").to_pylist()]


def _block_counts(order: int):
    """Distinct words and n-grams of a block and how often its training documents have them."""

    def run(table: pa.Table) -> pa.Table:
        vocab.release()
        seen: Counter = Counter()
        codes, counts, held = [], [], 0
        for batch in table.to_batches(max_chunksize=256):
            out = batch.column("held_out").to_pylist()
            texts = _lowered(batch)
            for text, o in zip(texts, out, strict=True):
                if o:
                    seen.update(dict.fromkeys(text.split(), 0))
                else:
                    seen.update(text.split())
            for learned in (True, False):
                chosen = [t for t, o in zip(texts, out, strict=True) if bool(o) != learned]
                for start, end in vocab.steps(chosen, STEP_CHARS):
                    for _, grams in coded(chosen[start:end], order):
                        code, times = np.unique(grams, return_counts=True)
                        codes.append(code)
                        counts.append(times * learned)
                        held += len(code)
            if held > MERGE_AT:
                code, times = _merged(codes, counts)
                codes, counts, held = [code], [times], 0
        code, times = _merged(codes, counts)
        block = table.column("block")[0].as_py()
        words = len(seen)
        return pa.table(
            {
                "block": pa.array([block] * (words + len(code)), pa.int64()),
                "word": pa.concat_arrays([pa.array(list(seen), pa.binary()), pa.nulls(len(code), pa.binary())]),
                "gram": pa.concat_arrays([pa.nulls(words, pa.int64()), pa.array(code, pa.int64())]),
                "n": pa.array(np.concatenate([np.fromiter(seen.values(), np.int64, words), times])),
            }
        )

    return run


def gram_logs(grams: DataFrame, order: int = ORDER, max_contexts: int | None = None) -> DataFrame:
    """(gram, log): log10 of the probability of each n-gram's last symbol after its other ones.

    `grams` has each n-gram that is asked for once, with its count n, 0 where it was not learned.
    What a context has seen, its suffix has seen too, so the excluded symbols of a context are
    those of the next longer one, and each level needs the level below only: `log` of a context
    where the walk begins, and `rest` of the shorter ones after what the context excludes.
    """
    levels = [cut_lineage(grams.select("gram", "n"))]
    for k in range(order - 1, -1, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k + 1))) - 1))
        levels.append(cut_lineage(levels[-1].groupBy(suffix.alias("gram")).agg(F.sum("n").alias("n"))))
    levels.reverse()
    context = F.shiftright("gram", BITS).alias("context")
    kept = None
    if max_contexts is not None:
        totals = [
            level.groupBy(F.lit(k).alias("k"), context).agg(F.sum("n").alias("total"))
            for k, level in enumerate(levels)
        ]
        totals = reduce(DataFrame.unionByName, totals).filter("total > 0")
        # a suffix is at least as frequent and shorter, so kept contexts have kept suffixes
        kept = cut_lineage(totals.orderBy(F.desc("total"), "k", "context").limit(max_contexts))
    of_context = Window.partitionBy("context")
    below = None
    for k, level in enumerate(levels):
        rows = level.select("gram", "n", context)
        if kept is not None:
            chosen = kept.filter(F.col("k") == k).select("context", F.lit(True).alias("kept"))
            rows = rows.join(chosen, "context", "left")
            rows = rows.withColumn("n", F.when(F.col("kept"), F.col("n")).otherwise(0))
        if below is None:
            rows = rows.withColumns({c: F.lit(0) for c in ("n0", "total0", "kinds0")})
            rows = rows.withColumns({"log0": F.lit(-math.log10(SYMBOLS)), "rest0": F.lit(0.0)})
        else:
            shorter = below.select(
                F.col("gram").alias("suffix"),
                *(F.col(c).alias(f"{c}0") for c in ("n", "total", "kinds", "log", "rest")),
            )
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1)))
            rows = rows.join(shorter, "suffix")
        rows = rows.select(
            "*", F.sum("n").over(of_context).alias("total"),
            F.count_if(F.col("n") > 0).over(of_context).alias("kinds"),
            F.sum(F.when(F.col("n") > 0, F.col("n0")).otherwise(0)).over(of_context).alias("gone"),
        )
        n, total, kinds = F.col("n"), F.col("total"), F.col("kinds")
        if below is None:
            rest = F.when(kinds < SYMBOLS, -F.log10(SYMBOLS - kinds)).otherwise(0.0)
        else:
            # the shorter context without the symbols of this one
            new = F.col("kinds0") - kinds
            open_ = F.col("kinds0") < SYMBOLS  # else its seen symbols share everything
            left = F.col("total0") - F.col("gone") + F.when(open_, new).otherwise(0)
            escape = F.when((new > 0) & open_, F.log10(new) - F.log10(left)).otherwise(0.0)
            rest = F.when(F.col("n0") > 0, F.log10("n0") - F.log10(left)).otherwise(escape + F.col("rest0"))
        whole = total + F.when(kinds < SYMBOLS, kinds).otherwise(0)
        log = F.when(total == 0, F.col("log0")).when(n > 0, F.log10(n) - F.log10(whole)).otherwise(
            F.log10(kinds) - F.log10(whole) + F.col("rest")
        )
        rows = rows.withColumn("rest", rest).withColumn("log", log)
        below = cut_lineage(rows.select("gram", "n", "total", "kinds", "log", "rest"))
    return below.select("gram", "log")


def _scorer(order: int, id_type: pa.DataType, shared=None):
    """Scores of a block; `shared` is a broadcast of all n-grams in order and their logs, if they are few."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        vocab.release()
        words = found.filter(pc.is_valid(found["word"]))
        if shared is not None:
            gram, code_logs = np.frombuffer(shared.value[0], np.int64), np.frombuffer(shared.value[1])
        else:
            grams = found.filter(pc.is_valid(found["gram"]))
            gram = grams.column("gram").to_numpy()
            by_code = np.argsort(gram)
            gram, code_logs = gram[by_code], grams.column("log").to_numpy()[by_code]
        counts = words.column("count").to_numpy()
        index = dict(zip(words.column("word").to_pylist(), range(len(counts)), strict=True))
        logs = np.log10(counts + 1.0)
        texts = _lowered(docs)
        sums, known = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        tokens, scores = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for start, end in vocab.steps(texts, STEP_CHARS):
            lists = [t.split() for t in texts[start:end]]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            total = int(lengths.sum())
            at = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int64, total)
            ends = np.cumsum(lengths)
            met = np.concatenate([[0], np.cumsum(counts[at] > 0)])
            full = np.flatnonzero(lengths)
            if len(full):
                sums[start + full] = np.add.reduceat(logs[at], (ends - lengths)[full])
            known[start:end] = met[ends] - met[ends - lengths]
            tokens[start:end] = lengths + 1
            ends = np.cumsum(np.fromiter(map(len, texts[start:end]), np.int64, end - start) + 1)
            for at, codes in coded(texts[start:end], order):
                values = code_logs[np.searchsorted(gram, codes)]
                owner = np.searchsorted(ends, np.arange(at, at + len(codes)), side="right")
                scores[start:end] += np.bincount(owner, values, minlength=end - start)
        first = words.column("first").to_numpy(zero_copy_only=False)
        held = docs.column("held_out").to_pylist()
        n = len(texts)
        return pa.table(
            {
                "doc_id": pa.concat_arrays(
                    [docs.column("doc_id").combine_chunks(), pa.nulls(1, id_type)]
                ),
                "held_out": pa.array([*held, None], pa.bool_()),
                "n_tokens": pa.array([*tokens.tolist(), int(words.column("n").to_numpy().sum())], pa.int64()),
                "n_known": pa.array([*known.tolist(), int(((counts > 0) & first).sum())], pa.int64()),
                "logs": pa.array([*sums.tolist(), float(held.count(False))], pa.float64()),
                "score": pa.array([*scores.tolist(), 0.0], pa.float64()),
                "summary": pa.array([False] * n + [True], pa.bool_()),
            }
        )

    return run


def score(
    docs: DataFrame, held_out, path: str, order: int = ORDER, max_contexts: int | None = None,
    block_bytes: int = BLOCK_BYTES, held_logs: int = HELD_LOGS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Both models learn from the documents that are not `held_out`, in all contexts unless the caller
    gives `max_contexts`. Up to `held_logs` code lengths of n-grams are broadcast, more return to the
    blocks by a join. Counts and scores of the blocks are written under `path`, a new folder
    that executors share, the scores together with each block's share of the totals.
    """
    spark = docs.sparkSession
    vocab.small_batches(spark)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    counts = rows.groupBy("block").applyInArrow(
        _block_counts(order), "block long, word binary, gram long, n long"
    )
    counts.write.mode("errorifexists").parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    of_word = Window.partitionBy("word")
    words = counts.filter(F.col("word").isNotNull()).select(
        "block", "word", "n", F.sum("n").over(of_word).alias("count"),
        (F.min("block").over(of_word) == F.col("block")).alias("first"),
    )
    grams = counts.filter(F.col("gram").isNotNull()).select("block", "gram", "n")
    logs = gram_logs(grams.groupBy("gram").agg(F.sum("n").alias("n")), order, max_contexts)
    found, shared = words, None
    if logs.count() <= held_logs:
        few = logs.toArrow()  # at most held_logs rows
        gram = few.column("gram").to_numpy()
        by_code = np.argsort(gram)
        shared = spark.sparkContext.broadcast(
            (gram[by_code].tobytes(), few.column("log").to_numpy()[by_code].tobytes())
        )
    else:
        found = words.unionByName(
            grams.select("block", "gram").join(logs, "gram"), allowMissingColumns=True
        )
    scored = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _scorer(order, id_type, shared),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double,"
        " summary boolean",
    )
    scored.write.mode("errorifexists").parquet(f"{path}/scores")
    scored = spark.read.parquet(f"{path}/scores")
    totals = scored.filter("summary").agg(
        F.sum("n_tokens").alias("words"), F.sum("n_known").alias("kinds"), F.sum("logs").alias("docs")
    ).first()
    ends = int(totals["docs"] or 0)
    tokens = (totals["words"] or 0) + ends
    kinds = (totals["kinds"] or 0) + (ends > 0)
    base = F.col("logs") + math.log10(ends + 1) - F.col("n_tokens") * math.log10(tokens + kinds + 1)
    return scored.filter("not summary").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
