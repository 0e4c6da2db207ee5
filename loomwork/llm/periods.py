"""Periodic runs of words, by string synchronising sets.

A run is a stretch of words with smallest period q and at least max(LEAST_WORDS, LEAST_POWER * q)
words that cannot be made longer with that period. Periods below `SMALL` are compared word by
word. For longer ones, each dyadic scale t looks for periods from t to 2t - 1: a position is
synchronising if the hash of its t words, or of the t words that start t later, is the least of
the window of t + 1 starts. That choice depends on 2t words only, so a run repeats it every q
words, and two neighbouring positions with equal 2t words propose their distance as a period.
Starts whose t words lie in a run of period t/4 or less are left out of the windows, which keeps
the set sparse; the runs that this omits have small periods, and the smaller scales found them
before. Hashes only propose: each period is measured on the words themselves.

Why nothing is missed: a run with period q from t to 2t - 1 has 4q words, so all starts of one
period see their 3t words inside it. If each of these lay in a region of period t/4, q would not be
the smallest period; so one start is synchronising, and so is the start q words on. Equal contexts
of 2t > q words less than q apart would again mean a smaller period.

Texts are spread by Spark; a task holds the words of about `vocab.STEP_CHARS` characters, or of one
longer text. A scale keeps only texts in which the scale before found equal contexts.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; null ids
are kept as they are; equal words are equal bytes of UTF-8; runs are listed by start, then period;
repeated rows are returned each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm import vocab
from loomwork.llm.common import let
from loomwork.llm.quality import words

LEAST_WORDS = 6
LEAST_POWER = 4
#: periods below this are compared directly; a power of two
SMALL = 8

RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_TOP = np.uint64(2**64 - 1)


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_POWER * period)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _later(x: np.ndarray, by: int, fill: int) -> np.ndarray:
    """x[i + by], and `fill` beyond the end."""
    out = np.full_like(x, fill)
    if by < len(x):
        out[:-by] = x[by:]
    return out


def _doubled(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of 2 * length words from hashes of `length` words."""
    return _mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + _later(hashes, length, 0))


def _equal_length(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal leading elements."""
    n, at, size = min(len(a), len(b)), 0, 64
    while at < n:
        differs = a[at : min(n, at + size)] != b[at : min(n, at + size)]
        if differs.any():
            return at + int(differs.argmax())
        at, size = at + size, 2 * size
    return n


def small_runs(ids: np.ndarray) -> dict[tuple[int, int], int]:
    """(start, length) -> period of all runs with a period below SMALL."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, SMALL):
        if len(ids) <= q:
            break
        edges = np.flatnonzero(np.diff(ids[q:] == ids[:-q], prepend=False, append=False))
        first, last = edges[::2], edges[1::2]
        long = last - first >= least_length(q) - q
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            # the same stretch with a smaller period comes first
            found.setdefault((a, b - a + q), q)
    return found


def _highly_periodic(n: int, scale: int, found: dict) -> np.ndarray:
    """True for starts whose `scale` words lie in a run of period scale / 4 or less."""
    change = np.zeros(n + 1, np.int64)
    for (start, length), q in found.items():
        if LEAST_POWER * q <= scale <= length:
            change[start] += 1
            change[start + length - scale + 1] -= 1
    return np.cumsum(change[:n]) > 0


def _synchronising(hashes: np.ndarray, scale: int, omitted: np.ndarray) -> np.ndarray:
    """Positions whose window of scale + 1 starts has its least hash at either end."""
    named = np.where(omitted, _TOP, hashes)
    least, width = named, 1
    while width < scale:
        least = np.minimum(least, _later(least, width, _TOP))
        width *= 2
    least = np.minimum(least, _later(least, 1, _TOP))
    at_end = (least == named) | (least == _later(named, scale, _TOP))
    return np.flatnonzero(at_end & (least != _TOP))


def _scale_runs(ids, hashes, contexts, scale, starts, found) -> np.ndarray:
    """Add runs with periods from scale to 2 * scale - 1; numbers of texts with equal contexts."""
    chosen = _synchronising(hashes, scale, _highly_periodic(len(ids), scale, found))
    text = np.searchsorted(starts, chosen, "right") - 1
    inside = chosen + 2 * scale < starts[text + 1]
    chosen, text = chosen[inside], text[inside]
    keys = contexts[chosen] + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    left, right = chosen[order[same]], chosen[order[same + 1]]
    distance = right - left
    near = (distance >= scale) & (distance < 2 * scale)
    proposed = np.lexsort((left[near], distance[near]))
    last_period, last_end = 0, 0
    for at, q in zip(left[near][proposed].tolist(), distance[near][proposed].tolist(), strict=True):
        if q == last_period and at < last_end:
            continue
        before = _equal_length(ids[:at][::-1], ids[: at + q][::-1])
        after = _equal_length(ids[at:], ids[at + q :])
        last_period, last_end = q, at + after
        if before + after + q >= least_length(q):
            found.setdefault((at - before, before + after + q), q)
    return np.unique(text[order[same]])


def runs_of(ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs.

    `ids` holds the texts one after the other, each followed by an id of its own, and `starts` the
    position of each text and the end of all.
    """
    found = small_runs(ids)
    # for each scale: ids, where texts start, and by how much a text was moved
    moved, scale = np.zeros(len(starts) - 1, np.int64), SMALL
    hashes = None
    alive = np.arange(len(starts) - 1)
    runs = [(a, n, q) for (a, n), q in found.items()]
    while len(alive):
        sizes = np.diff(starts)[alive]
        alive = alive[sizes > LEAST_POWER * scale]
        if not len(alive):
            break
        if hashes is None or len(alive) < len(starts) - 1:
            sizes = np.diff(starts)[alive]
            new = np.concatenate([[0], np.cumsum(sizes)])
            shift = starts[alive] - new[:-1]
            take = np.arange(new[-1]) + np.repeat(shift, sizes)
            inside = np.searchsorted(starts, [a for a, _ in found], "right") - 1
            place = np.full(len(starts), -1)
            place[alive] = np.arange(len(alive))
            found = {
                (a - int(shift[place[t]]), n): q
                for ((a, n), q), t in zip(found.items(), inside.tolist(), strict=True)
                if place[t] >= 0
            }
            ids, starts, moved = ids[take], new, moved[alive] + shift
            if hashes is None:
                hashes, t = _mixed(ids.astype(np.uint64)), 1
                while t < scale:
                    hashes, t = _doubled(hashes, t), 2 * t
            else:
                hashes = hashes[take]
        contexts = _doubled(hashes, scale)
        known = len(found)
        alive = _scale_runs(ids, hashes, contexts, scale, starts, found)
        new_runs = list(found.items())[known:]
        at = np.searchsorted(starts, [a for (a, _), _ in new_runs], "right") - 1
        runs.extend(
            (a + int(moved[t]), n, q)
            for ((a, n), q), t in zip(new_runs, at.tolist(), strict=True)
        )
        hashes, scale = contexts, 2 * scale
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _analyse(texts: list[bytes | None]) -> list[pa.Array]:
    """n_words, runs and collapsed text of each text."""
    lists = [(t or b"").split() for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = list(chain.from_iterable((*w, b"") for w in lists))
    index = dict(zip(dict.fromkeys(flat), range(len(flat)), strict=False))
    ids = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    ids[starts[1:] - 1] = -1 - np.arange(len(lists))  # an end differs from all else
    runs = runs_of(ids, starts)
    per_text = np.searchsorted(starts, [a for a, _, _ in runs], "right") - 1
    change = np.zeros(len(flat) + 1, np.int64)
    for a, n, q in runs:
        change[a + q] += 1
        change[a + n] -= 1
    dropped = np.cumsum(change[:-1]) > 0
    collapsed = []
    hit = set(per_text.tolist())
    for t, found in enumerate(lists):
        if t in hit:
            keep = ~dropped[starts[t] : starts[t] + len(found)]
            found = [found[i] for i in np.flatnonzero(keep).tolist()]
        collapsed.append(b" ".join(found))
    offsets = np.searchsorted(per_text, np.arange(len(lists) + 1), "left").astype(np.int32)
    values = np.array(runs, np.int64).reshape(-1, 3)
    values[:, 0] -= starts[per_text]
    struct = pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(3)], fields=list(_RUN))
    return [
        pa.array(sizes),
        pa.ListArray.from_arrays(pa.array(offsets), struct),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of every document.

    The collapsed text holds the words that no run has after its first period, joined by a space.
    """
    vocab.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        vocab.release()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in vocab.steps([t or b"" for t in texts]):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *_analyse(texts[a:b])],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string"
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the ids get a period planted behind their first words.

    With h = crc32 of the decimal id and g = h div 10, texts of ids with h % 10 = 0 repeat from
    word a = g % n on with period 1 + (n - a) div (3 + g % 8). Null ids are left alone.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(
            F.struct(a.alias("a"), p.alias("p")),
            lambda s: F.concat_ws(
                " ",
                F.transform(
                    F.sequence(F.lit(0), F.size(w) - 1),
                    lambda i: F.get(
                        w, F.when(i >= s["a"], s["a"] + (i - s["a"]) % s["p"]).otherwise(i).cast("int")
                    ),
                ),
            ),
        )

    text = F.coalesce("text", F.lit(""))
    chosen = (h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(chosen, let(words(text), repeated)).otherwise(text).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Counts, the longest run and checksums of `find_runs` over documents with planted periods."""
    runs = F.col("runs")
    longest = F.array_max(
        F.transform(runs, lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("a"), (-r["period"]).alias("q")))
    )
    lines = F.transform(
        runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    length, start, period = longest["n"], -longest["a"], -longest["q"]
    return find_runs(planted(docs)).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
