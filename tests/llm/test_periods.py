"""Periodic runs against a brute-force version."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from loomwork.llm import periods
from tests.llm.data import frame, messy


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    """All runs by the definition; quadratic."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            s = w[a : i + q]
            if len(s) >= max(6, 4 * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.add((a, len(s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rnd: random.Random) -> list[int]:
    """Numbers with nested repetitions, also of periods that begin with long runs of one number."""
    k = rnd.choice([1, 2, 2, 3, 5, 20])
    w = [rnd.randrange(k) for _ in range(rnd.randint(0, 300))]
    for _ in range(rnd.randint(0, 4)):
        p = [rnd.randrange(k) for _ in range(rnd.randint(1, 60))]
        if rnd.random() < 0.5:
            p = [0] * rnd.randint(1, 40) + p[: rnd.randint(1, 5)]
        if rnd.random() < 0.3:
            p = p[:3] * rnd.randint(1, 12) + p[:2]
        at = rnd.randint(0, len(w))
        w[at:at] = p * rnd.randint(2, 7) + p[: rnd.randint(0, len(p))]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_of_nested_repetitions(seed):
    rnd = random.Random(seed)
    for _ in range(25):
        texts = [periodic(rnd) for _ in range(rnd.randint(1, 5))]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        ids = np.concatenate([np.array([*t, -1 - i], np.int64) for i, t in enumerate(texts)])
        want = [
            (int(s) + a, n, q)
            for s, t in zip(starts, texts, strict=False) for a, n, q in brute_runs(t)
        ]
        assert periods.runs_of(ids, starts) == sorted(want, key=lambda r: (r[0], r[2]))


def test_long_periods_and_fibonacci_words():
    rnd = random.Random(1)
    period = [rnd.randrange(1000) for _ in range(3000)]
    w = [5] * 100 + period * 4 + period[:17] + [7, 8] * 50
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for text in (w, b):
        ids = np.array([*text, -1], np.int64)
        assert periods.runs_of(ids, np.array([0, len(ids)])) == brute_runs(text)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    first = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    milli = 1000 * first[1] // first[2] if runs else None
    return (
        doc_id, len(runs), *first, milli, hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


COLUMNS = (
    "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
    "collapsed_sha256",
)


@pytest.mark.parametrize("clash", [False, True])
def test_digests_of_awkward_rows(spark, clash):
    rnd = random.Random(4)
    rows = messy()
    for i in range(200, 320):
        text = " ".join(f"w{x}" for x in periodic(rnd))
        rows.append((i, rnd.choice(["", "\n ", "\x85"]) + text, None, None, None))
    got = periods.digests(frame(spark, rows, clash)).select(*COLUMNS).collect()
    want = [expected(r[0], r[1]) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(r["n_runs"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_collapsed_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "d")], "doc_id long, text string")
    (row,) = periods.find_runs(docs).collect()
    assert row["collapsed"] == "x a b c d"
    assert [tuple(r) for r in row["runs"]] == [(1, 15, 3)]
    assert periods.digests(docs.limit(0)).count() == 0
