"""Tokenizer files on executors, and texts in pieces that tokenize independently."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import SparkSession

#: words kept in a task's memory at most, and the longest word that is kept
MEMO_WORDS = 500_000
MEMO_CHARS = 64
#: rows of an Arrow batch
BATCH_ROWS = 1_000
#: characters of text handled at a time
STEP_CHARS = 2_000_000

_UNUSUAL_SPACE = re.compile(r"[^\S \n\t\r]")
_CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_CUT = re.compile(r"(?<=[^ \n\t\r])(?=[ \n\t\r])")

_loaded: dict = {}


def shipped(spark: SparkSession, name: str):
    """A tokenizer file as a broadcast; its size is that of a vocabulary, not of data."""
    small_batches(spark)
    path = name if os.path.sep in name else public_tokenizers.path(name)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def release() -> None:
    """Give back what this worker holds, before work that needs memory of its own."""
    if _loaded:
        _loaded.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts reach Python few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def held(build, content: bytes | None = None):
    """build() or build(content), kept by this Python worker until something else is asked for.

    Workers are reused by later tasks of other operators; one thing at a time bounds their memory.
    """
    if _loaded.get("of") != (build, content):
        release()  # the old one goes before the new one is made
        _loaded["it"] = build() if content is None else build(content)
        _loaded["of"] = (build, content)
    return _loaded["it"]


def once(shared, build):
    """build(bytes of a broadcast), kept for the tasks of this Python worker."""
    return held(build, shared.value)


def tokenizer(content: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content.decode())


def added_tokens(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def whole_only(text: str, special: list[str]) -> bool:
    """True for texts in which special strings or unusual spaces may reach across words."""
    return any(s in text for s in special) or _UNUSUAL_SPACE.search(text) is not None


def chunks(text: str) -> list[str]:
    """Words with the white space before them; byte-level pre-tokens never cross their borders."""
    return _CHUNK.findall(text)


def pieces(text: str, size: int = STEP_CHARS) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut before white space."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def steps(texts: list[str], size: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` characters each."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= size:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Memo:
    """Ids of words, looked up many at a time; new ones are learned in one call.

    `encode(list of words)` gives all their ids, one word after the other, and the number of ids
    of each word. When MEMO_WORDS are known, the half that was looked up least goes. Words above
    MEMO_CHARS are encoded where they stand and not remembered.
    """

    def __init__(self, encode) -> None:
        self.encode = encode
        self.index: dict = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.asked = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _grown(self, array, need):
        return array if need <= len(array) else np.resize(array, max(need, 2 * len(array)))

    def _drop_cold(self) -> None:
        """Keep the half of the words that was asked for most."""
        n = len(self.index)
        kept = np.sort(np.argsort(-self.asked[:n], kind="stable")[: MEMO_WORDS // 2])
        words = list(self.index)
        flat = self.gather(kept)
        lengths = self.lengths[kept]
        self.index = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.ids[: len(flat)], self.used = flat, len(flat)
        self.starts[: len(kept)] = np.cumsum(lengths) - lengths
        self.lengths[: len(kept)] = lengths
        self.asked[: len(kept)] = self.asked[kept] // 2

    def learn(self, words) -> None:
        words = list(words)
        n = len(self.index)
        got, lengths = self.encode(words)
        need = n + len(words)
        self.ids = self._grown(self.ids, self.used + len(got))
        self.starts = self._grown(self.starts, need)
        self.lengths = self._grown(self.lengths, need)
        self.asked = self._grown(self.asked, need)
        self.ids[self.used : self.used + len(got)] = got
        self.starts[n:need] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n:need] = lengths
        self.asked[n:need] = 0
        self.used += len(got)
        self.index.update(zip(words, range(n, need), strict=True))

    def _found(self, words: list) -> tuple[np.ndarray, list[int], dict]:
        """Positions of the words, -1 for unknown ones; where these are; and each of these once."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        return at, missing, dict.fromkeys(map(words.__getitem__, missing))

    def look_up(self, words: list) -> np.ndarray:
        """Positions of the words in `lengths` and `starts`; good until the next look-up."""
        at, missing, new = self._found(words)
        if len(self.index) + len(new) > MEMO_WORDS:
            self._drop_cold()
            at, missing, new = self._found(words)
        if new:
            self.learn(new)
            again = map(words.__getitem__, missing)
            at[missing] = np.fromiter(map(self.index.__getitem__, again), np.int64, len(missing))
        self.asked[at] += 1
        return at

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of the words at these positions, one after the other."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[at] - (ends - lengths), lengths)
        return self.ids[shift + np.arange(total)]

    def encoded(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and the number of ids of each."""
        if max(map(len, words), default=0) <= MEMO_CHARS:
            at = self.look_up(words)
            return self.gather(at), self.lengths[at]
        long = [i for i, w in enumerate(words) if len(w) > MEMO_CHARS]
        flat, lengths, start = [], [], 0
        own, sizes = self.encode([words[i] for i in long])
        ends = np.cumsum(sizes)
        for k, i in enumerate(long):
            at = self.look_up(words[start:i])
            flat += [self.gather(at), own[ends[k] - sizes[k] : ends[k]]]
            lengths += [self.lengths[at], sizes[k : k + 1]]
            start = i + 1
        at = self.look_up(words[start:])
        return np.concatenate([*flat, self.gather(at)]), np.concatenate([*lengths, self.lengths[at]])


def flattened(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and their lengths."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths


class Vectors:
    """One vector for each word, looked up and summed by text; `learn(list of words)` makes new ones."""

    def __init__(self, learn, width: int) -> None:
        self.make, self.width = learn, width
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.rows = np.zeros((1 << 12, self.width))

    def learn(self, words) -> None:
        words = list(words)
        if len(self.index) + len(words) > MEMO_WORDS:
            self.clear()
        n, need = len(self.index), len(self.index) + len(words)
        if need > len(self.rows):
            grown = np.zeros((max(need, 2 * len(self.rows)), self.width))
            grown[:n] = self.rows[:n]
            self.rows = grown
        if words:
            self.rows[n:need] = self.make(words)
        self.index.update(zip(words, range(n, need), strict=True))

    def of(self, words: list) -> np.ndarray:
        try:
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        except KeyError:
            distinct = set(words)
            new = distinct.difference(self.index)
            self.learn(distinct if len(self.index) + len(new) > MEMO_WORDS else new)
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.rows[at]

    def sums(self, lists: list[list]) -> np.ndarray:
        """The sum of vectors of each list."""
        out = np.zeros((len(lists), self.width))
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        full = np.flatnonzero(lengths)
        if len(full):
            starts = np.cumsum(lengths[full]) - lengths[full]
            flat = self.of(list(chain.from_iterable(lists)))
            out[full] = np.add.reduceat(flat, starts, axis=0)
        return out
