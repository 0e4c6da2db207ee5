"""Token counts with a whole-token shortcut.

Before any text is read, the strings of the vocabulary that the tokenizer encodes as exactly one
token, when they stand alone, are proved by encoding each of them. A text is split into
pre-tokens; those among the proved strings count one, and only the rest is merged. Counts of
words are kept for the rest of a worker's tasks, up to a fixed number of words.

Defined cases: null text counts as empty, with 0 tokens; texts that hold a special string or
white space beyond ASCII are given whole to the library, as their pre-tokens may reach across
words; very long texts are handled in pieces cut before white space; repeated rows are counted
each; empty tables give empty results. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import vocab

#: letters that every Unicode version classes alike; other words go to the library
_PLAIN = regex.compile(r"[\x00-\x7fÀ-ɏ]*")
_PRE = regex.compile(PATTERN)


def whole_tokens(tokenizer) -> frozenset[str]:
    """Strings that the tokenizer encodes as the one token of that string."""
    ids = sorted(tokenizer.get_vocab().values())
    texts = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    special = set(vocab.added_tokens(tokenizer))
    pairs = [
        (i, t) for i, t in zip(ids, texts, strict=True) if t and "�" not in t and t not in special
    ]
    encoded = tokenizer.encode_batch([t for _, t in pairs], add_special_tokens=False)
    return frozenset(t for (i, t), e in zip(pairs, encoded, strict=True) if e.ids == [i])


class Counter:
    def __init__(self, content: bytes) -> None:
        self.tokenizer = vocab.tokenizer(content)
        self.special = vocab.added_tokens(self.tokenizer)
        self.whole = whole_tokens(self.tokenizer)
        self.merged: dict[str, int] = {}
        self.memo: dict[str, int] = {}

    def library(self, texts: list[str]) -> list[int]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [len(e) for e in got]

    def learn(self, words: list[str]) -> dict[str, int]:
        """Tokens of words that were not met before."""
        if len(self.memo) + len(self.merged) + len(words) > vocab.MEMO_WORDS:
            self.memo.clear()
            self.merged.clear()
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        other = [w for w in words if not _PLAIN.fullmatch(w)]
        split = [[p for p in _PRE.findall(w) if p not in self.whole] for w in plain]
        rest = list(set(chain.from_iterable(split)).difference(self.merged))
        self.merged.update(zip(rest, self.library(rest), strict=True))
        merged = self.merged
        counts = {
            w: sum(1 for _ in _PRE.finditer(w)) - len(s) + sum(map(merged.__getitem__, s))
            for w, s in zip(plain, split, strict=True)
        }
        counts.update(zip(other, self.library(other), strict=True))
        return counts

    def count_words(self, words: list[str]) -> Iterator[int]:
        new = set(words).difference(self.memo)
        extra = {}
        if new:
            found = self.learn(list(new))
            extra = {w: n for w, n in found.items() if len(w) > vocab.MEMO_CHARS}
            self.memo.update((w, n) for w, n in found.items() if w not in extra)
            if missing := set(words).difference(self.memo, extra):  # the memo was emptied
                self.memo.update(self.learn(list(missing)))
        if extra:
            return (extra[w] if w in extra else self.memo[w] for w in words)
        return map(self.memo.__getitem__, words)

    def count(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        for start, end in vocab.steps(texts):
            if end - start == 1:
                counts[start] = self.count_long(texts[start])
                continue
            whole = [i for i in range(start, end) if vocab.whole_only(texts[i], self.special)]
            if whole:
                counts[whole] = self.library([texts[i] for i in whole])
            left = [i for i in range(start, end) if i not in set(whole)] if whole else range(start, end)
            words = [vocab.chunks(texts[i]) for i in left]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            flat = list(chain.from_iterable(words))
            sums = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(np.fromiter(self.count_words(flat), np.int64, len(flat)), out=sums[1:])
            ends = np.cumsum(lengths)
            counts[list(left)] = sums[ends] - sums[ends - lengths]
        return counts

    def count_long(self, text: str) -> int:
        if vocab.whole_only(text, self.special):
            return self.library([text])[0]
        return sum(sum(self.count_words(vocab.chunks(p))) for p in vocab.pieces(text))


def count_tokens(docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every document."""
    shared = vocab.shipped(docs.sparkSession, file)

    def run(batches):
        counter = vocab.once(shared, Counter)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counter.count(texts))],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
