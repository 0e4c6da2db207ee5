"""Benchmark decontamination by BM25 retrieval with block-max pruning.

Test items are the indexed side: each term has postings (item, impact) and, for each block of
items with similar self scores, the largest impact. Every passage of every document is a query:
overlapping windows that hold any item whole. A passage retrieves an item when its score is at
least `SHARE` of the item's score for its own text, all of it for an item under `EXACT_BELOW`
words. Bounds skip work without losing a result:
the sum of a passage's largest impacts must reach the least threshold of all items, then the sum
of its block maxima that of a block, and only items of blocks that pass are scored. Retrieved
pairs are verified on word order: five-word runs of the question and words of the answer; short
items on their whole word sequence, which must occur as it stands.

The index is built on the driver from the items, in parts of at most `PART_ITEMS` items, so what
is broadcast is bounded; documents are scanned once for each part. Number, lengths and document
frequencies are those of all items, so results are the same however many parts there are.

Defined cases: words are runs of letters and digits in lower case; the last sentence of an item
is its answer and the rest its question, an item of one sentence is cut in the middle; null and
empty texts and texts without a word match nothing; items with equal texts each match; repeated documents match each; very long texts
are queries as a whole; empty tables give empty results; further columns are left alone.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import vocab

K1, B = 1.2, 0.75
#: share of an item's own score that retrieves it; shares of its runs and words that prove it
SHARE, QUESTION, ANSWER = 0.5, 0.5, 0.6
RUN = 5
#: words an item needs to match anything; items of fewer words than this match as a whole only
MIN_WORDS = 1
EXACT_BELOW = 8
BLOCK_ITEMS = 16
MOST_BLOCKS = 64
PART_ITEMS = 5_000
LEAST_STRIDE = 64

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    sentences = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(sentences) > 1:
        return list(chain.from_iterable(sentences[:-1])), sentences[-1]
    words = sentences[0] if sentences else []
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def statistics(items: list[tuple]) -> tuple[int, float, Counter, int]:
    """Number of items, their mean length, items by word, and the longest item's words."""
    df: Counter = Counter()
    sizes = []
    for _, text in items:
        words = [*chain.from_iterable(split_item(text))]
        sizes.append(len(words))
        df.update(set(words))
    return len(items), sum(sizes) / max(1, len(items)), df, max(sizes, default=0)


class Index:
    """Impacts, block maxima and thresholds of test items, which may be a part of all items."""

    def __init__(self, content: bytes) -> None:
        loaded = pickle.loads(content)
        items, (total, mean, frequency, longest) = (
            loaded if isinstance(loaded, tuple) else (loaded, statistics(loaded))
        )
        split = [split_item(text) for _, text in items]
        texts = [q + a for q, a in split]
        self.terms: dict[str, int] = {}
        for words in texts:
            for w in words:
                self.terms.setdefault(w, len(self.terms))
        n = len(texts)
        item, term, times = [], [], []
        for i, words in enumerate(texts):
            ids, counts = np.unique([self.terms[w] for w in words], return_counts=True)
            item.append(np.full(len(ids), i))
            term.append(ids)
            times.append(counts)
        item, term, tf = (np.concatenate(x) for x in (item, term, times))
        df = np.array([frequency[w] for w in self.terms])
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        size = np.array([len(w) for w in texts])
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean))
        own = np.bincount(item, impact, minlength=n)
        # a passage with the whole item scores as much as the item, but for rounding
        needed = own * np.where(size < EXACT_BELOW, 1 - 1e-6, SHARE)
        # items in order of what they need: a block's items have similar thresholds
        rank = np.argsort(needed, kind="stable")
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        item = place[item]
        self.needed = needed[rank]
        per_block = max(BLOCK_ITEMS, -(-n // MOST_BLOCKS))
        self.block_of = np.arange(n) // per_block
        blocks = int(self.block_of[-1]) + 1
        self.block_needed = np.minimum.reduceat(self.needed, np.arange(0, n, per_block))
        self.most = np.zeros((len(self.terms), blocks), np.float32)
        np.maximum.at(self.most, (term, self.block_of[item]), impact.astype(np.float32))
        self.largest = self.most.max(axis=1).astype(np.float64)
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.terms)))])
        self.ids = [items[i][0] for i in rank]
        self.question, self.answer, self.exact = [], [], []
        for i in rank:
            q, a = ([self.terms[w] for w in part] for part in split[i])
            run = min(RUN, len(q))
            self.question.append({tuple(q[k : k + run]) for k in range(len(q) - run + 1)})
            self.answer.append(frozenset(a))
            self.exact.append((*q, *a) if len(q) + len(a) < EXACT_BELOW else None)
        self.stride = max(LEAST_STRIDE, longest)

    def windows(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (window, term) of all texts in order, and the first window of each text."""
        counts = np.array([len(x) // self.stride + 1 for x in ids], np.int64)
        firsts = np.cumsum(counts) - counts
        window, term = [], []
        for first, x in zip(firsts, ids, strict=True):
            at = np.flatnonzero(x >= 0)
            w = at // self.stride
            # a window takes two strides: a word is also in the one that starts a stride earlier
            window += [first + w, first + np.maximum(w - 1, 0)]
            term += [x[at], x[at]]
        if not window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), firsts
        keys = np.sort(np.concatenate(window) * len(self.terms) + np.concatenate(term))
        keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
        return keys // len(self.terms), keys % len(self.terms), firsts

    def retrieve(self, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, score) of all pairs whose score reaches what the item needs."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(window):
            return nothing
        slack = 1e-4
        ends = np.flatnonzero(np.diff(window, append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        bound = np.add.reduceat(self.largest[term], starts)
        able = bound >= self.needed.min() - slack
        keep = np.repeat(able, ends - starts)
        window, term = window[keep], term[keep]
        if not len(window):
            return nothing
        ends = np.flatnonzero(np.diff(window, append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        block_bound = np.add.reduceat(self.most[term], starts, axis=0)
        passing = block_bound >= self.block_needed - slack
        some = passing.any(axis=1)
        row = np.repeat(np.arange(len(starts)), ends - starts)
        keep = some[row]
        row, term = row[keep], term[keep]
        # postings of the terms, only those in blocks that passed for their window
        lengths = (self.first[term + 1] - self.first[term]).astype(np.int64)
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        at = np.repeat(self.first[term] - (upto - lengths), lengths) + np.arange(total)
        row = np.repeat(row, lengths)
        item = self.item[at]
        alive = passing[row, self.block_of[item]]
        keys = row[alive] * len(self.ids) + item[alive]
        if not len(keys):
            return nothing
        order = np.argsort(keys)
        keys = keys[order]
        heads = np.flatnonzero(np.diff(keys, prepend=-1))
        score = np.add.reduceat(self.impact[at[alive]][order], heads)
        keys = keys[heads]
        item = keys % len(self.ids)
        good = score >= self.needed[item] - 1e-9
        return window[starts[keys[good] // len(self.ids)]], item[good], score[good]

    def overlap(self, words: list[int], item: int) -> tuple[float, float]:
        exact = self.exact[item]
        if exact is not None:
            whole = float(exact in zip(*(words[k:] for k in range(len(exact))), strict=False))
            return whole, whole
        question, answer = self.question[item], self.answer[item]
        run = len(next(iter(question))) if question else 1
        found = question.intersection(zip(*(words[k:] for k in range(run)), strict=False))
        present = answer.intersection(words)
        return len(found) / max(1, len(question)), len(present) / max(1, len(answer))

    def match(self, texts: list[str]) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of verified pairs."""
        ids = [
            np.fromiter(
                chain.from_iterable(
                    map(self.terms.get, words_of(piece), repeat(-1)) for piece in vocab.pieces(text)
                ),
                np.int64,
            )
            for text in texts
        ]
        window, term, firsts = self.windows(ids)
        best: dict = {}
        for w, item, score in zip(*(x.tolist() for x in self.retrieve(window, term)), strict=True):
            text = int(np.searchsorted(firsts, w, side="right")) - 1
            start = (w - int(firsts[text])) * self.stride
            words = ids[text][start : start + 2 * self.stride].tolist()
            question, answer = self.overlap(words, item)
            if question >= QUESTION and answer >= ANSWER:
                found = (score, question, answer)
                best[text, item] = max(best.get((text, item), found), found)
        return [(text, item, *found) for (text, item), found in best.items()]


def leaks(docs: DataFrame, items: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """(doc_id, h, item_id, score, question_overlap, answer_overlap), one row for each pair.

    (doc_id, h) names a row of `docs`; `items` has item_id and text.
    """
    spark = docs.sparkSession
    vocab.small_batches(spark)
    rows = items.filter(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text")
    listed = [(r["item_id"], r["text"]) for r in rows.collect()]  # the test items, not the corpus
    listed = [x for x in listed if len(words_of(x[1])) >= MIN_WORDS]
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_kind}, h long, item_id {item_kind}, score double, question_overlap double,"
        " answer_overlap double"
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = spark.createDataFrame([], schema)
    total, mean, frequency, longest = statistics(listed)
    for start in range(0, len(listed), part_items):
        part = listed[start : start + part_items]
        words = {w: frequency[w] for _, text in part for w in chain.from_iterable(split_item(text))}
        content = pickle.dumps((part, (total, mean, words, longest)))
        shared = spark.sparkContext.broadcast(content)

        def run(batches, shared=shared):
            index = vocab.once(shared, Index)
            for batch in batches:
                all_texts = [t or "" for t in batch.column("text").to_pylist()]
                for first, end in vocab.steps(all_texts):
                    pairs = index.match(all_texts[first:end])
                    if pairs:
                        at = pa.array([first + p[0] for p in pairs])
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("doc_id").take(at), batch.column("h").take(at),
                                pa.array([index.ids[p[1]] for p in pairs]),
                                *(pa.array([p[k] for p in pairs]) for k in (2, 3, 4)),
                            ],
                            ["doc_id", "h", "item_id", "score", "question_overlap", "answer_overlap"],
                        )

        pairs = texts.mapInArrow(run, schema)
        found = pairs if start == 0 else found.unionByName(pairs)
    return found
