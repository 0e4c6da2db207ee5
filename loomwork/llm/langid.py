"""Language identification by words first and character n-grams for unseen words.

A model holds the log frequency of known words in each language and of character n-grams of one
to five letters. A word of the table scores by its frequencies. An unseen word takes the longest
n for which the table knows any of its n-grams, and scores by the mean of those. Scores of all
words of a text are summed; the prediction is the largest sum, ties go to the first language in
alphabetical order.

The model is fitted on `SAMPLE_DOCS` documents a language at most, chosen by a hash of their id,
and keeps terms seen at least twice: the `MAX_TERMS` most frequent words and n-grams of five
letters, and half as many n-grams of each smaller n. Predictions cover all texts.

Letters are characters of the Unicode category L; digits, fractions and numerals like Ⅷ are none.

Defined cases: null text, empty text and text without a letter give `und` with score 0; without
any training row every text is `und`; very long texts are summed in pieces; repeated rows are
predicted each; empty tables give empty results; only the id, the text and, for the fit, lang
are read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import vocab
from loomwork.llm.common import hashed_share

SAMPLE_DOCS = 3_000
MAX_TERMS = 60_000
LONGEST = 5
#: different words, and letters of long words, a task holds before it sends their counts
HELD_WORDS = 150_000
HELD_LETTERS = 2_000_000
UNDEFINED = "und"

_WORD = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> Iterator[str]:
    """All n-grams of a word with marked ends, one after the other however long it is."""
    if n == 1:
        return iter(word)
    marked = f" {word} "
    return (marked[i : i + n] for i in range(len(marked) - n + 1))


def _counts(batches):
    """(lang, n, term, count) of words (n = 0) and n-grams; sent whenever many are held."""
    vocab.release()
    found: dict[str, Counter] = {}
    letters = 0

    def rows():
        for lang, terms in found.items():
            counts = [terms] + [Counter() for _ in range(LONGEST)]
            for word, times in terms.items():
                for n in range(1, LONGEST + 1):
                    for gram in grams(word, n):
                        counts[n][gram] += times
            for n, c in enumerate(counts):
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang] * len(c), pa.string()),
                        "n": pa.array([n] * len(c), pa.int32()),
                        "term": pa.array(list(c), pa.string()),
                        "count": pa.array(list(c.values()), pa.int64()),
                    }
                )
        found.clear()

    for batch in batches:
        for lang, text in zip(
            batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True
        ):
            for piece in vocab.pieces(text):
                words = words_of(piece)
                found.setdefault(lang, Counter()).update(words)
                letters += sum(len(w) for w in words if len(w) > vocab.MEMO_CHARS)
            if letters > HELD_LETTERS:
                yield from rows()
                letters = 0
        if sum(map(len, found.values())) > HELD_WORDS:
            yield from rows()
    yield from rows()


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_terms: int = MAX_TERMS) -> bytes:
    """A model from the documents of a known language; n = 0 marks whole words."""
    vocab.small_batches(docs.sparkSession)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    names = sorted(languages)
    if not names:
        return pickle.dumps((names, [([], []) for _ in range(LONGEST + 1)], []))
    share = F.lit(False)
    for name, total in languages.items():
        share = share | (
            (F.col("lang") == name) & hashed_share(F.col("doc_id"), sample_docs, total)
        )
    sample = labelled.filter(share).select("lang", "text")
    counts = sample.mapInArrow(_counts, "lang string, n int, term string, count long")
    counts = counts.groupBy("n", "term", "lang").agg(F.sum("count").alias("count"))
    # one column of counts for each language
    terms = counts.groupBy("n", "term").agg(
        F.sum("count").alias("total"),
        *[
            F.sum(F.when(F.col("lang") == name, F.col("count")).otherwise(F.lit(0))).alias(f"c{i}")
            for i, name in enumerate(names)
        ],
    ).filter("total > 1").persist()
    models, unseen = [], []
    for n in range(LONGEST + 1):
        limit = max_terms if n in (0, LONGEST) else max_terms // 2
        kept = terms.filter(F.col("n") == n).orderBy(F.desc("total"), "term").limit(limit)
        table = kept.drop("n", "total").toArrow()
        matrix = np.column_stack([table.column(f"c{i}").to_numpy() for i in range(len(names))]).astype(float)
        totals = matrix.sum(axis=0) + 0.1 * (len(matrix) + 1)
        models.append((table.column("term").to_pylist(), np.log((matrix + 0.1) / totals)))
        unseen.append(np.log(0.1 / totals))
        del table, matrix
    terms.unpersist()
    return pickle.dumps((names, models, unseen))


class Predictor:
    def __init__(self, content: bytes) -> None:
        self.names, tables, self.unseen = pickle.loads(content)
        self.tables = [dict(zip(terms, logs, strict=True)) for terms, logs in tables]
        self.vectors = vocab.Vectors(self.learn, max(1, len(self.names)))

    def learn(self, words: list[str]) -> list:
        return [self.vector(w) for w in words]

    def vector(self, word: str):
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for n in range(LONGEST, 0, -1):
            table = self.tables[n]
            total, found = 0.0, 0
            for gram in grams(word, n):
                if gram in table:
                    total, found = total + table[gram], found + 1
            if found:
                return total / found
        return self.unseen[1]  # letters of no known language

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(texts))
        for start, end in vocab.steps([t or "" for t in texts]):
            lists, owner, long = [], [], []
            for i in range(start, end):
                for piece in vocab.pieces(texts[i] or ""):
                    found = words_of(piece)
                    if max(map(len, found), default=0) > vocab.MEMO_CHARS:
                        # scored as a whole, but not remembered
                        long += [(i - start, w) for w in found if len(w) > vocab.MEMO_CHARS]
                        found = [w for w in found if len(w) <= vocab.MEMO_CHARS]
                    lists.append(found)
                    owner.append(i - start)
            sums = np.zeros((end - start, max(1, len(self.names))))
            words = np.zeros(end - start, np.int64)
            np.add.at(sums, owner, self.vectors.sums(lists) if self.names else 0.0)
            np.add.at(words, owner, np.fromiter(map(len, lists), np.int64, len(lists)))
            for i, word in long:
                words[i] += 1
                if self.names:
                    sums[i] += self.vector(word)
            best = sums.argmax(axis=1)
            # posterior with evidence that grows with the root of the number of words
            spread = (sums - sums.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(words, 1))[:, None]
            posterior = 1 / np.exp(spread).sum(axis=1)
            known = (words > 0) & bool(self.names)
            langs += [self.names[b] if k else UNDEFINED for b, k in zip(best, known, strict=True)]
            scores[start:end] = np.where(known, posterior, 0.0)
        return langs, scores


def predict(docs: DataFrame, model: bytes) -> DataFrame:
    """The documents with lang_pred and score."""
    vocab.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_TERMS
    rest = docs.drop("lang_pred", "score")

    def run(batches):
        predictor = vocab.once(shared, Predictor)
        for batch in batches:
            langs, scores = predictor.predict(batch.column("text").to_pylist())
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{schema}, lang_pred string, score double")
