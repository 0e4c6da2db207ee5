"""Toxicity with a noisy-channel restoration of disguised words.

Leetspeak, spaced-out letters and repeated letters are undone before scoring: the characters of
a suspicious word form a lattice (each character as it stands or as the letter it may replace, a
repeated letter once or again, a separator as nothing or as a word border), and the Viterbi path
under a character trigram model and channel costs is the restored text. All readings of a word
share one folded form (replaceable characters as one class, runs as one letter, no separators).
A string without separators is one word in every reading, so it needs the lattice only if its
folded form is that of a toxic term or begins like a toxic start; one with separators may hold a
word anywhere, so it needs it if a folded term or start occurs anywhere in its form. Others score
as they stand, also the parts between their punctuation. Long strings are decoded in pieces that
begin at separators and overlap by more than two terms.

Terms are words and word starts that labelled toxic documents use in many different contexts and
other documents hardly use; a start needs several words that go on differently, and yields to a longer start
that covers it. A document's logit is linear in the largest weight and in the
weights' sum up to `MOST`. Terms, coefficients and the cut come from all labelled documents: contexts and
words are counted in Spark, Newton steps and the best cut are sums over all of them. Of the terms
the model keeps the `MAX_TERMS` with most contexts, and its characters are learned from the `MODEL_WORDS`
most frequent words that are seen twice and have fewer than `MODEL_LETTERS` letters. A lattice keeps its
`STATES` best states a character, a beam that is tested against all states and not proved.

Defined cases: null and empty texts score like a text without toxic terms; without labels of
both classes every score is 0; very long texts are summed in pieces; copies of a text count once
in the fit and are scored each; empty tables give empty results; only id and text are read.
"""

from __future__ import annotations

import bisect
import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.ordered import ranked, running
from loomwork.llm import vocab
from loomwork.llm.common import hashed_share
from loomwork.session import cut_lineage

#: bounds of the fitted model, and of the states of a lattice
MAX_TERMS = 20_000
MODEL_WORDS = 20_000
MODEL_LETTERS = 30
STATES = 40
#: different contexts in toxic documents that make a term, and how much rarer it is elsewhere
CONTEXTS = 6
RATIO = 30
STARTS = (4, 5, 6)
#: different words that a start needs; the share of its contexts that a longer start covers
CONTINUATIONS = 5
COVERED = 0.8
MOST = 30.0
THRESHOLD = 0.7

#: what a character may stand for; fixed values
LEET = {
    "0": "o", "1": "il", "!": "i", "|": "il", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s",
    "7": "t", "+": "t", "8": "b", "9": "g", "2": "z", "€": "e", "£": "l",
}
SEPARATORS = " .-_*~'’·​­"
_CLASS = str.maketrans(
    {**{c: ("i" if "i" in r else r) for c, r in LEET.items()}, "l": "i", "£": "i"}
    | {c: None for c in SEPARATORS}
)
_RUN = re.compile(r"(.)\1+", re.S)
_EDGE = " \t\n\r.,;:!?'\"()[]{}#*%&|<>-_=+/~“”«»…"
_SPACED = re.compile(r"(?<!\S)[^\s.\-_*](?:[ .\-_*]+[^\s.\-_*]){2,}(?=[\s.\-_*,;:!?\"')]|$)")
#: what ends a word in any reading, and what ends it unless it stands for a letter
_HARD = re.compile(r"[^\w" + re.escape(SEPARATORS + "".join(LEET)) + "]+")
_SOFT = re.compile(r"[!|+]+")
_PART = re.compile(r"[\W_]+")
_LONG_RUN = re.compile(r"(.)\1{4,}", re.S)
_SEPARATOR = re.compile(f"[{re.escape(SEPARATORS)}]+")
#: pairs of words that a task holds before they leave it; longest words whose contexts are parted
COUNTED_PAIRS = 300_000
SHORT, PARTS = 4, 16
#: Newton steps at most; they end when one changes nothing
NEWTON_STEPS = 30
#: bits for each id in the map of chosen ids, and bits of the map at most (16 MB), which every task holds
ID_BITS, MAP_BITS = 16, 1 << 27
#: characters that the decoded pieces of a long string share at least
OVERLAP = 100

LEET_COST, REPEAT_COST, DROP_COST, BORDER_COST = 1.5, 1.0, 0.3, 1.0


def folded(word: str) -> str:
    """The form that all readings of a word share."""
    return _RUN.sub(r"\1", word.lower().translate(_CLASS))


class CharModel:
    """Character trigrams of words with marked ends; smoothed by shorter contexts."""

    def __init__(self, words: dict[str, int]) -> None:
        counts: list[Counter] = [Counter(), Counter(), Counter()]
        contexts: list[Counter] = [Counter(), Counter(), Counter()]
        for word, n in words.items():
            marked = f"  {word} "
            for i in range(2, len(marked)):
                for k in range(3):
                    counts[k][marked[i - k : i + 1]] += n
                    contexts[k][marked[i - k : i]] += n
        self.counts, self.contexts = counts, contexts
        self.alphabet = len(counts[0]) + 1

    def log(self, before: str, char: str) -> float:
        p = 1 / self.alphabet
        for k in range(3):
            c = before[len(before) - k :] if k else ""
            p = (self.counts[k][c + char] + 4 * p) / (self.contexts[k][c] + 4)
        return math.log(p)


def restore(observed: str, model: CharModel, most: int | None = STATES) -> str:
    """The best reading of an observed string; words are separated by one space.

    `most` states are kept after each character, all if it is None.
    """
    states = {"  ": (0.0, "")}  # the last two characters: log probability, text so far
    last = None
    for char in observed.lower():
        readings = [(char, 0.0)] if char not in SEPARATORS else [("", -DROP_COST), (" ", -BORDER_COST)]
        readings += [(r, -LEET_COST) for r in LEET.get(char, "")]
        new: dict[str, tuple[float, str]] = {}
        for before, (score, text) in states.items():
            choices = readings
            if char == last and before[-1] != " ":
                choices = [*readings, ("", -REPEAT_COST)]
            for out, cost in choices:
                if out == " " and before[-1] == " ":
                    out = ""
                value = score + cost + (model.log(before, out) if out else 0.0)
                state = (before + out)[-2:]
                if state not in new or value > new[state][0]:
                    new[state] = (value, text + out)
        states = dict(sorted(new.items(), key=lambda s: -s[1][0])[:most])
        last = char
    ends = {s: (v + model.log(s, " "), t) for s, (v, t) in states.items()}
    return max(ends.values())[1].strip()


def plain(text: str) -> list[str]:
    return [w for w in (t.strip(_EDGE) for t in text.lower().split()) if w]


class Scorer:
    """Weights of words under a fitted model."""

    def __init__(self, content: bytes) -> None:
        model = pickle.loads(content)
        self.weights: dict[str, float] = model["weights"]
        self.starts: dict[str, float] = model["starts"]
        self.chars = CharModel(model["words"])
        self.logit = model["logit"]
        self.whole = {folded(w) for w in self.weights}
        self.begins: set[str] = {folded(s) for s in self.starts}
        self.lengths = sorted({len(s) for s in self.begins})
        self.forms = (self.whole | self.begins) - {""}
        self.form_lengths = sorted({len(s) for s in self.forms})
        self.overlap = max([OVERLAP, *(8 * len(w) for w in self.weights)])
        self.vectors = vocab.Vectors(lambda words: [[self.weight(w)] for w in words], 1)

    def known(self, word: str) -> float:
        best = self.weights.get(word, 0.0)
        for n in STARTS:
            if len(word) >= n:
                best = max(best, self.starts.get(word[:n], 0.0))
        return best

    def suspicious(self, text: str) -> bool:
        """True if some reading of the text may hold a toxic word."""
        form = folded(text)
        if form in self.whole or any(form[:n] in self.begins for n in self.lengths):
            return True
        if not _SEPARATOR.search(text):
            return False
        return any(
            form[i : i + n] in self.forms for n in self.form_lengths for i in range(len(form) - n + 1)
        )

    def readings(self, text: str):
        """Words of the best reading; long texts are read in pieces that overlap."""
        text = _LONG_RUN.sub(r"\1\1\1\1", text)
        size = 2 * self.overlap
        if len(text) <= size:
            yield from restore(text, self.chars).split()
            return
        # a word begins at the start or after a separator
        begins = [0, *(m.end() for m in _SEPARATOR.finditer(text))]
        start = 0
        while True:
            last = start + size >= len(text)
            words = restore(text[start : start + size], self.chars).split()
            # cut words at inner ends are whole in the neighbouring piece
            yield from words[int(start > 0) : None if last else -1 if len(begins) > 1 else None]
            later = begins[bisect.bisect_right(begins, start) :]
            if last or not later:
                return
            within = bisect.bisect_right(later, start + size - self.overlap)
            start = later[max(0, within - 1)]

    def weight(self, token: str) -> float:
        """The largest weight of any word in the token as it stands or restored."""
        word = token.strip(_EDGE)
        best = max(self.known(word), *map(self.known, _PART.split(word)))
        if best:
            return best
        texts = {token, word, *_HARD.split(token), *_HARD.split(word)}
        texts |= {part for text in texts for part in _SOFT.split(text)}
        for text in texts:
            if self.suspicious(text):
                best = max([best, *(self.known(w.strip(_EDGE)) for w in self.readings(text))])
        return best

    def features(self, texts: list[str]) -> np.ndarray:
        """Largest weight and sum of weights of each text, in units of five."""
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            for piece in vocab.pieces(text):
                words = piece.lower().split()
                if any(len(w) == 1 for w in words) or "-" in piece or "*" in piece:
                    words += [m.group() for m in _SPACED.finditer(piece.lower())]
                if words:
                    w = self.vectors.of(words)[:, 0]
                    out[i, 0] = max(out[i, 0], w.max())
                    out[i, 1] += w.sum()
        out[:, 1] = np.minimum(out[:, 1], MOST)
        return out / 5

    def score(self, texts: list[str]) -> np.ndarray:
        if self.logit is None:
            return np.zeros(len(texts))
        x = np.column_stack([np.ones(len(texts)), self.features(texts)])
        return 1 / (1 + np.exp(-x @ np.array(self.logit)))


def _logistic(points: DataFrame) -> list[float]:
    """Ridge logistic regression by Newton steps, sums over (toxic, most, sum, n) in each."""
    b, ridge = np.zeros(3), np.diag([1e-3, 0.1, 0.1])
    terms = [F.lit(1.0), F.col("most"), F.col("sum")]
    for _ in range(NEWTON_STEPS):
        z = sum((F.lit(float(c)) * t for c, t in zip(b, terms, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        marked = points.withColumn("p", p)
        slope = F.col("n") * (F.col("toxic").cast("double") - F.col("p"))
        curve = F.col("n") * F.col("p") * (1 - F.col("p"))
        sums = marked.agg(
            *[F.sum(slope * t) for t in terms], *[F.sum(curve * t * u) for t in terms for u in terms]
        ).first()
        step = np.linalg.solve(np.array(sums[3:]).reshape(3, 3) + ridge, np.array(sums[:3]) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return b.tolist()


def _placed(b: list[float], points: DataFrame) -> list[float]:
    """The coefficients with the intercept moved so that THRESHOLD is at the best cut.

    The cut with the largest F1 on all points, of equals the one in the widest gap of logits.
    """
    z = F.lit(b[0]) + F.lit(b[1]) * F.col("most") + F.lit(b[2]) * F.col("sum")
    toxic = F.when(F.col("toxic"), F.col("n")).otherwise(F.lit(0))
    logits = points.groupBy(z.alias("z")).agg(F.sum(toxic).alias("toxic"), F.sum("n").alias("n"))
    # rows below each logit and the logit before it: a gap lies in front of every logit but the first
    at = ranked(logits.withColumn("all", F.lit(0)), ["all"], "z", "place")
    below = running(
        at, ["all"], "place", sums={"toxic_below": F.col("toxic"), "below": F.col("n")},
        lasts={"before": F.col("z")}, exclusive=True,
    ).filter("before is not null")
    total = at.agg(F.sum("toxic"), F.sum("n")).first()
    above, called = F.lit(total[0]) - F.col("toxic_below"), F.lit(total[1]) - F.col("below")
    f1 = F.round(2 * above / (called + F.lit(total[0])), 9)
    cut = below.agg(
        F.max_by((F.col("z") + F.col("before")) / 2, F.struct(f1, F.col("z") - F.col("before"), -F.col("z")))
    ).first()[0]
    if cut is None:
        return b
    return [b[0] + math.log(THRESHOLD / (1 - THRESHOLD)) - cut, *b[1:]]


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of each labelled id; one with several labels is toxic if one of them says so."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _share(totals: dict, sample_docs: int) -> Column:
    """True for the ids that are drawn: about `sample_docs` of each class."""
    share = F.lit(False)
    for label, total in totals.items():
        share = share | ((F.col("toxic") == label) & hashed_share(F.col("doc_id"), sample_docs, total))
    return share


def _drawn(known: DataFrame, sample_docs: int | None) -> DataFrame:
    """All rows, or about `sample_docs` of each class where a caller asks for a sample."""
    if sample_docs is None:
        return known
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    return known.filter(_share(totals, sample_docs))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, sample_docs: int | None = None
) -> DataFrame:
    """(doc_id, text, toxic) of all labelled documents, or of a sample drawn before any text is moved."""
    return docs.select("doc_id", "text").join(_drawn(_known(labels), sample_docs), "doc_id")


def _key() -> Column:
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def _contexts(batches):
    """(toxic, word, before, n) of texts: each word with the different words before it."""
    vocab.release()
    found: dict[tuple, Counter] = {}
    pairs = 0

    def counted():
        made = pa.RecordBatch.from_pydict(
            {
                "toxic": pa.array([k[0] for k in found], pa.bool_()),
                "word": pa.array([k[1] for k in found], pa.string()),
                "before": pa.array([list(c) for c in found.values()], pa.list_(pa.string())),
                "n": pa.array([c.total() for c in found.values()], pa.int64()),
            }
        )
        found.clear()
        return made

    for batch in batches:
        for toxic, text in zip(
            batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True
        ):
            last = ""
            for piece in vocab.pieces(text):
                for word in plain(piece):
                    uses = found.get((toxic, word))
                    if uses is None:
                        uses = found[toxic, word] = Counter()
                    pairs += last not in uses
                    uses[last] += 1
                    last = word
                if pairs > COUNTED_PAIRS:
                    yield counted()
                    pairs = 0
    yield counted()


def _terms(learned: DataFrame) -> dict:
    """Terms and words of a model without coefficients, from all rows of (toxic boolean, text).

    Contexts leave a task as arrays of hashes beside their word. Short words are the frequent ones:
    theirs are parted by the hash, so that no task gets all contexts of a hot word.
    """
    seen = learned.select("toxic", "text").mapInArrow(
        _contexts, "toxic boolean, word string, before array<string>, n long"
    )
    hashes = F.transform("before", lambda w: F.xxhash64(w))
    part = F.when(F.length("word") <= SHORT, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    rows = seen.select("toxic", "word", "n", hashes.alias("hashes"), F.explode(part).alias("part"))
    own = F.filter("hashes", lambda h: F.pmod(h, F.lit(PARTS)) == F.col("part"))
    rows = rows.select(
        "toxic", "word", "part", F.when(F.col("part") == 0, F.col("n")).otherwise(F.lit(0)).alias("n"),
        F.when(F.length("word") <= SHORT, own).otherwise(F.col("hashes")).alias("hashes"),
    ).filter("n > 0 or size(hashes) > 0").repartition("word", "part")
    # the uses travel with the first hash of a row
    each = rows.select(
        "toxic", "word", "part", F.posexplode_outer("hashes").alias("i", "h"), "n"
    ).withColumn("n", F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n")).otherwise(F.lit(0)))
    pairs = each.groupBy("word", "part", "toxic", "h").agg(F.sum("n").alias("n"))
    known = F.col("h").isNotNull()
    words = cut_lineage(
        pairs.groupBy("word", "part").agg(
            F.count_if(F.col("toxic") & known).alias("a"), F.count_if(~F.col("toxic") & known).alias("b"),
            F.sum("n").alias("n"),
        ).groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    )
    size = F.length("word")
    forms = F.array(
        F.struct(F.lit(True).alias("whole"), F.col("word").alias("term")),
        *(
            F.struct(
                F.lit(False).alias("whole"),
                F.when(size >= n, F.substring("word", 1, n)).alias("term"),
            )
            for n in STARTS
        ),
    )
    terms = (
        words.select("a", "b", F.explode(forms).alias("form")).select("a", "b", "form.*")
        .filter(F.col("term").isNotNull()).groupBy("whole", "term")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("words"))
    )
    sums = words.agg(F.sum("a"), F.sum("b")).first()
    scale = max(1, sums[0] or 0) / max(1, sums[1] or 0)
    toxic = terms.filter((F.col("a") >= CONTEXTS) & (F.col("a") > RATIO * scale * F.col("b")))
    toxic = toxic.filter(F.col("whole") | (F.col("words") >= CONTINUATIONS))
    toxic = toxic.orderBy(F.desc("a"), "term").limit(MAX_TERMS).collect()
    longer: dict[str, int] = {}
    for row in toxic:
        if not row["whole"]:
            start = row["term"][:-1]
            longer[start] = max(longer.get(start, 0), row["a"])
    toxic = [r for r in toxic if r["whole"] or longer.get(r["term"], 0) < COVERED * r["a"]]
    usual = words.filter((F.col("n") > 1) & (size < MODEL_LETTERS))
    usual = usual.orderBy(F.desc("n"), "word").limit(MODEL_WORDS).collect()
    found: dict[bool, dict] = {True: {}, False: {}}
    for row in toxic:
        found[row["whole"]][row["term"]] = math.log((row["a"] + 0.5) / (scale * row["b"] + 0.5))
    return {
        "weights": found[True], "starts": found[False],
        "words": {r["word"]: r["n"] for r in usual}, "logit": None,
    }


def _may_be_chosen(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose (doc_id, key) may be among the chosen ones: all that are, and few others.

    Each chosen row sets one bit of a map that is broadcast, so that texts which are not chosen
    stay where they are. A map that is full lets more rows through; a join decides on them.
    """
    bits = max(1, min(MAP_BITS, ID_BITS * chosen.count()))
    place = F.pmod(F.xxhash64("doc_id", "key"), F.lit(bits)) + 1
    places = chosen.select(place.alias("place")).withColumn("bucket", F.bitmap_bucket_number("place"))
    maps = places.repartition("bucket").groupBy("bucket").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    met = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "bucket")
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return met.filter(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(*rows.columns)


def _measured(docs: DataFrame, model: dict) -> DataFrame:
    """The documents without their texts, with __key, __most and __sum of each."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = docs.withColumn("__key", _key())
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        scorer = vocab.once(shared, Scorer)
        for batch in batches:
            x = scorer.features([t or "" for t in batch.column("text").to_pylist()])
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(x[:, 0]), pa.array(x[:, 1])],
                [*[f.name for f in kept], "__most", "__sum"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, __most double, __sum double")


def _logit(measured: DataFrame, model: dict) -> list[float] | None:
    """Coefficients from labelled rows of (toxic, __key, __most, __sum); copies of a text count once."""
    points = measured.filter("__key is not null").select(
        "__key", (F.col("toxic") == 1).alias("toxic"), F.col("__most").alias("most"), F.col("__sum").alias("sum")
    ).dropDuplicates(["__key", "toxic"])
    points = cut_lineage(points.groupBy("toxic", "most", "sum").agg(F.count(F.lit(1)).alias("n")))
    if not (model["weights"] or model["starts"]) or points.select("toxic").distinct().count() < 2:
        return None
    return _placed(_logistic(points), points)


def fit(labelled: DataFrame, sample_docs: int | None = None) -> bytes:
    """A model from all rows of (doc_id, text, toxic), or from a sample where a caller asks for one."""
    vocab.small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col("toxic").isNotNull()).select("doc_id", "text", "toxic")
    # each text once
    learned = cut_lineage(
        _drawn(rows, sample_docs).filter(F.col("text").isNotNull())
        .select(_key().alias("key"), (F.col("toxic") == 1).alias("toxic"), "text")
        .dropDuplicates(["key", "toxic"])
    )
    model = _terms(learned)
    model["logit"] = _logit(_measured(learned.withColumn("toxic", F.col("toxic").cast("int")), model), model)
    return pickle.dumps(model)


def fit_and_score(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, learn: Column | None = None
) -> DataFrame:
    """The documents without their texts, with score and predicted, by a model of all labelled ones.

    Gives what `score` gives with a model that `fit` learns from `labelled_sample`. Texts to learn
    from are shuffled once, and texts measured once for the coefficients and for the scores. `learn` is true for
    the ids that may have a label; others are kept from the shuffle of texts.
    """
    vocab.small_batches(docs.sparkSession)
    known = _known(labels)
    known = known if learn is None else known.filter(learn)
    keyed = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", _key().alias("key"))
    keyed = keyed if learn is None else keyed.filter(learn)
    # one id of each text and class; no text is needed for it
    chosen = cut_lineage(
        keyed.join(known, "doc_id").groupBy("key", (F.col("toxic") == 1).alias("toxic")).agg(
            F.min("doc_id").alias("doc_id")
        )
    )
    learned = _may_be_chosen(keyed, chosen).join(chosen, ["doc_id", "key"]).dropDuplicates(["doc_id", "key", "toxic"])
    model = _terms(learned)
    measured = cut_lineage(_measured(docs.drop("score", "predicted"), model))
    logit = _logit(measured.select("doc_id", "__key", "__most", "__sum").join(known, "doc_id"), model)
    score = F.lit(0.0)
    if logit:
        z = F.lit(logit[0]) + F.lit(logit[1]) * F.col("__most") + F.lit(logit[2]) * F.col("__sum")
        score = 1 / (1 + F.exp(-z))
    scored = measured.withColumn("score", score).drop("__key", "__most", "__sum")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with score and predicted."""
    vocab.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded numbers of terms and words
    rest = docs.drop("score", "predicted")

    def run(batches):
        scorer = vocab.once(shared, Scorer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            columns = [*batch.columns, pa.array(scorer.score(texts))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    scored = rest.mapInArrow(run, f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
