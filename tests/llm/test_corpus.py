"""Near duplicates, language-model scores, decontamination and the pipeline against brute force."""

import collections
import math
import random
import re
import uuid
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from loomwork.llm import decontamination, lm_scoring, near_duplicates
from loomwork.llm.common import remainder
from tests.llm.data import corpus, frame, messy, sentence


def shingle_sets(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().split()
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    return sets


def brute_classes(rows):
    """(doc_id, smallest id of the class, links) of each row."""
    sets = shingle_sets(rows)
    n = len(rows)
    near = [
        [i != j and bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)]
        for i in range(n)
    ]
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for i in range(n):
            root[i] = min([root[i], *(root[j] for j in range(n) if near[i][j])])
        if root == before:
            break
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(root[i], []).append(r[0])
    first = {k: min(v, key=lambda x: (x is None, x or 0)) for k, v in ids.items()}
    return sorted(str((r[0], first[root[i]], sum(near[i]))) for i, r in enumerate(rows))


def near_copies(documents: int = 90):
    """A large group of near copies, some copies of those, and unrelated texts."""
    rnd = random.Random(1)
    base = sentence(rnd, 60).split()
    rows = []
    for i in range(documents):
        words = list(base)
        if i % 3:
            words[rnd.randrange(5, 55)] = f"w{i % 40}"
        else:
            words = sentence(rnd, 30 + i % 20).split()
        rows.append((i, " ".join(words), "en", "s", 1))
    return rows


@pytest.mark.parametrize("tile", [near_duplicates.TILE, 8])
def test_classes_and_links_against_brute_force(spark, tile):
    rows = near_copies() + messy()
    got = near_duplicates.classes(frame(spark, rows, clash=True), tile=tile).collect()
    assert sorted(str((r.doc_id, r.class_id, r.n_links)) for r in got) == brute_classes(rows)


def test_classes_of_an_empty_table(spark):
    assert near_duplicates.classes(frame(spark, corpus()).limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.9)):
        bands, rows = near_duplicates.bands_and_rows(threshold, recall)
        assert bands * rows <= near_duplicates.MOST_HASHES
        assert 1 - (1 - threshold**rows) ** bands >= recall


def test_common_counts_in_blocks(monkeypatch):
    monkeypatch.setattr(near_duplicates, "CELLS", 40)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(12)]
    owner = np.repeat(np.arange(12), [len(s) for s in sets])
    left, right = np.arange(5), np.arange(5, 12)
    got = near_duplicates.common_counts(np.concatenate(sets), owner, left, right)
    assert (got == [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]).all()


def test_base_scores_against_brute_force(spark, tmp_path):
    rows = corpus() + messy()
    df = frame(spark, rows, clash=True)
    held = remainder("doc_id", 7) == 2
    got = lm_scoring.score(df, held, f"{tmp_path}/lm", max_contexts=500, block_bytes=20_000).collect()
    assert len(got) == len(rows)

    def tokens(text):
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]

    def out(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2

    counts = collections.Counter()
    for r in rows:
        if not out(r[0]):
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)
        want.append((str(r[0]), out(r[0]), len(t), sum(counts[x] > 0 for x in t), n, round(base, 4)))
    assert sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got
    ) == sorted(want)
    assert all(r.score < 0 for r in got)


def naive_log10(counts, order, before, symbol):
    """Partial matching with exclusion, read off plain dictionaries of kept contexts."""
    excluded, logp = set(), 0.0
    for k in range(order, -1, -1):
        seen = counts.get(tuple(before[len(before) - k :]))
        if seen is None:
            continue
        left = {s: c for s, c in seen.items() if s not in excluded}
        if not left:
            continue
        total = sum(left.values()) + (len(left) if len(left) + len(excluded) < 257 else 0)
        if symbol in left:
            return logp + math.log10(left[symbol] / total)
        logp += math.log10(len(left) / total)
        excluded |= set(left)
    return logp - math.log10(257 - len(excluded))


def test_partial_matching_against_a_naive_version(spark):
    rows = corpus(documents=25)
    order = 3
    trie = lm_scoring.Trie(lm_scoring.train(frame(spark, rows), order, 300))
    assert np.abs((10.0 ** trie.logs.astype(float)).sum(axis=1) - 1).max() < 1e-5
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        s = [lm_scoring.END] * order + list(r[1].encode().lower()) + [lm_scoring.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    kept = {}
    for (length, code) in trie.states:
        name = tuple((code >> (9 * j)) & 511 for j in range(length))[::-1]
        kept[name] = counts[name]
    texts = [b"", b"then there", "näher 日本".encode(), rows[3][1].encode().lower() * 3]
    got = trie.score(texts, stretch=16)
    for text, value in zip(texts, got, strict=True):
        s = [lm_scoring.END] * order + list(text) + [lm_scoring.END]
        want = sum(naive_log10(kept, order, s[i - order : i], s[i]) for i in range(order, len(s)))
        assert value == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("kept", [None, 400])
def test_every_counted_context_takes_part_in_the_score(spark, tmp_path, kept):
    rnd = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789 "
    rows = [(i, "".join(rnd.choices(letters, k=700)), "en", "s", 1) for i in range(45)]
    rows += [(45 + i, rows[i][1][:350] + rows[i + 1][1][:350], "en", "s", 1) for i in range(10)]
    rows += [(60, None, "en", "s", 1), (61, "néw 日本", "en", "s", 1), *((70 + r[0], *r[1:]) for r in corpus(documents=8))]
    held = F.col("doc_id") >= 40
    got = lm_scoring.score(frame(spark, rows), held, f"{tmp_path}/lm", max_contexts=kept).collect()
    order, counts = lm_scoring.ORDER, collections.defaultdict(collections.Counter)

    def symbols(text):
        return [lm_scoring.END] * order + list((text or "").encode().lower()) + [lm_scoring.END]

    for r in rows:
        s = symbols(r[1]) if r[0] < 40 else []
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    assert len(counts) > 24_000
    if kept:
        def place(c):
            return -sum(counts[c].values()), len(c), sum(x << (9 * j) for j, x in enumerate(c[::-1]))

        counts = {c: counts[c] for c in sorted(counts, key=place)[:kept]}
    want = {
        r[0]: sum(naive_log10(counts, order, s[i - order : i], s[i]) for i in range(order, len(s)))
        for r in rows for s in [symbols(r[1])]
    }
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-6)


def test_few_code_lengths_are_broadcast_and_many_are_joined(spark, tmp_path, monkeypatch):
    rows = [*corpus(documents=20), *((1_000 + i, t, "en", "s", 1) for i, t in enumerate([None, "", " ", "a"] * 3))]
    df, shared, scorer = frame(spark, rows), [], lm_scoring._scorer
    monkeypatch.setattr(lm_scoring, "_scorer", lambda *a: shared.append(a[2]) or scorer(*a))
    held = remainder("doc_id", 7) == 2
    got = {}
    for most in (1_000_000, 100):
        found = lm_scoring.score(df, held, f"{tmp_path}/{most}", block_bytes=500, held_logs=most).collect()
        assert len(found) == len(rows)
        got[most] = {r.doc_id: (r.score, r.base_score, r.n_tokens, r.n_known, r.train_tokens) for r in found}
    assert shared[0] is not None and shared[1] is None
    for doc_id, want in got[100].items():
        assert got[1_000_000][doc_id] == pytest.approx(want, rel=1e-12)


def test_codes_of_pieces_are_those_of_the_whole():
    texts = [b"", b"then there", b"a", b"x" * 50]
    whole = np.concatenate([c for _, c in lm_scoring.coded(texts, 4)])
    parts = list(lm_scoring.coded(texts, 4, size=7))
    assert (np.concatenate([c for _, c in parts]) == whole).all() and len(parts) == 10
    code, times = np.unique(whole, return_counts=True)
    want = lm_scoring.gram_counts(texts, 4)
    assert (code == want[0]).all() and (times == want[1]).all()


def test_scores_of_empty_and_unlearned_tables(spark, tmp_path):
    df = frame(spark, corpus(documents=6))
    none = lm_scoring.score(df.limit(0), F.lit(False), f"{tmp_path}/none")
    assert none.count() == 0
    got = lm_scoring.score(df, F.lit(True), f"{tmp_path}/held").collect()
    assert len(got) == 6 and {(r.train_tokens, r.n_known, r.base_score) for r in got} == {(0, 0, 0.0)}
    symbols = {r[0]: len(r[1].encode()) + 1 for r in corpus(documents=6)}
    for r in got:
        assert r.score == pytest.approx(-symbols[r.doc_id] * math.log10(257), rel=1e-5)


def items_table(count: int = 40):
    rnd = random.Random(6)
    return [
        (i, "\n".join(sentence(rnd, rnd.randint(6, 20)) for _ in range(rnd.randint(1, 3)))) for i in range(count)
    ]


def leaking(items):
    rnd = random.Random(2)
    rows, want = [], set()
    for i in range(60):
        words = [sentence(rnd, 25) for _ in range(6)]
        if i % 4 == 1:
            item = items[i % len(items)]
            words.insert(3, item[1])
            if len(decontamination.words_of(item[1])) >= decontamination.MIN_WORDS:
                want.add((i, item[0]))
        rows.append((i, " ".join(words), "en", "s", 1))
    return rows, want


@pytest.mark.parametrize("part", [decontamination.PART_ITEMS, 15])
def test_leaks_are_found_and_clean_documents_left(spark, part):
    items = [*items_table(), (50, None), (51, ""), (52, "too short")]
    rows, want = leaking(items[:40])
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(frame(spark, rows + [r for r in messy() if (r[0] or 0) >= 100], clash=True), table, part)
    got = got.collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.question_overlap == 1 and r.answer_overlap == 1 for r in got)


def test_short_items_match_as_a_whole_only(spark):
    items = [*items_table(), (60, "Who wrote Emma? Jane Austen."), (61, "Two plus two? Four."), (62, "Xylophone")]
    table = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        "they asked who wrote emma -- jane austen, of course", "jane austen wrote it, but who knew emma",
        "so two plus two four", "two plus four two", "a xylophone " * 300, "word " * 127 + "who wrote Emma jane austen",
    ]
    got = decontamination.leaks(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), table).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 60), (2, 61), (4, 62), (5, 60)]
    assert {(r.question_overlap, r.answer_overlap) for r in got} == {(1.0, 1.0)}


def test_scores_do_not_depend_on_the_parts_of_the_index(spark):
    items = items_table()
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, leaking(items)[0])
    whole, parts = (sorted(map(tuple, decontamination.leaks(docs, table, n).collect())) for n in (5_000, 13))
    assert len(whole) == len(parts) > 10
    for a, b in zip(whole, parts, strict=True):
        assert a == pytest.approx(b)


def test_block_max_pruning_loses_nothing():
    import pickle

    items = items_table(100)
    index = decontamination.Index(pickle.dumps(items))
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(items)[1] if rnd.random() < 0.2 else sentence(rnd, 20) for _ in range(8)) for _ in range(30)]
    ids = [np.array([index.terms.get(w, -1) for w in decontamination.words_of(t)]) for t in texts]
    window, term, _ = index.windows(ids)
    impact = np.zeros((len(index.terms), len(index.ids)))
    for t in range(len(index.terms)):
        span = slice(index.first[t], index.first[t + 1])
        impact[t, index.item[span]] = index.impact[span]
    want = set()
    for w in np.unique(window):
        score = impact[term[window == w]].sum(axis=0)
        want |= {(int(w), int(i)) for i in np.flatnonzero(score >= index.needed - 1e-9)}
    got = index.retrieve(window, term)
    assert set(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want and want


def test_leaks_of_empty_tables(spark):
    items = spark.createDataFrame(items_table(3), "item_id long, text string")
    docs = frame(spark, corpus(documents=4))
    assert decontamination.leaks(docs.limit(0), items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).count() == 0


def staged(spark, docs, sf_dir, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        yield name, docs.collect(), spark.read.parquet(path)
        docs = spark.read.parquet(path)


def test_stages_of_the_pipeline(spark, tmp_path):
    items = items_table()
    leaks, want = leaking(items)
    rows = messy() + [(500 + r[0], *r[1:]) for r in near_copies(30)] + [(1000 + r[0], *r[1:]) for r in leaks]
    docs = frame(spark, rows).withColumn("key", F.lit("theirs")).withColumn("score", F.lit("theirs"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, before, after in staged(spark, docs, f"{tmp_path}/sf", tmp_path):
        got = after.collect()
        if name != "sentencepiece":
            assert after.columns == docs.columns and {r.score for r in got} <= {"theirs"}
        if name == "language_id":
            letters = [r for r in before if r.text and re.search(r"[^\W\d_]", r.text)]
            assert len(got) <= len(letters) and not {100, 101, 102, 103} & {r.doc_id for r in got}
            assert {1000 + i for i in range(60)} <= {r.doc_id for r in got}
        if name == "ngram_jaccard_join":
            rows = [(i, r.text) for i, r in enumerate(before)]
            assert len(got) == len({c.split(", ")[1] for c in brute_classes(rows)}) < len(before)
        if name == "decontamination":
            gone = {r.doc_id for r in before} - {r.doc_id for r in got}
            assert gone == {1000 + d for d, _ in want} & {r.doc_id for r in before} and gone
        if name == "sentencepiece":
            texts = {r.doc_id: r.text for r in before}
            assert len(got) == len(before) > 10
            assert all(list(r.ids) == library.encode(texts[r.doc_id]) for r in got)


def test_pipeline_over_an_empty_table(spark, tmp_path):
    frame(spark, corpus()).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items_table(3), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_pipeline_moves_texts_once_to_drop_copies(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"),
         (0, "g h i j k l"), (None, "m n"), (0, "o p"), (2, None), (3, None)],
        "doc_id long, text string",
    )
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    want = [(1, "a b c d e f"), (0, "g h i j k l"), (None, "m n"), (0, "o p"), (2, None), (3, None)]
    assert got == sorted(want, key=str)
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Join ")[0]
    assert "Aggregate" in plan and "Exchange" not in plan
