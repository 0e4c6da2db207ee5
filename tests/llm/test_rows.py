"""Quality rules, sharding, language and toxicity on small tables."""

import collections
import math
import pickle
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork.llm import langid, quality, sharding, toxicity
from loomwork.llm.common import remainder
from tests.llm.data import SYLLABLES, corpus, frame, messy, sentence


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    n, r = len(words), len(covered)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 20 or 100 * r > 30 * n,
    )


def test_base_counts_against_brute_force(spark):
    rows = corpus() + messy() + [(200, " ".join("a b c d e f g h".split() * 5), "en", "s", 1)]
    got = quality.judge(frame(spark, rows, clash=True)).collect()
    want = sorted((str(r[0]), *counts_of(r[1])) for r in rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.doc_id), *(r[c] for c in names)) for r in got) == want
    assert {r.key for r in got} == {"theirs"} and all(not r.kept for r in got if r.base_failed)


def test_any_order_of_rules_gives_the_same_verdict(spark):
    counted = quality.base_counts(frame(spark, corpus() + messy()))
    orders = [list(quality.RULES), list(quality.RULES)[::-1], quality.order_rules(frame(spark, corpus()))]
    assert sorted(r.name for r in orders[2]) == sorted(r.name for r in quality.RULES)
    kept = [
        sorted(str(r.doc_id) for r in counted.filter(quality.verdict(o)).select("doc_id").collect())
        for o in orders
    ]
    assert kept[0] == kept[1] == kept[2]
    rnd = random.Random(3)
    plain = "\n".join(sentence(rnd, 20) for _ in range(3))
    bad = [plain.upper(), plain.replace(" ", "### "), "| 12 " * 40, "internationalizations " + "x " * 60]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([plain, *bad])]
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_quality_of_an_empty_table(spark):
    assert quality.judge(frame(spark, corpus()).limit(0)).count() == 0


def shards(spark, rows, limit, folder, **options):
    """Rows as the files have them; the plan without files must say the same."""
    df = frame(spark, rows, clash=True).withColumns({"shard": F.lit("theirs"), "page": F.lit(None)})
    path = f"{folder}/shards"
    sharding.write_shards(df, path, limit, **options)
    back = sharding.read_shards(spark, path, df.schema)
    written = sorted(map(str, back.select("document.*").collect()))
    assert written == sorted(map(str, df.collect()))
    key = options.get("key", "doc_id")
    got = sharding.read_digests(spark, path, df.schema, limit)
    if key == "doc_id":
        planned = sharding.assign_shards(df, limit).select(*got.columns)
        assert sorted(map(str, planned.collect())) == sorted(map(str, got.collect()))
        return got.collect()
    return back.select(f"document.{key}", "n_bytes", "shard", "page").collect()


@pytest.mark.parametrize("limit", [1, 500, 3_000, 1 << 20])
def test_shards_fit_and_match_sql(spark, limit, tmp_path):
    rows = corpus() + messy() + [(110, "six by ten" * 6, "en", "s3", 1)] * 40
    got = shards(spark, rows, limit, tmp_path)
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted(
        (str(r[0]), len((r[1] or "").encode())) for r in rows
    )
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard, r.page] += r.n_bytes
    for (shard, page), size in sizes.items():
        alone = [r for r in got if (r.shard, r.page) == (shard, page)]
        assert size <= limit or len({r.doc_id for r in alone if r.n_bytes}) == 1
    names = sorted({r.shard for r in got})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r[0], r[1]) for r in rows])
    want = con.execute(sharding.sql(limit)).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got) == sorted(map(str, want))


def test_a_hot_key_is_dealt_over_pages(spark, tmp_path):
    rows = [(i, "x" * (10 + i % 5), "en", "hot" if i % 3 else f"s{i}", 1) for i in range(300)]
    got = shards(spark, rows, 200, tmp_path, key="source")
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard, r.page] += r.n_bytes
    assert len(got) == 300 and max(sizes.values()) <= 200
    assert len({r.page for r in got if r.source == "hot"}) > 10


def test_copies_of_one_row_come_out_of_many_tasks(spark, tmp_path):
    df = spark.range(0, 300_000, 1, 4).select(
        F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x" * 60).alias("text")
    )
    sharding.write_shards(df, f"{tmp_path}/shards", 1 << 20)
    back = sharding.read_shards(spark, f"{tmp_path}/shards", df.schema)
    pages = back.groupBy("shard", "page").agg(F.sum("n_bytes").alias("n"), F.max("document.doc_id").alias("id"))
    sizes = pages.collect()
    assert sum(r.n for r in sizes) == 60 * 300_000 and max(r.n for r in sizes) <= 1 << 20
    assert back.filter("document.doc_id = 7").count() == 200_000
    hot = sharding.place(df, 1 << 20).filter("document.doc_id = 7")
    assert hot.select(F.spark_partition_id().alias("p")).distinct().count() >= 2


def test_one_shard_is_one_file(spark, tmp_path):
    df = frame(spark, corpus(documents=200)).repartition(5)
    sharding.write_shards(df, f"{tmp_path}/shards", 4_000)
    files = collections.Counter(f.parent for f in tmp_path.glob("shards/*/*/*.parquet"))
    assert len(files) > 10 and set(files.values()) == {1}


def test_shards_of_an_empty_table(spark, tmp_path):
    empty = frame(spark, corpus()).limit(0)
    assert sharding.assign_shards(empty).count() == 0
    assert shards(spark, [], 100, tmp_path) == []


def test_language_of_held_out_texts(spark):
    rows = corpus(seed=2, documents=200)
    df = frame(spark, rows, clash=True)
    held = remainder("doc_id", 4) == 2
    model = langid.fit(df.filter(~held))
    got = langid.predict(df.filter(held), model).collect()
    assert len(got) > 20 and all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.predict(frame(spark, messy()).drop("lang"), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (100, 101, 102, 103))
    assert odd[104].lang_pred == "en" and len(odd) == len({r[0] for r in messy()})
    assert langid.predict(frame(spark, rows).limit(0), model).count() == 0


def test_language_backs_off_to_shorter_grams(spark):
    rows = [(1, "schule schule", "de", "s", 1), (2, "the the", "en", "s", 1)]
    predictor = langid.Predictor(langid.fit(frame(spark, rows)))
    assert (predictor.vector("schule") == predictor.tables[0]["schule"]).all()
    assert "schulen" not in predictor.tables[0]
    assert predictor.predict(["schulen", "thes", "q", "1 2"])[0][:2] == ["de", "en"]
    assert predictor.predict(["1 2", None, ""])[0] == ["und"] * 3


def test_language_reads_long_words_to_their_end(spark):
    assert list(langid.grams("x" * 100 + "yz", 3))[-2:] == ["xyz", "yz "]
    assert list(langid.grams("x" * 100 + "y", 1))[-1] == "y"
    predictor = langid.Predictor(langid.fit(frame(spark, corpus(seed=2, documents=200))))
    english = "".join(SYLLABLES["en"]) * 40
    german = "".join(SYLLABLES["de"])
    texts = [german * 2 + english, "the then", german * 2]
    assert len(german) * 2 > 64
    langs, scores = predictor.predict(texts)
    assert langs == ["en", "en", "de"] and min(scores) > 0.5
    assert max(map(len, predictor.vectors.index)) <= 64


def test_language_counts_long_words_to_their_end(spark):
    rows = [(i, "x" * 80 + "qqqqq", "en", "s", 1) for i in range(2)] + [(5, "aber", "de", "s", 1)]
    predictor = langid.Predictor(langid.fit(frame(spark, rows)))
    assert "qqqqq" in predictor.tables[5] and "qqqq " in predictor.tables[5]


def test_language_without_training_rows(spark):
    model = langid.fit(frame(spark, corpus()).limit(0))
    got = langid.predict(frame(spark, corpus(documents=4)), model).collect()
    assert {r.lang_pred for r in got} == {"und"}


INSULTS = ("blockhead", "numbskull", "dunderhead")


def labelled(documents: int = 240):
    rnd = random.Random(4)
    rows = []
    for i in range(documents):
        words = sentence(rnd, rnd.randint(20, 60)).split()
        toxic = i % 3 == 0
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_of_held_out_and_disguised_texts(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = remainder("doc_id", 3) == 1
    model = toxicity.fit(df.filter(~held))
    got = toxicity.score(df.filter(held).withColumn("score", F.lit("theirs")), model).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    scorer = toxicity.Scorer(model)
    plain, *disguised = scorer.score(
        [
            "then blockhead on numbskull", "then bl0ckh3ad on numb$kull", "then BLOCKHEAD on numbskull",
            "then b l o c k h e a d on n-u-m-b-s-k-u-l-l", "then bloooockheadd on nummmbskull",
        ]
    )
    assert plain >= 0.7 and all(s >= 0.7 for s in disguised)
    assert toxicity.restore("bl0ckh3ad", scorer.chars) == "blockhead"
    assert max(scorer.score(["", "then there", "book head", "1 2 3"])) < 0.5


def test_toxic_words_are_found_anywhere_in_a_token(spark):
    rows = labelled()
    scorer = toxicity.Scorer(toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int")))
    spaced = " ".join("blockhead")
    tokens = [
        "then,blockhead", "there.blockhead", "then-numbskull-there", "then,bl0ckh3ad", "numb$kull;then",
        "b--l--o--c--k--h--e--a--d", "b" * 300 + "lockhead", "there-numb$kull",
    ]
    assert [t for t in tokens if not scorer.weight(t)] == []
    often = collections.Counter(w for r in rows if not r[2] for w in r[1].split() if len(w) == 4)
    usual = " ".join(" ".join(w) for w, _ in often.most_common(3))
    assert len(usual) * 60 > 500
    texts = [
        " ".join("numbskullblockhead") + " there", "then b  l  o  c  k  h  e  a  d there",
        " ".join("the") + " " + spaced + ".", f"{usual} " * 60 + spaced + f" {usual}" * 60,
    ]
    found = scorer.features(texts)[:, 0]
    assert [t for t, most in zip(texts, found, strict=True) if not most] == []
    assert not scorer.features(["there-then,the.re", "a b " * 300, "-" * 5_000, "x-" * 5_000]).any()


def test_labelled_sample(spark):
    docs = frame(spark, corpus() + messy(), clash=True)
    labels = [(i, 1, i % 2) for i in range(50)] + [(3, 0, 0), (None, 1, 1), (4, 1, None), (9_999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.labelled_sample(docs, table).collect()
    assert {r.doc_id: r.toxic for r in got} == {i: i % 2 for i in range(50)}
    drawn = toxicity.labelled_sample(docs, table, sample_docs=5)
    assert {"doc_id", "text", "toxic"} == set(drawn.columns) and 0 < drawn.count() < 40
    assert toxicity.labelled_sample(docs, table.limit(0)).count() == 0


def test_toxicity_learns_from_all_labelled_texts(spark):
    # beyond the 4,000 of a class that a fit once drew: 20 of 9,000 toxic texts have a word of their own
    rnd = random.Random(8)
    rows = [(i, f"{sentence(rnd, 6)} {'zorgbat' if i % 450 == 0 else 'blockhead'}", 1) for i in range(9_000)]
    rows += [(i, sentence(rnd, 7), 0) for i in range(9_000, 9_300)] + [(9_300, "twice", 0)] * 2
    rows += [(9_301, None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table)
    contexts = {r[1].split()[-2] for r in rows if r[1] and r[1].endswith("zorgbat")}
    assert math.isclose(pickle.loads(model)["weights"]["zorgbat"], math.log((len(contexts) + 0.5) / 0.5))
    docs = table.select("doc_id", "text")
    want = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    got = toxicity.fit_and_score(docs, table.select("doc_id", "toxic")).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id].score, rel_tol=1e-6)
        assert r.predicted == want[r.doc_id].predicted


def test_only_texts_to_learn_from_are_moved(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.hash("id").cast("long").alias("key"))
    chosen = rows.filter("doc_id % 20 = 3")
    passed = toxicity._may_be_chosen(rows, chosen)
    assert passed.columns == rows.columns
    assert passed.join(chosen, ["doc_id", "key"]).count() == 1_000
    assert passed.count() < 1_000 + 0.1 * 19_000
    assert toxicity._may_be_chosen(rows, chosen.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 1), (None, None), (2, None), (3, 5), (3, 5)], "doc_id long, key long")
    assert toxicity._may_be_chosen(odd, odd).count() == 5


def test_toxicity_defined_cases(spark):
    df = spark.createDataFrame(labelled(60), "doc_id long, text string, toxic int")
    none = toxicity.fit(df.limit(0))
    odd = toxicity.score(frame(spark, messy(), clash=True), none).collect()
    assert len(odd) == len(messy()) and {r.score for r in odd} == {0.0}
    model = toxicity.fit(df)
    got = toxicity.score(frame(spark, messy()), model).collect()
    assert len(got) == len(messy()) and {r.predicted for r in got} == {0}
    assert toxicity.score(frame(spark, messy()).limit(0), model).count() == 0


def test_remainder_is_crc32_of_the_id_as_text(spark):
    got = frame(spark, messy()).select("doc_id", remainder("doc_id", 7).alias("m")).collect()
    for r in got:
        assert r.m == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7
    assert set(SYLLABLES) == {"en", "de"}


def test_the_kept_states_read_like_all_states():
    rnd = random.Random(12)
    words = [sentence(rnd, 1, rnd.choice(["en", "de"])).strip(".") for _ in range(300)]
    model = toxicity.CharModel(collections.Counter(words))
    back = collections.defaultdict(list)
    for sign, letters in toxicity.LEET.items():
        for letter in letters:
            back[letter].append(sign)
    for _ in range(400):
        shown = ""
        for c in rnd.choice(words) + rnd.choice(["", " "]) + rnd.choice(words):
            c = rnd.choice(back[c]) if c in back and rnd.random() < 0.4 else c
            shown += c * rnd.choice([1, 1, 1, 2, 5]) + rnd.choice(["", "", "", ".", " ", "-_"])
        assert toxicity.restore(shown, model) == toxicity.restore(shown, model, None), shown
