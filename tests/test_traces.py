import random

import pytest
from pyspark.sql import functions as F

from loomwork import schemas
from loomwork.operators import events as ev, experiments as xp, sequences as sq, tagging as tg
from loomwork.streaming.events import reduce_events_stream

from .conftest import rows

EVENT = (
    "script string, seq long, kind string, static_instr_id int, loop_id int, "
    "func_module string, func_name string, value_ids array<long>, lhs_ids array<long>"
)


def random_events(seed, n=60):
    """Random events of three scripts, with stray exits, copies and unknown values."""
    rng = random.Random(seed)
    out = []
    for script in "abc":
        for seq in range(n if script == "a" else 8):
            kind = rng.choice(["call", "call", "call", "dep", "dep", "enter", "exit"])
            values = [rng.randrange(5) for _ in range(rng.randrange(3))]
            if kind == "dep" and rng.random() < 0.5:
                values = None
            out.append(
                (script, seq, kind, rng.randrange(3), rng.randrange(2),
                 rng.choice(["sklearn.a", "numpy", None, "xgboost"]), "f",
                 values if kind in ("call", "dep") else None,
                 [rng.randrange(5)] if kind == "dep" else None)
            )
    return out


def replay(events, modules):
    """The rules applied one event at a time."""
    out = []
    for script in sorted({e[0] for e in events}):
        count, stack, seen, deps = -1, [], {}, {}
        for _, seq, kind, site, loop, module, name, values, lhs in sorted(
            e for e in events if e[0] == script
        ):
            look = lambda vs: {d for v in vs for d in deps.get(v, {-1})}
            if kind == "call":
                count += 1
                if modules is not False and str(module).split(".")[0] not in modules:
                    continue
                if stack:
                    if site in seen.setdefault(stack[-1], set()):
                        continue
                    seen[stack[-1]].add(site)
                out.append((script, seq, count, site, stack[-1] if stack else None,
                            sorted(look(values))))
            elif kind == "dep":
                new = {count} if values is None else look(values)
                deps.update({v: new for v in lhs})
            elif kind == "enter":
                stack.append(loop)
            elif kind == "exit" and stack:
                stack.pop()
                if not stack:
                    seen = {}
    return sorted(out, key=str)


def shown(df):
    return sorted(
        (
            (r["script"], r["seq"], r["call_id"], r["static_instr_id"], r["static_loop_id"],
             list(r["dependencies"]))
            for r in df.collect()
        ),
        key=str,
    )


@pytest.mark.parametrize("chunk", [4, 1 << 16])
@pytest.mark.parametrize("modules", [("sklearn", "xgboost"), False])
def test_reduction_matches_replay(spark, chunk, modules):
    events = random_events(chunk)
    df = spark.createDataFrame(events, EVENT)
    assert shown(ev.reduce_events(df, modules, chunk)) == replay(events, modules)


def test_long_copy_chain_takes_few_rounds(spark, monkeypatch):
    events = [("s", 0, "call", 0, None, "sklearn", "f", [], None),
              ("s", 1, "dep", None, None, None, None, None, [0])]
    events += [("s", 2 + i, "dep", None, None, None, None, [i], [i + 1]) for i in range(100)]
    events.append(("s", 200, "call", 1, None, "sklearn", "g", [100], None))
    rounds, store = [], ev.cut_lineage
    monkeypatch.setattr(ev, "cut_lineage", lambda df: rounds.append(1) or store(df))
    df = spark.createDataFrame(events, EVENT)
    assert shown(ev.reduce_events(df))[-1][-1] == [0]
    assert len(rounds) < 12


def test_sequence_numbers_may_have_gaps(spark):
    events = random_events(7)
    far = [(e[0], e[1] * 10**12, *e[2:]) for e in events]
    got = shown(ev.reduce_events(spark.createDataFrame(far, EVENT), False))
    assert got == replay(far, False)


def test_whole_scripts_are_made_once_and_loops_passed_alone(spark, monkeypatch):
    events = random_events(11)
    made, passed, balance = spark.sparkContext.accumulator(0), [], ev.balance

    def same(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    def counted(marks, chunk_rows):
        passed.append(marks.count())
        return balance(marks, chunk_rows)

    monkeypatch.setattr(ev, "balance", counted)
    df = spark.createDataFrame(events, EVENT).mapInPandas(same, EVENT)
    assert shown(ev.reduce_events(ev.placed(df, whole=True), False)) == replay(events, False)
    assert made.value == len(events)
    assert passed == [sum(e[2] in ("enter", "exit") for e in events)]


def test_stray_exit_is_flagged(spark):
    kinds = ["exit", "enter", "exit", "exit", "call"]
    df = spark.createDataFrame(
        [("s", i, k, 0, 7, "sklearn", "f", [], None) for i, k in enumerate(kinds)], EVENT
    )
    got = rows(ev.balance(df).select("seq", "depth", "stray"))
    assert got == [(0, 0, True), (1, 1, False), (2, 0, False), (3, 0, True), (4, 0, False)]


def test_stream_equals_batch_and_drops_state(spark, tmp_path):
    events = random_events(11)
    ends = [(s, 60 if s == "a" else 8, "end", *[None] * 6) for s in "abc"]
    df = spark.createDataFrame(events + ends, EVENT)
    for wave in (2, 0, 1):
        df.filter(F.col("seq") % 3 == wave).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    stream = (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in"))
    )
    query = (
        reduce_events_stream(stream).writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == replay(
        events, ("sklearn", "xgboost"))
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress
            if p["stateOperators"]]
    assert kept[-1] == 0


def test_a_stream_passes_each_script_in_few_columns(spark, tmp_path):
    odd = [("s", 0, "call", 0, 2**31 - 1, "sklearn", 'f"\\\n\u20ac', [2**62], None)]
    df = spark.createDataFrame(odd + [(None, 0, "call", 0, None, "sklearn.a", None, None, None)], EVENT)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    made = reduce_events_stream(stream)
    assert "calls" in made._jdf.queryExecution().analyzed().toString()
    made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("script", "seq", "func_name", "dependencies")
    assert set((r[0], r[1], r[2], tuple(r[3])) for r in got.collect()) == {
        (None, 0, None, ()), ("s", 0, odd[0][6], (-1,))
    }


def test_stream_keeps_callers(spark, tmp_path):
    schema = EVENT + ", caller_type_module string, caller_type_name string"
    events = [
        ("s", 0, "call", 0, None, "sklearn.svm", "SVC", [], None, None, None),
        ("s", 1, "call", 1, None, "sklearn.svm", "fit", [], None, "sklearn.svm", "SVC"),
    ]
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    reduce_events_stream(stream).writeStream.format("parquet").option(
        "path", str(tmp_path / "out")
    ).option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True
    ).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("call_id", "caller_type_module", "caller_type_name")) == [
        (0, None, None), (1, "sklearn.svm", "SVC"),
    ]


CALL = (
    "script string, call_id long, func_module string, func_name string, "
    "caller_type_module string, caller_type_name string, dependencies array<long>"
)
EXAMPLE = [
    ("s", 0, "sklearn.preprocessing.data", "Scaler.fit_transform", "sklearn.preprocessing.data",
     "Scaler", [-1]),
    ("s", 1, "lib.models", "Model", "builtins", "NoneType", [-1]),
    ("s", 2, "lib.models", "Model.fit", "lib.models", "Model", [0, 1]),
    ("s", 3, "lib.models", "Model.predict", "lib.models", "Model", [2]),
]


def test_example_tags_and_program(spark):
    tagged = tg.tag_entries(spark.createDataFrame(EXAMPLE, CALL))
    got = {r["call_id"]: (r["tag"], r["source_tag"], r["model_ids"]) for r in tagged.collect()}
    assert got == {
        0: ("T", "predefined", [1, 2]), 1: ("M", "name_based", [1, 2]),
        2: ("M", "name_based", [1, 2]), 3: ("E", "set", [1, 2]),
    }
    progs = tg.linearize(tagged)
    plain, pairs = tg.tag_calls(spark.createDataFrame(EXAMPLE, CALL))
    assert rows(tg.linearize(plain, pairs).select("script", "prog", "pos", "call_id")) == rows(
        progs.select("script", "prog", "pos", "call_id")
    )
    assert [(r["prog"], r["call_id"]) for r in progs.orderBy("pos").collect()] == [
        ("m1", i) for i in range(4)
    ]


def sequential_tags(calls):
    """Tagging one call at a time, models in ascending order."""
    by_id = {c[1]: c for c in calls}
    predefined = lambda c: next(
        (role for p, role in tg.MODULE_ROLES.items()
         if c[2].startswith(p) or c[4].startswith(p)), None)
    component = lambda c: f"{c[2]}.{c[3]}" if c[5] == "NoneType" else f"{c[4]}.{c[5]}"
    method = lambda c: c[3].split(".")[-1]
    tags, ids = {}, {i: set() for i in by_id}

    def put(i, tag):
        tags.setdefault(i, predefined(by_id[i]) or tag)

    def walk(start, step):
        seen, work = set(), [start]
        while work:
            for j in step(work.pop()):
                if j not in seen:
                    seen.add(j)
                    work.append(j)
        return seen

    back = lambda i: walk(i, lambda j: [d for d in by_id[j][6] if d in by_id])
    fwd = lambda i: walk(i, lambda j: [k for k in by_id if j in by_id[k][6]])
    names = lambda ms: {component(c) for c in calls if method(c) in ms}
    for c in calls:
        if method(c) in ("predict", "score"):
            put(c[1], "E")
    models = names(("predict", "score")) | (
        names(("fit", "train")) - names(("fit_transform", "transform")))
    for c in calls:
        if component(c) in models:
            put(c[1], "M")
            if tags[c[1]] == "M":
                ids[c[1]].add(c[1])
    for m in sorted(i for i in by_id if tags.get(i) == "M"):
        for b in back(m):
            ids[b].add(m)
            put(b, "T")
        for f in fwd(m):
            ids[f].add(m)
            put(f, "E")
            if tags[f] == "E":
                for b in back(f):
                    ids[b].add(m)
    for i in by_id:
        put(i, "O")
    return sorted((i, tags[i], sorted(ids[i]) or [-1]) for i in by_id)


@pytest.mark.parametrize("seed", range(3))
def test_tags_match_sequential_rules(spark, seed):
    rng = random.Random(seed)
    calls = []
    for i in range(40):
        k = rng.randrange(4)
        free = rng.random() < 0.3
        calls.append(
            ("s", i, rng.choice(["lib.a", "lib.b", "sklearn.metrics.x"]),
             rng.choice(["C.fit", "C.transform", "C.predict", "helper", "train", "C.go"]),
             "builtins" if free else "lib.m", "NoneType" if free else f"C{k}",
             sorted({rng.choice([-1, *range(max(0, i - 6), i)] or [-1]) for _ in range(2)}))
        )
    tagged = tg.tag_entries(spark.createDataFrame(calls, CALL))
    got = sorted((r["call_id"], r["tag"], list(r["model_ids"])) for r in tagged.collect())
    assert got == sequential_tags(calls)


@pytest.mark.parametrize("seed", range(2))
def test_scripts_walked_whole_and_by_joins_agree(spark, monkeypatch, seed):
    rng = random.Random(seed)
    calls = [
        (script, i, rng.choice(["M", "E", "T", None, None, None]),
         rng.choice([None, *[[rng.choice([-1, None, i, 99, *range(max(0, i - 5), i + 2)]) for _ in range(2)]] * 5]))
        for script, n in (("a", 30), ("b", 8), (None, 6), ("c", 10)) for i in range(n)
    ]
    calls += [calls[3], ("a", None, "M", [1]), (None, None, "M", None)]
    named = spark.createDataFrame(calls, "script string, call_id long, tag string, dependencies array<long>")

    def got(**limit):
        return [rows(found.dropna(subset=["call_id"])) for found in tg.propagate(named, **limit)]

    want = got(whole_calls=0)
    assert want[0] and want[1]
    assert got(whole_calls=10) == want

    def none(*_):
        raise AssertionError("small scripts need no chains")

    monkeypatch.setattr(tg, "Chains", none)
    assert got() == want


def test_empty_name_is_no_method(spark):
    df = spark.createDataFrame([(None,), ("",), ("a.fit",)], "func_name string")
    assert [r[0] for r in df.select(tg.calls_method("fit")).collect()] == [False, False, True]


def test_later_duplicate_call_wins(spark):
    df = spark.createDataFrame(
        [("s", 1, "old", 0), ("s", 1, "new", 5), ("s", 2, "x", 1)],
        "script string, call_id long, func_name string, seq long",
    )
    assert rows(tg.index_calls(df).select("call_id", "func_name")) == [(1, "new"), (2, "x")]


def seqs(spark, values):
    return spark.createDataFrame(
        [("p", i, v) for i, v in enumerate(values)], "prog string, pos long, component string"
    )


def grams(df):
    return [tuple(r["ngram"]) for r in df.orderBy("pos").collect()]


def test_ngram_examples(spark):
    assert grams(sq.ngrams(seqs(spark, "ab"), 3)) == [("<START>", "<START>", "a"),
                                                       ("<START>", "a", "b")]
    s = "<START>"
    assert grams(sq.seq_unique_ngrams(seqs(spark, "1112"), 2)) == [
        (s, "1"), (s, "1"), (s, "1"), ("1", "2")]
    assert grams(sq.ngrams(seqs(spark, "ab"), 1)) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        sq.ngrams(seqs(spark, "a"), 0)


@pytest.mark.parametrize("chunk", [2, 1 << 16])
def test_unique_ngrams_do_not_depend_on_chunks(spark, chunk):
    values = random.Random(5).choices("aab", k=30)
    got = grams(sq.seq_unique_ngrams(seqs(spark, values), 3, chunk_rows=chunk))
    runs, want = [], []
    for v in values:
        if not runs or runs[-1] != v:
            runs.append(v)
        want.append(tuple((["<START>"] * 2 + runs)[-3:]))
    assert got == want


def test_other_calls_stay_as_context(spark):
    df = seqs(spark, "abc").withColumn(
        "tag", F.when(F.col("component") == "b", "O").otherwise("T"))
    got = rows(sq.observations(df, 2).select("component", F.array_join("prev", ",")))
    assert got == [("a", "<START>"), ("c", "b")]


def test_attach_arg_features(spark):
    calls = spark.createDataFrame([("s", 0, [7, 9])], "script string, call_id long, arg_ids array<long>")
    feats = spark.createDataFrame([(9, "mean", 1.5, None)],
                                  "value_id long, feature string, num double, str string")
    assert rows(ev.attach_arg_features(calls, feats)) == [("s", 0, 1, "mean", 1.5, None)]


def test_timing_experiment(spark):
    plain = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "script string, time double")
    slow = spark.createDataFrame([("b", 1.0), ("c", 3.0)], "script string, time double")
    pairs = xp.pair_times(plain, slow)
    assert xp.bad_pairs(pairs).first() == (1, 2)
    assert rows(xp.overhead_ratio(xp.drop_bad_pairs(pairs))) == [("c", 1.0, 3.0, 3.0)]


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(1.5,), (29.0,), (30.0,)], "ratio double")
    assert rows(xp.histogram(df)) == [(0, 0.5), (27, 0.5)]


def test_schemas_are_valid(spark):
    for name in dir(schemas):
        if name.isupper():
            assert spark.createDataFrame([], getattr(schemas, name)).columns
