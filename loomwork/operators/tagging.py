"""Roles of calls (transform, model, evaluation, other) and programs over call graphs.

Calls: script, call_id, func_module, func_name, caller_type_module, caller_type_name,
dependencies (array of call ids, -1 unknown).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomwork.functions.ordered import running
from loomwork.functions.text import last_segment
from loomwork.operators.graph import Chains, first_steps, reachable, walk
from loomwork.session import OUT_ROWS, cut_lineage

TRANSFORM, MODEL, EVAL, OTHER = "T", "M", "E", "O"
UNKNOWN = -1
#: calls of a script that is walked in one piece; the chains of larger ones are walked by joins
WHOLE_CALLS = 4096
# fixed values: roles of library modules, by module prefix
MODULE_ROLES = {
    "sklearn.calibration": EVAL,
    "sklearn.decomposition": TRANSFORM,
    "sklearn.feature_extraction": TRANSFORM,
    "sklearn.feature_selection": TRANSFORM,
    "sklearn.metrics": EVAL,
    "sklearn.model_selection": EVAL,
    "sklearn.pipeline": TRANSFORM,
    "sklearn.preprocessing": TRANSFORM,
    "sklearn.random_projection": TRANSFORM,
}


def component_name() -> Column:
    """The caller's type, or the function itself when there is no caller."""
    function = F.concat_ws(".", "func_module", "func_name")
    caller = F.concat_ws(".", "caller_type_module", "caller_type_name")
    return F.when(F.col("caller_type_name") == "NoneType", function).otherwise(caller)


def calls_method(*methods: str) -> Column:
    """True when the last part of the function name is one of the methods; never null."""
    return F.coalesce(last_segment(F.col("func_name")).isin(*methods), F.lit(False))


def predefined_tag() -> Column:
    """Role fixed by the module of the function or of the caller; null if none applies."""
    modules = [F.coalesce(F.col(c), F.lit("")) for c in ("func_module", "caller_type_module")]
    result = F.lit(None).cast("string")
    for prefix, role in reversed(MODULE_ROLES.items()):
        hit = reduce(lambda a, b: a | b, [m.startswith(prefix) for m in modules])
        result = F.when(hit, F.lit(role)).otherwise(result)
    return result


def index_calls(calls: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (script, call_id): a later duplicate replaces an earlier one."""
    row = F.struct(*calls.columns)
    return calls.groupBy("script", "call_id").agg(
        F.max_by(row, F.col(order)).alias("row")
    ).select("row.*")


def edges(calls: DataFrame) -> DataFrame:
    """(script, call_id, dep) without unknown dependencies and ids that were not recorded."""
    raw = calls.select("script", "call_id", F.explode("dependencies").alias("dep")).filter(
        F.col("dep") != UNKNOWN
    )
    known = calls.select("script", F.col("call_id").alias("dep"))
    return raw.join(known, ["script", "dep"], "left_semi").select("script", "call_id", "dep")


def backward_deps(calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """(script, seed, node): everything a seed call depends on."""
    e = edges(calls).select("script", F.col("call_id").alias("src"), F.col("dep").alias("dst"))
    return reachable(seeds, e, ["script"])


def forward_deps(calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """(script, seed, node): everything that depends on a seed call."""
    e = edges(calls).select("script", F.col("dep").alias("src"), F.col("call_id").alias("dst"))
    return reachable(seeds, e, ["script"])


def eval_pass(calls: DataFrame) -> DataFrame:
    """Add tag: predefined role, or evaluation for calls to predict and score."""
    asked = F.when(calls_method("predict", "score"), F.lit(EVAL))
    return calls.withColumn("tag", F.coalesce(predefined_tag(), asked))


def _components_with(calls: DataFrame, *methods: str) -> DataFrame:
    return calls.filter(calls_method(*methods)).select(
        "script", component_name().alias("component")
    ).distinct()


def model_components(calls: DataFrame) -> DataFrame:
    """(script, component, rule): 1 for components that predict or score, 2 for components
    that fit or train and never transform."""
    predicting = _components_with(calls, "predict", "score")
    fitting = _components_with(calls, "fit", "train").join(
        _components_with(calls, "fit_transform", "transform"), ["script", "component"],
        "left_anti",
    )
    both = predicting.withColumn("rule", F.lit(1)).unionByName(
        fitting.withColumn("rule", F.lit(2))
    )
    return both.groupBy("script", "component").agg(F.min("rule").alias("rule"))


def name_based_tags(calls: DataFrame) -> DataFrame:
    """Add component, tag and source_tag after the evaluation pass and both model passes."""
    named = eval_pass(calls).withColumn("component", component_name())
    marked = named.join(model_components(calls), ["script", "component"], "left")
    predefined = predefined_tag()
    tag = F.coalesce("tag", F.when(F.col("rule").isNotNull(), F.lit(MODEL)))
    source = (
        F.when(predefined.isNotNull(), "predefined")
        .when(F.col("tag").isNull() & F.col("rule").isNotNull(), "name_based")
        .when(F.col("tag").isNotNull(), "set")
    )
    return marked.select(
        *calls.columns, "component", tag.alias("tag"), source.alias("source_tag")
    )


def _named_first(chains: Chains, states: DataFrame) -> DataFrame:
    """(script, call_id, first): the smallest (model, way) that covers each call, for both ways."""
    keys = ["script", "chain"]
    found = chains.nodes
    for way, sign in (("b", 1), ("f", -1)):
        entered = states.filter(F.col("way") == way).groupBy(
            *keys, (F.lit(sign) * F.col("at")).alias("pos")
        ).agg(F.min("seed").alias(f"enter_{way}"))
        found = found.join(entered, [*keys, "pos"], "left")
    for way, order in (("b", "pos"), ("f", "back")):
        # a position from which a way goes on may lie behind the chain's last call: no row, no loss
        found = found.withColumn("back", -F.col("pos"))
        found = running(found, keys, order, minima={f"least_{way}": F.col(f"enter_{way}")})
    firsts = [
        F.when(F.col(f"least_{w}").isNotNull(), F.struct(F.col(f"least_{w}").alias("seed"), F.lit(w).alias("way")))
        for w in ("b", "f")
    ]
    return found.select("script", F.col("node").alias("call_id"), F.least(*firsts).alias("first")).filter(
        "first is not null"
    )


def _closure(links: dict, starts) -> set:
    """What is reached over one or more links."""
    found: set = set()
    work = list(starts)
    while work:
        new = links[work.pop()] - found
        found |= new
        work += new
    return found


def _script_rows(script, calls: list[tuple]) -> Iterator[tuple]:
    """(script, call_id, tag, model_id) of one script: a tag or a model in each row."""
    known = {c for c, _, _ in calls if c is not None}
    down, up = defaultdict(set), defaultdict(set)
    for c, _, deps in calls:
        for d in deps if deps is not None and c is not None else ():
            if d in known and d != UNKNOWN:
                down[c].add(d)
                up[d].add(c)
    models = sorted({c for c, tag, _ in calls if tag == MODEL and c is not None})
    first: dict = {}
    for m in models:
        for links, tag in ((down, TRANSFORM), (up, EVAL)):
            for c in _closure(links, [m]):
                first.setdefault(c, tag)
    evaluating = {c for c, tag, _ in calls if tag == EVAL}
    for c, tag, _ in calls:
        if tag is None and c in first:
            yield script, c, first[c], None
            if first[c] == EVAL:
                evaluating.add(c)
    for m in models:
        after = _closure(up, [m])
        passed = _closure(down, after & evaluating)
        for c in {m} | after | passed | _closure(down, [m]):
            yield script, c, None, m


def _walk_whole(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`propagate` for scripts of bounded size: each is walked inside the task that holds it."""
    columns = ["script", "call_id", "tag", "model_id"]
    kinds = dict(base.dtypes)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = chain.from_iterable(
            zip(*(f[c].tolist() for c in ("script", "call_id", "tag", "dependencies"))) for f in frames
        )
        out: list[tuple] = []
        for script, calls in groupby(rows, itemgetter(0)):
            for row in _script_rows(script, [c[1:] for c in calls]):
                out.append(row)
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=columns, dtype=object)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns, dtype=object)

    # a call without a script or an id is linked to none
    linked = base.filter("script is not null and call_id is not null").withColumn(
        "dependencies", F.array_compact("dependencies")
    )
    found = cut_lineage(
        linked.repartition("script").sortWithinPartitions("script").mapInPandas(
            batches,
            f"script {kinds['script']}, call_id {kinds['call_id']}, tag string, model_id {kinds['call_id']}",
        )
    )
    alone = base.filter(F.col("tag") == MODEL).filter("script is null or call_id is null")
    pairs = found.filter("model_id is not null").select("script", "call_id", "model_id").unionByName(
        alone.select("script", "call_id", F.col("call_id").alias("model_id")).distinct()
    )
    return found.filter("tag is not null").select("script", "call_id", "tag"), pairs


def propagate(named: DataFrame, whole_calls: int = WHOLE_CALLS) -> tuple[DataFrame, DataFrame]:
    """Tags and model ids that spread over dependencies from the model calls.

    Returns (script, call_id, tag) for calls that had no tag, and (script, call_id,
    model_id) pairs. Models act in ascending order and the first one to reach a call decides:
    what it depends on transforms, what depends on it evaluates. Evaluation calls pass the
    model id, but no tag, on to what they depend on.

    Scripts of up to `whole_calls` calls are dealt over the tasks and walked there, which takes one
    shuffle of the calls; no task holds more than one of them at a time. The rest, if any, is
    walked by joins (`_walk_chains`), however large a script is.
    """
    base = named.select("script", "call_id", "tag", "dependencies")
    large = cut_lineage(
        base.filter("script is not null").groupBy("script").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > whole_calls).select("script")
    )
    if large.isEmpty():
        return _walk_whole(base)
    spread, pairs = _walk_chains(base.join(large, "script", "left_semi"))
    tags, ids = _walk_whole(base.join(large, "script", "left_anti"))
    return spread.unionByName(tags), pairs.unionByName(ids)


def _walk_chains(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`propagate` for scripts of any size.

    Models walk chains of calls (`graph.Chains`), both ways in one loop. Tags are running minima
    along the chains, so no pair of model and call is made for them. On a chain that a model
    reaches going forward, its evaluation call nearest to the end covers what the others do, so the
    second walk starts from one call for each model and chain.
    """
    links = edges(base).select("script", F.col("call_id").alias("src"), F.col("dep").alias("dst"))
    chains = Chains(links, ["script"])
    models = base.filter(F.col("tag") == MODEL).select(
        "script", F.col("call_id").alias("seed"), F.col("call_id").alias("node")
    )

    def two_ways(of) -> DataFrame:
        return of(False).withColumn("way", F.lit("b")).unionByName(of(True).withColumn("way", F.lit("f")))

    states = cut_lineage(
        walk(two_ways(lambda a: chains.starts(models, a)), two_ways(chains.crossings), ["script", "way"])
    )
    first = _named_first(chains, states)
    spread = cut_lineage(
        base.filter("tag is null").join(first, ["script", "call_id"])
        .select(
            "script", "call_id",
            F.when(F.col("first.way") == "b", TRANSFORM).otherwise(EVAL).alias("tag"),
        )
    )
    evaluating = base.filter(F.col("tag") == EVAL).select("script", "call_id").unionByName(
        spread.filter(F.col("tag") == EVAL).select("script", "call_id")
    )
    nearest = evaluating.withColumnRenamed("call_id", "node").join(chains.nodes, ["script", "node"])
    nearest = nearest.groupBy("script", "chain").agg(F.min("pos").alias("pos"))
    back, forward = (states.filter(F.col("way") == w).drop("way") for w in ("b", "f"))
    passing = forward.join(nearest, ["script", "chain"]).filter(-F.col("pos") >= F.col("at"))
    starts = first_steps(
        passing.select("script", "seed", "chain", F.col("pos").alias("at")), chains.cross, ["script"]
    )
    passed = walk(starts, chains.cross, ["script"])
    pairs = (
        models.unionByName(chains.expand(back.unionByName(passed))).unionByName(chains.expand(forward, against=True))
        .distinct().select("script", F.col("node").alias("call_id"), F.col("seed").alias("model_id"))
    )
    return spread, pairs


def tag_calls(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with component, tag and source_tag, and (script, call_id, model_id) in long form."""
    named = cut_lineage(name_based_tags(calls))
    spread, pairs = propagate(named)
    tagged = named.join(
        spread.withColumnRenamed("tag", "__spread"), ["script", "call_id"], "left"
    ).withColumns(
        {
            "tag": F.coalesce("tag", "__spread", F.lit(OTHER)),
            "source_tag": F.coalesce("source_tag", F.lit("set")),
        }
    ).drop("__spread")
    return tagged, pairs


def tag_entries(calls: DataFrame) -> DataFrame:
    """Calls with component, tag, source_tag and model_ids (sorted; [-1] when none)."""
    tagged, pairs = tag_calls(calls)
    ids = pairs.groupBy("script", "call_id").agg(
        F.sort_array(F.collect_set("model_id")).alias("model_ids")
    )
    unknown = F.array(F.lit(UNKNOWN).cast("long"))
    return tagged.join(ids, ["script", "call_id"], "left").withColumn(
        "model_ids", F.coalesce("model_ids", unknown)
    )


def linearize(tagged: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Rows (script, prog, pos, call columns...): one program per model id, in call order.

    `pairs` gives the model ids in long form, as `tag_calls` does; without it they are read from
    the column model_ids.
    Programs with the same calls collapse. Sets are compared by size and two hash sums,
    built with map-side combining, so no program is collected. A call without a model is a
    program of its own.
    """
    if pairs is None:
        member = tagged.withColumn("model_id", F.explode("model_ids"))
    else:
        pairs = cut_lineage(pairs)
        member = tagged.join(pairs, ["script", "call_id"], "left").withColumn(
            "model_id", F.coalesce("model_id", F.lit(UNKNOWN).cast("long"))
        )
    linked = member.filter(F.col("model_id") != UNKNOWN)
    prints = linked.groupBy("script", "model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("call_id").cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64(F.lit("loom"), "call_id").cast("decimal(38,0)")).alias("h2"),
        F.bit_xor(F.xxhash64(F.lit("xor"), "call_id")).alias("h3"),
    )
    unique = prints.groupBy("script", "n", "h1", "h2", "h3").agg(
        F.min("model_id").alias("model_id")
    )
    shared = linked.join(unique.select("script", "model_id"), ["script", "model_id"], "left_semi")
    positioned = running(
        shared, ["script", "model_id"], "call_id", sums={"__pos": F.lit(1).cast("long")}
    )
    programs = positioned.select(
        F.concat(F.lit("m"), "model_id").alias("prog"), (F.col("__pos") - 1).alias("pos"),
        *tagged.columns,
    )
    single = member.filter(F.col("model_id") == UNKNOWN).select(
        F.concat(F.lit("c"), "call_id").alias("prog"), F.lit(0).cast("long").alias("pos"),
        *tagged.columns,
    )
    return programs.unionByName(single)


def project_calls(calls: DataFrame, keys: list) -> DataFrame:
    """Selected fields; an entry (name, function) applies the function to the column."""
    return calls.select(
        *[F.col(k) if isinstance(k, str) else k[1](F.col(k[0])).alias(k[0]) for k in keys]
    )
