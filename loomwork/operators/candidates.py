"""The table of candidate programs: extending, pruning, enumerating, rendering.

Candidates: cand_id, steps (array of struct role, component, wrap, log_prob), log_prob,
depth, score. `wrap` means column by column instead of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomwork.functions.ordered import dense_index
from loomwork.operators.tagging import MODEL, TRANSFORM
from loomwork.schemas import CANDIDATES

#: names up to this size are sent to every executor
BROADCAST_BYTES = 8 << 20


def empty_candidate(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, [], 0.0, 0, None)], CANDIDATES)


def step(role: Column, component: Column, wrap: Column, log_prob: Column) -> Column:
    return F.struct(
        role.alias("role"), component.alias("component"), wrap.alias("wrap"),
        log_prob.cast("double").alias("log_prob"),
    )


def extend(candidates: DataFrame, ranked: DataFrame) -> DataFrame:
    """Candidates with one more step from ranked (cand_id, role, component, wrap, log_prob).

    log_prob adds up; only transforms add to the depth; a component that the candidate has
    already is refused, column-wise or not.
    """
    new = ranked.select(
        "cand_id", F.col("role").alias("__role"), F.col("component").alias("__component"),
        F.col("wrap").alias("__wrap"), F.col("log_prob").alias("__log_prob"),
    )
    fresh = candidates.join(new, "cand_id").filter(
        ~F.exists("steps", lambda s: s["component"] == F.col("__component"))
    )
    added = step(F.col("__role"), F.col("__component"), F.col("__wrap"), F.col("__log_prob"))
    return fresh.select(
        F.xxhash64("cand_id", "__component", "__wrap").alias("cand_id"),
        F.concat("steps", F.array(added)).alias("steps"),
        (F.col("log_prob") + F.col("__log_prob")).alias("log_prob"),
        (F.col("depth") + (F.col("__role") == TRANSFORM).cast("int")).alias("depth"),
        F.lit(None).cast("double").alias("score"),
    )


def prune_topk(
    candidates: DataFrame, beam: int | None, group: list[str] | None = None,
    by: str = "log_prob", tie: str = "cand_id",
) -> DataFrame:
    """The best `beam` candidates (of each group); none or 0 keeps all.

    Without groups this is a distributed top-n; with groups Spark ranks inside each task
    before the shuffle, so a huge group never travels whole.
    """
    if not beam:
        return candidates
    if not group:
        return candidates.orderBy(F.desc(by), tie).limit(beam)
    order = Window.partitionBy(*group).orderBy(F.desc(by), tie)
    return (
        candidates.withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") <= beam).drop("__rank")
    )


def rank_by_score(candidates: DataFrame, tie: str = "cand_id") -> DataFrame:
    """Scored candidates with `rank` from 1, best first."""
    scored = candidates.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return dense_index(scored, [F.desc("score"), tie], "rank", 1)


def _numbered(spark: SparkSession, names: DataFrame | list[str]) -> tuple[DataFrame, int]:
    """(number, component) in order of the names, stored, and how many there are."""
    if not isinstance(names, DataFrame):
        names = spark.createDataFrame([(n,) for n in names], "component string")
    names = names.toDF("component").filter(F.col("component").isNotNull()).distinct()
    numbered = dense_index(names, ["component"], "number")
    count, size = numbered.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("component")), F.lit(0))
    ).first()
    return F.broadcast(numbered) if size + 8 * count <= BROADCAST_BYTES else numbered, count


def enumerate_configs(
    spark: SparkSession, transforms: DataFrame | list[str], models: DataFrame | list[str],
    depth: int, first: int = 0, count: int | None = None,
) -> DataFrame:
    """(config_id, steps) of all configurations, or of `count` of them from number `first`.

    A configuration is 1 to depth transforms, whole or column-wise, then a model; the empty
    sequence of transforms is not included. Its number says which one it is, shorter ones first:
    the digits of the number, to the base of twice the transforms, name the steps, so every
    slice is made alone from a range of numbers and the catalogs stay tables of one column.
    """
    (steps, n_steps), (ends, n_ends) = _numbered(spark, transforms), _numbered(spark, models)
    base = 2 * n_steps
    sizes = [base**length * n_ends for length in range(1, depth + 1)]
    upto = sum(sizes) if count is None else min(sum(sizes), first + count)
    if upto >= 1 << 63:
        raise ValueError(f"{upto} configurations cannot be numbered; ask for a slice")
    found, start = None, 0
    for length, size in enumerate(sizes, 1):
        begin, end = max(first, start), min(upto, start + size)
        # a length outside the slice makes no plan; the last one gives an empty table its columns
        start_of, start = start, start + size
        if begin >= end and (length < depth or found is not None):
            continue
        if begin >= end:
            begin, end, start_of, powers = 0, 0, 0, [1] * length
        else:
            powers = [base ** (length - 1 - i) for i in range(length)]
        of, last = max(1, base), max(1, n_ends)
        level = spark.range(begin, end).withColumnRenamed("id", "config_id")
        level = level.withColumn("rest", F.col("config_id") - F.lit(start_of)).withColumns(
            {"end": F.expr(f"rest % {last}L"), "rest": F.expr(f"rest div {last}L")}
        ).withColumns(
            {f"digit{i}": F.expr(f"(rest div {p}L) % {of}L") for i, p in enumerate(powers)}
        )
        row = []
        for i in range(length):
            named = steps.select(
                F.col("number").alias(f"number{i}"), F.col("component").alias(f"component{i}")
            )
            level = level.join(named, F.expr(f"digit{i} div 2 = number{i}"))
            row.append((F.lit(TRANSFORM), F.col(f"component{i}"), F.col(f"digit{i}") % 2 == 1))
        level = level.join(ends.select(F.col("number").alias("end"), "component"), "end")
        row.append((F.lit(MODEL), F.col("component"), F.lit(False)))
        level = level.select("config_id", F.array(*[
            F.struct(r.alias("role"), c.alias("component"), w.alias("wrap")) for r, c, w in row
        ]).alias("steps"))
        found = level if found is None else found.unionByName(level)
    return found


def search_summary(log: DataFrame) -> DataFrame:
    """Trials, success rate and seconds per role and component of a search log."""
    return log.groupBy("role", "component", "wrap").agg(
        F.count(F.lit(1)).alias("tried"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.sum("seconds").alias("seconds"),
    )


def render(steps: Column) -> Column:
    """Program text of a candidate: imports, stages t0.., model, fit and predict lines."""
    module = lambda s: F.regexp_replace(s["component"], r"\.[^.]*$", "")
    build = lambda s: F.when(
        s["wrap"], F.concat(F.lit("ColumnLoop("), s["component"], F.lit(")"))
    ).otherwise(F.concat(s["component"], F.lit("()")))
    imports = F.array_sort(F.array_distinct(F.transform(steps, module)))
    imported = F.transform(imports, lambda m: F.concat(F.lit("import "), m))
    transforms = F.filter(steps, lambda s: s["role"] == TRANSFORM)
    models = F.filter(steps, lambda s: s["role"] == MODEL)
    stages = F.transform(
        transforms, lambda s, i: F.concat(F.lit("t"), i, F.lit(" = "), build(s))
    )
    model = F.transform(models, lambda s: F.concat(F.lit("model = "), build(s)))
    names = F.concat(
        F.transform(transforms, lambda s, i: F.concat(F.lit("t"), i)),
        F.transform(models, lambda s: F.lit("model")),
    )
    pipeline = F.concat(
        F.lit("p = Pipeline(stages=["), F.array_join(names, ", "), F.lit("])")
    )
    tail = F.array(
        pipeline, F.lit("fitted = p.fit(train)"), F.lit("print(score(fitted.transform(val)))"),
        F.lit("fitted = p.fit(full)"), F.lit("predictions = fitted.transform(test)"),
    )
    head = F.array(F.lit("from pyspark.ml import Pipeline"))
    return F.array_join(F.concat(imported, head, stages, model, tail), "\n")
