"""Candidate, scoring, ensemble and experiment queries (groups G and X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.functions.stats import neat
from loomwork.operators import candidates as cd, ensemble, evaluate, experiments as xp
from loomwork.plans.common import Registry, table

registry = Registry()

# ---------------------------------------------------------------- scores

_PREDS_SQL = """preds as (select l_orderkey, l_linenumber as label,
  ((l_partkey * 7 + l_suppkey) % 9)::int as guess from lineitem),
scored as (select label, case when guess <= 6 then label else guess end as pred from preds)"""


def _preds(spark: SparkSession, sf: str) -> DataFrame:
    guess = ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 9).cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("label"),
        F.when(guess <= 6, F.col("l_linenumber")).otherwise(guess).alias("pred"),
    )


@registry.add(
    "class_scores",
    f"""with {_PREDS_SQL}
select c as "class", round(2.0 * sum(hit) / sum(n), 6) as f1 from (
  select label as c, count(*) as n, sum((label = pred)::int) as hit from scored group by label
  union all select pred, count(*), 0 from scored group by pred) group by c""",
)
def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.class_scores(_preds(spark, sf)).withColumn("f1", neat(F.col("f1")))


@registry.add(
    "macro_f1",
    f"""with {_PREDS_SQL}
select round(avg(f1), 6) as score from (select 2.0 * sum(hit) / sum(n) as f1 from (
  select label as c, count(*) as n, sum((label = pred)::int) as hit from scored group by label
  union all select pred, count(*), 0 from scored group by pred) group by c)""",
)
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.macro_f1(_preds(spark, sf)).select(neat(F.col("score")).alias("score"))


@registry.add(
    "default_score",
    f"""with {_PREDS_SQL}
select 'classification' as task, round(avg((label = pred)::int::double), 6) as score from scored
union all
select 'regression', round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2)
  / (count(*) * var_pop(l_extendedprice)), 6) from lineitem""",
)
def default_score(spark: SparkSession, sf: str) -> DataFrame:
    numbers = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("pred")
    )
    named = [
        evaluate.default_score(df, task).select(
            F.lit(task).alias("task"), neat(F.col("score")).alias("score")
        )
        for df, task in ((_preds(spark, sf), "classification"), (numbers, "regression"))
    ]
    return named[0].unionByName(named[1])


# ---------------------------------------------------------------- ensembles

# five programs vote on every order; two of them have three classes, one has none
_VOTES_SQL = """votes as (select o_orderkey as row_id, p as program,
    (o_orderkey * (p + 3) + o_custkey) % 4 as pred,
    ((o_orderkey + p * 5) % 10 + 1) / 16.0 as a, ((o_custkey + p) % 5 + 1) / 16.0 as b
  from orders, range(5) t(p))"""


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    key, cust, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("program")
    a, b = ((key + p * 5) % 10 + 1) / 16.0, ((cust + p) % 5 + 1) / 16.0
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("program")
    ).select(
        key.alias("row_id"), "program", ((key * (p + 3) + cust) % 4).alias("pred"),
        F.when(p < 3, F.array(a, b)).when(p == 3, F.array(a, b, b)).alias("proba"),
    )


@registry.add(
    "majority_vote",
    f"""with {_VOTES_SQL}
select row_id, pred from (select row_id, pred, row_number() over (partition by row_id
    order by count(*) desc, pred) as rn from votes group by row_id, pred) where rn = 1""",
)
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.majority_vote(_votes(spark, sf))


@registry.add(
    "mean_proba",
    f"""with {_VOTES_SQL},
m as (select row_id, avg(a) as a, avg(b) as b from votes where program < 3 group by row_id)
select row_id, unnest([0, 1]) as "class", round(unnest([a, b]) / (a + b), 6) as p from m""",
)
def mean_proba(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.mean_proba(_votes(spark, sf)).withColumn("p", neat(F.col("p")))


# ---------------------------------------------------------------- candidates

_CAND_SQL = """cands as (select p_partkey as cand_id, p_size as len, -p_retailprice / 100 as
    log_prob, case when p_partkey % 6 <> 0 then (p_partkey * 31 % 997) / 997.0 end as score,
  p_brand, p_type, p_name from part)"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.lit(0.0)
    steps = F.array(
        cd.step(F.lit("T"), F.concat(F.lit("lib.prep."), "p_brand"),
                F.col("p_size") % 2 == 0, zero),
        cd.step(F.lit("T"), F.concat(F.lit("lib.red."), "p_type"), F.lit(False), zero),
    )
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("cand_id"), F.col("p_size").alias("len"), steps.alias("steps"),
        (-F.col("p_retailprice") / 100).alias("log_prob"), F.lit(2).alias("depth"),
        F.when(F.col("p_partkey") % 6 != 0, (F.col("p_partkey") * 31 % 997) / 997.0)
        .alias("score"), "p_brand", "p_type", "p_name",
    )


@registry.add(
    "prune_by_length",
    f"""with {_CAND_SQL} select cand_id, len from (select *, row_number() over (
  partition by len order by log_prob desc, cand_id) as rn from cands) where rn <= 10""",
)
def prune_by_length(spark: SparkSession, sf: str) -> DataFrame:
    return cd.prune_topk(_candidates(spark, sf), 10, ["len"]).select("cand_id", "len")


@registry.add(
    "prune_beam", f"with {_CAND_SQL} select cand_id from cands order by log_prob desc, cand_id limit 25"
)
def prune_beam(spark: SparkSession, sf: str) -> DataFrame:
    return cd.prune_topk(_candidates(spark, sf), 25).select("cand_id")


@registry.add(
    "rank_by_score",
    f"""with {_CAND_SQL} select cand_id, row_number() over (order by score desc, cand_id) as rank
from cands where score is not null""",
)
def rank_by_score(spark: SparkSession, sf: str) -> DataFrame:
    return cd.rank_by_score(_candidates(spark, sf)).select("cand_id", "rank")


@registry.add(
    "extend_candidates",
    f"""with {_CAND_SQL},
ranked as (select cand_id, unnest(['lib.prep.' || p_brand, 'lib.red.' || p_type,
    'lib.add.' || p_name, 'lib.model.' || p_type]) as component,
  unnest(['T', 'T', 'T', 'M']) as role from cands)
select c.cand_id as parent, r.component, round(log_prob - 0.5, 6) as log_prob,
  case when role = 'T' then 3 else 2 end as depth
from cands c join ranked r using (cand_id)
where r.component not in ('lib.prep.' || p_brand, 'lib.red.' || p_type)""",
)
def extend_candidates(spark: SparkSession, sf: str) -> DataFrame:
    cands = _candidates(spark, sf)
    options = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.concat(F.lit(prefix), col).alias("component"))
            for role, prefix, col in (
                ("T", "lib.prep.", "p_brand"), ("T", "lib.red.", "p_type"),
                ("T", "lib.add.", "p_name"), ("M", "lib.model.", "p_type"),
            )
        ]
    )
    ranked = cands.select("cand_id", F.inline(options)).select(
        "*", F.lit(False).alias("wrap"), F.lit(-0.5).alias("log_prob")
    )
    parents = cands.withColumn(
        "steps", F.transform("steps", lambda s: s.withField(
            "log_prob", F.col("cand_id").cast("double")))
    )
    last = F.element_at("steps", -1)["component"]
    return cd.extend(parents, ranked).select(
        F.element_at("steps", 1)["log_prob"].cast("long").alias("parent"),
        last.alias("component"), neat(F.col("log_prob")).alias("log_prob"), "depth",
    )


@registry.add(
    "enumerate_configs",
    """
with t as (select distinct p_type as t from part), m as (select distinct p_name as m from part),
s as (select t || w as s from t, (values (':0'), (':1')) v(w)),
c as (select s as c from s union all select a.s || ' ' || b.s from s a, s b)
select c || ' ' || m || ':0' as config from c, m""",
)
def enumerate_configs(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    configs = cd.enumerate_configs(spark, part.select("p_type"), part.select("p_name"), 2)
    text = F.transform(
        "steps",
        lambda s: F.concat_ws(":", s["component"], s["wrap"].cast("int").cast("string")),
    )
    return configs.select(F.array_join(text, " ").alias("config"))


@registry.add(
    "search_summary",
    """select case when p_size % 3 = 0 then 'M' else 'T' end as role, p_type as component,
  p_size % 2 = 0 as wrap, count(*) as tried,
  round(avg((p_partkey % 4 <> 0)::int::double), 6) as success_rate,
  round(sum(p_retailprice), 2) as seconds from part group by all""",
)
def search_summary(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "part").select(
        F.when(F.col("p_size") % 3 == 0, "M").otherwise("T").alias("role"),
        F.col("p_type").alias("component"), (F.col("p_size") % 2 == 0).alias("wrap"),
        (F.col("p_partkey") % 4 != 0).alias("success"), F.col("p_retailprice").alias("seconds"),
    )
    return cd.search_summary(log).withColumns(
        {"success_rate": neat(F.col("success_rate")), "seconds": neat(F.col("seconds"), 2)}
    )


@registry.add(
    "render_candidates",
    """select p_partkey as cand_id, 'import lib.model' || chr(10) || 'import lib.prep' || chr(10)
  || 'import lib.red' || chr(10) || 'from pyspark.ml import Pipeline' || chr(10) || 't0 = '
  || case when p_size % 2 = 0 then 'ColumnLoop(lib.prep.' || p_brand || ')'
     else 'lib.prep.' || p_brand || '()' end || chr(10)
  || 't1 = lib.red.' || p_type || '()' || chr(10) || 'model = lib.model.' || p_name || '()'
  || chr(10) || 'p = Pipeline(stages=[t0, t1, model])' || chr(10) || 'fitted = p.fit(train)'
  || chr(10) || 'print(score(fitted.transform(val)))' || chr(10) || 'fitted = p.fit(full)'
  || chr(10) || 'predictions = fitted.transform(test)' as code from part""",
)
def render_candidates(spark: SparkSession, sf: str) -> DataFrame:
    model = cd.step(F.lit("M"), F.concat(F.lit("lib.model."), "p_name"), F.lit(False), F.lit(0.0))
    return _candidates(spark, sf).select(
        "cand_id", cd.render(F.concat("steps", F.array(model))).alias("code")
    )


# ---------------------------------------------------------------- timing experiments

_TIMES_SQL = """plain as (select o_orderkey as script, 1 + o_orderkey % 20 + o_totalprice / 1e6
    as time_no_instr from orders),
instr as (select l_orderkey as script, sum(l_quantity) as time_instr from lineitem
  group by l_orderkey),
pairs as (select * from plain left join instr using (script)),
good as (select *, time_instr / time_no_instr as ratio from pairs
  where time_instr > time_no_instr)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    plain = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("script"),
        (1 + F.col("o_orderkey") % 20 + F.col("o_totalprice") / 1e6).alias("time"),
    )
    instrumented = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("script")
    ).agg(F.sum("l_quantity").alias("time"))
    return xp.pair_times(plain, instrumented)


@registry.add(
    "pair_times",
    f"""with {_TIMES_SQL} select script, round(time_no_instr, 9) as time_no_instr, time_instr
from pairs""",
)
def pair_times(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).withColumn("time_no_instr", neat(F.col("time_no_instr"), 9))


@registry.add(
    "bad_pairs",
    f"""with {_TIMES_SQL} select (select count(*) from good) as kept,
  (select count(*) from pairs) - (select count(*) from good) as dropped""",
)
def bad_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return xp.bad_pairs(_pairs(spark, sf))


@registry.add(
    "overhead_ratio", f"with {_TIMES_SQL} select script, round(ratio, 6) as ratio from good"
)
def overhead_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = xp.overhead_ratio(xp.drop_bad_pairs(_pairs(spark, sf)))
    return rows.select("script", neat(F.col("ratio")).alias("ratio"))


@registry.add(
    "ratio_summary",
    f"""with {_TIMES_SQL} select count(*) as scripts, round(avg(ratio), 6) as ratio_mean,
  round(stddev_samp(ratio), 6) as ratio_std, round(avg(time_no_instr) / 60, 6) as plain_mins_mean,
  round(stddev_samp(time_no_instr) / 60, 6) as plain_mins_std,
  round(avg(time_instr) / 60, 6) as instr_mins_mean,
  round(stddev_samp(time_instr) / 60, 6) as instr_mins_std from good""",
)
def ratio_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = xp.ratio_summary(xp.overhead_ratio(xp.drop_bad_pairs(_pairs(spark, sf))))
    return rows.select(
        "scripts", *[neat(F.col(c)).alias(c) for c in rows.columns if c != "scripts"]
    )


@registry.add(
    "ratio_histogram",
    f"""with {_TIMES_SQL}, b as (select least(floor(ratio) - 1, 27)::int as bin from good
  where ratio between 1 and 29)
select bin, round(count(*) / (select count(*) from b)::double, 6) as density from b group by bin""",
)
def ratio_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = xp.histogram(xp.overhead_ratio(xp.drop_bad_pairs(_pairs(spark, sf))))
    return rows.withColumn("density", neat(F.col("density")))
