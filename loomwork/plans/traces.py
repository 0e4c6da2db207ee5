"""Call-event, tagging and training-row queries (groups E, T and L)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.functions.ordered import running
from loomwork.functions.stats import neat
from loomwork.functions.text import last_segment
from loomwork.operators import events as ev, experiments, sequences as sq, tagging as tg
from loomwork.plans.common import Registry, table

registry = Registry()

def cents():
    return F.round(F.col("value") * 100).cast("long")

# ---------------------------------------------------------------- recorded events

RAW_SQL = """base as (select *, round(value * 100)::bigint as cents from events),
raw as (select user_id::varchar as script, event_id as seq,
  case event_type when 'signup' then 'enter' when 'error' then 'exit' when 'purchase' then 'dep'
    else 'call' end as kind,
  cents % 6 as site, cents % 4 as loop_id,
  case when cents % 5 = 0 then 'numpy.lib' else 'sklearn.m' || (cents % 3) end as func_module,
  'f' || (cents % 6) as func_name,
  case when event_type in ('view', 'click') then [cents % 7, (cents // 7) % 7]
    when event_type = 'purchase' and cents % 2 = 1 then [cents % 7] end as value_ids,
  case when event_type = 'purchase' then [(cents // 7) % 7] end as lhs_ids
  from base),
numbered as (select *, sum((kind = 'call')::int) over (partition by script order by seq) - 1
  as call_id from raw)"""
_LOOP_SQL = f"""{RAW_SQL},
s1 as (select *, sum(case kind when 'enter' then 1 when 'exit' then -1 else 0 end)
  over (partition by script order by seq) as up from numbered),
s2 as (select *, least(0, coalesce(min(up) over (partition by script order by seq
  rows between unbounded preceding and 1 preceding), 0)) as low from s1),
s3 as (select *, up - least(low, up) as depth, kind = 'exit' and up < low as stray from s2),
s4 as (select *, sum((kind = 'enter' and depth = 1)::int) over (partition by script order by seq)
    as episode,
  case when depth > 0 then last_value(case when kind = 'enter' then loop_id end ignore nulls)
    over (partition by script, depth order by seq) end as current_loop from s3)"""
_REPEAT_SQL = f"""{_LOOP_SQL},
calls as (select *, row_number() over (partition by script, episode, current_loop, site
    order by seq) as rn from s4
  where kind = 'call' and split_part(func_module, '.', 1) in ('sklearn', 'xgboost') and depth > 0
  union all select *, 1 from s4
  where kind = 'call' and split_part(func_module, '.', 1) in ('sklearn', 'xgboost') and depth = 0),
kept as (select * from calls where rn = 1)"""
_DEPS_SQL = f"""touch as (
  select script, unnest(lhs_ids) as v, seq * 2 + 1 as k, seq as write from numbered
    where kind = 'dep'
  union select script, unnest(value_ids), seq * 2, null from numbered
    where value_ids is not null),
found as (select * from (select script, k // 2 as reader, write, max(write) over (
    partition by script, v order by k) as source from touch) where write is null),
links as (select distinct f.script, f.reader,
    case when n.seq is not null and n.value_ids is not null then f.source end as next,
    case when f.source is null then -1 when n.value_ids is null then n.call_id end as origin
  from found f left join numbered n on n.script = f.script and n.seq = f.source),
walk as (select * from links union
  select w.script, w.reader, l.next, l.origin from walk w
    join links l on l.script = w.script and l.reader = w.next),
deps as (select script, reader as seq, list_sort(list(distinct origin)) as d from walk
  where origin is not null group by all)"""


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    t, c = F.col("event_type"), F.col("cents")
    a, b = c % 7, F.floor(c / 7) % 7
    return table(spark, sf, "events").withColumn("cents", cents()).select(
        F.col("user_id").cast("string").alias("script"), F.col("event_id").alias("seq"),
        F.when(t == "signup", "enter").when(t == "error", "exit").when(t == "purchase", "dep")
        .otherwise("call").alias("kind"),
        (c % 6).cast("int").alias("static_instr_id"), (c % 4).cast("int").alias("loop_id"),
        F.when(c % 5 == 0, F.lit("numpy.lib")).otherwise(F.concat(F.lit("sklearn.m"), c % 3))
        .alias("func_module"),
        F.concat(F.lit("f"), c % 6).alias("func_name"),
        F.when(t.isin("view", "click"), F.array(a, b))
        .when((t == "purchase") & (c % 2 == 1), F.array(a)).alias("value_ids"),
        F.when(t == "purchase", F.array(b)).alias("lhs_ids"),
    )


@registry.add("number_calls", f"with {RAW_SQL} select script, seq, call_id from numbered")
def number_calls(spark: SparkSession, sf: str) -> DataFrame:
    return ev.number_calls(raw_events(spark, sf)).select("script", "seq", "call_id")


@registry.add(
    "filter_relevant",
    f"""with {RAW_SQL} select script, seq, func_module from raw
where kind = 'call' and split_part(func_module, '.', 1) in ('sklearn', 'xgboost')""",
)
def filter_relevant(spark: SparkSession, sf: str) -> DataFrame:
    calls = raw_events(spark, sf).filter("kind = 'call'")
    return ev.filter_relevant(calls).select("script", "seq", "func_module")


@registry.add(
    "loop_context",
    f"with {_LOOP_SQL} select script, seq, depth, stray, episode, current_loop from s4",
)
def loop_context(spark: SparkSession, sf: str) -> DataFrame:
    return ev.loop_context(raw_events(spark, sf)).select(
        "script", "seq", "depth", "stray", "episode", "current_loop"
    )


@registry.add(
    "suppress_loop_repeats",
    f"with {_REPEAT_SQL} select script, seq, current_loop, site from kept",
)
def suppress_loop_repeats(spark: SparkSession, sf: str) -> DataFrame:
    placed = ev.loop_context(raw_events(spark, sf)).filter("kind = 'call'")
    return ev.suppress_loop_repeats(ev.filter_relevant(placed)).select(
        "script", "seq", "current_loop", F.col("static_instr_id").alias("site")
    )


@registry.add(
    "resolve_dependencies",
    f"""with recursive {RAW_SQL}, {_DEPS_SQL}
select n.script, n.seq, array_to_string(coalesce(d, []), ',') as dependencies
from numbered n left join deps using (script, seq) where kind = 'call'""",
)
def resolve_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    numbered = ev.number_calls(raw_events(spark, sf))
    return ev.resolve_dependencies(numbered).select(
        "script", "seq", F.array_join("dependencies", ",").alias("dependencies")
    )


@registry.add(
    "last_write_before_read",
    f"""with {RAW_SQL}, {_DEPS_SQL.split("links as")[0].rstrip().rstrip(",")}
select script, reader, count(*) as reads, count(source) as known, max(source) as latest
from found group by all""",
)
def last_write_before_read(spark: SparkSession, sf: str) -> DataFrame:
    """The as-of step alone: the latest write of each value before each read."""
    rows = raw_events(spark, sf)
    writes = rows.filter("kind = 'dep'").select(
        "script", F.explode("lhs_ids").alias("v"), (F.col("seq") * 2 + 1).alias("at"),
        F.col("seq").alias("write"),
    )
    reads = rows.filter("value_ids is not null").select(
        "script", F.explode("value_ids").alias("v"), (F.col("seq") * 2).alias("at"),
        F.lit(None).cast("long").alias("write"),
    )
    found = running(
        writes.unionByName(reads).distinct(), ["script", "v"], "at",
        lasts={"source": F.col("write")},
    ).filter("write is null")
    return found.groupBy("script", (F.col("at") / 2).cast("long").alias("reader")).agg(
        F.count(F.lit(1)).alias("reads"), F.count("source").alias("known"),
        F.max("source").alias("latest"),
    )


@registry.add(
    "reduce_events",
    f"""with recursive {_REPEAT_SQL}, {_DEPS_SQL}
select k.script, k.call_id, site, current_loop, k.func_module, k.func_name,
  array_to_string(coalesce(d, []), ',') as dependencies
from kept k left join deps using (script, seq)""",
)
def reduce_events(spark: SparkSession, sf: str) -> DataFrame:
    return ev.reduce_events(raw_events(spark, sf)).select(
        "script", "call_id", F.col("static_instr_id").alias("site"),
        F.col("static_loop_id").alias("current_loop"), "func_module", "func_name",
        F.array_join("dependencies", ",").alias("dependencies"),
    )


@registry.add(
    "attach_arg_features",
    f"""with {RAW_SQL},
feats as (select cents % 7 as value_id, count(*)::double as n, round(avg(value), 6) as m
  from base group by all),
args as (select script, call_id, unnest(value_ids) as value_id,
    generate_subscripts(value_ids, 1) - 1 as arg from numbered where kind = 'call')
select script, call_id, arg, f.feature, f.num from args join (
  select value_id, 'num_rows' as feature, n as num from feats
  union all select value_id, 'mean', m from feats) f using (value_id)""",
)
def attach_arg_features(spark: SparkSession, sf: str) -> DataFrame:
    profile = (
        table(spark, sf, "events").groupBy((cents() % 7).alias("value_id"))
        .agg(F.count(F.lit(1)).cast("double").alias("num_rows"),
             neat(F.avg("value")).alias("mean"))
    )
    features = profile.unpivot(
        "value_id", ["num_rows", "mean"], "feature", "num"
    ).withColumn("str", F.lit(None).cast("string"))
    calls = ev.number_calls(raw_events(spark, sf)).filter("kind = 'call'")
    return ev.attach_arg_features(calls, features, "value_ids").drop("str")


# ---------------------------------------------------------------- tagging

CALLS_SQL = """calls0 as (select user_id::varchar as script, event_type,
    row_number() over (partition by user_id order by event_id) - 1 as call_id,
    round(value * 100)::bigint as c from events),
calls as (select script, call_id, c,
  case event_type when 'signup' then 'lib.m' || (c % 4) when 'error' then
    (case when c % 4 = 0 then 'sklearn.preprocessing.data' else 'numpy' end)
    else 'lib.base' end as func_module,
  case event_type when 'view' then 'Base.fit' when 'click' then
    (case when c % 4 = 3 then 'Base.summary' else 'Base.transform' end)
    when 'purchase' then (case when c % 4 = 1 then 'predict' else 'report' end)
    when 'signup' then 'Est' || (c % 4) else 'helper' end as func_name,
  case when event_type in ('signup', 'error') then 'builtins' else 'lib.m' || (c % 4) end
    as caller_type_module,
  case when event_type in ('signup', 'error') then 'NoneType' else 'Est' || (c % 4) end
    as caller_type_name,
  list_distinct([case when c % 3 = 0 or call_id = 0 then -1 else call_id - 1 end]
    || case when c % 5 = 0 and call_id >= 2 then [call_id - 2] else [] end) as dependencies
  from calls0),
named as (select *, case when caller_type_name = 'NoneType' then func_module || '.' || func_name
    else caller_type_module || '.' || caller_type_name end as component,
  split_part(func_name, '.', -1) as method,
  case when starts_with(func_module, 'sklearn.preprocessing') then 'T' end as pre from calls),
links as (select script, call_id, unnest(dependencies) as dep from calls),
edges as (select l.* from links l join calls c on c.script = l.script and c.call_id = l.dep)"""
_NAMES_SQL = f"""{CALLS_SQL},
models1 as (select distinct script, component from named where method in ('predict', 'score')),
models2 as (select distinct script, component from named where method in ('fit', 'train')
  except select script, component from named where method in ('fit_transform', 'transform')),
tag0 as (select n.*, coalesce(pre, case when method in ('predict', 'score') then 'E'
    when (script, component) in (select (script, component) from models1) or
      (script, component) in (select (script, component) from models2) then 'M' end) as tag
  from named n)"""
_SPREAD_SQL = f"""{_NAMES_SQL},
back as (select t.script, t.call_id as m, e.dep as node from tag0 t join edges e using
    (script, call_id) where tag = 'M'
  union select b.script, b.m, e.dep from back b join edges e
    on e.script = b.script and e.call_id = b.node),
fwd as (select t.script, t.call_id as m, e.call_id as node from tag0 t join edges e
    on e.script = t.script and e.dep = t.call_id where tag = 'M'
  union select f.script, f.m, e.call_id from fwd f join edges e
    on e.script = f.script and e.dep = f.node),
first as (select script, node, min(case when w = 'b' then m end) as mb,
    min(case when w = 'f' then m end) as mf
  from (select *, 'b' as w from back union all select *, 'f' from fwd) group by all),
tag1 as (select t.*, coalesce(tag, case when mb is not null and (mf is null or mb <= mf) then 'T'
    when mf is not null then 'E' end) as spread
  from tag0 t left join first f on f.script = t.script and f.node = t.call_id),
eback as (select f.script, f.m, e.dep as node from fwd f join tag1 t on t.script = f.script
    and t.call_id = f.node and t.spread = 'E' join edges e on e.script = f.script
    and e.call_id = f.node
  union select b.script, b.m, e.dep from eback b join edges e
    on e.script = b.script and e.call_id = b.node),
member as (select script, node as call_id, m from back union select script, node, m from fwd
  union select script, node, m from eback
  union select script, call_id, call_id from tag0 where tag = 'M'),
tagged as (select t.script, t.call_id, component, coalesce(spread, 'O') as tag,
    case when pre is not null then 'predefined' when tag = 'M' then 'name_based' else 'set' end
      as source_tag, ids
  from tag1 t left join (select script, call_id, list_sort(list(m)) as ids from member
    group by all) using (script, call_id))"""


def trace_calls(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "events").withColumns(
        {"script": F.col("user_id").cast("string"), "c": cents()}
    )
    counted = running(
        base, ["script"], "event_id", sums={"n": F.lit(1).cast("long")}
    ).withColumn("call_id", F.col("n") - 1)
    t, c, k = F.col("event_type"), F.col("c"), F.col("call_id")
    free = t.isin("signup", "error")
    return counted.select(
        "script", "call_id",
        F.when(t == "signup", F.concat(F.lit("lib.m"), c % 4))
        .when(t == "error", F.when(c % 4 == 0, "sklearn.preprocessing.data").otherwise("numpy"))
        .otherwise("lib.base").alias("func_module"),
        F.when(t == "view", "Base.fit")
        .when(t == "click", F.when(c % 4 == 3, "Base.summary").otherwise("Base.transform"))
        .when(t == "purchase", F.when(c % 4 == 1, "predict").otherwise("report"))
        .when(t == "signup", F.concat(F.lit("Est"), c % 4)).otherwise("helper")
        .alias("func_name"),
        F.when(free, "builtins").otherwise(F.concat(F.lit("lib.m"), c % 4))
        .alias("caller_type_module"),
        F.when(free, "NoneType").otherwise(F.concat(F.lit("Est"), c % 4))
        .alias("caller_type_name"),
        F.array_distinct(
            F.concat(
                F.array(F.when((c % 3 == 0) | (k == 0), F.lit(-1)).otherwise(k - 1)),
                F.when((c % 5 == 0) & (k >= 2), F.array(k - 2))
                .otherwise(F.array().cast("array<bigint>")),
            )
        ).alias("dependencies"),
    )


@registry.add(
    "component_name", f"with {CALLS_SQL} select script, call_id, component from named"
)
def component_name(spark: SparkSession, sf: str) -> DataFrame:
    return trace_calls(spark, sf).select(
        "script", "call_id", tg.component_name().alias("component")
    )


@registry.add(
    "calls_to_methods",
    f"""with {CALLS_SQL} select script, call_id, func_name from named
where method in ('fit', 'predict')""",
)
def calls_to_methods(spark: SparkSession, sf: str) -> DataFrame:
    return trace_calls(spark, sf).filter(tg.calls_method("fit", "predict")).select(
        "script", "call_id", "func_name"
    )


@registry.add("predefined_tag", f"with {CALLS_SQL} select script, call_id, pre as tag from named")
def predefined_tag(spark: SparkSession, sf: str) -> DataFrame:
    return trace_calls(spark, sf).select(
        "script", "call_id", tg.predefined_tag().alias("tag")
    )


@registry.add(
    "eval_tags",
    f"""with {CALLS_SQL} select script, call_id, coalesce(pre, case when method in
  ('predict', 'score') then 'E' end) as tag from named""",
)
def eval_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tg.eval_pass(trace_calls(spark, sf)).select("script", "call_id", "tag")


@registry.add(
    "model_components",
    f"""with {_NAMES_SQL} select script, component, min(rule) as rule from (
  select *, 1 as rule from models1 union all select *, 2 from models2) group by all""",
)
def model_components(spark: SparkSession, sf: str) -> DataFrame:
    return tg.model_components(trace_calls(spark, sf))


@registry.add("name_based_tags", f"with {_NAMES_SQL} select script, call_id, tag from tag0")
def name_based_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tg.name_based_tags(trace_calls(spark, sf)).select("script", "call_id", "tag")


def _predicting(calls: DataFrame) -> DataFrame:
    return calls.filter(tg.calls_method("predict")).select(
        "script", F.col("call_id").alias("seed"), F.col("call_id").alias("node")
    )


@registry.add(
    "backward_dependencies",
    f"""with recursive {CALLS_SQL},
r as (select n.script, n.call_id as seed, e.dep as node from named n join edges e
    using (script, call_id) where method = 'predict'
  union select r.script, r.seed, e.dep from r join edges e
    on e.script = r.script and e.call_id = r.node)
select script, seed, node from r""",
)
def backward_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    calls = trace_calls(spark, sf)
    return tg.backward_deps(calls, _predicting(calls)).select("script", "seed", "node")


@registry.add(
    "forward_dependencies",
    f"""with recursive {CALLS_SQL},
r as (select n.script, n.call_id as seed, e.call_id as node from named n join edges e
    on e.script = n.script and e.dep = n.call_id where method = 'predict'
  union select r.script, r.seed, e.call_id from r join edges e
    on e.script = r.script and e.dep = r.node)
select script, seed, node from r""",
)
def forward_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    calls = trace_calls(spark, sf)
    return tg.forward_deps(calls, _predicting(calls)).select("script", "seed", "node")


@registry.add(
    "tag_entries",
    f"""with recursive {_SPREAD_SQL} select script, call_id, component, tag, source_tag,
  array_to_string(coalesce(ids, [-1]), ',') as model_ids from tagged""",
)
def tag_entries(spark: SparkSession, sf: str) -> DataFrame:
    return tg.tag_entries(trace_calls(spark, sf)).select(
        "script", "call_id", "component", "tag", "source_tag",
        F.array_join("model_ids", ",").alias("model_ids"),
    )


_PROGRAM_SQL = f"""{_SPREAD_SQL},
sets as (select script, m, list_sort(list(call_id)) as calls from member group by all),
uniq as (select script, min(m) as m from sets group by script, calls),
prog as (select u.script, 'm' || u.m as prog, call_id,
    row_number() over (partition by u.script, u.m order by call_id) - 1 as pos
  from uniq u join member using (script, m)
  union all select script, 'c' || call_id, call_id, 0 from tagged where ids is null)"""


@registry.add(
    "linearize",
    f"with recursive {_PROGRAM_SQL} select script, prog, pos, call_id from prog",
)
def linearize(spark: SparkSession, sf: str) -> DataFrame:
    tagged, pairs = tg.tag_calls(trace_calls(spark, sf))
    return tg.linearize(tagged, pairs).select("script", "prog", "pos", "call_id")


@registry.add(
    "project_calls",
    f"with {CALLS_SQL} select call_id, script, method as func_name from named",
)
def project_calls(spark: SparkSession, sf: str) -> DataFrame:
    return tg.project_calls(
        trace_calls(spark, sf), ["call_id", "script", ("func_name", last_segment)]
    )


@registry.add(
    "index_calls",
    """select script, call_id, arg_max(event_type, event_id) as event_type from (
  select user_id::varchar as script, round(value)::bigint % 10 as call_id, event_type, event_id
  from events) group by all""",
)
def index_calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("script"),
        (F.round("value").cast("long") % 10).alias("call_id"), "event_type",
        F.col("event_id").alias("seq"),
    )
    return tg.index_calls(rows).drop("seq")


@registry.add(
    "trace_graph",
    f"""with {CALLS_SQL}
select script, 'node' as kind, call_id as a, null::bigint as b,
  func_module || '.' || func_name as label from calls
union all select script, 'edge', dep, call_id, null from links where dep <> -1""",
)
def trace_graph(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.trace_graph(trace_calls(spark, sf))


# ---------------------------------------------------------------- training rows

_TURNS_SQL = """turns as (select conv_id as prog, turn as pos, role as component,
  case role when 'system' then 'O' when 'user' then 'T' else 'M' end as tag, text
  from conversations),
runs as (select *, sum((component is distinct from prev)::int) over (partition by prog
    order by pos) as run from (select *, lag(component) over (partition by prog order by pos)
    as prev from turns)),
heads as (select prog, run, any_value(component) as component from runs group by all),
grams as (select prog, run, lag(component, 2, '<START>') over w as p0,
    lag(component, 1, '<START>') over w as p1, component
  from heads window w as (partition by prog order by run))"""
_OBS_SQL = f"""{_TURNS_SQL},
obs as (select r.prog, r.pos, r.tag as role, p0, p1, r.component, text
  from runs r join grams using (prog, run) where tag <> 'O')"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(F.col("role") == "system", "O").when(F.col("role") == "user", "T").otherwise("M")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("prog"), F.col("turn").alias("pos"),
        F.col("role").alias("component"), tag.alias("tag"), "text",
    )


@registry.add(
    "call_arity",
    f"""with {CALLS_SQL} select script, call_id, component as component_name,
  len(dependencies) as nargs from named""",
)
def call_arity(spark: SparkSession, sf: str) -> DataFrame:
    calls = trace_calls(spark, sf).withColumnRenamed("dependencies", "args")
    return sq.add_extra_info(calls).select("script", "call_id", "component_name", "nargs")


@registry.add(
    "ngrams",
    """select user_id, event_id, lag(event_type, 2, '<START>') over w || ' '
  || lag(event_type, 1, '<START>') over w || ' ' || event_type as ngram
from events window w as (partition by user_id order by event_id)""",
)
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    rows = sq.ngrams(
        table(spark, sf, "events"), 3, ["user_id"], "event_id", "event_type"
    )
    return rows.select("user_id", "event_id", F.array_join("ngram", " ").alias("ngram"))


_EVENT_RUNS_SQL = """runs as (select *, sum((event_type is distinct from prev)::int) over (
    partition by user_id order by event_id) as run from (select *, lag(event_type) over (
    partition by user_id order by event_id) as prev from events)),
grams as (select user_id, run, lag(et, 2, '<START>') over w as p0,
    lag(et, 1, '<START>') over w as p1, et
  from (select user_id, run, any_value(event_type) as et from runs group by all)
  window w as (partition by user_id order by run))"""


@registry.add(
    "seq_unique_ngrams",
    f"""with {_EVENT_RUNS_SQL} select user_id, event_id, p0 || ' ' || p1 || ' ' || et as ngram
from runs join grams using (user_id, run)""",
)
def seq_unique_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    rows = sq.seq_unique_ngrams(
        table(spark, sf, "events"), 3, ["user_id"], "event_id", "event_type"
    )
    return rows.select("user_id", "event_id", F.array_join("ngram", " ").alias("ngram"))


@registry.add(
    "observations",
    f"with {_OBS_SQL} select prog, pos, role, p0 || ' ' || p1 as prev, component from obs",
)
def observations(spark: SparkSession, sf: str) -> DataFrame:
    return sq.observations(turns(spark, sf), 3, dense=True).select(
        "prog", "pos", "role", F.array_join("prev", " ").alias("prev"), "component"
    )


# argument features of a turn: its length, a ratio that is NaN on first turns, a type name and
# a bookkeeping feature
_ARGS_SQL = """args as (
  select conv_id as prog, turn as pos, 0 as arg, 'length' as feature, length(text)::double as num,
    null as str from conversations
  union all select conv_id, turn, 0, 'ratio',
    case when turn = 0 then 'nan'::double else length(text) / turn end, null from conversations
  union all select conv_id, turn, 1, 'arg_type', null,
    case when length(text) % 2 = 0 then 'DataFrame' else 'ndarray' end from conversations
  union all select conv_id, turn, 1, 'num_rows_sampled', 100, null from conversations),
good as (select * from args where feature <> 'num_rows_sampled'
  and (num is null or (not isnan(num) and not isinf(num))))"""
ROWS_SQL = f"""{_OBS_SQL}, {_ARGS_SQL},
rows as (select prog, pos, 'prev_component_0' as feature, null::double as num, p0 as str from obs
  union all select prog, pos, 'prev_component_1', null, p1 from obs
  union all select prog, pos, 'role', null, role from obs
  union all select prog, pos, 'arg_' || arg || '_' || feature, num, str from good
    where (prog, pos) in (select (prog, pos) from obs)),
enc as (select prog, pos, case when str is null then feature else feature || '=' || str end as name,
  case when str is null then num else 1.0 end as value from rows),
vocab as (select name, row_number() over (order by name) - 1 as idx
  from (select distinct name from enc))"""


def arg_features(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("text").cast("double")
    none = F.lit(None).cast("string")
    entries = F.array(
        _entry(0, "length", size, none),
        _entry(0, "ratio", F.when(F.col("turn") == 0, F.lit(math.nan))
               .otherwise(F.try_divide(size, F.col("turn"))), none),
        _entry(1, "arg_type", F.lit(None).cast("double"),
               F.when(F.length("text") % 2 == 0, "DataFrame").otherwise("ndarray")),
        _entry(1, "num_rows_sampled", F.lit(100.0), none),
    )
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("prog"), F.col("turn").alias("pos"), F.inline(entries)
    )


def _entry(arg: int, feature: str, num, text):
    return F.struct(
        F.lit(arg).alias("arg"), F.lit(feature).alias("feature"),
        num.cast("double").alias("num"), text.cast("string").alias("str"),
    )


@registry.add(
    "clean_features", f"with {_ARGS_SQL} select prog, pos, arg, feature, num, str from good"
)
def clean_features(spark: SparkSession, sf: str) -> DataFrame:
    return sq.clean_features(arg_features(spark, sf))


@registry.add(
    "feature_rows", f"with {ROWS_SQL} select prog, pos, feature, round(num, 6) as num, str from rows"
)
def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    obs = sq.observations(turns(spark, sf), 3, dense=True)
    return sq.feature_rows(obs, ["prog", "pos"], arg_features(spark, sf)).withColumn(
        "num", F.round("num", 6)
    )


@registry.add(
    "vectorize",
    f"""with {ROWS_SQL} select prog, pos, idx, round(value, 6) as value
from enc join vocab using (name)""",
)
def vectorize(spark: SparkSession, sf: str) -> DataFrame:
    obs = sq.observations(turns(spark, sf), 3, dense=True)
    rows = sq.feature_rows(obs, ["prog", "pos"], arg_features(spark, sf))
    return sq.vectorize(rows, ["prog", "pos"], sq.vocabulary(rows)).withColumn(
        "value", F.round("value", 6)
    )


@registry.add(
    "encode_labels",
    """with classes as (select c, row_number() over (order by c) - 1 as label from
  (select distinct p_name || ' ' || p_type as c from part))
select p_partkey, label from part join classes on c = p_name || ' ' || p_type""",
)
def encode_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("c")
    )
    return sq.encode_labels(labels, "c", sq.label_classes(labels, "c")).drop("c")


@registry.add(
    "previous_components",
    "select p_partkey, p_type || ' ' || p_name as last2, case when p_size % 2 = 0 then "
    "'<START> ' || p_brand else p_brand || ' ' || p_type end as short2 from part",
)
def previous_components(spark: SparkSession, sf: str) -> DataFrame:
    long = F.array("p_brand", "p_type", "p_name")
    short = F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(
        F.array("p_brand", "p_type")
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(sq.previous_components(long, 3), " ").alias("last2"),
        F.array_join(sq.previous_components(short, 3), " ").alias("short2"),
    )


@registry.add(
    "component_catalog", f"with {_OBS_SQL} select distinct role, component from obs"
)
def component_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return sq.component_catalog(sq.observations(turns(spark, sf), 2, dense=True))
