"""Source-text queries (group P, code mode of D, notebooks of S).

The tables hold prose, so each document becomes a script whose statements follow from the
lengths of its lines, and a notebook with one cell per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwork.operators import corpus, events as ev, parsing
from loomwork.plans.common import Registry, table
from loomwork.sources import notebooks as nb

registry = Registry()

HEADER = (
    "import numpy as np\n"
    "from lib.models import Estimator as Est\n"
    "from joblib import Parallel, delayed"
)

# every line of a document, with the statement kind its length selects
_LINES_SQL = """lines as (select doc_id, i, length(line) as n, length(line) % 6 as k
  from (select doc_id, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents
    where doc_id % 17 <> 0))"""
_CALLS_SQL = f"""{_LINES_SQL},
found as (select doc_id, i, unnest(case k
    when 0 then [{{'j': 0, 't': 'np.zeros', 'm': 'numpy', 'q': 'zeros', 'e': null}}]
    when 1 then [{{'j': 0, 't': 'Est', 'm': 'lib.models', 'q': 'Estimator', 'e': null}},
      {{'j': 1, 't': 'm' || i || '.fit', 'm': 'lib.models', 'q': 'Estimator.fit', 'e': null}}]
    when 2 then [{{'j': 0, 't': 'max', 'm': 'builtins', 'q': 'max', 'e': null}},
      {{'j': 1, 't': 'print', 'm': 'builtins', 'q': 'print', 'e': null}}]
    when 3 then [{{'j': 0, 't': 'missing', 'm': null, 'q': null, 'e': 'func lookup failed'}},
      {{'j': 1, 't': 'missing(1)[0]', 'm': null, 'q': null, 'e': 'calling subscripted func'}}]
    when 4 then [{{'j': 0, 't': 'np.exp', 'm': 'numpy', 'q': 'exp', 'e': null}},
      {{'j': 1, 't': 'range', 'm': 'builtins', 'q': 'range', 'e': null}}]
    else [{{'j': 0, 't': 's.append', 'm': null, 'q': 'list.append', 'e': null}},
      {{'j': 1, 't': 'lambda: 0', 'm': null, 'q': null, 'e': 'calling lambda'}}] end) as c
  from lines),
calls as (select doc_id, row_number() over (partition by doc_id order by i, c.j) - 1 as seq,
    c.t as func_text, c.m as module, split_part(c.q, '.', -1) as name, c.q as qualname, c.e as err
  from found)"""


def _statement(line: Column, i: Column) -> Column:
    n, pos = F.length(line).cast("string"), i.cast("string")
    k = F.length(line) % 6
    return (
        F.when(k == 0, F.concat(F.lit("v"), pos, F.lit(" = np.zeros("), n, F.lit(")")))
        .when(k == 1, F.concat(F.lit("m"), pos, F.lit(" = Est(alpha="), n, F.lit(")\nm"), pos,
                               F.lit(".fit(np)")))
        .when(k == 2, F.concat(F.lit("print(max("), n, F.lit(", 3))")))
        .when(k == 3, F.lit("missing(1)[0](2)"))
        .when(k == 4, F.concat(
            F.lit("Parallel(n_jobs=2)(delayed(np.exp)(x) for x in range("), n, F.lit("))")))
        .otherwise(F.lit("s = []\ns.append(1)\n(lambda: 0)()"))
    )


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source); one document in 17 does not parse."""
    body = F.array_join(F.transform(F.split("text", "\n"), _statement), "\n")
    broken = F.when(F.col("doc_id") % 17 == 0, F.lit("\ndef (")).otherwise("")
    return table(spark, sf, "documents", heavy=True).select(
        "doc_id", F.concat(F.lit(HEADER + "\n"), body, broken).alias("source")
    )


@registry.add(
    "extract_calls",
    f"with {_CALLS_SQL} select doc_id, seq, func_text, module, name, qualname, err from calls",
)
def extract_calls(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.extract_calls(scripts(spark, sf), "doc_id")


@registry.add(
    "extract_imports",
    """select doc_id, unnest([0, 1, 2]) as seq, unnest(['numpy', 'lib.models', 'joblib']) as module
from documents where doc_id % 17 <> 0""",
)
def extract_imports(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.extract_imports(scripts(spark, sf), "doc_id")


@registry.add(
    "call_errors",
    f"""with {_CALLS_SQL} select coalesce(err, 'resolved') as err, count(*) as calls from calls
group by all""",
)
def call_errors(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.call_errors(parsing.extract_calls(scripts(spark, sf), "doc_id"))


@registry.add(
    "parse_status",
    f"""with {_CALLS_SQL}, n as (select doc_id, count(*) as calls from calls group by doc_id)
select doc_id, case when doc_id % 17 = 0 then 'syntax_error' else 'ok' end as status,
  coalesce(calls, 0) as calls from documents left join n using (doc_id)""",
)
def parse_status(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.parse_status(scripts(spark, sf), "doc_id")


@registry.add(
    "static_types",
    f"""with {_LINES_SQL}
select doc_id, unnest(['np', 'Est', 'Parallel', 'delayed']) as variable,
  unnest(['numpy', 'lib.models', 'joblib', 'joblib']) as module,
  unnest(['numpy', 'Estimator', 'Parallel', 'delayed']) as type
from documents where doc_id % 17 <> 0
union all select doc_id, 'm' || i, 'lib.models', 'Estimator' from lines where k = 1
union all select distinct doc_id, 's', 'builtins', 'list' from lines where k = 5""",
)
def static_types(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.static_types(scripts(spark, sf), "doc_id")


@registry.add(
    "def_use_events",
    f"""with {_LINES_SQL}
select doc_id, sum(case k when 0 then 1 else 2 end)::bigint as calls,
  sum(case k when 1 then 3 when 5 then 3 else 2 end)::bigint as deps
from lines group by doc_id""",
)
def def_use_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = parsing.def_use_events(scripts(spark, sf), "doc_id")
    return rows.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "call").alias("calls"),
        F.count_if(F.col("kind") == "dep").alias("deps"),
    )


@registry.add("def_use_dependencies")
def def_use_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Source text to reduced call events: parsing and event reduction together."""
    rows = parsing.def_use_events(scripts(spark, sf), "doc_id").withColumnRenamed(
        "doc_id", "script"
    )
    # a script is one row of its table, so its events fit into a task
    return ev.reduce_events(ev.placed(rows, whole=True), modules=False).select(
        "script", "call_id", "func_module", "func_name",
        F.array_join("dependencies", ",").alias("dependencies"),
    )


@registry.add(
    "standardize_code",
    """select doc_id as id from documents where doc_id % 17 <> 0""",
)
def standardize_code(spark: SparkSession, sf: str) -> DataFrame:
    rows = scripts(spark, sf).withColumnRenamed("doc_id", "id")
    return corpus.standardize(rows, "source", code=True).select("id")


# ---------------------------------------------------------------- notebooks

# line i of a document is a code cell unless its length is 4 modulo 5; one document in three
# has the old layout; some cells carry no text
_CELLS_SQL = """cells as (select doc_id, i as cell, length(line) % 5 <> 4 as is_code,
  case when length(line) % 4 = 3 then '' else 'x' || i || ' = max(' || length(line) || ', '
    || i || ')' end as source
  from (select doc_id, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)),
code as (select * from cells where is_code and source <> '')"""


def notebooks(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda s: F.when(F.length(s) % 5 == 4, "markdown").otherwise("code")
    code = lambda s, i: F.when(F.length(s) % 4 == 3, F.lit("")).otherwise(
        F.concat(F.lit("x"), i, F.lit(" = max("), F.length(s), F.lit(", "), i, F.lit(")"))
    )
    outputs = F.array(F.struct(F.lit("out").alias("text")))
    lines = F.split("text", "\n")
    new = F.transform(lines, lambda s, i: F.struct(
        kind(s).alias("cell_type"), code(s, i).alias("source"), outputs.alias("outputs"),
        F.struct(F.lit(True).alias("collapsed")).alias("metadata"),
    ))
    old = F.transform(lines, lambda s, i: F.struct(
        kind(s).alias("cell_type"), code(s, i).alias("input"), outputs.alias("outputs"),
        F.lit(7).alias("prompt_number"),
    ))
    modern = F.to_json(F.struct(
        F.lit(4).alias("nbformat"), new.alias("cells"),
        F.struct(F.lit("s").alias("signature"), F.lit("py").alias("kernel")).alias("metadata"),
    ))
    legacy = F.to_json(F.struct(
        F.lit(3).alias("nbformat"),
        F.array(F.struct(old.alias("cells"))).alias("worksheets"),
        F.struct(F.lit("s").alias("signature")).alias("metadata"),
    ))
    return table(spark, sf, "documents", heavy=True).select(
        F.col("doc_id").alias("script_id"),
        F.when(F.col("doc_id") % 3 == 0, legacy).otherwise(modern).alias("raw"),
    )


@registry.add(
    "notebook_cells", f"with {_CELLS_SQL} select doc_id as script_id, cell, source from code"
)
def notebook_cells(spark: SparkSession, sf: str) -> DataFrame:
    return nb.notebook_cells(notebooks(spark, sf))


@registry.add(
    "notebook_to_script",
    f"""with {_CELLS_SQL}
select doc_id as script_id, coalesce(code, '') as code, 'Python' as language, 'py' as ext
from documents left join (
  select doc_id, string_agg(source, chr(10) || chr(10) order by cell) as code from code
  group by doc_id) using (doc_id)""",
)
def notebook_to_script(spark: SparkSession, sf: str) -> DataFrame:
    return nb.notebook_to_script(notebooks(spark, sf))


@registry.add(
    "strip_notebook_outputs",
    """select doc_id as script_id, false as signature, 0 as outputs, 0 as prompts,
  doc_id % 3 <> 0 as kernel from documents""",
)
def strip_notebook_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of signature, outputs, prompt numbers and other keys."""
    text = F.col("clean")
    return notebooks(spark, sf).select(
        "script_id", nb.strip_notebook_outputs("raw").alias("clean")
    ).select(
        "script_id", text.contains('"signature"').alias("signature"),
        F.size(F.regexp_extract_all(text, F.lit(r'"outputs": \[\{'), F.lit(0))).alias("outputs"),
        F.size(F.regexp_extract_all(text, F.lit(r'"prompt_number": \d'), F.lit(0)))
        .alias("prompts"),
        text.contains('"kernel": "py"').alias("kernel"),
    )


@registry.add(
    "extract_notebook_calls",
    f"""with {_CELLS_SQL} select doc_id as script_id,
  row_number() over (partition by doc_id order by cell) - 1 as cell, 0 as seq, 'max' as qualname
from code""",
)
def extract_notebook_calls(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.extract_notebook_calls(notebooks(spark, sf)).select(
        "script_id", "cell", "seq", "qualname"
    )
