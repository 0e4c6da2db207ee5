"""Corpus and source queries (groups S and D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.functions.ordered import previous
from loomwork.functions.stats import neat
from loomwork.operators import corpus, graph, similarity
from loomwork.plans.common import Registry, table
from loomwork.session import cut_lineage
from loomwork.sources import logs, pages, tables

registry = Registry()

# ---------------------------------------------------------------- script tables

LANGUAGES_SQL = """languages as (select n_nationkey::int as lid,
  case n_nationkey when 0 then 'Python' when 1 then 'IPython Notebook' else n_name end as name
  from nation)"""
# every document is a version; its script is 1,000,000 + doc_id, one in 11 has no script id
SCRIPTS_SQL = f"""with {LANGUAGES_SQL},
cur as (select doc_id as script_id, 1000000 + doc_id as sid, hash_user as user_id,
    n_chars % 9 as project_id, case when doc_id % 5 = 0 then doc_id - 5 end as parent_id,
    text as script, lid, name
  from (select *, doc_id % 37 as hash_user from documents where doc_id % 11 <> 3) d
  join languages on lid = (case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2
    else 3 end))"""


def script_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    language = (
        F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1)
        .when(F.col("lang") == "de", 2).otherwise(3)
    )
    scripts = docs.select(
        F.when(F.col("doc_id") % 11 != 3, F.col("doc_id") + 1000000).alias("Id"),
        (F.col("doc_id") % 37).alias("AuthorUserId"),
        (F.col("n_chars") % 9).alias("ScriptProjectId"),
        F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") - 5).alias("ForkParentScriptVersionId"),
        F.col("doc_id").alias("CurrentScriptVersionId"),
        F.lit(0).alias("TotalVotes"),
    )
    versions = docs.select(
        F.col("doc_id").alias("Id"), language.alias("ScriptLanguageId"),
        F.col("text").alias("ScriptContent"),
    )
    name = (
        F.when(F.col("n_nationkey") == 0, "Python")
        .when(F.col("n_nationkey") == 1, "IPython Notebook").otherwise(F.col("n_name"))
    )
    languages = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("Id"), name.alias("Name")
    )
    return scripts, versions, languages


@registry.add(
    "current_scripts",
    SCRIPTS_SQL + """
select user_id, project_id, script_id, parent_id, script from (
  select *, row_number() over (partition by script order by script_id) as rn
  from cur where name = 'Python') where rn = 1""",
)
def current_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.current_scripts(*script_tables(spark, sf), "Python")


@registry.add(
    "distinct_contents",
    SCRIPTS_SQL + " select distinct script as content from cur where name = 'Python'",
)
def distinct_contents(spark: SparkSession, sf: str) -> DataFrame:
    return tables.distinct_contents(*script_tables(spark, sf), ["Python"])


@registry.add(
    "multi_language_scripts",
    SCRIPTS_SQL + """
select min(sid) as id, script as content from cur
where name in ('Python', 'IPython Notebook') group by script""",
)
def multi_language_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.multi_language_scripts(*script_tables(spark, sf))


# crawled rows: every benchmark text, and every document with some nulls
CRAWLED_SQL = """crawled as (
  select 'b/' || item_id as link, 'u' || (item_id % 7) as "user", (item_id % 13)::int as votes,
    'Python' as language, text as code from benchmark
  union all
  select 'd/' || doc_id, source, (doc_id % 17)::int,
    case lang when 'en' then 'Python' when 'fr' then 'IPython Notebook' when 'de' then 'ALGERIA'
      end,
    case when doc_id % 29 = 4 then null else text || (case when doc_id % 2 = 0 then '' else '!' end)
      end
  from documents)"""


def crawled_rows(spark: SparkSession, sf: str) -> DataFrame:
    bench = table(spark, sf, "benchmark").select(
        F.concat(F.lit("b/"), "item_id").alias("link"),
        F.concat(F.lit("u"), F.col("item_id") % 7).alias("user"),
        (F.col("item_id") % 13).cast("int").alias("votes"),
        F.lit("Python").alias("language"), F.col("text").alias("code"),
    )
    language = (
        F.when(F.col("lang") == "en", "Python").when(F.col("lang") == "fr", "IPython Notebook")
        .when(F.col("lang") == "de", "ALGERIA")
    )
    mark = F.when(F.col("doc_id") % 2 == 0, "").otherwise("!")
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d/"), "doc_id").alias("link"), F.col("source").alias("user"),
        (F.col("doc_id") % 17).cast("int").alias("votes"), language.alias("language"),
        F.when(F.col("doc_id") % 29 != 4, F.concat("text", mark)).alias("code"),
    )
    return bench.unionByName(docs)


_EXISTING_SQL = """existing as (select distinct script as content from cur
  where name in ('Python', 'IPython Notebook'))"""
_NEW_SQL = (
    SCRIPTS_SQL + f", {CRAWLED_SQL}, {_EXISTING_SQL}, "
    """fresh as (select link, "user", votes, language, code from crawled
  where language is not null and code is not null
    and code not in (select content from existing))"""
)


def _fresh(spark: SparkSession, sf: str, null_aware: bool = False) -> DataFrame:
    existing = tables.multi_language_scripts(*script_tables(spark, sf)).select("content")
    return tables.new_records(crawled_rows(spark, sf), existing, null_aware)


@registry.add("new_records", _NEW_SQL + "select * from fresh")
def new_records(spark: SparkSession, sf: str) -> DataFrame:
    return _fresh(spark, sf, null_aware=True)


@registry.add(
    "assign_dense_ids",
    _NEW_SQL + """select link, (select max(doc_id) + 1000000 from documents where doc_id % 11 <> 3)
  + row_number() over (order by link) as id from fresh""",
)
def assign_dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    scripts, _, _ = script_tables(spark, sf)
    return tables.assign_dense_ids(
        _fresh(spark, sf), scripts.select("Id"), ["link"]
    ).select("link", "id")


@registry.add(
    "resolve_language_ids",
    f"with {LANGUAGES_SQL}, {CRAWLED_SQL} "
    "select link, language, lid as lang_id from crawled left join languages on name = language",
)
def resolve_language_ids(spark: SparkSession, sf: str) -> DataFrame:
    _, _, languages = script_tables(spark, sf)
    return tables.resolve_language_ids(crawled_rows(spark, sf), languages).select(
        "link", "language", "lang_id"
    )


@registry.add(
    "record_rows",
    _NEW_SQL + """
select id as Id, lid as ScriptLanguageId, code as ScriptContent, votes as TotalVotes from (
  select *, (select max(doc_id) + 1000000 from documents where doc_id % 11 <> 3)
    + row_number() over (order by link) as id from fresh)
left join languages on name = language""",
)
def record_rows(spark: SparkSession, sf: str) -> DataFrame:
    scripts, _, languages = script_tables(spark, sf)
    records = tables.resolve_language_ids(
        tables.assign_dense_ids(_fresh(spark, sf), scripts.select("Id"), ["link"]), languages
    )
    return tables.version_rows(records).join(
        tables.script_rows(records), F.col("Id") == F.col("CurrentScriptVersionId")
    ).select("Id", "ScriptLanguageId", "ScriptContent", "TotalVotes")


# ---------------------------------------------------------------- pages

BASE = "https://site.example"
_LINKS_SQL = f"""links as (
  select distinct case when href like '/%' then '{BASE}' || href else href end as link
  from (select unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) as href
    from pages))"""


@registry.add("extract_links", f"with {_LINKS_SQL} select link from links")
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract_links(table(spark, sf, "pages"), BASE)


@registry.add("extract_links_html", f"with {_LINKS_SQL} select link from links")
def extract_links_html(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract_links_html(table(spark, sf, "pages"), BASE)


@registry.add(
    "new_links",
    f"""with {_LINKS_SQL}, split as (select link, length(link) % 5 as k from links)
select link from split where k not in (0, 3)""",
)
def new_links(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.extract_links(table(spark, sf, "pages"), BASE)
    kind = F.length("link") % 5
    return pages.new_links(found, found.filter(kind == 0), found.filter(kind == 3))


@registry.add(
    "extract_page_fields",
    """
select url, '/dl/' || page_id || '.py' as code_link, 'user' || (page_id % 9) as "user",
  case when page_id % 4 = 0 then null else (page_id % 100)::int end as votes,
  case when page_id % 3 = 0 then 'Python' else 'R' end as language
from pages""",
)
def extract_page_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a header of the wanted elements in front of their own mark-up."""
    n = F.col("page_id")
    votes = F.when(n % 4 == 0, F.lit("many")).otherwise((n % 100).cast("string"))
    language = F.when(n % 3 == 0, "Python").otherwise("R")
    header = F.concat(
        F.lit('<a class="script-code-pane__download-x" href="/dl/'), n, F.lit('.py">get</a>'),
        F.lit('<a href="/user'), n % 9, F.lit('" class="big kernel-header__username">u</a>'),
        F.lit('<span class="vote-button__vote-count"> '), votes, F.lit(" </span><p>"),
        language, F.lit(" notebook</p>"),
    )
    marked = table(spark, sf, "pages").select("url", F.concat(header, "html").alias("html"))
    return pages.extract_page_fields(marked)


@registry.add(
    "classify_file",
    """
select page_id, case page_id % 3 when 0 then 'ipynb' when 1 then 'py' else 'csv' end as ext,
  case page_id % 3 when 0 then 'IPython Notebook' when 1 then 'Python' end as language
from pages""",
)
def classify_file(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(F.lit("ipynb"), F.lit("py"), F.lit("csv")),
                       (F.col("page_id") % 3 + 1).cast("int"))
    named = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("a.b."), ext).alias("file")
    )
    return named.select("page_id", pages.classify_file(F.col("file")).alias("f")).select(
        "page_id", "f.ext", "f.language"
    )


# ---------------------------------------------------------------- logs and work

_STATUS_SQL = """log as (select event_id as line_no, event_id % 4001 as script_id,
    case event_type when 'view' then 0 when 'click' then 2 when 'purchase' then 3
      when 'signup' then 4 else 124 end as status from events),
status as (select script_id, arg_max(status, line_no) as status from log group by script_id),
traces as (select doc_id as script_id, n_chars % 9 as project_id from documents)"""


def _status(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    code = (
        F.when(t == "view", 0).when(t == "click", 2).when(t == "purchase", 3)
        .when(t == "signup", 4).otherwise(124)
    )
    return logs.latest_status(
        table(spark, sf, "events").select(
            F.col("event_id").alias("line_no"), (F.col("event_id") % 4001).alias("script_id"),
            code.alias("status"),
        )
    )


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("script_id"), (F.col("n_chars") % 9).alias("project_id")
    )


@registry.add("latest_status", f"with {_STATUS_SQL} select script_id, status from status")
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf)


@registry.add(
    "select_work",
    f"""with {_STATUS_SQL},
open as (select project_id, script_id from traces where script_id not in
  (select script_id from status where status <> 124)),
done as (select project_id, count(*) as n from traces where script_id in
  (select script_id from status where status = 0) group by project_id)
select project_id, script_id from (
  select o.*, row_number() over (partition by project_id order by script_id) as rn from open o)
left join done using (project_id) where rn <= 40 - coalesce(n, 0)""",
)
def select_work(spark: SparkSession, sf: str) -> DataFrame:
    return logs.select_work(_traces(spark, sf), _status(spark, sf), 40, quota=True)


@registry.add(
    "status_summary",
    f"""with {_STATUS_SQL}
select project_id, case status when 0 then 'ok' when 2 then 'compile' when 3 then 'exec'
  when 4 then 'no data' else 'timeout' end as outcome, count(*) as scripts
from traces join status using (script_id) group by all""",
)
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return logs.status_summary(_traces(spark, sf), _status(spark, sf))


@registry.add(
    "group_by_project",
    f"""with {_STATUS_SQL} select project_id, count(*) as scripts from traces
where project_id in (1, 2, 5) group by project_id""",
)
def group_by_project(spark: SparkSession, sf: str) -> DataFrame:
    return logs.project_counts(_traces(spark, sf), [1, 2, 5])


@registry.add(
    "uses_library",
    """
select doc_id, len(list_filter(string_split(source || '.a ' || lang || '.b', ' '),
  lambda x: starts_with(x, 'src1'))) > 0 as uses from documents""",
)
def uses_library(spark: SparkSession, sf: str) -> DataFrame:
    imports = F.array(F.concat("source", F.lit(".a")), F.concat("lang", F.lit(".b")))
    return table(spark, sf, "documents").select(
        "doc_id", logs.uses_library(imports, "src1").alias("uses")
    )


# ---------------------------------------------------------------- near duplicates

# white space as Python sees it, for the SQL engine's regular expressions
_WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES_SQL = f"""list_filter(list_transform(string_split(text, chr(10)),
  lambda s: regexp_replace(regexp_replace(s, '^{_WS}+', ''), '{_WS}+$', '')),
  lambda s: length(s) > 0)"""
_ITEMS_SQL = f"""docs as (select doc_id, lang, source,
    array_to_string({_LINES_SQL}, chr(10)) as text,
    lag(doc_id) over (partition by lang, source order by doc_id) as parent_id from documents),
items as (select * from docs where length(text) > 0),
chars as (select doc_id, ch, count(*) as n from
  (select doc_id, unnest(regexp_extract_all(text, '(?s).')) as ch from items) group by all),
size as (select doc_id, sum(n)::bigint as len from chars group by doc_id)"""
_FORK_SQL = f"""{_ITEMS_SQL},
fork as (select c.doc_id as child, c.parent_id as parent,
    2.0 * coalesce((select sum(least(x.n, y.n)) from chars x join chars y on x.ch = y.ch
      where x.doc_id = c.doc_id and y.doc_id = c.parent_id), 0) / (a.len + b.len) as ratio
  from items c join size a on a.doc_id = c.doc_id join size b on b.doc_id = c.parent_id),
remaining as (select i.*, s.len from items i join size s using (doc_id)
  where doc_id not in (select child from fork where ratio > 0.75))"""
_PAIRS_SQL = f"""{_FORK_SQL},
cand as (select a.doc_id as id1, b.doc_id as id2, a.len + b.len as total
  from remaining a join remaining b on a.lang = b.lang and a.source = b.source
    and a.doc_id < b.doc_id
    and 2.0 * least(a.len, b.len) / (a.len + b.len) > 0.75),
pairs as (select id1, id2, 2.0 * sum(least(x.n, y.n)) / any_value(total) as ratio
  from cand join chars x on x.doc_id = id1 join chars y on y.doc_id = id2 and y.ch = x.ch
  group by id1, id2 having 2.0 * sum(least(x.n, y.n)) / any_value(total) > 0.75)"""
_COMPONENTS_SQL = f"""{_PAIRS_SQL},
sym as (select id1 as a, id2 as b from pairs union select id2, id1 from pairs),
reach as (select a as node, a as seen from sym union
  select r.node, s.b from reach r join sym s on s.a = r.seen),
comp as (select node, min(seen) as component from reach group by node)"""
_CLEAN_SQL = f"""{_COMPONENTS_SQL},
kept as (select doc_id from (select doc_id, row_number() over (partition by component
    order by len desc, doc_id) as rn
  from comp join remaining on doc_id = node) where rn = 1),
clean as (select doc_id from remaining where doc_id not in (select node from comp)
  union all select doc_id from kept)"""


def _contents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(id, lang, source, script), and (id, parent_id)."""
    docs = table(spark, sf, "documents", heavy=True).select(
        F.col("doc_id").alias("id"), "lang", "source", F.col("text").alias("script")
    )
    linked = previous(
        docs.drop("script"), ["lang", "source"], "id", F.col("id"), 1, "before"
    ).select("id", F.get("before", F.lit(0)).alias("parent_id"))
    return docs, linked


def _scripts(spark: SparkSession, sf: str) -> DataFrame:
    docs, linked = _contents(spark, sf)
    return docs.join(linked, "id")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    # counted before the join, which moves character counts then and not texts
    docs, linked = _contents(spark, sf)
    return cut_lineage(
        similarity.with_char_counts(corpus.standardize(docs), "script").join(linked, "id")
    )


@registry.add(
    "split_lines",
    f"""select doc_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as line
from (select doc_id, {_LINES_SQL} as l from documents)""",
)
def split_lines(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.split_lines(table(spark, sf, "documents").select("doc_id", "text"))


@registry.add(
    "count_loc",
    f"""
select sum(len(list_filter({_LINES_SQL}, lambda s: left(s, 1) not in ('''', '"', '#'))))::bigint
  as loc
from (select text from documents union all select html as text from pages)""",
)
def count_loc(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "documents", heavy=True).select("text").unionByName(
        table(spark, sf, "pages").select(F.col("html").alias("text"))
    )
    return corpus.count_loc(sources)


@registry.add(
    "standardize",
    f"with {_ITEMS_SQL} select doc_id as id, md5(text) as digest, length(text) as len from items",
)
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", heavy=True).select(
        F.col("doc_id").alias("id"), "text"
    )
    return corpus.standardize(docs, "text").select(
        "id", F.md5("text").alias("digest"), F.length("text").alias("len")
    )


@registry.add(
    "quick_ratio",
    f"with {_FORK_SQL} select child, parent, round(ratio, 6) as ratio from fork",
)
def quick_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.fork_ratios(_items(spark, sf)).select(
        "child", "parent", neat(F.col("ratio")).alias("ratio")
    )


@registry.add(
    "fork_duplicates", f"with {_FORK_SQL} select child as id from fork where ratio > 0.75"
)
def fork_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.fork_duplicates(_items(spark, sf))


def _remaining(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return items.join(corpus.fork_duplicates(items), "id", "left_anti")


@registry.add(
    "similar_scripts",
    f"with {_PAIRS_SQL} select id1, id2, round(ratio, 6) as ratio from pairs",
)
def similar_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similar_pairs(_remaining(spark, sf), ["lang", "source"]).select(
        "id1", "id2", neat(F.col("ratio")).alias("ratio")
    )


@registry.add(
    "similar_components", f"with recursive {_COMPONENTS_SQL} select node as id, component from comp"
)
def similar_components(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similar_components(_remaining(spark, sf), ["lang", "source"])


# every line links its order to a later order of the same ten, or to itself
@registry.add(
    "merge_overlapping_sets",
    """
with recursive pairs as (select distinct l_orderkey as a, l_orderkey + l_linenumber as b
    from lineitem where l_orderkey % 10 + l_linenumber < 10),
sym as (select a, b from pairs union select b, a from pairs),
reach as (select a as node, a as seen from sym union
  select r.node, s.b from reach r join sym s on s.a = r.seen)
select node, min(seen) as component from reach group by node""",
)
def merge_overlapping_sets(spark: SparkSession, sf: str) -> DataFrame:
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    pairs = table(spark, sf, "lineitem").select(
        key.alias("src"), F.when(key % 10 + line < 10, key + line).otherwise(key).alias("dst")
    )
    return graph.connected_components(pairs)


@registry.add(
    "keep_largest",
    f"""with recursive {_CLEAN_SQL} select component, doc_id as id from kept join comp on node = doc_id""",
)
def keep_largest(spark: SparkSession, sf: str) -> DataFrame:
    left = _remaining(spark, sf)
    return corpus.keep_largest(
        similarity.similar_components(left, ["lang", "source"]), left
    )


@registry.add("clean_corpus", f"with recursive {_CLEAN_SQL} select doc_id as id from clean")
def clean_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.clean(_scripts(spark, sf), ["lang", "source"]).select("id")


@registry.add(
    "clean_corpus_report",
    f"""with recursive {_CLEAN_SQL} select (select count(*) from clean) as kept,
  (select count(*) from documents) as total""",
)
def clean_corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    scripts = _scripts(spark, sf)
    return corpus.conserved(corpus.clean_ids(scripts, ["lang", "source"]), scripts)


@registry.add(
    "sampled_edit_distances",
    """
with top as (select item_id, regexp_replace(text, '[^[:ascii:]]', '?', 'g') as text,
    row_number() over (order by md5('1:' || item_id), item_id) - 1
    as r from benchmark),
b as (select item_id, text, (r // 10)::int as batch from top where r < 40)
select x.batch, x.item_id as i, y.item_id as j, levenshtein(x.text, y.text)::int as distance
from b x join b y on x.batch = y.batch and x.item_id < y.item_id""",
)
def sampled_edit_distances(spark: SparkSession, sf: str) -> DataFrame:
    # one byte per character, since the SQL engine measures edits in bytes
    plain = F.regexp_replace("text", r"[^\x00-\x7f]", "?").alias("text")
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), plain)
    return corpus.sampled_edit_distances(texts, batches=4, batch_size=10)


@registry.add(
    "duplicate_titles",
    SCRIPTS_SQL + """
select script_id, 'script ' || script_id as title from (
  select *, row_number() over (partition by script order by script_id) as rn
  from cur where name = 'Python') where rn = 1 and user_id = 7""",
)
def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    current = tables.current_scripts(*script_tables(spark, sf), "Python").withColumn(
        "title", F.concat(F.lit("script "), "script_id")
    )
    return corpus.duplicate_titles(current, 7)
