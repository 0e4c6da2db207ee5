import json
import weakref

import pytest
from pyspark.sql import functions as F

from loomwork import schemas
from loomwork.operators import parsing
from loomwork.sources import logs, notebooks as nb, pages
from loomwork.streaming.events import latest_status_stream
from loomwork.streaming.ingest import IngestSink, ingest_stream

from .conftest import rows


def script(spark, text):
    return spark.createDataFrame([(1, text)], "script_id int, source string")


def calls(spark, text):
    return [
        (r["func_text"], r["module"], r["name"], r["qualname"], r["err"])
        for r in parsing.extract_calls(script(spark, text)).orderBy("seq").collect()
    ]


def test_calls_follow_evaluation_order_and_aliases(spark):
    got = calls(spark, "import a.b as c\nfrom m import K as Z\nx = Z(c.f(1))\nx.go(len([]))")
    assert got == [
        ("c.f", "a.b", "f", "f", None),
        ("Z", "m", "K", "K", None),
        ("len", "builtins", "len", "len", None),
        ("x.go", "m", "go", "K.go", None),
    ]


def test_error_classes(spark):
    text = "nope()\nf = open\nf('a')()\n[len][0](1)\n(lambda: 1)()\n('a' + 'b')()"
    assert [c[4] for c in calls(spark, text)] == [
        "func lookup failed", None, "calling returned func", "calling subscripted func",
        "calling lambda", "unexpected type",
    ]


def test_parallel_is_lifted(spark):
    text = (
        "from joblib import Parallel, delayed\nimport numpy as np\n"
        "Parallel(2)(delayed(np.exp)(x) for x in range(3))\nnp.vectorize(np.log)(1)"
    )
    assert [c[0] for c in calls(spark, text)] == ["np.exp", "range", "np.log"]


def test_with_bodies_are_visited(spark):
    assert [c[0] for c in calls(spark, "with open('f') as f:\n  print(1)")] == ["open", "print"]


def test_imports_keep_order_and_repeats(spark):
    df = script(spark, "import a.b\nfrom c import d\nimport a.b, e")
    got = [r["module"] for r in parsing.extract_imports(df).orderBy("seq").collect()]
    assert got == ["a.b", "c", "a.b", "e"]


def test_static_types(spark):
    text = "a = {}\nb = a\nc, d = 1, 2\ne = 2.5\nf = 'x'\ng = dict()\nh = len('')\ni = (1,)\nj = u"
    got = {
        r["variable"]: r["type"] for r in parsing.static_types(script(spark, text)).collect()
    }
    assert got == {"a": "dict", "b": "dict", "e": "float", "f": "str", "g": "dict", "i": "tuple"}


def test_parse_status(spark):
    df = spark.createDataFrame(
        [(1, "f()"), (2, "def ("), (3, "  "), (4, None)], "script_id int, source string"
    )
    assert rows(parsing.parse_status(df)) == [
        (1, "ok", 1), (2, "syntax_error", 0), (3, "empty", 0), (4, "empty", 0)]


def test_def_use_events(spark):
    text = "x = f(g(1))\ny = x\nfor i in y:\n    z = h(y.a)\n"
    got = [
        (r["kind"], r["static_instr_id"], r["loop_id"], r["value_ids"], r["lhs_ids"])
        for r in parsing.def_use_events(script(spark, text)).orderBy("seq").collect()
    ]
    # ids in order of first use: _x0 0, _x1 1, x 2, y 3, _x2 4, z 5
    assert got == [
        ("call", 0, None, [-1, -1], None), ("dep", None, None, None, [0]),
        ("call", 1, None, [0, -1], None), ("dep", None, None, None, [1]),
        ("dep", None, None, [1], [2]), ("dep", None, None, [2], [3]),
        ("enter", None, 0, None, None),
        ("call", 2, None, [-1, -1, 3], None), ("dep", None, None, None, [4]),
        ("dep", None, None, [4], [5]), ("exit", None, None, None, None),
    ]


def test_pages_are_dropped_once_their_fields_are_read(spark, monkeypatch):
    alive, most = weakref.WeakSet(), []

    class Counted(pages._Fields):
        def __init__(self):
            super().__init__()
            alive.add(self)
            most.append(len(alive))

    monkeypatch.setattr(pages, "_Fields", Counted)
    got = list(pages._field_rows(['<a href="/x" class="kernel-header__username">u</a>', None] * 50))
    assert got == [(None, "x", None, None), (None, None, None, None)] * 50 and max(most) <= 2
    pages.extract_page_fields(spark.createDataFrame([("u", None)], "url string, html string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_rows_of_scripts_leave_python_in_bounded_frames(spark):
    made = ([(k, i) for i in range(7)] for k in range(100))
    frames = list(parsing._frames(iter([*made, [], [(100, i) for i in range(1_000)]]), ["k", "i"], 50))
    assert max(map(len, frames)) <= 56 * 2 and sum(map(len, frames)) == 1_700
    assert [tuple(r) for f in frames for r in f.to_numpy()][-1] == (100, 999)
    parsing.def_use_events(script(spark, "a = f(1)"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_def_use_events_keep_wrapper_calls(spark):
    text = "from joblib import Parallel, delayed\ny = Parallel(n_jobs=2)(delayed(f)(x) for x in z)\n"
    got = [
        (r["kind"], r["func_name"], r["value_ids"], r["lhs_ids"])
        for r in parsing.def_use_events(script(spark, text)).orderBy("seq").collect()
    ]
    # two calls, and y depends on the second one
    assert got == [
        ("call", "Parallel", [-1, -1], None), ("dep", None, None, [0]),
        ("call", "Parallel", [-1, -1], None), ("dep", None, None, [1]),
        ("dep", None, [1], [2]),
    ]


def test_results_of_classes_resolve_in_def_use_events(spark):
    text = "from lib import Est\nEst(1).fit(2)\nm = Est()\nm.fit(3)\n"
    got = [
        r["func_name"]
        for r in parsing.def_use_events(script(spark, text)).orderBy("seq").collect()
        if r["kind"] == "call"
    ]
    assert got == ["Est", "Est.fit", "Est", "Est.fit"]


@pytest.mark.parametrize("raw", ["[1]", "3", "null", '{"metadata": null}', '{"cells": [1]}', "{"])
def test_notebooks_of_other_shapes_do_not_fail_the_job(spark, raw):
    df = spark.createDataFrame([(1, raw)], "script_id int, raw string")
    got = df.select(nb.strip_notebook_outputs("raw").alias("t")).first()["t"]
    assert got is None or isinstance(json.loads(got), dict)


def test_notebook_layouts(spark):
    new = {"nbformat": 4, "metadata": {"signature": "s", "k": 1}, "cells": [
        {"cell_type": "markdown", "source": "t"},
        {"cell_type": "code", "source": ["a = 1\n", "f(a)"], "outputs": [1]},
        {"cell_type": "code", "source": ""}]}
    old = {"nbformat": 3, "metadata": {}, "worksheets": [{"cells": [
        {"cell_type": "code", "input": "x = 1", "prompt_number": 3, "outputs": []}]},
        {"cells": [{"cell_type": "code", "input": ["y = max(x)"]}]}]}
    df = spark.createDataFrame(
        [(1, json.dumps(new)), (2, json.dumps(old))], "script_id int, raw string")
    assert rows(nb.notebook_cells(df)) == [
        (1, 1, "a = 1\nf(a)"), (2, 0, "x = 1"), (2, 1, "y = max(x)")]
    clean = dict(rows(df.select("script_id", nb.strip_notebook_outputs("raw"))))
    assert json.loads(clean[1])["metadata"] == {"k": 1}
    assert json.loads(clean[1])["cells"][1]["outputs"] == []
    assert json.loads(clean[2])["worksheets"][0]["cells"][0]["prompt_number"] is None
    code = dict(rows(nb.notebook_to_script(df).select("script_id", "code")))
    assert code[2] == "x = 1\n\ny = max(x)"
    found = parsing.extract_notebook_calls(df).select("script_id", "cell", "qualname", "err")
    assert rows(found) == [
        (1, 0, None, "func lookup failed"), (2, 1, "max", None)]


def test_page_fields(spark):
    html = (
        '<a class="x script-code-pane__download-2" href="/c.ipynb">c</a>'
        "<a href='/ann' class='kernel-header__username'>Ann</a>"
        '<span class="vote-button__vote-count">12<span>!</span></span><b>Python notebook</b>'
    )
    df = spark.createDataFrame([("u1", html), ("u2", "<p>")], "url string, html string")
    got = rows(pages.extract_page_fields(df))
    assert got[0][:3] == ("u1", "/c.ipynb", "ann") and got[0][4] == "Python"
    assert got[1] == ("u2", None, None, None, None)
    plain = df.withColumn("html", F.regexp_replace("html", "<span>!</span>", ""))
    assert rows(pages.extract_page_fields(plain))[0][3] == 12


def test_links_by_class(spark):
    html = ('<a class="scripts__item-name" href="/a">1</a><a class="z" href="/b">2</a>'
            '<a class="scripts__item-name" href="http://o.example/x">3</a>'
            '<a class="scripts__item-name" href="/a">4</a>')
    df = spark.createDataFrame([("u", html)], "url string, html string")
    want = [("http://o.example/x",), ("https://b.example/a",)]
    assert rows(pages.extract_links(df, "https://b.example", pages.ITEM_LINK_CLASS)) == want
    assert rows(pages.extract_links_html(df, "https://b.example", pages.ITEM_LINK_CLASS)) == want


def test_status_log_and_work(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = spark.createDataFrame([("1:0",), ("",), ("2:124",), ("1:3",)], "v string").coalesce(1)
    lines.write.text(path)
    read = logs.read_status_log(spark, path)
    assert [f.dataType.simpleString() for f in read.schema] == ["bigint", "bigint", "int"]
    assert sorted(r["line_no"] for r in read.collect()) == list(range(read.count()))
    status = logs.latest_status(read)
    assert rows(status) == [(1, 3), (2, 124)]
    traces = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "project_id int, script_id long")
    assert rows(logs.select_work(traces, status, 10)) == [(7, 2), (7, 3)]
    ids = spark.createDataFrame([(2,), (3,)], "script_id long")
    assert rows(logs.select_work(traces, status, 1, ids)) == [(7, 2)]
    assert rows(logs.status_summary(traces, status)) == [(7, "exec", 1), (7, "timeout", 1)]
    logs.append_status_log(spark.createDataFrame([(9, 0)], "script_id long, status int"),
                           str(tmp_path / "more"))
    assert rows(logs.succeeded(logs.read_status_log(spark, str(tmp_path / "more")))) == [(9,)]


def test_times(spark, tmp_path):
    (tmp_path / "script_12_time.txt").write_text("3.5\n")
    (tmp_path / "script_7_x_time.txt").write_text("oops")
    (tmp_path / "other.txt").write_text("1")
    assert rows(logs.load_times(spark, str(tmp_path))) == [("12", 3.5), ("7", None)]


def test_trace_files(spark, tmp_path):
    folder = tmp_path / "project_31" / "scripts"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"call_id": 0, "func_name": "f"}) + "\n{broken\n")
    got = logs.load_trace_events(spark, str(tmp_path)).select("project", "call_id", "func_name")
    assert rows(got) == [(31, 0, "f")]
    logs.save_trace(logs.load_trace_events(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("project = 31").count() == 1


def test_ratio_file(spark, tmp_path):
    logs.write_ratios(spark.createDataFrame([("a", 2.0)], "script string, ratio double"),
                      str(tmp_path / "r"))
    assert rows(spark.read.csv(str(tmp_path / "r"), header=True)) == [("a", "2.0")]


def test_projects_and_libraries(spark):
    df = spark.createDataFrame(
        [(1, 5, ["sklearnx", "os"]), (2, 6, ["os"])],
        "script_id int, project_id int, imports array<string>")
    assert rows(logs.of_projects(df, [6]).select("script_id")) == [(2,)]
    assert [r[0] for r in df.select(logs.uses_library(F.col("imports"), "sklearn")).collect()] == [
        True, False]


def test_ingest_batches_can_run_again(spark, tmp_path):
    sink = IngestSink(str(tmp_path / "t"), str(tmp_path / "f"))
    make = lambda *r: spark.createDataFrame(list(r), schemas.CRAWLED)
    first = make(("l1", "u", 1, "Python", "a"), ("l1", "u", 1, "Python", "a"),
                 ("l2", "u", 1, None, "b"))
    second = make(("l1", "u", 1, "Python", "a"), ("l2", "u", 1, "Python", "b"),
                  ("l3", "u", 2, "Python", "c"))
    sink(first, 0)
    sink(second, 1)
    sink(second, 1)
    links = lambda p: rows(spark.read.parquet(str(tmp_path / p)).select("link"))
    assert links("t") == [("l1",), ("l3",)] and links("f") == [("l2",)]


def test_ingestion_remembers_links_and_contents_without_reading_history(spark, tmp_path):
    def arrive(*found):
        spark.createDataFrame(list(found), schemas.CRAWLED).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
        stream = spark.readStream.schema(schemas.CRAWLED).parquet(str(tmp_path / "in"))
        at = lambda name: str(tmp_path / name)
        ingest_stream(stream, at("t"), at("f"), at("state")).awaitTermination()

    links = lambda p, b: rows(
        spark.read.schema("link string").parquet(str(tmp_path / p / f"batch_id={b}")))
    arrive(("l1", "u", 1, "Python", "a"), ("l1", "u", 1, "Python", "a"), ("l2", "u", 1, None, "b"))
    assert links("t", 0) == [("l1",)] and links("f", 0) == [("l2",)]
    # what is stored may be moved away: the next start knows it all the same
    (tmp_path / "t").rename(tmp_path / "elsewhere")
    arrive(("l1", "u", 1, "Python", "z"), ("l2", "u", 1, "Python", "b"), ("l3", "u", 2, "Python", "a"),
           ("l4", "u", 2, "Python", "b"), ("l5", "u", 2, "Python", None), (None, "u", 2, "Python", "d"))
    assert sorted(links("t", 1), key=str) == [("l4",), (None,)] and links("f", 1) == [("l5",)]


def test_status_stream(spark, tmp_path):
    for i, r in enumerate([(0, 1, 0), (2, 1, 3), (1, 1, 124)]):
        spark.createDataFrame([r], schemas.STATUS_LOG).write.mode("append").parquet(
            str(tmp_path / "in"))
    stream = (spark.readStream.schema(schemas.STATUS_LOG).option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "in")))
    query = (latest_status_stream(stream).writeStream.outputMode("complete").format("memory")
             .queryName("statuses").trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows(spark.table("statuses")) == [(1, 3)]
