"""The parsing step holds few files at once, and queries over sources parse each of them once."""

import types

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import sinks
from tessera.plans import catalogue, detect, parsed  # noqa: F401  adds its queries
from tessera.sources import java_source, python_source, typescript_source, walk

SF = "/root/testdata/sf0.001"


def step(monkeypatch, parser, schema):
    """The function that parse_table gives to Spark."""
    monkeypatch.setattr(walk, "ship", lambda spark: None)
    files = types.SimpleNamespace(sparkSession=None, select=lambda *c: types.SimpleNamespace(mapInArrow=lambda run, ddl: run))
    return walk.parse_table(files, parser, schema, "")


@pytest.mark.parametrize("text,at_most", [("x", 256), ("x" * 100_000, 20)])
def test_few_files_are_held(monkeypatch, text, at_most):
    """F1, F2, F5, F8: of a batch of 1,000 files the facts of no more than a few are there before they leave."""
    seen = []
    run = step(monkeypatch, lambda p, t: seen.append(p) or {"path": p, "calls": [t[:1]] * 50}, pa.schema([("path", pa.string()), ("calls", pa.list_(pa.string()))]))
    given = [pa.RecordBatch.from_pydict({"path": [f"{k}-{i}" for i in range(1000)], "content": [text] * 1000}) for k in range(2)]
    paths, before = [], 0
    for b in run(iter(given)):
        assert b.num_rows <= at_most and len(seen) - before <= at_most
        before = len(seen)
        paths += b.column(0).to_pylist()
    assert paths == [f"{k}-{i}" for k in range(2) for i in range(1000)]


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


@pytest.mark.parametrize("name", ["typescript_sinks", "java_sinks", "detect_tree", "audit_tree", "sink_places", "runtime_sites", "subclassable"])
def test_sources_are_parsed_once(spark, name):
    """F1, F3, F4, F6, F7."""
    assert parses(catalogue.QUERIES[name](spark, SF)) == 1


def test_many_files_are_many_whole_waves(spark, monkeypatch):
    monkeypatch.setattr(parsed, "FILES_PER_TASK", 15)
    n = spark.sparkContext.defaultParallelism
    tasks = parsed._py(spark, SF, "imports").rdd.getNumPartitions()
    assert tasks > n and tasks % n == 0


def rows(df):
    return sorted(repr(sorted(r.asDict(True).items())) for r in df.collect())


def of(spark, front, *texts):
    return front.modules_of(spark.createDataFrame([(f"d{i}/m{i}{front.ENDINGS[0]}", t) for i, t in enumerate(texts)], "path string, content string"))


def test_named_columns_are_those_of_all(spark):
    sources = spark.createDataFrame([("a.py", "import x\ndef f(): eval(1)"), ("b.py", "def (")], "path string, content string")
    some = python_source.modules_of(sources, "qualname", "calls", "parse_error")
    assert some.columns == ["qualname", "calls", "parse_error"] and rows(some) == rows(python_source.modules_of(sources).select(some.columns))


def test_bindings_in_a_row_are_those_of_the_join(spark):
    """One local bound to two modules, a namespace called, a member renamed, a full name, names that nothing binds."""
    m = of(
        spark, typescript_source,
        "import * as a from 'vm'; import * as a from 'child_process'; a.exec(x); a.Script(y); a(z); vm.Script(q); child_process.fork(q);",
        "import { exec, spawn as exec } from 'child_process'; import { exec } from 'node:child_process'; exec(a); spawn(b); exec.exec(c); import { Script } from 'node:vm'; new Script(z); this.vm.Script(n)",
        "exec(a); eval(b); Function('x'); require(n); setTimeout('x'); setTimeout(`${x}`); import(n); import { eval } from 'vm'; x.y.eval(z)", "", "import vm from 'vm'",
    ).cache()
    calls = m.select(F.col("qualname").alias("file"), F.explode("calls").alias("c")).select("file", "c.*")
    binds = m.select(F.col("qualname").alias("file"), F.explode("bindings").alias("b")).select("file", "b.*")
    joined = sinks.lookup_bound(calls, binds).select(F.col("file").alias("module"), "id", "lineno", "severity", "visit_ord")
    rest = ("TSX-EVAL", "TSX-JSFUNC", "TSX-DYNREQUIRE", "TSX-TIMERSTR")
    found = typescript_source.audit(m)
    assert rows(found.filter(~F.col("id").isin(*rest)).select(*joined.columns)) == rows(joined) and joined.count() > 6
    assert sorted(r.id for r in found.filter(F.col("id").isin(*rest)).collect()) == sorted(["TSX-EVAL", "TSX-JSFUNC", "TSX-DYNREQUIRE", "TSX-TIMERSTR", "TSX-DYNREQUIRE"])


def test_types_in_a_row_are_those_of_the_join(spark):
    """A variable declared twice has the type that is first by name; one that isn't declared is a type itself."""
    m = of(spark, java_source, "class A { Yaml v; Other v; void f() { v.load(s); Yaml.load(s); w.load(s); new XMLDecoder(s).readObject(); } }", "class B { Yaml z; Yaml z; void f() { z.load(s); \n z.loadAll(t); v.load(s); } }", "", "class C { void f() { Class.forName(x).y(); } }").cache()
    calls = m.select(F.col("qualname").alias("file"), F.explode("calls").alias("c")).select("file", "c.*")
    known = m.select(F.col("qualname").alias("file"), F.explode("types").alias("t")).select("file", "t.*").groupBy("file", "variable").agg(F.min("type").alias("type"))
    joined = sinks.lookup_typed(calls.filter("receiver IS NOT NULL"), known).select(F.col("file").alias("module"), "lineno", "id").distinct()
    assert rows(java_source.audit(m).select("module", "lineno", "id")) == rows(joined) and joined.count() >= 4


def test_run_time_imports_are_no_reexports(spark):
    """A seam's place and flag are as found, also where a package exports the name of a call."""
    m = of(spark, python_source, "").limit(0).unionByName(python_source.modules_of(spark.createDataFrame([
        ("p/__init__.py", "from .a import find_spec, f, C\n"),
        ("p/a.py", "def g(): return find_spec('x')\ndef f(): pass\nclass C:\n    def n(self): raise NotImplementedError\nclass _H: pass\n"),
        ("p/bad.py", "def ("),
    ], "path string, content string"))).cache()
    got = sorted((r.seam_ord.grp, r.seam_ord.idx, r.kind, r.name, r.detail, r.reexported, r.has_override_point) for r in detect.seams(m).collect())
    assert got == [(0, 0, "function", "g", "", False, False), (0, 1, "function", "f", "", True, False), (1, 0, "class", "C", "", True, True), (2, 0, "dynamic_import", "find_spec", "find_spec('x')", False, False)]
