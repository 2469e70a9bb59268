"""Operators on small planted tables: exact counts, decoys, ties, and properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import crosscheck, diff, docgen, evaluate, facts, graph, ranking, scoring, sinks

SEAM = "kind string, module string, name string, lineno int, detail string, reexported boolean, has_override_point boolean, seam_ord int"


def seams(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SEAM)


def scored(spark, *rows):
    return {r.name: r for r in scoring.score_seams(seams(spark, rows)).collect()}


def test_scores_and_categories(spark):
    got = scored(
        spark,
        ("abstract_class", "m", "Exporter", 1, "ABC", False, False),
        ("class", "m", "JobHandler", 2, "", False, True),
        ("class", "m", "Plain", 3, "x.core.BasePlugin, Other", True, False),
        ("function", "m", "on_start", 4, "", False, False),
        ("function", "m", "unregister", 5, "app.route", True, False),
        ("function", "m", "helper", 6, "", False, False),
        ("dynamic_import", "m", "__import__", 7, "", False, False),
        ("dynamic_import", "m", "entry_points", 8, "", False, False),
    )
    assert got["Exporter"].score == 0.1 + 0.6 and got["Exporter"].category == "subclass"
    assert got["JobHandler"].score == 0.1 + 0.45 + 0.3
    assert got["Plain"].score == 1.0 and got["Plain"].category == "subclass"
    assert got["on_start"].category == "hook" and got["on_start"].score == 0.6
    assert got["unregister"].score == 1.0 and "register" in got["unregister"].signals[0] and "unregister" not in got["unregister"].signals[0]
    assert (got["helper"].score, got["helper"].category) == (0.1, "api")
    assert (got["__import__"].score, got["__import__"].category) == (0.1, "reflection")
    assert (got["entry_points"].score, got["entry_points"].category) == (0.9, "plugin_loader")


def test_band_edge_is_double(spark):
    """0.1 + 0.7 is less than 0.8 in doubles, so a threshold of 0.8 leaves it out."""
    s = seams(spark, [("function", "m", "plain", 1, "", True, False)])
    assert scoring.points(s, 0.8).count() == 0 and scoring.points(s, 0.79).count() == 1


def test_tie_bounds_of_known_scores(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([1.0] * 3 + [0.8] * 2 + [0.1])], "i int, score double")
    got = {r.i: (r.best, r.worst) for r in ranking.tie_bounds(df).collect()}
    assert [got[i] for i in (0, 2, 3, 5)] == [(1, 3), (1, 3), (4, 5), (6, 6)]


def test_tie_note(spark):
    df = spark.createDataFrame([(s,) for s in [1.0, 0.9, 0.9, 0.9, 0.1]], "score double")
    note = ranking.tie_note(df, 2).first()
    assert (note.cutoff, note.band, note.above, note.in_view) == (0.9, 3, 1, 1)
    assert ranking.tie_note(df, 1).count() == 0 and ranking.tie_note(df, 0).count() == 0 and ranking.tie_note(df, 99).count() == 0


def test_overloads(spark):
    df = spark.createDataFrame([("m", "f", 1, True), ("m", "f", 2, True), ("m", "f", 3, False), ("m", "g", 4, True), ("m", "g", 5, True), ("m", "h", 6, False), ("m", "h", 7, False)], "module string, name string, ord int, is_stub boolean")
    assert sorted(r.ord for r in graph.collapse_overloads(df).collect()) == [3, 4, 6, 7]


def test_import_resolution(spark):
    m = spark.createDataFrame([("pkg",), ("pkg.json",), ("pkg.core.io",), ("a_b",), ("axb.c",)], "qualname string")
    i = spark.createDataFrame([("x", "json"), ("x", ".core"), ("x", "pkg.core.io"), ("pkg", "pkg"), ("x", "a_b.c"), ("x", "none"), ("x", "a_b")], "src string, import string")
    got = {(r["src"], r["import"]): r.dst for r in graph.resolve_imports(i, m).collect()}
    assert got == {("x", "json"): "pkg.json", ("x", ".core"): None, ("x", "pkg.core.io"): "pkg.core.io", ("pkg", "pkg"): None, ("x", "a_b.c"): None, ("x", "none"): None, ("x", "a_b"): "a_b"}


def test_every_dotted_pattern_has_one_dot():
    assert all(p[0].count(".") == 1 for p in sinks.PY_DOTTED) and all("." not in p[0] for p in sinks.PY_BARE + sinks.PY_LOADER)
    assert len(sinks.PY_DOTTED) + len(sinks.PY_BARE) == 38 and len(sinks.PY_LOADER) == 7 and len(sinks.JAVA_TYPED) == 24 and len(sinks.JAVA_NEW) == 5


def test_lookup_equals_suffix_scan(spark):
    every = [p[0] for p in sinks.PY_DOTTED + sinks.PY_BARE + sinks.PY_LOADER]
    calls = every + [f"a.b.{p}" for p in every] + ["evaluate", "xos.system", "json.loads", "my.eval"]
    df = spark.createDataFrame([(c, i, False) for i, c in enumerate(calls)], "dotted string, ord int, shell_true boolean")
    got = {r.dotted: r.id for r in sinks.lookup_python(df).collect()}

    def scan(c):
        for p in sinks.PY_BARE + sinks.PY_DOTTED:
            if c == p[0]:
                return p[1]
        for p in sinks.PY_DOTTED:
            if c.endswith("." + p[0]):
                return p[1]
        return next((p[1] for p in sinks.PY_LOADER if c.rpartition(".")[2] == p[0]), None)

    assert got == {c: scan(c) for c in calls if scan(c)}


def test_shell_elevates(spark):
    df = spark.createDataFrame([("subprocess.run", True), ("subprocess.run", False), ("subprocess.run", None), ("os.execv", True)], "dotted string, shell_true boolean")
    assert sorted((r.id, r.severity) for r in sinks.lookup_python(df).collect()) == [("TSX-SPAWN", "medium"), ("TSX-SUBPROC", "high"), ("TSX-SUBPROC", "medium"), ("TSX-SUBPROC", "medium")]


SNAP = "id string, module string, call string, category string, severity string, ord int"


def snap(spark, keys):
    return spark.createDataFrame([(k, "m", "c", "x", "high", i) for i, k in enumerate(keys)], SNAP)


def test_multiset_difference(spark):
    got = {(r.direction, r.id): r["count"] for r in diff.surface_diff(snap(spark, "aab"), snap(spark, "aaac")).collect()}
    assert got == {("introduced", "a"): 1, ("introduced", "c"): 1, ("removed", "b"): 1}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_counts_are_conserved(spark, base, new):
    got = diff.surface_diff(snap(spark, base), snap(spark, new)).collect()
    for k in "abc":
        delta = sum(r["count"] * (1 if r.direction == "introduced" else -1) for r in got if r.id == k)
        assert delta == new.count(k) - base.count(k)


def test_threshold(spark):
    d = diff.surface_diff(snap(spark, ""), snap(spark, "a"))
    assert [diff.at_or_above(d, t).count() for t in ("none", "high", "medium", "low")] == [0, 1, 1, 1]


def test_manifest_diff(spark):
    cols = "id string, signature string, implement string, kind string, category string, ord int"
    old = spark.createDataFrame([("a", "s", None, "k", "c", 0), ("a", "s2", None, "k", "c", 1), ("b", None, None, "k", "c", 2), ("gone", "s", "i", "k", "c", 3), (None, "s", "i", "k", "c", 4)], cols)
    new = spark.createDataFrame([("a", "s2", "x", "k", "d", 0), ("b", None, None, "k", "c", 1), ("new", "s", "i", "k", "c", 2)], cols)
    got = {(r.id, r.change, r.field, r.old, r.new) for r in diff.manifest_diff(old, new).collect()}
    assert got == {("a", "changed", "implement", None, "x"), ("a", "changed", "category", "c", "d"), ("gone", "removed", None, None, None), ("new", "added", None, None, None)}


def test_label_ranks_and_medians(spark):
    c = spark.createDataFrame([("t", f"i{k}", k, 1.0) for k in range(1, 51)], "target string, id string, rank long, score double")
    lab = spark.createDataFrame([("t", "i1"), ("t", "i2"), ("t", "i38"), ("t", "i39"), ("u", "z")], "target string, id string")
    r = evaluate.label_ranks(c, lab)
    assert {x.target: x.median_rank for x in evaluate.median_ranks(r).collect()} == {"t": 20.0, "u": 1.0}
    rp = {x.target: (x.hits, x.recall, x.precision) for x in evaluate.recall_precision(r, 10).collect()}
    assert rp["t"] == (2, 0.5, 0.2)
    b = {x.target: (x.worst_hits, x.best_hits) for x in evaluate.recall_bounds(evaluate.label_bounds(c, lab), 10).collect()}
    assert b["t"] == (0, 4)


def test_tolerance(spark):
    a = spark.createDataFrame([("p", 1), ("p", 10), ("q", 5)], "path string, line int")
    b = spark.createDataFrame([("p", 4), ("p", 14), ("r", 5)], "path string, line int")
    assert {(r.path, r.line): r.agreed for r in crosscheck.tolerance_match(a, b).collect()} == {("p", 1): True, ("p", 10): False, ("q", 5): False}


def test_one_package_one_vote(spark):
    u = spark.createDataFrame([("a", "X")] * 40 + [("b", "X"), ("b", "Y")], "package string, symbol string")
    assert {r.symbol: r.votes for r in crosscheck.votes(u).collect()} == {"X": 2, "Y": 1}


def test_first_success(spark):
    a = spark.createDataFrame([("p", 1, False), ("p", 2, True), ("p", 3, True), ("q", 1, False), ("q", 2, False), ("r", 5, True), ("r", 1, False)], "point string, n int, ok boolean")
    assert {r.point: (r.attempt, r.ok) for r in docgen.first_success(a, 4).collect()} == {"p": (2, True), "q": (2, False), "r": (1, False)}


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(N.bare(lit("a.Field[int]"))) == "Field" and one(N.bare_type(lit("java.util.List<String>"))) == "List"
    assert one(N.qualname(lit("pkg/__init__.py"))) == "pkg" and one(N.qualname(lit("__init__.py"))) == "" and one(N.qualname(lit("lib/a.b.ts"), "slash")) == "lib/a.b"
    once = N.target_id(lit("t"), lit("m"), lit("f"))
    assert one(once) == "t.m:f" and one(N.target_id(lit("t"), lit("t.m"), lit("f"))) == "t.m:f" and one(N.target_id(lit("t"), lit(""), lit("f"))) == "t:f"
    assert one(N.line_of(lit("a:b:12"))) == 12 and one(N.line_of(lit("a"))) == 0
    assert one(N.method_of(lit("def run(self)"))) == "run" and one(N.method_of(lit("("))) == "method"
    assert one(docgen.extract_code(lit("x\n```python\nprint(1)\n```\ny"))) == "print(1)" and one(docgen.extract_code(lit("```typescript\na\n```"))) == "typescript\na"


def test_facts(spark):
    m = "array<struct<name: string, args: array<string>, decorators: array<string>>>"
    c = spark.createDataFrame([("m", "Exporter", ["ABC"], [], [("run", ["self"], ["abc.abstractmethod"]), ("help", ["self"], [])], 2), ("m", "Exporter", [], [], [], 3)], f"module string, name string, bases array<string>, decorators array<string>, methods {m}, ord int")
    f = spark.createDataFrame([("m", "go", ["a", "b"], ["app.route"], 1)], "module string, name string, args array<string>, decorators array<string>, ord int")
    p = scoring.score_seams(seams(spark, [("abstract_class", "m", "Exporter", 1, "ABC", False, False), ("function", "m", "go", 2, "", False, False), ("dynamic_import", "m", "entry_points", 3, "", False, False)]))
    got = {r.name: r for r in facts.enrich(p, c, f).collect()}
    assert got["Exporter"].signature == "class Exporter(ABC)" and got["Exporter"].implement == ["def run(self)"]
    assert got["go"].signature == "def go(a, b)" and got["entry_points"].signature == ""
    e = facts.enrich(p, c, f)
    text = {r.name: r.t for r in e.select("name", facts.fact_text(e).alias("t")).collect()}
    assert "must implement:\n  - def run(self)" in text["Exporter"] and "signature" not in text["entry_points"]
    assert [r.id for r in facts.manifest(e).orderBy("id").collect()] == ["m:Exporter", "m:entry_points", "m:go"]


@pytest.mark.parametrize("keep, want", [("last", "b"), ("first", "a")])
def test_catalog_by_id(spark, keep, want):
    df = spark.createDataFrame([("X", "a", 0), ("X", "b", 1)], "id string, category string, ord int")
    assert sinks.distinct_entries(df, keep).first().category == want
