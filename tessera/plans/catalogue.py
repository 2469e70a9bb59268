"""All queries by name, and the SQL that gives the same rows in DuckDB.

Arrays are joined to text, weights are doubles, counts are longs, and every computed column has a name, so that both engines' rows compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import crosscheck, diff, docgen, evaluate, facts, graph, ranking, scoring, sinks
from tessera.sources import config_scan, snapshots

from . import validate
from .adapters import ctes, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TOP = 20
K = 10
TRIES = 4
BUDGET = 25


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- SQL texts of the scoring expressions ---
def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _first(text: str, parts: list[str]) -> str:
    return f"list_filter({_list(parts)}, lambda p: contains(lower({text}), p))[1]"


_ROLES = "(" + "|".join(N.ROLE_ENDINGS) + ")$"
_HOOK, _DECO = _first("name", N.HOOK_PARTS), _first("detail", N.DECORATOR_PARTS)
_ROLE = f"nullif(regexp_extract(name, '{_ROLES}', 1), '')"
_BASE = f"list_filter(list_transform(string_split(detail, ','), lambda b: nullif(regexp_extract(trim(b), '{_ROLES}', 1), '')), lambda r: r IS NOT NULL)[1]"
_d = lambda x: f"CAST({x} AS DOUBLE)"
_if = lambda c, w: f"CASE WHEN {c} THEN {_d(w)} ELSE {_d(0)} END"
_CLS, _FN, _DYN = "kind IN ('class', 'abstract_class')", "kind = 'function'", "kind = 'dynamic_import'"
_SC_CLASS = f"least({_d(0.1)} + {_if('kind = ' + chr(39) + 'abstract_class' + chr(39), 0.6)} + {_if(_ROLE + ' IS NOT NULL', 0.45)} + {_if(_BASE + ' IS NOT NULL', 0.45)} + {_if('reexported', 0.7)} + {_if('has_override_point', 0.3)}, {_d(1)})"
_SC_FN = f"least({_d(0.1)} + {_if(_HOOK + ' IS NOT NULL', 0.5)} + {_if(_DECO + ' IS NOT NULL', 0.4)} + {_if('reexported', 0.7)}, {_d(1)})"
_SC_DYN = f"CASE WHEN name = '__import__' THEN {_d(0.1)} ELSE {_d(0.9)} END"
_SCORE = f"CASE WHEN {_DYN} THEN {_SC_DYN} WHEN {_CLS} THEN {_SC_CLASS} ELSE {_SC_FN} END"
_CATEGORY = f"""CASE WHEN {_DYN} THEN CASE WHEN name = '__import__' THEN 'reflection' ELSE 'plugin_loader' END
  WHEN {_CLS} THEN CASE WHEN kind = 'abstract_class' OR {_ROLE} IS NOT NULL OR {_BASE} IS NOT NULL OR has_override_point THEN 'subclass' ELSE 'api' END
  WHEN coalesce({_HOOK} IN ({_list(N.CALLED_PARTS)[1:-1]}), false) THEN 'hook' WHEN {_HOOK} IS NOT NULL OR {_DECO} IS NOT NULL THEN 'registration' ELSE 'api' END"""
_POINTS = ctes("v_seams") + f",\npoints AS (SELECT *, {_SCORE} AS score, {_CATEGORY} AS category FROM v_seams)"
_BIG = ctes("v_seams_big") + f",\npoints AS (SELECT *, {_SCORE} AS score, {_CATEGORY} AS category FROM v_seams_big)"
_SEAM = "module, name, kind, lineno, seam_ord"


def _seams(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_seams")


def _points(spark: SparkSession, d: str, min_score: float = 0.0) -> DataFrame:
    return scoring.points(_seams(spark, d), min_score)


_SEAM_COLS = ["module", "name", "kind", "lineno", "seam_ord"]


# --- names and scores ---
@query("hook_name_match", f"{ctes('v_seams')} SELECT seam_ord, name, {_HOOK} AS part FROM v_seams WHERE {_FN}")
def _(spark, d):
    return _seams(spark, d).filter(scoring.is_function()).select("seam_ord", "name", N.hook_part(F.col("name")).alias("part"))


@query("role_suffix", f"{ctes('v_seams')} SELECT seam_ord, name, {_ROLE} AS role FROM v_seams WHERE {_CLS}")
def _(spark, d):
    return _seams(spark, d).filter(scoring.is_class()).select("seam_ord", "name", N.role_ending(F.col("name")).alias("role"))


@query("base_role", f"{ctes('v_seams')} SELECT seam_ord, detail, {_BASE} AS role FROM v_seams WHERE {_CLS}")
def _(spark, d):
    return _seams(spark, d).filter(scoring.is_class()).select("seam_ord", "detail", N.base_role(F.col("detail")).alias("role"))


@query("decorator_match", f"{ctes('v_seams')} SELECT seam_ord, detail, {_DECO} AS part FROM v_seams WHERE {_FN}")
def _(spark, d):
    return _seams(spark, d).filter(scoring.is_function()).select("seam_ord", "detail", N.decorator_part(F.col("detail")).alias("part"))


@query("score_class", f"{ctes('v_seams')} SELECT seam_ord, {_SC_CLASS} AS score FROM v_seams WHERE {_CLS}")
def _(spark, d):
    return _seams(spark, d).filter(scoring.is_class()).select("seam_ord", scoring.class_score().alias("score"))


@query("score_function", f"{ctes('v_seams')} SELECT seam_ord, {_SC_FN} AS score FROM v_seams WHERE {_FN}")
def _(spark, d):
    return _seams(spark, d).filter(scoring.is_function()).select("seam_ord", scoring.function_score().alias("score"))


@query("score_dynamic", f"{ctes('v_seams')} SELECT seam_ord, name, {_SC_DYN} AS score FROM v_seams WHERE {_DYN}")
def _(spark, d):
    return _seams(spark, d).filter(scoring.is_dynamic()).select("seam_ord", "name", scoring.dynamic_score().alias("score"))


@query("category_rules", f"{ctes('v_seams')} SELECT seam_ord, {_CATEGORY} AS category FROM v_seams")
def _(spark, d):
    return _seams(spark, d).select("seam_ord", scoring.category().alias("category"))


def _say(key: str, more: str = "") -> str:
    return f"'[{key}] {scoring.SIGNALS[key]}'" + (f" || ': ' || {more}" if more else "")


_SIGNALS = f"""array_to_string(list_filter([
  CASE WHEN {_DYN} AND name <> '__import__' THEN {_say('TES-DYN')} END, CASE WHEN {_DYN} AND name = '__import__' THEN {_say('TES-REFLECT')} END,
  CASE WHEN kind = 'abstract_class' THEN {_say('TES-ABSTRACT')} END, CASE WHEN {_CLS} THEN {_say('TES-ROLE', _ROLE)} END,
  CASE WHEN {_CLS} THEN {_say('TES-BASE', _BASE)} END, CASE WHEN {_FN} THEN {_say('TES-HOOK', _HOOK)} END, CASE WHEN {_FN} THEN {_say('TES-DECO', _DECO)} END,
  CASE WHEN NOT {_DYN} AND reexported THEN {_say('TES-EXPORT')} END, CASE WHEN {_CLS} AND has_override_point THEN {_say('TES-OVERRIDE')} END,
  CASE WHEN NOT {_DYN} THEN {_say('TES-PUBLIC')} END], lambda s: s IS NOT NULL), '; ')"""


@query("signal_list", f"{ctes('v_seams')} SELECT seam_ord, {_SIGNALS} AS signals FROM v_seams")
def _(spark, d):
    return _seams(spark, d).select("seam_ord", F.array_join(scoring.signals(), "; ").alias("signals"))


# --- ranks, limits and ties ---
@query("rank_points", f"{_POINTS} SELECT {_SEAM}, category, score, row_number() OVER (ORDER BY score DESC, module, lineno, seam_ord) AS rank FROM points")
def _(spark, d):
    return ranking.ranked(_points(spark, d).select(*_SEAM_COLS, "category", "score"))


@query("rank_points_big", f"{_BIG} SELECT {_SEAM}, category, score, row_number() OVER (ORDER BY score DESC, module, lineno, seam_ord) AS rank FROM points")
def _(spark, d):
    return ranking.ranked(scoring.points(view(spark, d, "v_seams_big")).select(*_SEAM_COLS, "category", "score"))


@query("min_score_filter", f"{_POINTS} SELECT seam_ord, score FROM points WHERE score >= CAST(0.8 AS DOUBLE)")
def _(spark, d):
    return _points(spark, d, 0.8).select("seam_ord", "score")


@query("top_n_implement", f"{_POINTS} SELECT {_SEAM}, category, score FROM points WHERE category <> 'plugin_loader' ORDER BY score DESC, module, lineno, seam_ord LIMIT {TOP}")
def top_n_implement(spark, d):
    return ranking.top(ranking.split_points(_points(spark, d))[0], TOP).select(*_SEAM_COLS, "category", "score")


@query("split_registration", f"{_POINTS} SELECT module, name, count(*) AS n, min(seam_ord) AS first_ord FROM points WHERE category = 'plugin_loader' GROUP BY 1, 2")
def _(spark, d):
    return ranking.collapse_registrations(_points(spark, d))


@query("tied_with", f"{_POINTS} SELECT seam_ord, score, count(*) OVER (PARTITION BY score) - 1 AS tied_with FROM points WHERE category <> 'plugin_loader'")
def _(spark, d):
    return ranking.tied_with(ranking.split_points(_points(spark, d))[0]).select("seam_ord", "score", "tied_with")


@query("tie_note", f"""{_POINTS}, p AS (SELECT score FROM points WHERE category <> 'plugin_loader'),
  s AS (SELECT score AS cutoff FROM p ORDER BY score DESC LIMIT 1 OFFSET {TOP - 1})
  SELECT cutoff, count(*) FILTER (score = cutoff) AS band, count(*) FILTER (score > cutoff) AS above, {TOP} - count(*) FILTER (score > cutoff) AS in_view
  FROM p, s GROUP BY cutoff HAVING count(*) FILTER (score = cutoff) >= 2""")
def _(spark, d):
    return ranking.tie_note(ranking.split_points(_points(spark, d))[0], TOP)


@query("tie_bounds", f"""{_POINTS} SELECT seam_ord, score, rank() OVER (ORDER BY score DESC) AS best,
  count(*) OVER (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS worst FROM points""")
def _(spark, d):
    return ranking.tie_bounds(_points(spark, d)).select("seam_ord", "score", "best", "worst")


# --- facts to seams ---
_STUBS = ctes("v_functions")


@query("overload_collapse", f"""{_STUBS}, k AS (SELECT *, bool_or(NOT is_stub) OVER (PARTITION BY module, name) AS whole,
    row_number() OVER (PARTITION BY module, name ORDER BY is_stub DESC, ord) AS k FROM v_functions)
  SELECT module, name, ord, is_stub FROM k WHERE NOT is_stub OR (NOT whole AND k = 1)""")
def _(spark, d):
    return graph.collapse_overloads(view(spark, d, "v_functions")).select("module", "name", "ord", "is_stub")


@query("public_filter", f"""{ctes('v_seams')}, m AS (SELECT module, CASE WHEN NOT (module LIKE '%1') THEN coalesce(list(DISTINCT name) FILTER (reexported), []) END AS exports FROM v_seams GROUP BY module)
  SELECT s.seam_ord, s.name, CASE WHEN m.exports IS NOT NULL THEN list_contains(m.exports, s.name) ELSE NOT starts_with(s.name, '_') END AS visible
  FROM v_seams s JOIN m ON s.module = m.module""")
def _(spark, d):
    """Modules with a list of exports, an empty one too (nothing is visible), and without."""
    s = _seams(spark, d)
    exports = s.groupBy("module").agg(F.collect_set(F.when(F.col("reexported"), F.col("name"))).alias("x")).select("module", F.when(~F.col("module").endswith("1"), F.col("x")).alias("exports"))
    return s.join(exports, "module").select("seam_ord", "name", graph.public(F.col("name"), F.col("exports"), ~F.col("name").startswith("_")).alias("visible"))


@query("seam_flatten", """WITH f AS (SELECT o_custkey AS module_ord, o_orderkey AS idx, 'f' || CAST(o_orderkey AS STRING) AS name FROM orders WHERE o_orderstatus <> 'P'),
  c AS (SELECT l_orderkey % 1500 AS module_ord, l_partkey AS idx, 'C' || CAST(l_partkey AS STRING) AS name, l_tax > 0.04 AS abstract FROM lineitem),
  e AS (SELECT user_id AS module_ord, event_id AS idx, event_type AS name FROM events)
  SELECT 'function' AS kind, 'm' || CAST(module_ord AS STRING) AS module, name, module_ord, 0 AS grp, idx FROM f
  UNION ALL SELECT CASE WHEN abstract THEN 'abstract_class' ELSE 'class' END, 'm' || CAST(module_ord AS STRING), name, module_ord, 1, idx FROM c
  UNION ALL SELECT 'dynamic_import', 'm' || CAST(module_ord AS STRING), name, module_ord, 2, idx FROM e""")
def _(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.array().cast("array<string>")
    f = read("orders").select(F.col("o_custkey").alias("module_ord"), F.col("o_orderkey").alias("idx"), text("f", "o_orderkey").alias("name"), (F.col("o_orderstatus") != "P").alias("visible"), none.alias("decorators"))
    c = read("lineitem").select((F.col("l_orderkey") % 1500).alias("module_ord"), F.col("l_partkey").alias("idx"), text("C", "l_partkey").alias("name"), F.lit(True).alias("visible"), (F.col("l_tax") > 0.04).alias("is_abstract"), none.alias("bases"), F.lit(False).alias("has_override_point"))
    e = read("events").select(F.col("user_id").alias("module_ord"), F.col("event_id").alias("idx"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("argument"))
    more = lambda t: t.withColumn("module", text("m", "module_ord")).withColumn("lineno", F.lit(1)).withColumn("reexported", F.lit(False))
    return graph.flatten_seams(more(f), more(c), more(e)).select("kind", "module", "name", "seam_ord.module_ord", "seam_ord.grp", "seam_ord.idx")


@query("module_resolve", f"""{ctes('v_hosts', 'v_imports')}, k AS (SELECT DISTINCT host AS m FROM v_hosts), i AS (SELECT DISTINCT src, import, regexp_replace(import, '^[.]+', '') AS w FROM v_imports),
  hit AS (SELECT i.src, i.import, k.m, k.m <> i.w AS other FROM i JOIN k ON k.m = i.w OR ends_with(k.m, '.' || i.w) OR starts_with(k.m, i.w || '.')),
  best AS (SELECT src, import, arg_min(m, (other, m)) AS m FROM hit GROUP BY 1, 2)
  SELECT i.src, i.import, CASE WHEN b.m <> i.src THEN b.m END AS dst FROM i LEFT JOIN best b ON b.src = i.src AND b.import = i.import""")
def _(spark, d):
    modules = view(spark, d, "v_hosts").select(F.col("host").alias("qualname"))
    return graph.resolve_imports(view(spark, d, "v_imports").distinct(), modules).select("src", "import", "dst")


@query("dependency_summary", f"""{ctes('v_hosts', 'v_imports')}, k AS (SELECT DISTINCT host AS m FROM v_hosts), i AS (SELECT DISTINCT src, regexp_replace(import, '^[.]+', '') AS w FROM v_imports),
  hit AS (SELECT i.src, i.w, k.m, k.m <> i.w AS other FROM i JOIN k ON k.m = i.w OR ends_with(k.m, '.' || i.w) OR starts_with(k.m, i.w || '.')),
  best AS (SELECT src, w, arg_min(m, (other, m)) AS m FROM hit GROUP BY 1, 2)
  SELECT (SELECT count(*) FROM k) AS n_modules, count(DISTINCT (src, m)) AS n_edges FROM best WHERE m <> src""")
def _(spark, d):
    modules = view(spark, d, "v_hosts").select(F.col("host").alias("qualname"))
    edges = graph.dependencies(graph.resolve_imports(view(spark, d, "v_imports").distinct(), modules))
    return edges.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(modules.agg(F.countDistinct("qualname").alias("n_modules"))).select("n_modules", "n_edges")


@query("reexport_flag", f"""{ctes('v_seams')}, x AS (SELECT DISTINCT name FROM v_seams WHERE reexported)
  SELECT s.seam_ord, s.name, x.name IS NOT NULL AS flag FROM v_seams s LEFT JOIN x ON x.name = s.name WHERE NOT {_DYN}""")
def _(spark, d):
    s = _seams(spark, d).filter(~scoring.is_dynamic())
    exports = _seams(spark, d).filter("reexported")
    return graph.reexported(s.drop("reexported"), exports).select("seam_ord", "name", F.col("reexported").alias("flag"))


@query("toplevel_packages", f"""{ctes('v_modules')}, p AS (SELECT DISTINCT path, regexp_replace(path, '/?__init__[.]py$', '') AS folder FROM v_modules)
  SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.folder = CASE WHEN contains(p.folder, '/') THEN regexp_replace(p.folder, '/[^/]*$', '') WHEN p.folder <> '' THEN '' END)""")
def _(spark, d):
    return graph.top_level_packages(view(spark, d, "v_modules").select("path").distinct()).select("path")


# --- risk sinks ---
def _values(rows: list[tuple]) -> str:
    return ", ".join(f"('{p}', '{i}', '{c}', '{s}', '{k}', {str(e).lower()})" for p, i, c, s, k, e in rows)


def _catalog(name: str, rows: list[tuple]) -> str:
    return f"{name}(pattern, id, category, severity, confidence, elevates) AS (VALUES {_values(rows)})"


_TWO = "array_to_string(list_slice(string_split(c.dotted, '.'), -2, -1), '.')"
_ONE = "string_split(c.dotted, '.')[-1]"
_LOOKUP = f"""{ctes('v_calls')}, {_catalog('bare', sinks.PY_BARE)}, {_catalog('dot', sinks.PY_DOTTED)}, {_catalog('loader', sinks.PY_LOADER)},
  found AS (SELECT c.ord, c.module, c.lineno, c.dotted, coalesce(b.id, t.id, l.id) AS id, coalesce(b.category, t.category, l.category) AS category,
      CASE WHEN coalesce(b.elevates, t.elevates, l.elevates) AND c.shell_true THEN 'high' ELSE coalesce(b.severity, t.severity, l.severity) END AS severity,
      coalesce(b.confidence, t.confidence, l.confidence) AS confidence
    FROM v_calls c LEFT JOIN bare b ON b.pattern = c.dotted LEFT JOIN dot t ON t.pattern = {_TWO} LEFT JOIN loader l ON l.pattern = {_ONE}
    WHERE coalesce(b.id, t.id, l.id) IS NOT NULL)"""
_SEV = lambda c: f"CASE {c} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END"


@query("sink_lookup", f"{_LOOKUP} SELECT ord, module, lineno, dotted, id, category, severity, confidence FROM found")
def _(spark, d):
    return sinks.lookup_python(view(spark, d, "v_calls")).select("ord", "module", "lineno", "dotted", "id", "category", "severity", "confidence")


@query("sink_rank", f"{_LOOKUP} SELECT ord, module, id, severity, confidence, row_number() OVER (PARTITION BY module ORDER BY {_SEV('severity')}, {_SEV('confidence')}, lineno, ord) AS rank FROM found")
def _(spark, d):
    found = sinks.lookup_python(view(spark, d, "v_calls")).withColumn("visit_ord", F.col("ord"))
    return sinks.ranks_within(found, "module").select("ord", "module", "id", "severity", "confidence", F.col("rank").cast("long").alias("rank"))


@query("sink_dedupe", f"{_LOOKUP} SELECT module, lineno, id, min(ord) AS ord, arg_min(dotted, ord) AS dotted FROM found GROUP BY 1, 2, 3")
def _(spark, d):
    found = sinks.lookup_python(view(spark, d, "v_calls")).withColumn("visit_ord", F.col("ord"))
    return sinks.dedupe(found).select("module", "lineno", "id", "ord", "dotted")


@query("severity_counts", f"{_LOOKUP} SELECT severity, count(*) AS n FROM found GROUP BY 1")
def _(spark, d):
    return sinks.severity_counts(sinks.lookup_python(view(spark, d, "v_calls")))


@query("catalog_distinct", f"WITH {_catalog('c', sinks.PY_DOTTED + sinks.PY_LOADER)}, n AS (SELECT *, row_number() OVER () AS ord FROM c) SELECT id, arg_max(category, ord) AS category, arg_max(severity, ord) AS severity, arg_max(confidence, ord) AS confidence FROM n GROUP BY id")
def _(spark, d):
    rows = [(*r, i) for i, r in enumerate(sinks.PY_DOTTED + sinks.PY_LOADER)]
    entries = spark.createDataFrame(rows, sinks._SCHEMA + ", ord int")
    return sinks.distinct_entries(entries).select("id", "category", "severity", "confidence")


_BOUND = """WITH calls AS (SELECT event_id AS ord, 'f' || CAST(user_id % 40 AS STRING) AS file, CASE WHEN event_id % 3 = 0 THEN 'cp' WHEN event_id % 3 = 1 THEN 'vmx' END AS obj,
    CASE WHEN event_id % 3 < 2 THEN CASE event_id % 4 WHEN 0 THEN 'exec' WHEN 1 THEN 'spawn' WHEN 2 THEN 'runInContext' ELSE 'other' END END AS prop,
    CASE WHEN event_id % 3 = 2 THEN CASE event_id % 2 WHEN 0 THEN 'execSync' ELSE 'run' END END AS name FROM events),
  binds AS (SELECT DISTINCT 'f' || CAST(user_id % 40 AS STRING) AS file, b.local, b.module, b.member FROM events, (VALUES (0, 'cp', 'node:child_process', NULL), (1, 'vmx', 'vm', NULL), (2, 'execSync', 'child_process', 'execSync'), (2, 'run', 'child_process', 'exec')) b(k, local, module, member) WHERE user_id % 3 = b.k)"""


@query("binding_lookup", f"""{_BOUND}, {_catalog('c', sinks.TS_MEMBER)} SELECT x.ord, x.file, c.id, c.severity FROM calls x
  LEFT JOIN binds s ON s.file = x.file AND s.member IS NULL AND s.local = x.obj LEFT JOIN binds n ON n.file = x.file AND n.member IS NOT NULL AND n.local = x.name
  JOIN c ON c.pattern = regexp_replace(coalesce(s.module, n.module), '^node:', '') || '.' || CASE WHEN s.module IS NOT NULL THEN x.prop ELSE x.name END""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    file = F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string"))
    k, m = F.col("event_id") % 3, F.col("event_id") % 4
    prop = F.when(m == 0, "exec").when(m == 1, "spawn").when(m == 2, "runInContext").otherwise("other")
    calls = e.select(F.col("event_id").alias("ord"), file.alias("file"), F.when(k == 0, "cp").when(k == 1, "vmx").alias("obj"), F.when(k < 2, prop).alias("prop"), F.when(k == 2, F.when(F.col("event_id") % 2 == 0, "execSync").otherwise("run")).alias("name"))
    named = spark.createDataFrame([(0, "cp", "node:child_process", None), (1, "vmx", "vm", None), (2, "execSync", "child_process", "execSync"), (2, "run", "child_process", "exec")], "k int, local string, module string, member string")
    binds = e.select(file.alias("file"), (F.col("user_id") % 3).cast("int").alias("k")).distinct().join(F.broadcast(named), "k").drop("k").distinct()
    return sinks.lookup_bound(calls, binds).select("ord", "file", "id", "severity")


@query("typed_lookup", f"""WITH calls AS (SELECT event_id AS ord, 'F' || CAST(user_id % 40 AS STRING) AS file, CASE event_id % 4 WHEN 0 THEN 'engine' WHEN 1 THEN 'Class' WHEN 2 THEN 'rt' ELSE 'this' END AS receiver,
    CASE event_id % 4 WHEN 0 THEN 'eval' WHEN 1 THEN 'forName' WHEN 2 THEN 'exec' ELSE 'eval' END AS method, user_id % 2 = 0 AS shell_true FROM events),
  types AS (SELECT DISTINCT 'F' || CAST(user_id % 40 AS STRING) AS file, CASE WHEN user_id % 2 = 0 THEN 'engine' ELSE 'rt' END AS variable, CASE WHEN user_id % 2 = 0 THEN 'ScriptEngine' ELSE 'Runtime' END AS type FROM events),
  {_catalog('c', sinks.JAVA_TYPED)} SELECT x.ord, x.file, c.id, CASE WHEN c.elevates AND x.shell_true THEN 'high' ELSE c.severity END AS severity FROM calls x
  LEFT JOIN types t ON t.file = x.file AND t.variable = x.receiver JOIN c ON c.pattern = coalesce(t.type, x.receiver) || '.' || x.method""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    file = F.concat(F.lit("F"), (F.col("user_id") % 40).cast("string"))
    k = F.col("event_id") % 4
    even = F.col("user_id") % 2 == 0
    calls = e.select(F.col("event_id").alias("ord"), file.alias("file"), F.when(k == 0, "engine").when(k == 1, "Class").when(k == 2, "rt").otherwise("this").alias("receiver"), F.when(k == 1, "forName").when(k == 2, "exec").otherwise("eval").alias("method"), even.alias("shell_true"))
    types = e.select(file.alias("file"), F.when(even, "engine").otherwise("rt").alias("variable"), F.when(even, "ScriptEngine").otherwise("Runtime").alias("type")).distinct()
    return sinks.lookup_typed(calls, types).select("ord", "file", "id", "severity")


# --- snapshot comparison ---
_SURFACE = f"""{ctes('v_sinks')}, b AS (SELECT id, module, call, count(*) AS n FROM v_sinks WHERE side = 0 GROUP BY ALL), w AS (SELECT id, module, call, count(*) AS n FROM v_sinks WHERE side = 1 GROUP BY ALL),
  meta AS (SELECT id, module, call, arg_min(category, (1 - side, ord)) AS category, arg_min(severity, (1 - side, ord)) AS severity FROM v_sinks GROUP BY ALL),
  j AS (SELECT id, module, call, coalesce(w.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN w USING (id, module, call)),
  changes AS (SELECT CASE WHEN delta > 0 THEN 'introduced' ELSE 'removed' END AS direction, id, module, call, category, severity, abs(delta) AS count FROM j JOIN meta USING (id, module, call) WHERE delta <> 0)"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "v_sinks")
    return diff.surface_diff(s.filter("side = 0"), s.filter("side = 1"))


@query("surface_diff", f"{_SURFACE} SELECT direction, id, module, call, category, severity, count FROM changes")
def _(spark, d):
    return _changes(spark, d)


@query("surface_gate", f"{_SURFACE} SELECT id, module, call, severity, count FROM changes WHERE direction = 'introduced' AND {_SEV('severity')} <= 1")
def _(spark, d):
    return diff.at_or_above(_changes(spark, d), "medium").select("id", "module", "call", "severity", "count")


_SIDES = f"""{ctes('v_points')}, o AS (SELECT id, arg_max(signature, ord_) AS signature, arg_max(implement, ord_) AS implement, arg_max(kind, ord_) AS kind, arg_max(category, ord_) AS category
    FROM (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY ord) AS ord_ FROM v_points) WHERE side = 1 GROUP BY id)"""
_LAST = "SELECT id, signature, implement, kind, category FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC, kind DESC, category DESC, coalesce(signature, '') DESC, implement DESC) AS k FROM v_points WHERE side = {}) WHERE k = 1"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = view(spark, d, "v_points")
    p = p.withColumn("ord", F.struct("ord", "kind", "category", F.coalesce("signature", F.lit("")).alias("s"), "implement"))
    return p.filter("side = 1").drop("side"), p.filter("side = 2").drop("side")


def _field(f: str) -> str:
    return f"SELECT id, 'changed' AS change, '{f}' AS field, o.{f} AS old, n.{f} AS new FROM o JOIN n USING (id) WHERE o.{f} IS DISTINCT FROM n.{f}"


@query("manifest_diff", f"""{ctes('v_points')}, o AS ({_LAST.format(1)}), n AS ({_LAST.format(2)})
  SELECT id, 'removed' AS change, CAST(NULL AS STRING) AS field, CAST(NULL AS STRING) AS old, CAST(NULL AS STRING) AS new FROM o ANTI JOIN n USING (id)
  UNION ALL SELECT id, 'added', NULL, NULL, NULL FROM n ANTI JOIN o USING (id)
  UNION ALL """ + " UNION ALL ".join(_field(f) for f in diff.FIELDS))
def _(spark, d):
    return diff.manifest_diff(*_sides(spark, d))


@query("manifest_ids", f"""{ctes('v_points')}, o AS (SELECT DISTINCT id FROM v_points WHERE side = 1), n AS (SELECT DISTINCT id FROM v_points WHERE side = 2)
  SELECT id, 'removed' AS change FROM o ANTI JOIN n USING (id) UNION ALL SELECT id, 'added' FROM n ANTI JOIN o USING (id)""")
def _(spark, d):
    return diff.manifest_ids(*_sides(spark, d))


# --- evaluation ---
_EVAL = f"""{ctes('v_candidates', 'v_labels')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, module, lineno, seam_ord) AS rank,
    rank() OVER (PARTITION BY target ORDER BY score DESC) AS best, count(*) OVER (PARTITION BY target ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS worst FROM v_candidates),
  size AS (SELECT target, count(*) AS n FROM v_candidates GROUP BY 1),
  lr AS (SELECT l.target, l.id, r.rank IS NOT NULL AS found, coalesce(r.rank, coalesce(s.n, 0) + 1) AS rank, r.best, r.worst FROM v_labels l LEFT JOIN ranked r ON r.target = l.target AND r.id = l.id LEFT JOIN size s ON s.target = l.target)"""


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.label_ranks(ranking.ranked(view(spark, d, "v_candidates"), ["target"]), view(spark, d, "v_labels"))


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.label_bounds(view(spark, d, "v_candidates"), view(spark, d, "v_labels"))


@query("label_rank", f"{_EVAL} SELECT target, id, found, rank FROM lr")
def _(spark, d):
    return _ranks(spark, d).select("target", "id", "found", "rank")


@query("missing_labels", f"{_EVAL} SELECT target, id FROM lr WHERE NOT found")
def _(spark, d):
    return view(spark, d, "v_labels").join(view(spark, d, "v_candidates").select("target", "id"), ["target", "id"], "left_anti")


@query("recall_precision", f"{_EVAL} SELECT target, count(*) FILTER (rank <= {K}) AS hits, count(*) AS n_labels, count(*) FILTER (rank <= {K}) / count(*) AS recall, count(*) FILTER (rank <= {K}) / CAST({K} AS DOUBLE) AS precision FROM lr GROUP BY 1")
def _(spark, d):
    return evaluate.recall_precision(_ranks(spark, d), K)


@query("recall_bounds", f"{_EVAL} SELECT target, count(*) FILTER (worst <= {K}) AS worst_hits, count(*) FILTER (best <= {K}) AS best_hits FROM lr GROUP BY 1")
def _(spark, d):
    return evaluate.recall_bounds(_bounds(spark, d), K)


@query("median_rank", f"{_EVAL} SELECT target, median(CAST(rank AS DOUBLE)) AS median_rank FROM lr GROUP BY 1")
def _(spark, d):
    return evaluate.median_ranks(_ranks(spark, d))


@query("aggregate_recall", f"{_EVAL} SELECT count(*) FILTER (rank <= {K}) AS hits, count(*) AS n_labels, count(*) FILTER (worst <= {K}) AS worst_hits, count(*) FILTER (best <= {K}) AS best_hits, count(*) FILTER (best <= {K} AND worst > {K}) AS tie_decided FROM lr")
def _(spark, d):
    return evaluate.aggregate(_ranks(spark, d), _bounds(spark, d), K)


# --- cross-checks ---
def _tool(spark: SparkSession, d: str, tool: str) -> DataFrame:
    return view(spark, d, "v_findings").filter(F.col("tool") == tool).select("path", "line").distinct()


@query("tolerance_match", f"""{ctes('v_findings')}, a AS (SELECT DISTINCT path, line FROM v_findings WHERE tool = 'R'), b AS (SELECT DISTINCT path, line FROM v_findings WHERE tool = 'A')
  SELECT path, line, EXISTS (SELECT 1 FROM b WHERE b.path = a.path AND abs(b.line - a.line) <= 3) AS agreed FROM a""")
def _(spark, d):
    return crosscheck.tolerance_match(_tool(spark, d, "R"), _tool(spark, d, "A")).select("path", "line", "agreed")


@query("stem_tolerance_match", f"""{ctes('v_findings')}, f AS (SELECT DISTINCT regexp_replace(path, '[.][^./]*$', '') AS stem, line, tool FROM v_findings), a AS (SELECT stem, line FROM f WHERE tool = 'R'), b AS (SELECT stem, line FROM f WHERE tool = 'A')
  SELECT stem, line, EXISTS (SELECT 1 FROM b WHERE b.stem = a.stem AND abs(b.line - a.line) <= 3) AS agreed FROM a""")
def _(spark, d):
    side = lambda t: _tool(spark, d, t).select(crosscheck.stem(F.col("path")).alias("stem"), "line").distinct()
    return crosscheck.tolerance_match(side("R"), side("A"), on="stem").select("stem", "line", "agreed")


@query("usage_votes", f"{ctes('v_uses')} SELECT symbol, count(DISTINCT package) AS votes FROM v_uses GROUP BY 1")
def _(spark, d):
    return crosscheck.votes(view(spark, d, "v_uses"))


@query("most_voted", f"{ctes('v_uses')} SELECT symbol, count(DISTINCT package) AS votes FROM v_uses GROUP BY 1 ORDER BY votes DESC, symbol LIMIT 12")
def _(spark, d):
    return crosscheck.most_voted(view(spark, d, "v_uses"), 12)


@query("unused_labels", f"{ctes('v_uses', 'v_symbol_labels')} SELECT DISTINCT symbol FROM v_symbol_labels WHERE symbol NOT IN (SELECT symbol FROM v_uses)")
def _(spark, d):
    return crosscheck.unused(view(spark, d, "v_symbol_labels"), view(spark, d, "v_uses"))


@query("unlabelled_used", f"""{ctes('v_uses', 'v_symbol_labels')}, t AS (SELECT symbol, count(DISTINCT package) AS votes FROM v_uses GROUP BY 1 ORDER BY votes DESC, symbol LIMIT 5)
  SELECT symbol, votes FROM t WHERE symbol NOT IN (SELECT symbol FROM v_symbol_labels)""")
def _(spark, d):
    return crosscheck.unlabelled(view(spark, d, "v_symbol_labels"), view(spark, d, "v_uses"))


# --- facts, manifest, scaffold ---
@query("fact_enrich", f"""{_POINTS}, defs AS (SELECT 'brand_' || CAST(o_custkey % 25 AS STRING) AS module, CASE o_orderkey % 3 WHEN 0 THEN 'small_ring' WHEN 1 THEN 'red_widgetPlugin' ELSE 'blue_boltHandler' END AS name, o_orderkey AS ord, o_orderpriority AS base FROM orders),
  first AS (SELECT module, name, arg_min(base, ord) AS base FROM defs GROUP BY 1, 2)
  SELECT p.seam_ord, p.module, p.name, p.kind, CASE WHEN f.name IS NULL OR {_DYN} THEN '' WHEN {_FN} THEN 'def ' || p.name || '(self)' ELSE 'class ' || p.name || '(' || f.base || ')' END AS signature
  FROM points p LEFT JOIN first f ON f.module = p.module AND f.name = p.name""")
def _(spark, d):
    k = F.col("o_orderkey") % 3
    defs = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("brand_"), (F.col("o_custkey") % 25).cast("string")).alias("module"), F.when(k == 0, "small_ring").when(k == 1, "red_widgetPlugin").otherwise("blue_boltHandler").alias("name"), F.col("o_orderkey").alias("ord"), F.array("o_orderpriority").alias("bases"))
    none = F.array().cast("array<string>")
    classes = defs.withColumn("decorators", none).withColumn("methods", F.array().cast("array<struct<name: string, args: array<string>, decorators: array<string>>>"))
    functions = defs.select("module", "name", "ord", F.array(F.lit("self")).alias("args"), none.alias("decorators"))
    return facts.enrich(_points(spark, d), classes, functions).select("seam_ord", "module", "name", "kind", "signature")


@query("scaffold_text", ctes("v_scaffolds") + r""", m AS (SELECT *, CASE WHEN methods = '' THEN [] ELSE string_split(methods, ';') END AS implement FROM v_scaffolds)
  SELECT ord, id, 'from ' || module || ' import ' || symbol || chr(10) || chr(10) || chr(10) ||
    CASE WHEN kind IN ('class', 'abstract_class') THEN 'class My' || symbol || '(' || symbol || '):' || chr(10) || '    ""\"Extends ' || id || '.""\"' || chr(10) ||
      CASE WHEN len(implement) > 0 THEN array_to_string(list_transform(implement, lambda s: chr(10) || '    ' || s || ':' || chr(10) || '        raise NotImplementedError("TODO: ' || trim(string_split(regexp_replace(s, '^def ', ''), '(')[1]) || '")' || chr(10)), '') ELSE chr(10) || '    pass' || chr(10) END
    ELSE '# ' || id || ' (' || category || ')' || chr(10) || CASE WHEN signature <> '' THEN '# It is: ' || signature || chr(10) ELSE '' END || chr(10) || 'def my_plugin():' || chr(10) || '    raise NotImplementedError("TODO: ' || symbol || '")' || chr(10) END AS text FROM m""".replace('\\"', '"'))
def _(spark, d):
    s = view(spark, d, "v_scaffolds").withColumn("implement", F.when(F.col("methods") == "", F.array().cast("array<string>")).otherwise(F.split("methods", ";")))
    return s.select("ord", "id", facts.scaffold_text().alias("text"))


@query("config_points", f"""{ctes('v_paths')}, p AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM v_paths), s AS (SELECT path, parts, lower(parts[-1]) AS name FROM p WHERE NOT list_has_any(parts[1:len(parts) - 1], {_list(config_scan.SKIPPED)}))
  SELECT path, 'manifest_file' AS kind FROM s WHERE list_contains({_list(config_scan.STEMS)}, regexp_extract(name, '^(.*)[.][^.]*$', 1)) AND list_contains({_list(config_scan.ENDINGS)}, regexp_extract(name, '[.]([^.]*)$', 1))
  UNION ALL SELECT DISTINCT array_to_string(parts[1:k], '/'), 'data_dir' FROM (SELECT parts, unnest(range(1, len(parts))) AS k FROM s) WHERE list_contains({_list(config_scan.FOLDERS)}, lower(parts[k]))""")
def _(spark, d):
    return config_scan.config_points(view(spark, d, "v_paths"))


# --- documentation run ---
@query("first_success", f"{ctes('v_attempts')} SELECT point, coalesce(min(n) FILTER (ok), max(n)) AS attempt, bool_or(ok) AS ok FROM v_attempts WHERE n <= {TRIES} GROUP BY 1")
def _(spark, d):
    return docgen.first_success(view(spark, d, "v_attempts"), TRIES)


@query("cache_key", f"{ctes('v_prompts')} SELECT doc_id, sha256('fake' || chr(0) || '' || chr(0) || 'm1' || chr(0) || source || chr(0) || prompt) AS key FROM v_prompts")
def _(spark, d):
    return view(spark, d, "v_prompts").select("doc_id", docgen.cache_key(F.lit("fake"), F.lit(""), F.lit("m1"), F.col("source"), F.col("prompt")).alias("key"))


@query("budget_cap", f"{ctes('v_prompts')}, n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS call_no FROM v_prompts) SELECT * FROM n WHERE call_no <= {BUDGET}")
def _(spark, d):
    return docgen.within_budget(view(spark, d, "v_prompts").select("doc_id", "source"), BUDGET, "source", "doc_id").select("doc_id", "source", F.col("call_no").cast("long").alias("call_no"))


@query("extract_code", f"""{ctes('v_names')}, t AS (SELECT ord, CASE ord % 3 WHEN 0 THEN 'Here:' || chr(10) || '```python' || chr(10) || p_name || chr(10) || '```' WHEN 1 THEN '```' || p_name || '```more' ELSE p_name END AS text FROM v_names)
  SELECT ord, trim(CASE WHEN contains(text, '```') THEN regexp_replace(string_split(text, '```')[2], '^(python|py)[ \t]*\n', '') ELSE text END, ' ' || chr(10)) AS code FROM t""")
def _(spark, d):
    k = F.col("ord") % 3
    text = F.when(k == 0, F.concat(F.lit("Here:\n```python\n"), F.col("p_name"), F.lit("\n```"))).when(k == 1, F.concat(F.lit("```"), F.col("p_name"), F.lit("```more"))).otherwise(F.col("p_name"))
    return view(spark, d, "v_names").select("ord", docgen.extract_code(text).alias("code"))


@query("drop_reasons", f"""{ctes('v_names')} SELECT CASE WHEN starts_with(CASE ord % 4 WHEN 0 THEN 'import failed: ' || p_name ELSE 'not callable' END, 'import failed') THEN 'import_failed' ELSE 'validation_failed' END AS status, count(*) AS n FROM v_names GROUP BY 1""")
def _(spark, d):
    detail = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("import failed: "), F.col("p_name"))).otherwise("not callable")
    return docgen.totals(view(spark, d, "v_names").select(docgen.drop_reason(detail).alias("status")))


@query("call_budget", f"{ctes('v_attempts')} SELECT point, 1 + count(*) * (1 + greatest(3, least(5, max(n)))) AS calls FROM v_attempts GROUP BY 1")
def _(spark, d):
    return view(spark, d, "v_attempts").groupBy("point").agg(docgen.worst_case_calls(F.count(F.lit(1)), docgen.retries(F.max("n"))).alias("calls"))


# --- scalar functions ---
@query("normalise_id", f"""{ctes('v_seams')} SELECT seam_ord, CASE WHEN seam_ord % 3 = 0 THEN 'brand_1' WHEN module = 'brand_1' OR starts_with(module, 'brand_1.') THEN module ELSE 'brand_1.' || module END || ':' || name AS id FROM v_seams""")
def _(spark, d):
    module = F.when(F.col("seam_ord") % 3 == 0, "").otherwise(F.col("module"))
    return _seams(spark, d).select("seam_ord", N.target_id(F.lit("brand_1"), module, F.col("name")).alias("id"))


@query("base_tail", f"""{ctes('v_names')}, b AS (SELECT ord, CASE ord % 3 WHEN 0 THEN 'a.b.' || p_type || '[int]' WHEN 1 THEN p_type ELSE 'x.' || p_type || '<T>' END AS base FROM v_names)
  SELECT ord, trim(string_split(string_split(base, '.')[-1], '[')[1]) AS tail, string_split(trim(string_split(base, '<')[1]), '.')[-1] AS bare FROM b""")
def _(spark, d):
    k = F.col("ord") % 3
    base = F.when(k == 0, F.concat(F.lit("a.b."), F.col("p_type"), F.lit("[int]"))).when(k == 1, F.col("p_type")).otherwise(F.concat(F.lit("x."), F.col("p_type"), F.lit("<T>")))
    return view(spark, d, "v_names").select("ord", N.bare(base).alias("tail"), N.bare_type(base).alias("bare"))


@query("slugify", f"{ctes('v_names')} SELECT ord, regexp_replace(p_brand || ':' || p_name, '[^\\p{{L}}\\p{{N}}]', '_', 'g') AS slug FROM v_names")
def _(spark, d):
    return view(spark, d, "v_names").select("ord", N.slug(F.concat("p_brand", F.lit(":"), "p_name")).alias("slug"))


@query("location", f"""{ctes('v_seams')} SELECT seam_ord, module || ':' || CAST(lineno AS STRING) AS place, coalesce(TRY_CAST(string_split(CASE WHEN seam_ord % 2 = 0 THEN module || ':' || CAST(lineno AS STRING) ELSE module END, ':')[-1] AS INT), 0) AS line FROM v_seams""")
def _(spark, d):
    place = N.location(F.col("module"), F.col("lineno"))
    return _seams(spark, d).select("seam_ord", place.alias("place"), N.line_of(F.when(F.col("seam_ord") % 2 == 0, place).otherwise(F.col("module"))).alias("line"))




# --- smaller operators ---
@query("ok_failed_modules", f"""{ctes('v_modules')}, m AS (SELECT path, CASE WHEN ord % 5 = 0 THEN 'SyntaxError' END AS parse_error FROM v_modules) SELECT parse_error IS NULL AS ok, count(*) AS n FROM m GROUP BY 1""")
def _(spark, d):
    m = view(spark, d, "v_modules").withColumn("parse_error", F.when(F.col("ord") % 5 == 0, "SyntaxError"))
    return m.groupBy(F.col("parse_error").isNull().alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("module_path_join", f"""{_LOOKUP}, p AS (SELECT 'mod' || CAST(c_custkey % 25 AS STRING) AS module, arg_max(c_name, c_custkey) AS path FROM customer GROUP BY 1)
  SELECT f.ord, f.module, p.path FROM found f JOIN p ON p.module = f.module""")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    path = c.groupBy(F.concat(F.lit("mod"), (F.col("c_custkey") % 25).cast("string")).alias("module")).agg(F.max_by("c_name", "c_custkey").alias("path"))
    return sinks.lookup_python(view(spark, d, "v_calls")).join(path, "module").select("ord", "module", "path")


@query("override_exists", "SELECT o_custkey AS cls, bool_or(o_orderstatus = 'P') AS has_override_point FROM orders GROUP BY 1")
def _(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("cls")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("has_override_point"))


@query("implement_projection", """WITH m AS (SELECT o_custkey AS cls, o_orderkey AS ord, 'def m' || CAST(o_orderkey AS STRING) || '(self, ' || lower(o_orderstatus) || ')' AS sig FROM orders WHERE o_orderpriority LIKE '1%')
  SELECT cls, string_agg(sig, '; ' ORDER BY ord) AS implement FROM m GROUP BY 1""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    decorators = F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("abc.abstractmethod"))).otherwise(F.array(F.lit("property")))
    method = F.struct(F.col("o_orderkey").alias("ord"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("name"), F.array(F.lit("self"), F.lower("o_orderstatus")).alias("args"), decorators.alias("decorators"))
    per = o.groupBy(F.col("o_custkey").alias("cls")).agg(F.array_sort(F.collect_list(method)).alias("methods"))
    return per.select("cls", F.array_join(facts.to_implement(F.col("methods")), "; ").alias("implement")).filter("implement <> ''")


@query("fact_text", f"""{_POINTS} SELECT seam_ord, 'module: ' || module || chr(10) || 'symbol: ' || name || chr(10) || 'kind: ' || kind || chr(10) || 'category: ' || category || chr(10) || 'location: ' || module || ':' || CAST(lineno AS STRING)
  || CASE WHEN {_FN} THEN chr(10) || 'signature: def ' || name || '(self)' ELSE '' END || CASE WHEN {_SIGNALS} <> '' THEN chr(10) || 'detector signals:' || chr(10) || '  - ' || replace({_SIGNALS}, '; ', chr(10) || '  - ') ELSE '' END AS text FROM points""")
def _(spark, d):
    none = F.array().cast("array<string>")
    p = _points(spark, d).withColumn("signature", F.when(scoring.is_function(), N.function_signature(F.col("name"), F.array(F.lit("self")))).otherwise("")).withColumn("bases", none).withColumn("decorators", none).withColumn("implement", none)
    return p.select("seam_ord", facts.fact_text(p).alias("text"))


@query("manifest_points", f"{_POINTS} SELECT seam_ord, module || ':' || name AS id, round(score, 4) AS score FROM points")
def _(spark, d):
    return _points(spark, d).select("seam_ord", N.point_id(F.col("module"), F.col("name")).alias("id"), F.round("score", 4).alias("score"))


@query("ids_in_both", f"{ctes('v_points')} SELECT DISTINCT id FROM v_points WHERE side = 1 INTERSECT SELECT DISTINCT id FROM v_points WHERE side = 2")
def _(spark, d):
    old, new = _sides(spark, d)
    return old.select("id").intersect(new.select("id"))


@query("version_guard", """WITH want AS (SELECT n_name AS target, CAST(n_regionkey AS STRING) AS version FROM nation), have AS (SELECT n_name AS target, CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS STRING) AS version FROM nation)
  SELECT target, version FROM want ANTI JOIN have USING (target, version)""")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    want = n.select(F.col("n_name").alias("target"), F.col("n_regionkey").cast("string").alias("version"), F.lit("x").alias("id"))
    have = n.select(F.col("n_name").alias("target"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")).cast("string").alias("version"))
    return snapshots.pinned(want, have)[1]


@query("verification_tally", f"""{ctes('v_attempts')} SELECT CASE WHEN n > 3 THEN 'SKIP' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS n FROM v_attempts GROUP BY 1""")
def _(spark, d):
    return validate.tally(view(spark, d, "v_attempts").select("ok", F.when(F.col("n") > 3, "skipped").otherwise("importable_callable").alias("method")))


@query("preview_counts", f"""{_POINTS} SELECT count(*) FILTER (score >= CAST(0.5 AS DOUBLE)) AS at_threshold, count(*) AS n_points, count(DISTINCT module) AS n_modules FROM points""")
def _(spark, d):
    return _points(spark, d).agg(F.count_if(F.col("score") >= 0.5).alias("at_threshold"), F.count(F.lit(1)).alias("n_points"), F.countDistinct("module").alias("n_modules"))


@query("positional_zip", f"""{_POINTS}, v AS (SELECT o_orderkey AS seam_ord, o_orderstatus = 'F' AS ok, o_orderpriority AS detail FROM orders) SELECT p.seam_ord, p.name, v.detail AS reason FROM points p JOIN v ON v.seam_ord = p.seam_ord WHERE NOT v.ok""")
def _(spark, d):
    v = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seam_ord"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_orderpriority").alias("reason"))
    return _points(spark, d).join(v, "seam_ord").filter(~F.col("ok")).select("seam_ord", "name", "reason")


@query("host_semi_join", f"""{ctes('v_names')}, b AS (SELECT ord, 'lib.' || p_type || CASE WHEN ord % 2 = 0 THEN '[int]' ELSE '' END AS base FROM v_names), h AS (SELECT DISTINCT p_type AS symbol FROM v_names WHERE p_type LIKE 'S%')
  SELECT ord, trim(string_split(string_split(base, '.')[-1], '[')[1]) AS symbol FROM b WHERE trim(string_split(string_split(base, '.')[-1], '[')[1]) IN (SELECT symbol FROM h)""")
def _(spark, d):
    names = view(spark, d, "v_names")
    base = F.concat(F.lit("lib."), F.col("p_type"), F.when(F.col("ord") % 2 == 0, "[int]").otherwise(""))
    host = names.filter(F.col("p_type").startswith("S")).select(F.col("p_type").alias("symbol")).distinct()
    return names.select("ord", N.bare(base).alias("symbol")).join(host, "symbol", "left_semi").select("ord", "symbol")


@query("in_scope", f"{ctes('v_sinks')} SELECT ord, id, lineno FROM v_sinks WHERE category IN ('process', 'dynamic_load')")
def _(spark, d):
    return view(spark, d, "v_sinks").filter(F.col("category").isin("process", "dynamic_load")).select("ord", "id", "lineno")


@query("qualnames", r"""SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(p, '\.[^./]*$', ''), '/'), lambda x: x <> '__init__'), '.') AS python, regexp_replace(p, '\.[^./]*$', '') AS slash FROM (
  SELECT page_id, split_part(url, '/', 3) || '/' || split_part(url, '/', 4) || CASE WHEN page_id % 2 = 0 THEN '/__init__.py' ELSE '/mod.py' END AS p FROM pages)""")
def _(spark, d):
    p = F.concat(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4)), F.when(F.col("page_id") % 2 == 0, "/__init__.py").otherwise("/mod.py"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", N.qualname(p).alias("python"), N.qualname(p, "slash").alias("slash"))
