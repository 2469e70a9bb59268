"""Queries over sources that are rows of tables: each row of a driver's table becomes a source file, and SQL says from the row's columns what is in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, scoring, sinks
from tessera.sources import java_source, python_source, typescript_source

from . import detect
from .adapters import ctes, view
from .catalogue import query

_N = " || chr(10) || "
_K = "CAST(k AS STRING)"


#: Rows of a large table that one parsing task gets.
FILES_PER_TASK = 20_000


def _case(by: int, *texts: str) -> str:
    """One of several SQL texts by the key's remainder."""
    return f"CASE k % {by} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts[:-1])) + f" ELSE {texts[-1]} END"


_q = lambda t: "'" + t.replace("'", "''") + "'"

#: A Python file per part: every 17th can't be parsed.
_PY_LINES = [
    "'import os.path, json as js'",
    "'from ' || " + _case(3, "''", "'.'", "'..'") + " || 'lib' || size || ' import thing as other, item'",
    _case(4, "'pass'", _q("__all__ = ['make', 'Tool']"), _q("__all__ = ('Tool', 3)"), "'__all__ = []'"),
    _case(2, "'@app.register'", "'@app.register(1)'"),
    "'def make(first, size=' || size || ', *rest, key=None):'",
    "'    ' || " + _case(3, "'raise NotImplementedError(first)'", "'return eval(first)'", "'return pickle.loads(first)'"),
    "'class Tool(' || " + _case(5, "'abc.ABC'", "'base.Handler'", "'Generic[T]'", "'metaclass=ABCMeta'", "'object, mixins.Log'") + " || '):'",
    "'    ' || " + _case(7, "'@abc.abstractmethod'", *["'@property'"] * 6),
    "'    def run(self, data):'",
    "'        subprocess.run(data, shell=' || " + _case(3, "'True'", "'flag'", "'False'") + " || ')'",
    "'    def __reduce__(self):'",
    "'        ' || " + _case(6, "'raise errors.NotImplementedError'", *["'return ()'"] * 5),
    "'if True:'",
    "'    def hidden(): return importlib.import_module(''plug' || size || ''')'",
    "'@overload'", "'def _over(a): ...'", "'@overload'", "'def _over(a, b): ...'",
    _case(2, "'item = get().__import__(name)'", "'def _over(*a): pass'"),
    "''",
]
V_PY = f"""SELECT k, 'pkg' || size || '/m' || {_K} || '.py' AS path, CASE WHEN k % 17 = 0 THEN 'def broken(:' ELSE {_N.join(_PY_LINES)} END AS content
  FROM (SELECT p_partkey AS k, CAST(p_size AS STRING) AS size FROM part) p"""
_PY = f"WITH p AS (SELECT p_partkey AS k, CAST(p_size AS STRING) AS size, 'pkg' || CAST(p_size AS STRING) || '.m' || CAST(p_partkey AS STRING) AS module FROM part), ok AS (SELECT * FROM p WHERE k % 17 <> 0)"

_TS_LINES = [
    "'import { exec as run, spawn } from ''child_process'';'",
    _q('import * as vm from "node:vm";'),
    "'const cp = require(''child_process''), quiet = 1; // cp.exec(not)'",
    "'const { fork, exec: split } = require(''child_process'');'",
    _case(2, "'@Component({selector: \"x\"})'", "'/* class Commented {} */'"),
    _case(3, "'export abstract class'", "'export class'", "'class'") + f" || ' Widget' || {_K} || ' extends Base<T> implements Core, Other {{ go() {{ class Inner {{}} }} }}'",
    f"'export interface Api' || {_K} || ' extends Root {{}}'",
    _case(2, "''", "'async '") + " || 'function helper(a: number, b?: string, ...rest) { return eval(a); }'",
    "'spawn(x); cp.execSync(x); vm.runInContext(code); fork(x);'",
    "'setTimeout(' || " + _case(2, "'''go()'''", "'go'") + " || ', 1); require(' || " + _case(2, "'''fs'''", "'name'") + " || '); run(x); child_process.exec(x);'",
    _case(4, "'module.exports = { helper, other: Hidden };'", "'exports.helper = helper;'", "'module.exports = Hidden;'", "''"),
    "'class Hidden {}'",
    "'const f = new Function(''return 1''); other.eval(x);'",
    "''",
]
V_TS = f"SELECT k, 'src/w' || {_K} || CASE WHEN k % 10 = 9 THEN '.d.ts' ELSE '.ts' END AS path, {_N.join(_TS_LINES)} AS content FROM (SELECT c_custkey AS k FROM customer) c"
_TS = f"WITH t AS (SELECT c_custkey AS k, 'src/w' || CAST(c_custkey AS STRING) AS module FROM customer WHERE c_custkey % 10 <> 9)"

_JAVA_LINES = [
    "'package a.b;'",
    "'import java.io.ObjectInputStream;'",
    "'import static java.util.List.of;'",
    "'import a.b.*; // import not.this;'",
    _case(2, "'@Plugin(name = \"x\") @org.Role'", "'// @Plugin'"),
    _case(3, "'public abstract class'", "'public class'", "'final class'") + f" || ' Job' || {_K} || '<K> extends pkg.Base<String> implements Hook, x.Other<K> {{'",
    "'  private ScriptEngine engine;'",
    "'  void run(String s, Runtime given) {'",
    "'    Runtime rt = Runtime.getRuntime();'",
    "'    rt.exec(' || " + _case(3, "'\"sh\"'", "'\"ls\"'", "'s'") + " || ');'",
    "'    engine.eval(s); given.exec(s);'",
    "'    new ProcessBuilder(' || " + _case(2, "'\"bash\", \"-c\"'", "'s'") + " || ').start();'",
    "'    Class.forName(s); Runtime.getRuntime().exec(s); other.eval(s);'",
    "'  }'",
    "'  private void readObject(' || " + _case(2, "'ObjectInputStream in'", "'String s'") + " || ') { }'",
    "'}'",
    "'interface Side extends A, B<C> {}'",
    "'@interface Mark {}'",
    "'public record Pair(int a, int b) implements Cmp {} enum Kind { X }'",
    "''",
]
V_JAVA = f"SELECT k, 'src/J' || {_K} || '.java' AS path, {_N.join(_JAVA_LINES)} AS content FROM (SELECT c_custkey AS k FROM customer) c"
_JAVA = "WITH t AS (SELECT c_custkey AS k, 'src.J' || CAST(c_custkey AS STRING) AS module FROM customer)"


def _files(spark: SparkSession, d: str, sql: str, table: str) -> DataFrame:
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {table})", "FROM {t})")  # the sources' own braces are no fields
    rows, n = spark.read.parquet(f"{d}/{table}.parquet"), spark.sparkContext.defaultParallelism
    tasks = n * max(1, round(rows.count() / n / FILES_PER_TASK))  # whole waves; a million rows may be one file, and parsing needs more tasks than reading
    if rows.rdd.getNumPartitions() < tasks:
        rows = rows.repartition(tasks)
    return spark.sql(text, t=rows)


def _py(spark: SparkSession, d: str, *facts: str) -> DataFrame:
    return python_source.modules_of(_files(spark, d, V_PY, "part"), "path", "qualname", "parse_error", "all_exports", *facts)


def _ts(spark: SparkSession, d: str, *facts: str) -> DataFrame:
    return typescript_source.modules_of(_files(spark, d, V_TS, "customer"), "qualname", "parse_error", *facts)


def _java(spark: SparkSession, d: str, *facts: str) -> DataFrame:
    return java_source.modules_of(_files(spark, d, V_JAVA, "customer"), "qualname", "parse_error", *facts)


def _each(modules: DataFrame, column: str) -> DataFrame:
    return modules.select(F.col("qualname").alias("module"), F.explode(column).alias("x")).select("module", "x.*")


_text = lambda c: F.array_join(c, ",").alias(c)


# --- Python: S4, S5, P1 to P7, P9, P17, P18, and P8 on parsed stubs ---
@query("parse_tree", f"{_PY} SELECT module, k % 17 <> 0 AS ok, CASE WHEN k % 17 = 0 THEN 'SyntaxError' END AS error FROM p")
def _(spark, d):
    return _py(spark, d).select(F.col("qualname").alias("module"), F.col("parse_error").isNull().alias("ok"), F.substring_index("parse_error", ":", 1).alias("error"))


@query("python_functions", f"""{_PY}, f AS (
  SELECT module, 'make' AS name, 5 AS lineno, 'first,size' AS args, CASE k % 2 WHEN 0 THEN 'app.register' ELSE '' END AS decorators, k % 3 = 0 AS raises_notimplemented, false AS is_stub, true AS is_public FROM ok
  UNION ALL SELECT module, '_over', CASE k % 2 WHEN 0 THEN 16 ELSE 19 END, CASE k % 2 WHEN 0 THEN 'a' ELSE '' END, CASE k % 2 WHEN 0 THEN 'overload' ELSE '' END, false, k % 2 = 0, false FROM ok) SELECT * FROM f""")
def _(spark, d):
    return _each(_py(spark, d, "functions"), "functions").select("module", "name", "lineno", _text("args"), _text("decorators"), "raises_notimplemented", "is_stub", "is_public")


@query("python_classes", f"""{_PY} SELECT module, 'Tool' AS name, 7 AS lineno, CASE k % 5 WHEN 0 THEN 'abc.ABC' WHEN 1 THEN 'base.Handler' WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'object,mixins.Log' END AS bases,
  CASE k % 5 WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS n_bases, k % 5 = 0 OR k % 7 = 0 AS is_abstract, k % 6 = 0 AS has_override_point, 'run(self,data),__reduce__(self)' AS methods FROM ok""")
def _(spark, d):
    methods = F.array_join(F.transform("methods", lambda m: F.concat(m["name"], F.lit("("), F.array_join(m["args"], ","), F.lit(")"))), ",")
    return _each(_py(spark, d, "classes"), "classes").select("module", "name", "lineno", _text("bases"), F.size("bases").alias("n_bases"), "is_abstract", F.exists("methods", lambda m: m["raises_notimplemented"]).alias("has_override_point"), methods.alias("methods"))


@query("python_imports", f"""{_PY}, i AS (SELECT module, 'os.path' AS import, 'os.path' AS name, false AS fromlist FROM ok UNION ALL SELECT module, 'json', 'js', false FROM ok
  UNION ALL SELECT module, repeat('.', CAST(k % 3 AS INT)) || 'lib' || size, n, true FROM ok, (VALUES ('other'), ('item')) x(n)) SELECT * FROM i""")
def _(spark, d):
    m = _py(spark, d, "imports").select(F.col("qualname").alias("file"), F.explode("imports").alias("x"))
    return m.select(F.col("file").alias("module"), F.col("x.module").alias("import"), "x.name", "x.fromlist")


@query("python_exports", f"{_PY} SELECT module, CASE k % 4 WHEN 1 THEN 'make,Tool' WHEN 2 THEN 'Tool' WHEN 3 THEN '' END AS exports FROM ok")
def _(spark, d):
    return _py(spark, d).filter("parse_error IS NULL").select(F.col("qualname").alias("module"), F.array_join("all_exports", ",").alias("exports"))


@query("python_runtime_imports", f"""{_PY} SELECT module, 'import_module' AS kind, 14 AS lineno, 'plug' || size AS argument FROM ok UNION ALL SELECT module, '__import__', 19, NULL FROM ok WHERE k % 2 = 0""")
def _(spark, d):
    return _each(_py(spark, d, "dynamic_imports"), "dynamic_imports").select("module", "kind", "lineno", "argument")


_PY_SINKS = f"""{_PY}, s AS (SELECT module, 6 AS lineno, 'eval' AS dotted, 'TSX-EVAL' AS id, 'high' AS severity, 'high' AS confidence FROM ok WHERE k % 3 = 1
  UNION ALL SELECT module, 6, 'pickle.loads', 'TSX-PICKLE', 'high', 'high' FROM ok WHERE k % 3 = 2
  UNION ALL SELECT module, 10, 'subprocess.run', 'TSX-SUBPROC', CASE k % 3 WHEN 0 THEN 'high' ELSE 'medium' END, 'medium' FROM ok
  UNION ALL SELECT module, 11, '__reduce__', 'TSX-REDUCE', 'medium', 'low' FROM ok
  UNION ALL SELECT module, 14, 'importlib.import_module', 'TSX-DYNIMPORT', 'medium', 'medium' FROM ok
  UNION ALL SELECT module, 19, '__import__', 'TSX-DYNIMPORT', 'medium', 'low' FROM ok WHERE k % 2 = 0)"""


@query("audit_tree", f"{_PY_SINKS} SELECT * FROM s")
def _(spark, d):
    return detect.audit(_py(spark, d, "calls")).select("module", "lineno", "dotted", "id", "severity", "confidence")


@query("sink_places", f"{_PY_SINKS} SELECT module, lineno, dotted, row_number() OVER (PARTITION BY module ORDER BY lineno, dotted) AS nth FROM s")
def _(spark, d):
    from pyspark.sql import Window

    found = detect.audit(_py(spark, d, "calls"))
    return found.select("module", "lineno", "dotted", F.row_number().over(Window.partitionBy("module").orderBy(*sinks.place(found)[1:])).cast("long").alias("nth"))


_SEAMS = ("imports", "functions", "classes", "dynamic_imports")
_PY_SEAMS = f"""{_PY}, x AS (SELECT module, 'function' AS kind, 'make' AS name, 5 AS lineno, CASE k % 2 WHEN 0 THEN 'app.register' ELSE '' END AS detail, false AS has_override_point FROM ok WHERE k % 4 IN (0, 1)
  UNION ALL SELECT module, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'abstract_class' ELSE 'class' END, 'Tool', 7, CASE k % 5 WHEN 0 THEN 'abc.ABC' WHEN 1 THEN 'base.Handler' WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'object, mixins.Log' END, k % 6 = 0 FROM ok WHERE k % 4 <> 3
  UNION ALL SELECT module, 'dynamic_import', 'import_module', 14, 'import_module(''plug' || size || ''')', false FROM ok
  UNION ALL SELECT module, 'dynamic_import', '__import__', 19, '__import__()', false FROM ok WHERE k % 2 = 0)"""


@query("detect_tree", f"{_PY_SEAMS} SELECT * FROM x")
def _(spark, d):
    """The seams of all files: lists of exports decide what is visible (also empty ones), stubs are collapsed; no file is a package, so nothing is re-exported."""
    return detect.seams(_py(spark, d, *_SEAMS)).select("module", "kind", "name", "lineno", "detail", "has_override_point")


@query("runtime_sites", f"{_PY_SEAMS} SELECT module, name, lineno, detail FROM x WHERE kind = 'dynamic_import'")
def _(spark, d):
    return graph.runtime_sites(detect.seams(_py(spark, d, *_SEAMS))).select("module", "name", "lineno", "detail")


@query("subclassable", f"{_PY_SEAMS} SELECT module, name, kind FROM x WHERE kind IN ('class', 'abstract_class')")
def _(spark, d):
    return graph.subclassable(detect.seams(_py(spark, d, *_SEAMS))).select("module", "name", "kind")


@query("exported_names", """WITH c AS (SELECT 'p' || CAST(c_custkey % 40 AS STRING) AS pkg, c_custkey AS k FROM customer),
  i AS (SELECT DISTINCT pkg FROM c) SELECT DISTINCT n AS name FROM (SELECT unnest(CASE CAST(substr(pkg, 2) AS INT) % 3 WHEN 0 THEN ['All_' || pkg] WHEN 1 THEN ['From_' || pkg, 'alias'] ELSE [] END) AS n FROM i) x""")
def _(spark, d):
    """What the top-level packages export: their list, else what they import from elsewhere; a package inside another says nothing."""
    c = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 40).alias("n")).distinct()
    pkg, k = F.concat(F.lit("p"), F.col("n").cast("string")), F.col("n") % 3
    text = F.when(k == 0, F.concat(F.lit("from x import not_this\n__all__ = ['All_"), pkg, F.lit("']"))).when(k == 1, F.concat(F.lit("import os\nfrom .a import From_"), pkg, F.lit(", b as alias"))).otherwise("import os\n__all__ = []")
    top = c.select(F.concat(pkg, F.lit("/__init__.py")).alias("path"), text.alias("content"))
    inner = c.select(F.concat(pkg, F.lit("/sub/__init__.py")).alias("path"), F.lit("__all__ = ['Inner']").alias("content"))
    return detect.exported_names(python_source.modules_of(top.unionByName(inner)))


# --- TypeScript and JavaScript: S6, P11 to P13, P19, F9, J10 ---
@query("typescript_declarations", f"""{_TS}, x AS (
  SELECT module, 'class' AS kind, 'Widget' || CAST(k AS STRING) AS name, 6 AS lineno, k % 3 < 2 AS is_public, k % 3 = 0 AS is_abstract, 'Base<T>,Core,Other' AS bases, CASE k % 2 WHEN 0 THEN 'Component' ELSE '' END AS decorators, '' AS args FROM t
  UNION ALL SELECT module, 'interface', 'Api' || CAST(k AS STRING), 7, true, true, 'Root', '', '' FROM t
  UNION ALL SELECT module, 'function', 'helper', 8, k % 4 < 2, false, '', '', 'a,b?,...rest' FROM t
  UNION ALL SELECT module, 'class', 'Hidden', 12, k % 4 IN (0, 2), false, '', '', '' FROM t) SELECT * FROM x""")
def _(spark, d):
    return _each(_ts(spark, d, "declarations"), "declarations").select("module", "kind", "name", "lineno", "is_public", "is_abstract", _text("bases"), _text("decorators"), _text("args"))


@query("typescript_bindings", f"""{_TS}, x AS (SELECT module, b.* FROM t, (VALUES ('run', 'child_process', 'exec'), ('spawn', 'child_process', 'spawn'), ('vm', 'node:vm', NULL), ('cp', 'child_process', NULL), ('fork', 'child_process', 'fork'), ('split', 'child_process', 'exec'))
  b(local, source, member)) SELECT * FROM x""")
def _(spark, d):
    m = _ts(spark, d, "bindings").select(F.col("qualname").alias("file"), F.explode("bindings").alias("x"))
    return m.select(F.col("file").alias("module"), "x.local", F.col("x.module").alias("source"), "x.member")


@query("typescript_sinks", f"""{_TS}, x AS (SELECT module, b.* FROM t, (VALUES (8, 'TSX-EVAL', 'eval', 'high'), (9, 'TSX-CHILDDIRECT', 'spawn', 'medium'), (9, 'TSX-CHILD', 'cp.execSync', 'high'), (9, 'TSX-VM', 'vm.runInContext', 'high'), (9, 'TSX-CHILDDIRECT', 'fork', 'medium'),
    (10, 'TSX-CHILD', 'child_process.exec', 'high'), (13, 'TSX-JSFUNC', 'Function', 'high')) b(lineno, id, call, severity)
  UNION ALL SELECT module, 10, 'TSX-TIMERSTR', 'setTimeout', 'medium' FROM t WHERE k % 2 = 0 UNION ALL SELECT module, 10, 'TSX-DYNREQUIRE', 'require', 'medium' FROM t WHERE k % 2 = 1) SELECT * FROM x""")
def _(spark, d):
    return typescript_source.audit(_ts(spark, d, "calls", "bindings")).select("module", "lineno", "id", "call", "severity")


# --- Java: S7, P14 to P16, P20 to P22, E4, A12 ---
@query("java_declarations", f"""{_JAVA}, x AS (
  SELECT module, 'class' AS kind, 'Job' || CAST(k AS STRING) AS name, 6 AS lineno, k % 3 < 2 AS is_public, k % 3 = 0 AS is_abstract, 'Base,Hook,Other' AS bases, CASE k % 2 WHEN 0 THEN 'Plugin,Role' ELSE '' END AS decorators FROM t
  UNION ALL SELECT module, 'interface', 'Side', 17, false, true, 'A,B', '' FROM t UNION ALL SELECT module, 'record', 'Pair', 19, true, false, 'Cmp', '' FROM t UNION ALL SELECT module, 'enum', 'Kind', 19, false, false, '', '' FROM t) SELECT * FROM x""")
def _(spark, d):
    return _each(_java(spark, d, "declarations"), "declarations").select("module", "kind", "name", "lineno", "is_public", "is_abstract", _text("bases"), _text("decorators"))


@query("java_imports", f"{_JAVA} SELECT module, i.import FROM t, (VALUES ('java.io.ObjectInputStream'), ('java.util.List.of'), ('a.b.*')) i(import)")
def _(spark, d):
    return _java(spark, d, "imports").select(F.col("qualname").alias("module"), F.explode("imports").alias("import"))


@query("java_types", f"{_JAVA} SELECT module, i.variable, i.type FROM t, (VALUES ('engine', 'ScriptEngine'), ('rt', 'Runtime')) i(variable, type)")
def _(spark, d):
    return _each(_java(spark, d, "types"), "types")


# a builder's start() is one finding with its constructor, and the first visited, whose arguments name no shell
@query("java_sinks", f"""{_JAVA}, x AS (SELECT module, 10 AS lineno, 'TSX-JEXEC' AS id, CASE k % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS severity FROM t UNION ALL SELECT module, 11, 'TSX-SCRIPT', 'high' FROM t
  UNION ALL SELECT module, 12, 'TSX-JEXEC', 'medium' FROM t UNION ALL SELECT module, 13, 'TSX-DYNIMPORT', 'medium' FROM t UNION ALL SELECT module, 13, 'TSX-JEXEC', 'medium' FROM t
  UNION ALL SELECT module, 15, 'TSX-JDESERHOOK', 'medium' FROM t WHERE k % 2 = 0) SELECT * FROM x""")
def _(spark, d):
    return java_source.audit(_java(spark, d, "calls", "types")).select("module", "lineno", "id", "severity")


# --- all front ends to points: U1, and declarations without re-exports ---
@query("declared_points", f"""{_JAVA} SELECT module, 'Job' || CAST(k AS STRING) AS name, CASE k % 3 WHEN 0 THEN 'abstract_class' ELSE 'class' END AS kind FROM t WHERE k % 3 < 2 UNION ALL SELECT module, 'Pair', 'class' FROM t""")
def _(spark, d):
    return scoring.points(detect.declared_seams(_java(spark, d, "declarations"))).select("module", "name", "kind")
