"""Execution-risk call sites: the catalogs, their lookups as equi-joins, elevation, ranking and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEVERITY_RANK = {level: r for r, level in enumerate("high medium low".split())}
_H, _M, _L = "high", "medium", "low"


def _rows(category: str, key: str, severity: str, confidence: str, patterns: str, elevates: bool = False) -> list[tuple]:
    return [(p, f"TSX-{key}", category, severity, confidence, elevates) for p in patterns.split()]


_EXEC = " ".join(f"os.{verb}{end}" for verb in ("exec", "spawn") for end in ("l", "le", "lp", "lpe", "v", "ve", "vp", "vpe"))
#: Dotted patterns (one dot each), matched whole or as the end of a longer dotted name.
PY_DOTTED = (
    _rows("deserialization", "PICKLE", _H, _H, "pickle.load pickle.loads cPickle.load cPickle.loads")
    + _rows("deserialization", "MARSHAL", _H, _M, "marshal.loads marshal.load")
    + _rows("deserialization", "YAML", _H, _H, "yaml.load")
    + _rows("process", "SHELL", _H, _H, "os.popen os.system")
    + _rows("process", "SHELL", _H, _M, "commands.getstatusoutput commands.getoutput")
    + _rows("process", "SPAWN", _M, _M, f"os.startfile {_EXEC} os.posix_spawn os.posix_spawnp")
    + _rows("process", "SUBPROC", _M, _M, " ".join(f"subprocess.{f}" for f in ("check_output", "check_call", "run", "call", "Popen")), True)
)
#: Bare names, matched whole only.
PY_BARE = _rows("code_exec", "EVAL", _H, _H, "eval") + _rows("code_exec", "EXEC", _H, _H, "exec") + _rows("code_exec", "COMPILE", _M, _L, "compile")
#: Last segments of any dotted name.
PY_LOADER = (
    _rows("dynamic_load", "DYNIMPORT", _M, _M, "import_module")
    + _rows("dynamic_load", "DYNIMPORT", _M, _L, "__import__")
    + _rows("dynamic_load", "IMPORTSTR", _M, _M, "import_string")
    + _rows("dynamic_load", "ENTRYPOINT", _L, _M, "load_entry_point iter_entry_points entry_points")
    + _rows("dynamic_load", "LOADMOD", _M, _L, "load_module")
)
PY_METHOD = _rows("deserialization", "REDUCE", _M, _L, "__reduce_ex__ __reduce__")

TS_MEMBER = (
    _rows("process", "CHILD", _H, _H, "child_process.exec child_process.execSync")
    + _rows("process", "CHILDDIRECT", _M, _M, " ".join(f"child_process.{f}" for f in ("fork", "execFileSync", "execFile", "spawnSync", "spawn")))
    + _rows("code_exec", "VM", _H, _M, " ".join(f"vm.{f}" for f in ("Script", "compileFunction", "runInContext", "runInNewContext", "runInThisContext")))
)
TS_GLOBAL = _rows("code_exec", "EVAL", _H, _H, "eval") + _rows("code_exec", "JSFUNC", _H, _H, "Function")
TS_LOADER = _rows("dynamic_load", "DYNREQUIRE", _M, _M, "import require")
TS_TIMER = _rows("code_exec", "TIMERSTR", _M, _L, "setInterval setTimeout")

JAVA_TYPED = (
    _rows("code_exec", "SCRIPT", _H, _H, "ScriptEngineManager.eval ScriptEngine.eval")
    + _rows("code_exec", "SCRIPT", _H, _M, "Compilable.compile")
    + _rows("code_exec", "GROOVY", _H, _H, "GroovyClassLoader.parseClass GroovyShell.parse GroovyShell.evaluate")
    + _rows("code_exec", "SPEL", _H, _M, "SpelExpressionParser.parseExpression ExpressionParser.parseExpression")
    + _rows("code_exec", "EL", _H, _L, "ExpressionFactory.createMethodExpression ExpressionFactory.createValueExpression")
    + _rows("code_exec", "DEFCLASS", _H, _M, "ClassLoader.defineClass")
    + _rows("deserialization", "JDESER", _H, _H, "Yaml.loadAll Yaml.load XStream.fromXML XMLDecoder.readObject ObjectInputStream.readUnshared ObjectInputStream.readObject")
    + _rows("process", "JEXEC", _M, _H, "Runtime.exec", True)
    + _rows("process", "JEXEC", _M, _M, "ProcessBuilder.start", True)
    + _rows("dynamic_load", "DYNIMPORT", _M, _M, "ClassLoader.loadClass Class.forName")
    + _rows("dynamic_load", "DYNIMPORT", _M, _L, "URLClassLoader.newInstance")
    + _rows("dynamic_load", "ENTRYPOINT", _L, _M, "ServiceLoader.load")
    + _rows("dynamic_load", "REFLECT", _M, _L, "Method.invoke")
)
JAVA_NEW = (
    _rows("process", "JEXEC", _M, _M, "ProcessBuilder", True)
    + _rows("deserialization", "JDESER", _H, _M, "XMLDecoder")
    + _rows("code_exec", "GROOVY", _H, _M, "GroovyShell")
    + _rows("code_exec", "GROOVY", _H, _L, "GroovyClassLoader")
    + _rows("dynamic_load", "DYNIMPORT", _M, _L, "URLClassLoader")
)
JAVA_HOOK = _rows("deserialization", "JDESERHOOK", _M, _L, "readExternal readResolve readObject")
JAVA_SHELLS = frozenset("powershell cmd.exe cmd /bin/bash /bin/sh zsh bash sh".split())

_ENTRY = "id category severity confidence elevates".split()
_SCHEMA = "pattern string, id string, category string, severity string, confidence string, elevates boolean"


def catalog(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, _SCHEMA)


def _spec(df: DataFrame, key: str, name: str) -> DataFrame:
    return F.broadcast(df.select(F.col("pattern").alias(key), F.struct("id", "category", "severity", "confidence", "elevates").alias(name)))


def entry(key: Column, rows: list[tuple]) -> Column:
    """The entry of a constant catalog for a key, null where there is none: no join, so calls are read once whatever number of catalogs they are held against."""
    pairs = [x for pattern, *r in rows for x in (F.lit(pattern), F.struct(*(F.lit(v).alias(n) for n, v in zip(_ENTRY, r))))]
    return F.create_map(*pairs)[key]


def python_entry(dotted: Column) -> Column:
    """The entry that lookup_python() finds for a called name."""
    return F.coalesce(entry(dotted, PY_BARE), entry(F.substring_index(dotted, ".", -2), PY_DOTTED), entry(F.substring_index(dotted, ".", -1), PY_LOADER))


def bound_entries(call: Column, bindings: Column, entries: list[tuple] = TS_MEMBER) -> Column:
    """The entries that lookup_bound() finds for a call (obj, prop, name), given the bindings (local, module, member) of its file; as an array."""
    fits = lambda b: (b["local"] == F.coalesce(call["obj"], call["name"])) & (b["member"].isNull() == call["obj"].isNotNull())
    modules = F.array_distinct(F.transform(F.filter(bindings, fits), lambda b: b["module"]))
    full = entry(F.concat(call["obj"], F.lit("."), call["prop"]), entries)
    member = lambda m: F.coalesce(entry(F.concat(F.regexp_replace(m, "^node:", ""), F.lit("."), F.coalesce(call["prop"], call["name"])), entries), full)
    return F.when(F.size(modules) == 0, F.array(full)).otherwise(F.transform(modules, member))


def lookup_python(calls: DataFrame) -> DataFrame:
    """calls (dotted, shell_true, ...) that a catalog entry matches, with id, category, severity, confidence.

    Three tiers in order: the whole name (bare or dotted), the last two segments, the last segment in the loaders. Every dotted pattern has one dot,
    so a suffix match is equality on the last two segments; the catalogs are constants of a few rows, so they are broadcast.
    """
    spark = calls.sparkSession
    bare, dotted, loader = (catalog(spark, c) for c in (PY_BARE, PY_DOTTED, PY_LOADER))
    out = calls.withColumn("_two", F.substring_index("dotted", ".", -2)).withColumn("_one", F.substring_index("dotted", ".", -1))
    out = out.join(_spec(bare, "dotted", "_b"), "dotted", "left").join(_spec(dotted, "_two", "_d"), "_two", "left").join(_spec(loader, "_one", "_l"), "_one", "left")
    spec = F.coalesce("_b", "_d", "_l")
    return elevate(out.withColumn("_s", spec).filter("_s IS NOT NULL").select("*", "_s.*").drop("_b", "_d", "_l", "_s", "_one", "_two"))


def elevate(found: DataFrame) -> DataFrame:
    """A shell given as a literal makes an entry that elevates high."""
    return found.withColumn("severity", F.when(F.col("elevates") & F.coalesce("shell_true", F.lit(False)), "high").otherwise(F.col("severity"))).drop("elevates")


def lookup_bound(calls: DataFrame, bindings: DataFrame, entries: list[tuple] = TS_MEMBER) -> DataFrame:
    """calls (file, obj, prop, name) matched through the file's bindings (file, local, module, member): a namespace's member, or a bound name; or as the member of a
    module that is named in full.

    member is null for a namespace binding; a bound name is looked up by its local name.
    """
    spark = calls.sparkSession
    space = bindings.filter("member IS NULL").select("file", F.col("local").alias("obj"), F.col("module").alias("_m1")).distinct()
    named = bindings.filter("member IS NOT NULL").select("file", F.col("local").alias("name"), F.col("module").alias("_m2")).distinct()
    out = calls.join(space, ["file", "obj"], "left").join(named, ["file", "name"], "left")
    module = F.regexp_replace(F.coalesce("_m1", "_m2"), "^node:", "")
    out = out.withColumn("_key", F.concat(module, F.lit("."), F.when(F.col("_m1").isNotNull(), F.col("prop")).otherwise(F.col("name")))).withColumn("_full", F.concat("obj", F.lit("."), "prop"))
    spec = catalog(spark, entries)
    out = out.join(_spec(spec, "_key", "_s"), "_key", "left").join(_spec(spec, "_full", "_t"), "_full", "left").withColumn("_s", F.coalesce("_s", "_t")).filter("_s IS NOT NULL")
    return out.select("file", "obj", "prop", "name", *[c for c in calls.columns if c not in ("file", "obj", "prop", "name")], "_s.id", "_s.category", "_s.severity", "_s.confidence")


def lookup_typed(calls: DataFrame, types: DataFrame, entries: list[tuple] = JAVA_TYPED) -> DataFrame:
    """calls (file, receiver, method, shell_true) matched as Type.method, the type being the receiver's declared one (file, variable, type), else
    the receiver itself."""
    known = types.select("file", F.col("variable").alias("receiver"), F.col("type").alias("_t")).distinct()
    out = calls.join(known, ["file", "receiver"], "left").withColumn("_key", F.concat(F.coalesce("_t", "receiver"), F.lit("."), F.col("method")))
    found = out.join(_spec(catalog(calls.sparkSession, entries), "_key", "_s"), "_key").select(*calls.columns, "_s.*")
    return elevate(found)


def dedupe(found: DataFrame) -> DataFrame:
    """One finding per (module, lineno, id): the first visited (visit_ord)."""
    rest = [c for c in found.columns if c not in ("module", "lineno", "id")]
    best = found.groupBy("module", "lineno", "id").agg(F.min_by(F.struct(*rest), "visit_ord").alias("r"))
    return best.select("module", "lineno", "id", "r.*")


def rank_of(level):
    out = F.lit(9)
    for name, r in reversed(SEVERITY_RANK.items()):
        out = F.when(level == name, r).otherwise(out)
    return out


def order() -> list:
    """The order of a report: severity, confidence, then place()."""
    return [rank_of(F.col("severity")), rank_of(F.col("confidence")), F.col("module"), F.col("lineno")]


def place(found: DataFrame) -> list:
    """The order of places: module, line, and the called name where the findings have one."""
    return [F.col("module"), F.col("lineno"), *(F.col(c) for c in ("dotted", "call") if c in found.columns)]


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def distinct_entries(entries: DataFrame, keep: str = "last") -> DataFrame:
    """The catalog by id; of several entries the last or the first (by ord)."""
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in entries.columns if c not in ("id", "ord")]
    return entries.groupBy("id").agg(pick(F.struct(*rest), "ord").alias("r")).select("id", "r.*")


def ranks_within(found: DataFrame, by: str) -> DataFrame:
    """found with a rank in the report's order, per target."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order(), "visit_ord")))
