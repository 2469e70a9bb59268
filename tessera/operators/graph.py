"""From module facts to seams: visibility, stub collapse, top-level packages, re-exports, import resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def public(name: Column, all_exports: Column, is_public: Column) -> Column:
    """A module's export list decides where there is one (an empty one too); else the name's own flag."""
    return F.when(all_exports.isNotNull(), F.array_contains(all_exports, name)).otherwise(is_public)


def collapse_overloads(functions: DataFrame, by: tuple[str, ...] = ("module", "name")) -> DataFrame:
    """Without overload stubs (is_stub) where an implementation exists, else with the first stub; all that aren't stubs stay. Order by ord."""
    w = Window.partitionBy(*by)
    first = F.row_number().over(w.orderBy(F.col("is_stub").desc(), "ord"))
    return functions.withColumn("whole", F.max((~F.col("is_stub")).cast("int")).over(w)).withColumn("k", first).filter(~F.col("is_stub") | ((F.col("whole") == 0) & (F.col("k") == 1))).drop("whole", "k")


def flatten_seams(functions: DataFrame, classes: DataFrame, dynamic: DataFrame) -> DataFrame:
    """All seams of three fact tables (module, module_ord, idx, name, lineno, ...): functions, then classes, then run-time imports of each module.

    seam_ord is the struct (module_ord, group, idx), which sorts as the seams were found. One projection of each table, no shuffle.
    """
    def of(df: DataFrame, group: int, kind: Column, name: Column, detail: Column, reexported: Column, override: Column) -> DataFrame:
        return df.select(kind.alias("kind"), "module", name.alias("name"), F.col("lineno").cast("int").alias("lineno"), detail.alias("detail"), reexported.alias("reexported"), override.alias("has_override_point"), F.struct(F.col("module_ord"), F.lit(group).alias("grp"), F.col("idx")).alias("seam_ord"))

    no = F.lit(False)
    f = of(functions.filter("visible"), 0, F.lit("function"), F.col("name"), F.array_join("decorators", ", "), F.col("reexported"), no)
    c = of(classes.filter("visible"), 1, F.when(F.col("is_abstract"), "abstract_class").otherwise("class"), F.col("name"), F.array_join("bases", ", "), F.col("reexported"), F.col("has_override_point"))
    quoted = F.concat(F.col("kind"), F.lit("("), F.coalesce(F.concat(F.lit("'"), F.col("argument"), F.lit("'")), F.lit("")), F.lit(")"))
    d = of(dynamic, 2, F.lit("dynamic_import"), F.col("kind"), quoted, no, no)
    return f.unionByName(c).unionByName(d)


SEAM = ["kind", "module", "name", "lineno", "detail", "reexported", "has_override_point", "seam_ord"]


def module_seams(modules: DataFrame) -> DataFrame:
    """The seams that flatten_seams() gives, but for reexported, from rows of modules: one reading of them."""
    def of(column: str, group: int, kind, name, detail, visible, override) -> Column:
        return F.transform(column, lambda x, i: F.struct(kind(x).alias("kind"), name(x).alias("name"), x["lineno"].alias("lineno"), detail(x).alias("detail"), visible(x).alias("visible"), override(x).alias("has_override_point"), F.lit(group).alias("grp"), i.alias("idx")))

    no = lambda x: F.lit(False)
    shown = lambda x: public(x["name"], F.col("all_exports"), x["is_public"])
    quoted = lambda x: F.concat(x["kind"], F.lit("("), F.coalesce(F.concat(F.lit("'"), x["argument"], F.lit("'")), F.lit("")), F.lit(")"))
    f = of("functions", 0, lambda x: F.lit("function"), lambda x: x["name"], lambda x: F.array_join(x["decorators"], ", "), shown, no)
    c = of("classes", 1, lambda x: F.when(x["is_abstract"], "abstract_class").otherwise("class"), lambda x: x["name"], lambda x: F.array_join(x["bases"], ", "), shown, lambda x: F.exists(x["methods"], lambda m: m["raises_notimplemented"]))
    d = of("dynamic_imports", 2, lambda x: F.lit("dynamic_import"), lambda x: x["kind"], quoted, lambda x: F.lit(True), no)
    found = modules.select(F.col("qualname").alias("module"), F.explode(F.concat(f, c, d)).alias("x")).filter("x.visible")
    return found.select("module", "x.kind", "x.name", "x.lineno", "x.detail", "x.has_override_point", F.struct(F.col("module").alias("module_ord"), "x.grp", "x.idx").alias("seam_ord"))


def runtime_sites(seams: DataFrame) -> DataFrame:
    """Where something is imported at run time."""
    return seams.filter(F.col("kind") == "dynamic_import")


def subclassable(seams: DataFrame) -> DataFrame:
    """The classes, abstract or not."""
    return seams.filter(F.col("kind").isin("class", "abstract_class"))


def top_level_packages(modules: DataFrame) -> DataFrame:
    """Package modules (path ends in __init__.py) whose parent folder isn't a package itself."""
    init = modules.filter(F.col("path").endswith("__init__.py")).withColumn("folder", F.regexp_replace("path", "/?__init__\\.py$", ""))
    parent = F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")).when(F.col("folder") != "", F.lit(""))
    return init.withColumn("parent", parent).join(init.select(F.col("folder").alias("parent")).distinct(), "parent", "left_anti").drop("folder", "parent")


def reexported(symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """symbols with reexported: whether the name is among those exported (name); the match is by name alone."""
    names = exports.select("name").distinct().withColumn("hit", F.lit(True))
    return symbols.join(names, "name", "left").withColumn("reexported", F.coalesce("hit", F.lit(False))).drop("hit")


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports (src, import) with dst: the internal module that an import string means, null if none or itself.

    Leading dots are dropped. A module fits if it equals the string, ends in '.' and the string, or starts with the string and '.'; the equal one
    wins, else the first by name. Each module's dotted tails and heads are exploded into keys, so this is an equi-join; the result is one row
    per distinct import string, joined back, so that a popular import costs no more.
    """
    known = modules.select(F.col("qualname").alias("m")).filter("m <> ''").distinct()
    parts = F.split("m", "\\.")
    n = F.size(parts)
    tails = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), "."))
    heads = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    keys = known.select("m", F.explode(F.array_distinct(F.concat(tails, heads))).alias("wanted"))
    best = keys.groupBy("wanted").agg(F.min(F.struct((F.col("m") != F.col("wanted")).alias("other"), F.col("m"))).alias("best")).select("wanted", F.col("best.m").alias("dst"))
    asked = imports.withColumn("wanted", F.regexp_replace("import", "^\\.+", ""))
    hit = asked.join(best, "wanted", "left").withColumn("dst", F.when(F.col("dst") != F.col("src"), F.col("dst")))
    return hit.drop("wanted")


def dependencies(resolved: DataFrame) -> DataFrame:
    """Distinct edges (src, dst)."""
    return resolved.filter("dst IS NOT NULL").select("src", "dst").distinct()
