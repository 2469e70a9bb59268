"""Fact blocks of points, the manifest, and the scaffolds rendered from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import class_signature, function_signature, method_of, point_id


def is_abstract_method(method: Column) -> Column:
    return F.exists(method["decorators"], lambda d: d.contains("abstractmethod"))


def to_implement(methods: Column) -> Column:
    """Signatures of the abstract methods of an array of structs (name, args, decorators)."""
    return F.transform(F.filter(methods, is_abstract_method), lambda m: function_signature(m["name"], m["args"]))


def enrich(points: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """points with signature, bases, decorators and implement of the first definition (by ord) of that name in the module; blank where there is none."""
    no = F.array().cast("array<string>")
    c = classes.groupBy("module", "name").agg(F.min_by(F.struct(class_signature(F.col("name"), F.col("bases")).alias("signature"), F.col("bases"), F.col("decorators"), to_implement(F.col("methods")).alias("implement")), "ord").alias("f")).withColumn("is_class", F.lit(True))
    f = functions.groupBy("module", "name").agg(F.min_by(F.struct(function_signature(F.col("name"), F.col("args")).alias("signature"), no.alias("bases"), F.col("decorators"), no.alias("implement")), "ord").alias("f")).withColumn("is_class", F.lit(False))
    is_class = F.when(F.col("kind").isin("class", "abstract_class"), True).when(F.col("kind") == "function", False)
    out = points.withColumn("is_class", is_class).join(c.unionByName(f), ["module", "name", "is_class"], "left")
    get = lambda n, default: F.coalesce(F.col(f"f.{n}"), default).alias(n)
    return out.select(*points.columns, get("signature", F.lit("")), get("bases", no), get("decorators", no), get("implement", no))


def fact_text(f: DataFrame) -> Column:
    """A fact block as text; lines about nothing are left out."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    listed = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{head}:\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    joined = lambda label, xs: F.when(F.size(xs) > 0, line(label, F.array_join(xs, ", ")))
    return F.concat_ws(
        "\n",
        line("module", f["module"]), line("symbol", f["name"]), line("kind", f["kind"]), line("category", f["category"]),
        line("location", F.concat(f["module"], F.lit(":"), f["lineno"].cast("string"))),
        F.when(f["signature"] != "", line("signature", f["signature"])),
        joined("bases", f["bases"]), joined("decorators", f["decorators"]),
        listed("must implement", f["implement"]), listed("detector signals", f["signals"]),
    )


def manifest(facts: DataFrame) -> DataFrame:
    """(id, point): each point as JSON with sorted keys; the writer orders them by id."""
    struct = F.struct(F.col("category"), F.col("decorators"), F.concat("module", F.lit(":"), "name").alias("id"), F.col("implement"), F.col("kind"), F.col("lineno").alias("line"), F.col("module"), F.round("score", 4).alias("score"), F.col("signals"), F.col("signature"), F.col("name").alias("symbol"))
    return facts.select(point_id(F.col("module"), F.col("name")).alias("id"), F.to_json(struct).alias("point"))


def scaffold_text() -> Column:
    """Python source to start a plugin from, of columns id, module, symbol, kind, category, signature and implement."""
    head = F.concat(F.lit("from "), F.col("module"), F.lit(" import "), F.col("symbol"), F.lit("\n\n\n"))
    body = F.array_join(F.transform("implement", lambda s: F.concat(F.lit("\n    "), s, F.lit(":\n        raise NotImplementedError(\"TODO: "), method_of(s), F.lit("\")\n"))), "")
    of_class = F.concat(head, F.lit("class My"), F.col("symbol"), F.lit("("), F.col("symbol"), F.lit("):\n    \"\"\"Extends "), F.col("id"), F.lit(".\"\"\"\n"), F.when(F.size("implement") > 0, body).otherwise(F.lit("\n    pass\n")))
    told = F.when(F.col("signature") != "", F.concat(F.lit("# It is: "), F.col("signature"), F.lit("\n"))).otherwise("")
    other = F.concat(head, F.lit("# "), F.col("id"), F.lit(" ("), F.col("category"), F.lit(")\n"), told, F.lit("\ndef my_plugin():\n    raise NotImplementedError(\"TODO: "), F.col("symbol"), F.lit("\")\n"))
    return F.when(F.col("kind").isin("class", "abstract_class"), of_class).otherwise(other)
