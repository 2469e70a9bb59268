"""Scores, categories and signals of seams: sums of weights in a fixed order, so that doubles agree to the last bit.

A seam has: kind (function, class, abstract_class, dynamic_import), module, name, lineno, detail (bases of a class, decorators of a function, both
comma-separated), reexported, has_override_point, seam_ord (its place among the seams as they were found).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import CALLED_PARTS, base_role, decorator_part, hook_part, role_ending

WEIGHT = {"dynamic": 0.9, "abstract": 0.6, "hook": 0.5, "role": 0.45, "decorator": 0.4, "reexport": 0.7, "override": 0.3, "public": 0.1}
BUILTIN_IMPORT = "__import__"

SIGNALS = {
    "TES-DYN": "imports at run time",
    "TES-REFLECT": "imports by the builtin, which is reflection",
    "TES-ABSTRACT": "is abstract",
    "TES-HOOK": "is named like a hook",
    "TES-ROLE": "is named for a role",
    "TES-BASE": "has a base named for a role",
    "TES-DECO": "has a registering decorator",
    "TES-EXPORT": "is exported by the top-level package",
    "TES-OVERRIDE": "has a method to be overridden",
    "TES-PUBLIC": "is public",
}

def is_class() -> Column:
    return F.col("kind").isin("class", "abstract_class")


def is_function() -> Column:
    return F.col("kind") == "function"


def is_dynamic() -> Column:
    return F.col("kind") == "dynamic_import"


def _abstract() -> Column:
    return F.col("kind") == "abstract_class"


def _hook() -> Column:
    return hook_part(F.col("name"))


def _deco() -> Column:
    return decorator_part(F.col("detail"))


def _role() -> Column:
    return role_ending(F.col("name"))


def _base() -> Column:
    return base_role(F.col("detail"))


def _builtin() -> Column:
    return F.col("name") == BUILTIN_IMPORT


def _add(condition: Column, weight: str) -> Column:
    return F.when(condition, F.lit(WEIGHT[weight])).otherwise(F.lit(0.0))


def class_score() -> Column:
    total = F.lit(WEIGHT["public"]) + _add(_abstract(), "abstract") + _add(_role().isNotNull(), "role") + _add(_base().isNotNull(), "role")
    return F.least(total + _add(F.col("reexported"), "reexport") + _add(F.col("has_override_point"), "override"), F.lit(1.0))


def function_score() -> Column:
    total = F.lit(WEIGHT["public"]) + _add(_hook().isNotNull(), "hook") + _add(_deco().isNotNull(), "decorator")
    return F.least(total + _add(F.col("reexported"), "reexport"), F.lit(1.0))


def dynamic_score() -> Column:
    return F.when(_builtin(), F.lit(WEIGHT["public"])).otherwise(F.lit(WEIGHT["dynamic"]))


def score() -> Column:
    return F.when(is_dynamic(), dynamic_score()).when(is_class(), class_score()).otherwise(function_score())


def category() -> Column:
    of_class = F.when(_abstract() | _role().isNotNull() | _base().isNotNull() | F.col("has_override_point"), "subclass").otherwise("api")
    of_function = F.when(_hook().isin(CALLED_PARTS), "hook").when(_hook().isNotNull() | _deco().isNotNull(), "registration").otherwise("api")
    of_dynamic = F.when(_builtin(), "reflection").otherwise("plugin_loader")
    return F.when(is_dynamic(), of_dynamic).when(is_class(), of_class).otherwise(of_function)


def signals() -> Column:
    """The reasons for a score, in the order of its weights: [id] text, with the part that matched."""
    say = lambda key, *more: F.concat(F.lit(f"[{key}] {SIGNALS[key]}"), *more)
    colon = F.lit(": ")
    return F.array_compact(
        F.array(
            F.when(is_dynamic() & ~_builtin(), say("TES-DYN")),
            F.when(is_dynamic() & _builtin(), say("TES-REFLECT")),
            F.when(_abstract(), say("TES-ABSTRACT")),
            F.when(is_class(), say("TES-ROLE", colon, _role())),
            F.when(is_class(), say("TES-BASE", colon, _base())),
            F.when(is_function(), say("TES-HOOK", colon, _hook())),
            F.when(is_function(), say("TES-DECO", colon, _deco())),
            F.when(~is_dynamic() & F.col("reexported"), say("TES-EXPORT")),
            F.when(is_class() & F.col("has_override_point"), say("TES-OVERRIDE")),
            F.when(~is_dynamic(), say("TES-PUBLIC")),
        )
    )


def score_seams(seams: DataFrame) -> DataFrame:
    """Seams with score, category and signals; one projection, no shuffle."""
    return seams.withColumn("score", score()).withColumn("category", category()).withColumn("signals", signals())


def order() -> list[Column]:
    """The total order of points: score, then module and line, then the order in which the seams were found."""
    return [F.desc("score"), F.asc("module"), F.asc("lineno"), F.asc("seam_ord")]


def points(seams: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Scored seams of at least min_score (compared as doubles)."""
    return score_seams(seams).filter(F.col("score") >= F.lit(min_score))
