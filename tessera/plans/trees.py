"""Plans over whole source trees: points, findings, fact blocks, a ranking scored against labels, downstream use, and the gate between two trees."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names, render
from tessera.operators import crosscheck, diff, evaluate, facts, ranking, scoring
from tessera.session import materialise
from tessera.sources import java_source, language, python_source, snapshots, typescript_source, walk
from tessera.sources.walk import Paths

from . import detect


def modules_in(spark: SparkSession, root: str, lang: str = "python", exclude: Paths = ()) -> DataFrame:
    """Parsed modules, written, since several lenses read them."""
    return materialise(language(lang)(spark, root, exclude), "modules")


def points_in(modules: DataFrame, lang: str = "python", min_score: float = 0.0) -> DataFrame:
    return scoring.points(detect.seams(modules) if lang == "python" else detect.declared_seams(modules), min_score)


def points_of(spark: SparkSession, root: str, lang: str = "python", min_score: float = 0.0, exclude: Paths = ()) -> DataFrame:
    return points_in(modules_in(spark, root, lang, exclude), lang, min_score)


def findings_of(spark: SparkSession, root: str, lang: str = "python") -> DataFrame:
    return {"python": detect.audit, "typescript": typescript_source.audit, "java": java_source.audit}[lang](modules_in(spark, root, lang))


def facts_of(modules: DataFrame, points: DataFrame, lang: str = "python") -> DataFrame:
    """points with signature, bases, decorators and what is to be implemented, from the modules they were found in."""
    ok = modules.filter("parse_error IS NULL")
    none = F.array().cast("array<string>")
    each = lambda column: ok.select(F.col("qualname").alias("module"), F.posexplode(column).alias("ord", "x")).select("module", "ord", "x.*")
    if lang == "python":
        return facts.enrich(points, each("classes"), each("functions"))
    d = each("declarations")
    classes = d.filter("kind <> 'function'").withColumn("methods", F.array().cast("array<struct<name: string, args: array<string>, decorators: array<string>>>"))
    functions = d.filter("kind = 'function'").withColumn("args", F.col("args") if "args" in d.columns else none)
    return facts.enrich(points, classes, functions)


# --- a ranking against labels ---
def candidates(spark: SparkSession, trees: dict[str, tuple[str, str]], min_score: float = 0.0) -> DataFrame:
    """(target, id, rank, score) of the points to implement of each target: {target: (root, language)}. Ids begin with their target."""
    out = None
    for target, (root, lang) in sorted(trees.items()):
        p = ranking.ranked(ranking.split_points(points_of(spark, root, lang, min_score))[0].select("module", "name", "lineno", "seam_ord", "score"))
        p = p.select(F.lit(target).alias("target"), names.target_id(F.lit(target), F.col("module"), F.col("name")).alias("id"), "rank", "score")
        out = p if out is None else out.unionByName(p)
    return spark.createDataFrame([], "target string, id string, rank long, score double") if out is None else out


def score_trees(spark: SparkSession, truth: str, trees: dict[str, tuple[str, str]], versions: dict[str, str] | None = None, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(scores, skipped): scores of evaluate.scores() for the labelled targets of a ground-truth file that are there, and (target, version) of the others.

    versions: what is installed; a target in another version than its labels' is skipped. Without it every target of trees counts as the right one.
    """
    labels = snapshots.read_labels(spark, truth)
    there = [(t, (versions or {}).get(t)) for t in trees]
    installed = spark.createDataFrame(there, "target string, version string") if versions is not None else labels.select("target", "version").distinct().join(spark.createDataFrame(there, "target string, v string").drop("v"), "target")
    kept, skipped = snapshots.pinned(labels, installed)
    return evaluate.scores(materialise(candidates(spark, trees), "candidates"), kept.select("target", "id"), k), skipped


# --- downstream use ---
def usage_of(spark: SparkSession, packages: str, symbols: DataFrame) -> DataFrame:
    """(symbol, subclassed, imported): how many of the installed packages in a folder subclass, and import, each of the symbols (symbol); each package votes once."""
    listed = walk.packages(packages)
    of = spark.createDataFrame(listed, "package string, path string")
    parsed = materialise(walk.parse(of.select("path").repartition(max(1, -(-len(listed) // walk.PATHS_PER_TASK))), packages, python_source.parse_module, python_source.SCHEMA, python_source.DDL), "usage").join(of, "path")
    ok = parsed.filter("parse_error IS NULL")
    bases = ok.select("package", F.explode("classes").alias("c")).select("package", F.explode("c.bases").alias("b")).select("package", names.bare(F.col("b")).alias("symbol"))
    imports = ok.select("package", F.explode("imports").alias("i")).select("package", names.bare(F.col("i.name")).alias("symbol"))
    mine = symbols.select("symbol").distinct()
    votes = lambda uses, name: crosscheck.votes(uses.join(mine, "symbol", "left_semi")).withColumnRenamed("votes", name)
    both = mine.join(votes(bases, "subclassed"), "symbol", "left").join(votes(imports, "imported"), "symbol", "left")
    return both.select("symbol", F.coalesce("subclassed", F.lit(0)).alias("subclassed"), F.coalesce("imported", F.lit(0)).alias("imported"))


# --- the gate between two trees ---
@contextmanager
def worktree(repository: str, ref: str) -> Iterator[str]:
    """A throwaway checkout of a ref, beside the one at hand."""
    with tempfile.TemporaryDirectory(prefix="tessera-base-") as folder:
        path = os.path.join(folder, "tree")
        git = lambda *a: subprocess.run(["git", "-C", repository, "worktree", *a], check=True, capture_output=True)
        git("add", "--detach", path, ref)
        try:
            yield path
        finally:
            git("remove", "--force", path)


def points_gate(spark: SparkSession, base: str, new: str, lang: str = "python", min_score: float = 0.5) -> tuple[str, bool]:
    """(report, failed): what points are gone, new and changed between two trees; fails if one is gone or changed."""

    def flat(root: str) -> DataFrame:
        p = points_of(spark, root, lang, min_score)
        none = F.lit(None).cast("string")
        return p.select(names.point_id(F.col("module"), F.col("name")).alias("id"), "kind", "category", none.alias("signature"), none.alias("implement"), F.struct("score", "lineno", "seam_ord").alias("ord"))

    changes = materialise(diff.manifest_diff(flat(base), flat(new)), "gate")
    return render.manifest_markdown(changes), render.breaking(changes)


def surface_gate(spark: SparkSession, base: str, new: str, lang: str = "python", fail_on: str = "none") -> tuple[str, bool]:
    """(report, failed): what risk findings came and went; fails if one of the severity or a worse one came."""

    def flat(root: str) -> DataFrame:
        f = findings_of(spark, root, lang)
        call = F.col("call") if "call" in f.columns else F.col("dotted") if "dotted" in f.columns else F.lit(None).cast("string")
        return f.select("id", "module", call.alias("call"), "category", "severity", F.col("visit_ord").cast("long").alias("ord"))

    changes = materialise(diff.surface_diff(flat(base), flat(new)), "gate")
    return render.surface_markdown(changes), fail_on != "none" and render.gate(changes, fail_on)
