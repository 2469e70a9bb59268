"""python -m tessera detect|audit|diff|surface|scaffold|verify|config|docs|score|usage|gate|tools ...; exit 0 fine, 1 the gate or a check failed, 2 bad input."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import render
from tessera.operators import diff, ranking
from tessera.plans import detect, docs, tools, trees, validate
from tessera.session import local_session
from tessera.sources import config_scan, snapshots, walk


def label_of(root: str) -> str:
    return os.path.basename(os.path.normpath(root))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, language: bool = False) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for place in places:
            s.add_argument(place)
        if language:
            s.add_argument("--language", default="python")
        return s

    for name in ("detect", "audit"):
        s = command(name, "root", language=True)
        s.add_argument("--json", action="store_true")
        if name == "detect":
            s.add_argument("--min-score", type=float, default=0.5)
            s.add_argument("--limit", type=int, default=20)
            s.add_argument("--label", default="")
    levels = ["none", "high", "medium", "low"]
    for name in ("diff", "surface"):
        command(name, "base", "new").add_argument("--fail-on", default="none", choices=[*levels, "breaking"])
    command("scaffold", "manifest", "out").add_argument("--id")
    s = command("verify", "manifest")
    s.add_argument("--id")
    s.add_argument("--root", required=True)
    command("config", "root")
    s = command("docs", "root", "out", language=True)
    s.add_argument("--provider", required=True, help="a registered name, or module:callable")
    s.add_argument("--min-score", type=float, default=0.5)
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--retries", type=int, default=4)
    s.add_argument("--max-calls", type=int)
    s.add_argument("--cache")
    s.add_argument("--concurrency", type=int, default=1)
    s.add_argument("--validate", action="store_true", help="import the target in child processes, and drop points that can't be loaded")
    s.add_argument("--dry-run", action="store_true")
    s = command("score", "truth")
    s.add_argument("tree", nargs="+", help="target=root or target=root:language")
    s.add_argument("-k", type=int, default=10)
    command("usage", "packages", "host")
    s = command("gate", "base", "new", language=True)
    s.add_argument("--of", choices=["points", "surface"], default="points")
    s.add_argument("--ref", help="take base from this ref of the repository in it")
    s.add_argument("--fail-on", default="none", choices=levels)
    s.add_argument("--comments", help="JSON list of [id, text]; the id of the one to replace is printed first")
    command("tools")
    return p


def _fail(text: str) -> int:
    print(text, file=sys.stderr)
    return 2


def run_docs(a: argparse.Namespace, spark: SparkSession) -> int:
    """Files of a documentation run; a dry run says what it would take."""
    modules = trees.modules_in(spark, a.root, a.language, (a.out,))
    points = trees.points_in(modules, a.language, a.min_score)
    n = min(points.count(), a.limit)
    print(f"{modules.filter('parse_error IS NULL').count()} modules parsed, {modules.filter('parse_error IS NOT NULL').count()} failed, {n} points, {1 + n * (1 + max(3, min(5, a.retries)))} calls at most")
    if a.dry_run:
        return 0
    python = a.language == "python"
    checked = None
    if a.validate and python:
        top = modules.filter("parse_error IS NULL").select(F.substring_index("qualname", ".", 1).alias("t")).filter("t <> ''").distinct().orderBy("t").first()
        ok, reason, missing = validate.preflight(a.root, top.t if top else "")
        if not ok:
            return _fail(validate.remedy(reason, missing))
        checked = validate.validate_points(points, a.root, a.limit)
    source = docs.provider(a.provider)
    if a.cache:
        source = docs.Cache(source, a.cache, name=a.provider)
    if a.max_calls is not None:
        source = docs.Budget(source, a.max_calls)
    facts = trees.facts_of(modules, points, a.language)
    report = docs.document(facts, source, a.limit, a.retries, checked, detect.edges(modules).count() if python else 0, a.concurrency, a.language)
    written = docs.write_docs(report, a.out)
    docs.write_manifest(facts.join(spark.createDataFrame([(p["id"],) for p in report.points], "p string"), F.concat("module", F.lit(":"), "name") == F.col("p"), "left_semi"), os.path.join(a.out, "manifest.json"), a.root)
    print(f"{len(written) + 1} files; {len(report.points)} points, {report.unverified} unverified, {len(report.dropped)} dropped")
    return 0


def run_score(a: argparse.Namespace, spark: SparkSession) -> int:
    given = {}
    for t in a.tree:
        name, _, rest = t.partition("=")
        root, _, lang = rest.partition(":")
        given[name] = (root, lang or "python")
        if not os.path.isdir(root):
            return _fail(f"{root} isn't there")
    scores, skipped = trees.score_trees(spark, a.truth, given, k=a.k)
    if not scores.head(1):
        return _fail("no labelled target is there")
    print(render.score_markdown(scores, a.k) + "".join(f"\nleft out: {r.target} {r.version}" for r in skipped.orderBy("target").toLocalIterator()))
    return 0


def run_usage(a: argparse.Namespace, spark: SparkSession) -> int:
    points = ranking.ranked(ranking.split_points(trees.points_of(spark, a.host))[0])
    used = trees.usage_of(spark, a.packages, points.select(F.col("name").alias("symbol"))).filter("subclassed + imported > 0")
    place = points.groupBy(F.col("name").alias("symbol")).agg(F.min("rank").alias("rank"))
    rows = used.join(place, "symbol").withColumn("line", render.cells(*(F.col(c) for c in ("symbol", "subclassed", "imported", "rank"))))
    print(render.head("symbol", "subclassed by", "imported by", "rank") + "\n" + render.text_of(rows, F.desc("subclassed"), F.desc("imported"), "symbol"))
    return 0


def run_gate(a: argparse.Namespace, spark: SparkSession) -> int:
    def compare(base: str) -> tuple[str, bool]:
        return trees.points_gate(spark, base, a.new, a.language) if a.of == "points" else trees.surface_gate(spark, base, a.new, a.language, a.fail_on)

    if a.ref:
        with trees.worktree(a.base, a.ref) as base:
            text, failed = compare(base)
    else:
        text, failed = compare(a.base)
    if a.comments:
        with open(a.comments, encoding="utf-8") as f:
            print(render.sticky([tuple(x) for x in json.load(f)], text)[0] or "")
    print(text)
    return int(failed)


def run_diff(a: argparse.Namespace, spark: SparkSession) -> int:
    joined = lambda path: snapshots.read_points(spark, path).withColumn("implement", F.array_join("implement", ", "))
    c = diff.manifest_diff(joined(a.base), joined(a.new)).cache()
    print(render.manifest_markdown(c))
    return int(a.fail_on != "none" and render.breaking(c))


def run_surface(a: argparse.Namespace, spark: SparkSession) -> int:
    c = diff.surface_diff(snapshots.read_findings(spark, a.base), snapshots.read_findings(spark, a.new)).cache()
    print(render.surface_markdown(c))
    return int(render.gate(c, "low" if a.fail_on == "breaking" else a.fail_on))


def run_detect(a: argparse.Namespace, spark: SparkSession) -> int:
    p = trees.points_of(spark, a.root, a.language, a.min_score)
    print(render.detect_json(p, a.limit, a.label or label_of(a.root)) if a.json else render.detect_markdown(p, a.limit))
    return 0


def run_audit(a: argparse.Namespace, spark: SparkSession) -> int:
    f = trees.findings_of(spark, a.root, a.language)
    print(render.audit_json(f, label_of(a.root)) if a.json else render.audit_markdown(f))
    return 0


def run_scaffold(a: argparse.Namespace, spark: SparkSession) -> int:
    print("\n".join(docs.write_scaffolds(snapshots.read_points(spark, a.manifest), a.out, a.id)))
    return 0


def run_verify(a: argparse.Namespace, spark: SparkSession) -> int:
    got = validate.verify_scaffolds(snapshots.read_points(spark, a.manifest), a.root, a.id).collect()
    for r in got:
        print(f"{'SKIP' if r.method == 'skipped' else 'PASS' if r.ok else 'FAIL'} {r.id}: {r.detail}")
    return int(any(not r.ok and r.method != "skipped" for r in got))


def run_config(a: argparse.Namespace, spark: SparkSession) -> int:
    print(render.config_markdown(config_scan.config_points(walk.paths(spark, a.root, ("",)))))
    return 0


def run_tools(a: argparse.Namespace, spark: SparkSession) -> int:
    tools.serve(spark, sys.stdin, sys.stdout)
    return 0


RUN: dict[str, Callable[[argparse.Namespace, SparkSession], int]] = {
    "detect": run_detect, "audit": run_audit, "diff": run_diff, "surface": run_surface, "scaffold": run_scaffold, "verify": run_verify, "config": run_config, "docs": run_docs, "score": run_score, "usage": run_usage, "gate": run_gate, "tools": run_tools,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    for path in (getattr(a, n, None) for n in ("root", "base", "new", "manifest", "truth", "packages", "host")):
        if path and not os.path.exists(path):
            return _fail(f"{path} isn't there")
    try:
        return RUN[a.command](a, spark or local_session())
    except (snapshots.BadSnapshot, KeyError, ValueError, docs.BudgetSpent) as e:
        return _fail(f"error: {e}")


if __name__ == "__main__":
    sys.exit(main())
