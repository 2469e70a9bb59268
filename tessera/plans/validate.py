"""Opt-in checks that execute target code, each in a child process with a time limit; nothing else in the library calls them.

A child process keeps the target's imports and crashes away from the caller. It is no security boundary.
"""

from __future__ import annotations

import json
import re
import subprocess
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

from .docs import point

TIMEOUT = 10.0
_PROBE = r"""
import importlib, inspect, json, os, sys
ask = json.loads(sys.stdin.read())
sys.path.insert(0, ask["root"])
def say(ok, method, detail): print("\n@@" + json.dumps([ok, method, detail]), flush=True); os._exit(0)
try:
    thing = importlib.import_module(ask["module"])
    for part in ask["name"].split("."): thing = getattr(thing, part)
except BaseException as e: say(False, "error", f"import failed: {type(e).__name__}: {e}")
try:
    if ask["category"] == "subclass":
        if not inspect.isclass(thing): say(False, "error", "not a class")
        body = {n: (lambda self, *a, **k: None) for n in getattr(thing, "__abstractmethods__", ())}
        type("Probe", (thing,), body)()
        say(True, "subclass_instantiation", "a subclass was made")
    say(callable(thing), "importable_callable" if callable(thing) else "error", "callable" if callable(thing) else "not callable")
except BaseException as e: say(False, "error", f"{type(e).__name__}: {e}")
"""
_EXAMPLE = "import json, sys\nask = json.loads(sys.stdin.read())\nsys.path.insert(0, ask['root'])\nexec(compile(ask['code'], '<example>', 'exec'), {'__name__': 'example'})\nprint('\\n@@[true, \"executed\", \"\"]')\n"


@contextmanager
def modules_kept() -> Iterator[None]:
    """What is imported inside is forgotten at the end, and what was there before is there again; for callers that load a target in their own process."""
    before = dict(sys.modules)
    try:
        yield
    finally:
        for name in [n for n in sys.modules if n not in before]:
            del sys.modules[name]
        sys.modules.update(before)


def isolated(program: str, ask: dict, timeout: float = TIMEOUT) -> tuple[bool, str, str]:
    """(ok, method, detail) of a program in a child process; one that hangs is killed."""
    try:
        got = subprocess.run([sys.executable, "-c", program], input=json.dumps(ask), capture_output=True, text=True, timeout=timeout)
    except subprocess.TimeoutExpired:
        return False, "error", f"took more than {timeout:g} seconds"
    last = got.stdout.rpartition("\n@@")[2]
    if got.stdout.count("\n@@") and got.returncode == 0:
        ok, method, detail = json.loads(last)
        return ok, method, detail
    return False, "error", (got.stderr.strip().splitlines() or [f"exit {got.returncode}"])[-1]


def validate_point(root: str, module: str, name: str, category: str, timeout: float = TIMEOUT) -> tuple[bool, str, str]:
    """A subclass point is subclassed and instantiated; a loader is skipped; anything else must be importable and callable."""
    if category == "plugin_loader":
        return False, "skipped", "a call site isn't loaded"
    return isolated(_PROBE, {"root": root, "module": module, "name": name, "category": category}, timeout)


def run_example(root: str, code: str, timeout: float = TIMEOUT) -> tuple[bool, str, str]:
    return isolated(_EXAMPLE, {"root": root, "code": code}, timeout)


def validate_points(points: DataFrame, root: str, limit: int, timeout: float = TIMEOUT) -> DataFrame:
    """(module, name, category, ok, method, detail) of the first points; the limit comes before any code runs, and the probes run on the executors."""
    return _probed(points.orderBy(F.desc("score"), "module", "lineno", "seam_ord").limit(limit).select("module", "name", "category"), root, timeout)


def verify_scaffolds(points: DataFrame, root: str, only: str | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """(id, module, name, category, ok, method, detail) of a manifest's points, or of one: whether what a scaffold starts from can be loaded."""
    chosen = points if only is None else point(points, only)
    named = chosen.select("id", F.coalesce("module", F.lit("")).alias("module"), F.coalesce("symbol", F.lit("")).alias("name"), F.coalesce("category", F.lit("")).alias("category"))
    keys = ["module", "name", "category"]
    return named.join(_probed(named.select(*keys).distinct(), root, timeout), keys).select("id", *keys, "ok", "method", "detail").orderBy("id")


def _probed(points: DataFrame, root: str, timeout: float) -> DataFrame:
    ship(points.sparkSession)
    schema = pa.schema([("module", pa.string()), ("name", pa.string()), ("category", pa.string()), ("ok", pa.bool_()), ("method", pa.string()), ("detail", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*r.values(), *validate_point(root, *r.values(), timeout)) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return points.mapInArrow(run, "module string, name string, category string, ok boolean, method string, detail string")


def tally(results: DataFrame) -> DataFrame:
    """(verdict, n): PASS, FAIL or SKIP; skipped ones don't fail a run."""
    verdict = F.when(F.col("method") == "skipped", "SKIP").when(F.col("ok"), "PASS").otherwise("FAIL")
    return results.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def preflight(root: str, package: str, timeout: float = TIMEOUT) -> tuple[bool, str, str]:
    """(ok, reason, missing module) of importing a package: ok, missing_dependency, not_found or import_error. The empty name passes."""
    if not package:
        return True, "ok", ""
    top = package.split(".", 1)[0]
    ok, _, detail = isolated("import json, sys, importlib\nask = json.loads(sys.stdin.read())\nsys.path.insert(0, ask['root'])\nimportlib.import_module(ask['package'])\nprint('\\n@@[true, \"ok\", \"\"]')\n", {"root": root, "package": top}, timeout)
    missing = re.search(r"No module named '([^']+)'", detail)
    if ok:
        return True, "ok", ""
    if missing:
        name = missing[1].split(".", 1)[0]
        return False, "not_found" if name == top else "missing_dependency", name
    return False, "import_error", ""


def remedy(reason: str, missing: str) -> str:
    """What to do about a failed preflight (docgen.remedy of a table's columns)."""
    if reason == "missing_dependency":
        return f"{missing} isn't installed: pip install {missing.split('.', 1)[0]}, then run again."
    return "The package can't be imported: pip install -e . in its folder, then run again." if reason == "not_found" else "Mend the error above, then run again." if reason == "import_error" else ""


def first_segment(name: Column) -> Column:
    return F.substring_index(name, ".", 1)
