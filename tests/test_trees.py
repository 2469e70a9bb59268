"""Whole trees: documentation, scoring, downstream use, gate, scaffold verification, tools, and the library's names."""

import io
import json
import subprocess

import pytest

import tessera
from tessera.__main__ import main
from tessera.functions import render
from tessera.plans import docs, tools, trees, validate
from tessera.sources import authority, java_source, python_source, typescript_source, walk


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "pkg/__init__.py").write_text("from .a import AHandler\n")
    (src / "pkg/a.py").write_text("from abc import ABC, abstractmethod\nclass AHandler(ABC):\n    @abstractmethod\n    def run(self, x): ...\nclass BHandler: pass\ndef register_it(f): return eval(f)\n")
    return src


def run(capsys, spark, *args):
    code = main(list(map(str, args)), spark)
    return code, capsys.readouterr()


def test_documentation_run(spark, tree, tmp_path, capsys):
    out = tmp_path / "out"
    code, said = run(capsys, spark, "docs", tree, out, "--provider", "fake", "--dry-run")
    assert code == 0 and "2 modules parsed, 0 failed, 3 points, 16 calls at most" in said.out and not out.exists()
    docs.register_provider("coder", lambda **_: docs.FakeProvider("```python\nx = 1\n```"))
    code, said = run(capsys, spark, "docs", tree, out, "--provider", "coder", "--cache", tmp_path / "cache", "--concurrency", "3", "--validate")
    assert code == 0 and "3 points, 0 unverified, 0 dropped" in said.out
    assert sorted(p.name for p in (out / "examples").iterdir()) == ["pkg_a_AHandler.py", "pkg_a_BHandler.py", "pkg_a_register_it.py"]
    points = json.loads((out / "manifest.json").read_text())["points"]
    assert [p["id"] for p in points] == ["pkg.a:AHandler", "pkg.a:BHandler", "pkg.a:register_it"] and points[0]["implement"] == ["def run(self, x)"]
    assert run(capsys, spark, "docs", tree, out, "--provider", "coder", "--max-calls", "2")[0] == 2
    assert run(capsys, spark, "docs", tree, out, "--provider", "nobody")[0] == 2
    (tree / "pkg/__init__.py").write_text("import not_there_at_all\n")
    code, said = run(capsys, spark, "docs", tree, out, "--provider", "coder", "--validate")
    assert code == 2 and "pip install not_there_at_all" in said.err


def test_scaffolds_are_verified(spark, tree, tmp_path, capsys):
    m = tmp_path / "m.json"
    point = lambda n, c: {"id": f"pkg.a:{n}", "module": "pkg.a", "symbol": n, "category": c}
    m.write_text(json.dumps({"points": [point("BHandler", "subclass"), point("AHandler", "subclass"), point("x", "plugin_loader")]}))
    code, said = run(capsys, spark, "verify", m, "--root", tree)
    assert code == 0 and [x.split(":")[0] for x in said.out.splitlines()] == ["PASS pkg.a", "PASS pkg.a", "SKIP pkg.a"]
    m.write_text(json.dumps({"points": [point("gone", "subclass"), point("AHandler", "subclass")]}))
    assert run(capsys, spark, "verify", m, "--root", tree)[0] == 1 and run(capsys, spark, "verify", m, "--root", tree, "--id", "pkg.a:AHandler")[0] == 0
    assert run(capsys, spark, "verify", m, "--root", tree, "--id", "none")[0] == 2


def test_scores_of_trees(spark, tree, tmp_path, capsys):
    truth = tmp_path / "truth.json"
    label = lambda *ids: {"version": "1", "extension_points": [{"id": i, "justification": "j"} for i in ids]}
    truth.write_text(json.dumps({"targets": {"pkg": label("pkg.a:AHandler", "pkg.a:BHandler", "pkg:Absent"), "other": label("other:X")}}))
    code, said = run(capsys, spark, "score", truth, f"pkg={tree}", "-k", "1")
    assert code == 0 and "| pkg | 3 | 3 | 1, 3, 4 | 1/3 | 3.0 |" in said.out and "not found: pkg:Absent" in said.out and "left out: other 1" in said.out
    assert run(capsys, spark, "score", truth, f"pkg={tmp_path}/not")[0] == 2
    scores, skipped = trees.score_trees(spark, str(truth), {"pkg": (str(tree), "python")}, {"pkg": "2"})
    assert scores.count() == 0 and skipped.count() == 2


def test_downstream_use(spark, tree, tmp_path, capsys):
    site = tmp_path / "site"
    for name, text in {"one/__init__.py": "from pkg.a import AHandler\nclass Mine(AHandler): pass\nclass Also(AHandler): pass\n", "one-1.dist-info/x.py": "class No(AHandler): pass\n", "two.py": "import pkg.a\nclass My(pkg.a.AHandler): pass\n", "bin/tool.py": "class No(AHandler): pass\n"}.items():
        (site / name).parent.mkdir(parents=True, exist_ok=True)
        (site / name).write_text(text)
    assert walk.packages(str(site)) == [("one", "one/__init__.py"), ("two", "two.py")]
    code, said = run(capsys, spark, "usage", site, tree)
    assert code == 0 and "| AHandler | 2 | 1 | 1 |" in said.out and "BHandler" not in said.out


def test_gate_between_trees(spark, tree, tmp_path, capsys):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "base")
    (tree / "pkg/a.py").write_text("class AHandler: pass\ndef f(x): return eval(eval(x))\n")
    comments = tmp_path / "comments.json"
    comments.write_text(json.dumps([["1", "hello"], ["2", render.DIFF_MARK + " old"], ["3", "x"]]))
    code, said = run(capsys, spark, "gate", tree, tree, "--ref", "HEAD", "--comments", comments)
    assert code == 1 and said.out.startswith("2\n" + render.DIFF_MARK) and "- pkg.a:BHandler" in said.out and "'abstract_class' -> 'class'" in said.out
    code, said = run(capsys, spark, "gate", tree, tree, "--ref", "HEAD", "--of", "surface", "--fail-on", "high")
    assert code == 1 and "1 introduced, 0 removed" in said.out
    assert run(capsys, spark, "gate", tree, tree)[0] == 0
    assert subprocess.run(["git", "-C", str(tree), "worktree", "list"], capture_output=True, text=True).stdout.count("\n") == 1


def test_tools(spark, tree):
    ask = lambda i, method, **p: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": p})
    lines = [ask(1, "initialize"), json.dumps({"method": "notifications/initialized"}), ask(2, "tools/list"), ask(3, "tools/call", name="rank_points", arguments={"path": str(tree), "limit": 2}), ask(4, "tools/call", name="audit_surface", arguments={"path": str(tree), "limit": 0}), ask(5, "tools/call", name="none"), "{", ask(6, "tools/call", name="rank_points", arguments={"path": str(tree), "language": "cobol"})]
    out = io.StringIO()
    tools.serve(spark, io.StringIO("\n".join(lines)), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in said] == [1, 2, 3, 4, 5, None, 6]
    assert {t["name"] for t in said[1]["result"]["tools"]} == {"rank_points", "audit_surface"}
    body = lambda x: json.loads(x["result"]["content"][0]["text"])
    assert [p["id"] for p in body(said[2])] == ["pkg.a:AHandler", "pkg.a:register_it"]
    assert body(said[3])["count"] == 1 and body(said[3])["sinks"] == [] and "error" in said[4] and "error" in said[5] and said[6]["result"]["isError"]


def test_sources_as_a_table(spark):
    files = spark.createDataFrame([("a/__init__.py", "X = 1"), ("a/b.py", "def f(: pass"), ("c.py", None)], "path string, content string")
    assert {r.qualname: r.parse_error is None for r in python_source.modules_of(files).collect()} == {"a": True, "a.b": False, "c": True}
    assert python_source.modules_of(files.limit(0)).count() == 0
    ts = spark.createDataFrame([("a.ts", "export class A {}"), ("a.d.ts", "export class B {}"), ("b.d.mts", "x")], "path string, content string")
    assert [[d.name for d in r.declarations] for r in typescript_source.modules_of(ts).collect()] == [["A"]]
    assert java_source.modules_of(spark.createDataFrame([("p/A.java", "class A {}")], "path string, content string")).first().qualname == "p.A"


def test_other_scanners_are_run(spark):
    said = json.dumps({"results": [{"filename": "a.py", "line_number": 4, "test_id": "T1"}]})
    assert authority.run(spark, ["echo", said], authority.read_flat).first().line == 4
    for command in (["echo", "oops"], ["a-scanner-that-is-not-there"], ["sleep", "9"]):
        assert authority.run(spark, command, authority.read_flat, timeout=1.0).count() == 0


def test_every_name_is_there():
    assert len(tessera.__all__) >= 70 and all(getattr(tessera, n) is not None for n in tessera.__all__)
    assert set(tessera.__all__) <= set(dir(tessera))
    with pytest.raises(AttributeError):
        tessera.nothing_of_this_name


def test_remedies():
    assert [validate.remedy(r, "a.b") for r in ("missing_dependency", "ok")] == ["a.b isn't installed: pip install a, then run again.", ""]
