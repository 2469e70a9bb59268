"""Snapshots, reports, documentation run, command line, stream."""

import json

import pytest

from tessera import sources
from tessera.__main__ import main
from tessera.operators import scoring
from tessera.plans import docs
from tessera.sources import config_scan, snapshots
from tessera.streaming import surface

A = {"sinks": [{"id": "X", "module": "m", "call": "eval", "category": "code_exec", "severity": "high", "confidence": "high", "lineno": 3}] * 2}
B = A["sinks"][:1] * 3 + [5]


@pytest.fixture
def files(tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x), encoding="utf-8")
    put("a.json", A)
    put("b.json", B)
    put("bad.json", "{")
    put("p1.json", {"schema_version": "1.0", "points": [{"id": "m:X", "module": "m", "symbol": "X", "kind": "class", "implement": ["def run(self)"]}, {"kind": "k"}]})
    put("p2.json", [{"id": "m:X", "module": "m", "symbol": "X", "kind": "abstract_class", "implement": ["def run(self)"], "score": 0.3}])
    put("truth.json", {"targets": {"click": {"version": "8", "extension_points": [{"id": "click:a", "justification": "j"}]}, "x": {"version": "1", "extension_points": []}}})
    put("lock.json", {"hosts": {"click": {"version": "8", "downstream": {"p": "1", "q": "2"}}}})
    return tmp_path


def test_both_shapes(spark, files):
    assert snapshots.read_findings(spark, f"{files}/a.json").count() == 2
    assert snapshots.read_findings(spark, f"{files}/b.json").count() == 3
    assert [r.id for r in snapshots.read_points(spark, f"{files}/p1.json").collect()] == ["m:X"]
    with pytest.raises(snapshots.BadSnapshot):
        snapshots.read_findings(spark, f"{files}/bad.json")
    labels = snapshots.read_labels(spark, f"{files}/truth.json")
    assert [(r.target, r.id) for r in labels.collect()] == [("click", "click:a")]
    assert snapshots.read_lock(spark, f"{files}/lock.json").count() == 2
    here, skip = snapshots.pinned(labels, spark.createDataFrame([("click", "7")], "target string, version string"))
    assert here.count() == 0 and skip.first().target == "click"


def test_command_line(spark, files, capsys):
    run = lambda *a: (main(list(a), spark), capsys.readouterr().out)
    code, out = run("surface", f"{files}/a.json", f"{files}/b.json", "--fail-on", "high")
    assert code == 1 and "1 introduced, 0 removed" in out and out.startswith("<!--")
    assert run("surface", f"{files}/a.json", f"{files}/b.json")[0] == 0 and run("surface", f"{files}/bad.json", f"{files}/b.json")[0] == 2
    code, out = run("diff", f"{files}/p1.json", f"{files}/p2.json", "--fail-on", "breaking")
    assert code == 1 and "kind 'class' -> 'abstract_class'" in out and "score" not in out
    code, out = run("scaffold", f"{files}/p1.json", f"{files}/out")
    text = (files / "out/m_X_plugin.py").read_text()
    assert code == 0 and "class MyX(X):" in text and "def run(self):" in text
    compile(text, "x", "exec")
    assert run("scaffold", f"{files}/p1.json", f"{files}/out", "--id", "none")[0] == 2 and run("detect", "/not/there")[0] == 2


def test_detect_and_audit_reports(spark, files, capsys):
    src = files / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "pkg/__init__.py").write_text("from .a import AHandler\n")
    (src / "pkg/a.py").write_text("import importlib.metadata as md\nclass AHandler: pass\nclass BHandler: pass\ndef f():\n    md.entry_points()\n    md.entry_points()\n    eval('x')\n")
    assert main(["detect", str(src), "--json"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert [(r["id"], r["tied_with"]) for r in got] == [("pkg.a:AHandler", 0), ("pkg.a:BHandler", 0), ("pkg.a:entry_points", 0), ("pkg.a:entry_points", 0)]
    assert main(["detect", str(src)], spark) == 0
    assert "entry_points (2 sites)" in capsys.readouterr().out
    assert main(["audit", str(src)], spark) == 0
    assert "1 high" in capsys.readouterr().out
    assert main(["audit", str(src), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["count"] == 3


def test_config(spark):
    p = spark.createDataFrame([(x,) for x in ("plugins.json", "a/CONFIG.Yaml", "mods/x.txt", "src/main.py", "node_modules/config.json", "a/data/deep/manifest.toml", "README.md")], "path string")
    assert sorted((r.kind, r.path) for r in config_scan.config_points(p).collect()) == [("data_dir", "a/data"), ("data_dir", "mods"), ("manifest_file", "a/CONFIG.Yaml"), ("manifest_file", "a/data/deep/manifest.toml"), ("manifest_file", "plugins.json")]


def test_providers(tmp_path):
    fake = docs.FakeProvider("```python\nx = 1\n```")
    p = docs.Budget(docs.Cache(fake, str(tmp_path)), 3)
    assert [p.generate("s", "a") for _ in range(3)] and len(fake.calls) == 1
    with pytest.raises(docs.BudgetSpent):
        p.generate("s", "a")
    assert docs.example(fake, "p") == ("x = 1", "compiled", 1)
    n = iter(["```(", "```def", "```y = 2```"])
    assert docs.example(docs.FakeProvider(lambda _: next(n)), "p") == ("y = 2", "compiled", 3)
    assert docs.example(docs.FakeProvider("```("), "p", 9)[1:] == ("unverified", 5)


def test_documents(spark, tmp_path):
    seam = "kind string, module string, name string, lineno int, detail string, reexported boolean, has_override_point boolean, seam_ord int"
    s = scoring.score_seams(spark.createDataFrame([("class", "m", "AHandler", 1, "", False, False, 0), ("class", "m", "B", 2, "", False, False, 1)], seam))
    from pyspark.sql import functions as F

    none = F.array().cast("array<string>")
    f = s.withColumn("signature", F.lit("class X")).withColumn("bases", none).withColumn("decorators", none).withColumn("implement", none)
    fake = docs.FakeProvider("```x = 1```")
    made = docs.document(f, fake, 1)
    assert [d["id"] for d in made.points] == ["m:AHandler"] and made.points[0]["status"] == "compiled" and made.unverified == 0
    assert len(fake.calls) == 3 and fake.calls[0][1].startswith("How can this codebase be extended?") and "1 modules, 0 dependencies" in fake.calls[0][1]
    assert docs.write_docs(made, str(tmp_path / "d")) == ["examples/m_AHandler.py", "guide.md", "index.md"]
    assert "| [m:AHandler](guide.md) |" in (tmp_path / "d/index.md").read_text()
    for name in ("one", "two"):
        docs.write_manifest(f, str(tmp_path / name))
    assert (tmp_path / "one").read_bytes() == (tmp_path / "two").read_bytes()
    assert [p["id"] for p in json.loads((tmp_path / "one").read_text())["points"]] == ["m:AHandler", "m:B"]


def test_documents_of_many_points_in_order(spark, tmp_path):
    """Threads don't change what comes out; failed points are dropped; ties go by the seams' order; other languages' examples aren't compiled."""
    from pyspark.sql import functions as F

    seam = "kind string, module string, name string, lineno int, detail string, reexported boolean, has_override_point boolean, seam_ord int"
    s = scoring.score_seams(spark.createDataFrame([("class", "m", f"P{i}Handler", 1, "", False, False, i) for i in range(12)], seam))
    none = F.array().cast("array<string>")
    f = s.withColumn("signature", F.lit("")).withColumn("bases", none).withColumn("decorators", none).withColumn("implement", none)
    checked = spark.createDataFrame([("m", "P0Handler", False, "import failed: x"), ("m", "P1Handler", True, "")], "module string, name string, ok boolean, detail string")
    answer = lambda q: "```python\n(```" if "P3Handler" in q and q.startswith("Write") else f"```y = {len(q)}```"
    runs = [docs.document(f, docs.FakeProvider(answer), 10, checked=checked, concurrency=n) for n in (1, 4)]
    assert runs[0] == runs[1]
    assert [p["id"] for p in runs[0].points] == [f"m:P{i}Handler" for i in range(1, 10)] and runs[0].unverified == 1
    assert [(d["id"], d["reason"]) for d in runs[0].dropped] == [("m:P0Handler", "import_failed")]
    docs.write_docs(runs[0], str(tmp_path))
    text = (tmp_path / "index.md").read_text()
    assert "1 can't be imported" in text and "UNVERIFIED" in text
    other = docs.document(f, docs.FakeProvider("interface X {}"), 2, language="typescript")
    assert [(p["status"], p["path"]) for p in other.points] == [("generated", "examples/m_P0Handler.ts"), ("generated", "examples/m_P1Handler.ts")]


def test_providers_by_name():
    docs.register_provider("echo", lambda **o: docs.FakeProvider(lambda q: q + o.get("end", "")))
    assert docs.provider("echo", end="!").generate("s", "a") == "a!" and docs.provider("fake").generate("s", "a") == "ok"
    assert docs.provider("tessera.plans.docs:FakeProvider", answer="b").generate("s", "a") == "b"
    with pytest.raises(ValueError):
        docs.provider("none")


def test_languages():
    assert sources.languages() == ["java", "python", "typescript"]
    with pytest.raises(KeyError):
        sources.language("cobol")


def test_stream_of_snapshots(spark, tmp_path):
    cols = "id string, module string, call string, category string, severity string, ord int"
    src = str(tmp_path / "in")
    for rows in (["a", "b"], ["a", "a"]):
        spark.createDataFrame([(x, "m", "c", "k", "high", i) for i, x in enumerate(rows)], cols).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(src)
    q = surface.watch(stream, f"file://{tmp_path}/base", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted((r.batch, r.direction, r.id, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "introduced", "a", 1), (0, "introduced", "b", 1), (1, "introduced", "a", 1), (1, "removed", "b", 1)]
