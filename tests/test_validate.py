import json
import os
import sys
import zipfile

from tessera.operators import crosscheck
from tessera.plans import validate as V
from tessera.sources import archives, authority

CODE = '''
from abc import ABC, abstractmethod
from typing import Protocol
class Base(ABC):
    @abstractmethod
    def run(self): ...
class Needs:
    def __init__(self, x): self.x = x
class Duck(Protocol):
    size: int
def go(): return 1
value = 3
'''


def test_points(spark, tmp_path):
    (tmp_path / "lib.py").write_text(CODE)
    (tmp_path / "hang.py").write_text("import time\ntime.sleep(60)\n")
    (tmp_path / "needs.py").write_text("import not_there_at_all\n")
    root = str(tmp_path)
    assert V.validate_point(root, "lib", "Base", "subclass")[:2] == (True, "subclass_instantiation")
    assert V.validate_point(root, "lib", "Needs", "subclass")[:2] == (False, "error")
    assert V.validate_point(root, "lib", "go", "hook")[:2] == (True, "importable_callable")
    assert V.validate_point(root, "lib", "value", "api")[2] == "not callable" and V.validate_point(root, "lib", "go", "subclass")[2] == "not a class"
    assert V.validate_point(root, "lib", "x", "plugin_loader")[1] == "skipped"
    assert "more than" in V.validate_point(root, "hang", "x", "api", timeout=1.0)[2]
    assert V.preflight(root, "lib") == (True, "ok", "") and V.preflight(root, "nope.sub") == (False, "not_found", "nope")
    assert V.preflight(root, "needs") == (False, "missing_dependency", "not_there_at_all") and V.preflight(root, "") == (True, "ok", "")
    assert V.run_example(root, "import lib\nassert lib.go() == 1")[:2] == (True, "executed") and not V.run_example(root, "1 / 0")[0]
    rows = [("lib", n, c, s, i, i) for i, (n, c, s) in enumerate([("Base", "subclass", 0.9), ("go", "hook", 0.8), ("entry_points", "plugin_loader", 0.7), ("gone", "api", 0.6), ("never", "api", 0.1)])]
    p = spark.createDataFrame(rows, "module string, name string, category string, score double, lineno int, seam_ord int")
    got = V.validate_points(p, root, 4).cache()
    assert {r.name: r.ok for r in got.collect()} == {"Base": True, "go": True, "entry_points": False, "gone": False}
    assert {r.verdict: r.n for r in V.tally(got).collect()} == {"PASS": 2, "SKIP": 1, "FAIL": 1}


def test_modules_are_kept(tmp_path, monkeypatch):
    (tmp_path / "a_target_of_the_test.py").write_text("import colorsys\nvalue = 1\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    sys.modules.pop("colorsys", None)
    with V.modules_kept():
        import a_target_of_the_test

        assert a_target_of_the_test.value == 1 and "colorsys" in sys.modules
        del sys.modules["json"]
    assert "a_target_of_the_test" not in sys.modules and "colorsys" not in sys.modules and sys.modules["json"] is json


def test_source_archives(tmp_path):
    at = tmp_path / "repository/org/ex/lib/1.2"
    at.mkdir(parents=True)
    with zipfile.ZipFile(at / "lib-1.2-sources.jar", "w") as z:
        z.writestr("org/ex/A.java", "class A {}")
    (tmp_path / "repository/org/ex/bad/1").mkdir(parents=True)
    (tmp_path / "repository/org/ex/bad/1/bad-1-sources.jar").write_text("no archive")
    base, root = f"file://{tmp_path}/repository", str(tmp_path / "targets")
    folder = archives.fetch("lib", "org.ex:lib", "1.2", root, base)
    assert folder == f"{root}/lib-1.2" and (tmp_path / "targets/lib-1.2/org/ex/A.java").read_text() == "class A {}"
    assert archives.fetch("lib", "org.ex:lib", "1.2", root, "file:///not/there") == folder
    assert archives.fetch("bad", "org.ex:bad", "1", root, base) is None and archives.fetch("none", "org.ex:none", "1", root, base) is None
    assert os.listdir(root) == ["lib-1.2"]


def test_other_scanners(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({"results": [{"filename": "a.py", "line_number": 4, "test_id": "T1"}, {"filename": "a.py", "line_number": 9, "test_id": "T2"}]}))
    (tmp_path / "files.json").write_text(json.dumps([{"filePath": "b.ts", "messages": [{"line": 2, "ruleId": "r"}]}]))
    (tmp_path / "bad.json").write_text("oops")
    flat = authority.in_scope(authority.read_flat(spark, f"{tmp_path}/flat.json"), ["T1"])
    assert [(r.path, r.line) for r in flat.collect()] == [("a.py", 4)]
    assert authority.read_by_file(spark, f"{tmp_path}/files.json").first().line == 2 and authority.read_flat(spark, f"{tmp_path}/bad.json").count() == 0
    mine = spark.createDataFrame([("a.py", 6), ("a.py", 20)], "path string, line int")
    assert {r.line: r.agreed for r in crosscheck.tolerance_match(mine, flat).collect()} == {6: True, 20: False}
