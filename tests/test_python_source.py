import pytest

from tessera.plans import detect
from tessera.sources import python_source as P
from tessera.sources import walk

FILES = {
    "pkg/__init__.py": "from .core import Exporter, make\nfrom .plugins import *\n",
    "pkg/core.py": '''
import os
from abc import ABC, abstractmethod
__all__ = ["Exporter", "make", "HiddenBase"]
class Exporter(ABC):
    @abstractmethod
    def run(self, data): ...
    def name(self):
        raise NotImplementedError
class _Private: pass
class HiddenBase:
    def go(self): raise NotImplementedError("x")
def make(a, *, b): 
    return __import__(a)
def unlisted(): pass
if True:
    def conditional(): pass
''',
    "pkg/plugins.py": "import importlib, subprocess\nfrom pkg.core import Exporter\nclass CsvPlugin(Exporter): pass\n@app.route('/x')\n@hook\ndef on_load(x): return importlib.import_module('pkg.core')\ndef run(c): subprocess.run(c, shell=True); eval(c); model.eval(); obj.evaluate(c)\nclass S:\n    def __reduce__(self): return 1\n",
    "pkg/broken.py": "def (:\n",
    "pkg/bom.py": "\ufeffx = 1\n",
    "pkg/over.py": "from typing import overload\n@overload\ndef f(a: int): ...\n@overload\ndef f(a: str): ...\ndef f(a): ...\n@overload\ndef g(a): ...\n@overload\ndef g(a, b): ...\n",
    "pkg/.venv/skip.py": "x = 1\n",
    "pkg/build/skip.py": "x = 1\n",
    "pkg/readme.PY": "x",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, text in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text, encoding="utf-8")
    (root / "pkg/latin.py").write_bytes(b"x = '\xe9'\n")
    return str(root)


def test_walk(tree):
    assert walk.walk(tree, (".py",)) == ["pkg/__init__.py", "pkg/bom.py", "pkg/broken.py", "pkg/core.py", "pkg/latin.py", "pkg/over.py", "pkg/plugins.py"]
    assert walk.walk(tree, (".py",), (f"{tree}/pkg/core.py",))[2:4] == ["pkg/broken.py", "pkg/latin.py"]


def test_modules(spark, tree):
    m = {r.path: r for r in P.modules(spark, tree).collect()}
    assert len(m) == 7 and "pkg/__init__.py" in m, "files that begin with an underscore must be there"
    assert sorted(p for p, r in m.items() if r.parse_error) == ["pkg/bom.py", "pkg/broken.py", "pkg/latin.py"]
    core = m["pkg/core.py"]
    assert core.qualname == "pkg.core" and core.all_exports == ["Exporter", "make", "HiddenBase"]
    assert [f.name for f in core.functions] == ["make", "unlisted"] and core.functions[0].args == ["a"]
    ex = core.classes[0]
    assert ex.is_abstract and [x.raises_notimplemented for x in ex.methods] == [False, True] and ex.methods[0].decorators == ["abstractmethod"]
    assert [(d.kind, d.argument) for d in m["pkg/plugins.py"].dynamic_imports] == [("import_module", "pkg.core")]
    assert m["pkg/plugins.py"].functions[0].decorators == ["", "hook"]
    assert [(f.name, f.lineno) for f in m["pkg/over.py"].functions] == [("f", 6), ("g", 8)]


def test_detect(spark, tree):
    m = P.modules(spark, tree).cache()
    got = {(r.module, r.name): r for r in detect.detect(m).collect()}
    assert ("pkg.core", "_Private") not in got and ("pkg.core", "unlisted") not in got
    assert got["pkg.core", "Exporter"].score == 1.0 and got["pkg.core", "Exporter"].kind == "abstract_class"
    assert got["pkg.core", "HiddenBase"].reexported is False and got["pkg.core", "HiddenBase"].has_override_point
    assert got["pkg.core", "make"].reexported and got["pkg.core", "__import__"].category == "reflection"
    assert got["pkg.plugins", "on_load"].score == 0.1 + 0.5 + 0.4
    assert {(r.src, r.dst) for r in detect.edges(m).collect()} == {("pkg", "pkg.core"), ("pkg", "pkg.plugins"), ("pkg.plugins", "pkg.core")}


def test_audit(spark, tree):
    found = sorted((r.dotted, r.severity) for r in detect.audit(P.modules(spark, tree).cache()).collect())
    assert found == [("__import__", "medium"), ("__reduce__", "medium"), ("eval", "high"), ("importlib.import_module", "medium"), ("subprocess.run", "high")]
