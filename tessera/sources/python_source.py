"""Python modules: declarations, imports, run-time imports and risky calls in one parse of each file."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import walk
from .walk import Paths

ENDINGS = (".py",)
#: Calls that import at run time, by the last part of the called name.
RUNTIME = {"walk_packages": "iter_modules", "load_entry_point": "entry_points", "iter_entry_points": "entry_points"} | {k: k for k in "get_loader find_spec load_module import_string entry_points iter_modules __import__ import_module".split()}

_FN = [("name", pa.string()), ("lineno", pa.int32()), ("is_public", pa.bool_()), ("decorators", pa.list_(pa.string())), ("args", pa.list_(pa.string())), ("raises_notimplemented", pa.bool_()), ("is_stub", pa.bool_())]
_CLS = [("name", pa.string()), ("lineno", pa.int32()), ("is_public", pa.bool_()), ("bases", pa.list_(pa.string())), ("decorators", pa.list_(pa.string())), ("methods", pa.list_(pa.struct(_FN))), ("is_abstract", pa.bool_())]
SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("qualname", pa.string()), ("parse_error", pa.string()), ("all_exports", pa.list_(pa.string())),
        ("imports", pa.list_(pa.struct([("module", pa.string()), ("name", pa.string()), ("fromlist", pa.bool_())]))),
        ("dynamic_imports", pa.list_(pa.struct([("kind", pa.string()), ("lineno", pa.int32()), ("argument", pa.string())]))),
        ("functions", pa.list_(pa.struct(_FN))), ("classes", pa.list_(pa.struct(_CLS))),
        ("calls", pa.list_(pa.struct([("dotted", pa.string()), ("lineno", pa.int32()), ("shell_true", pa.bool_()), ("is_definition", pa.bool_())]))),
    ]
)
_FN_DDL = "struct<name: string, lineno: int, is_public: boolean, decorators: array<string>, args: array<string>, raises_notimplemented: boolean, is_stub: boolean>"
DDL = (
    "path string, qualname string, parse_error string, all_exports array<string>, imports array<struct<module: string, name: string, fromlist: boolean>>, "
    f"dynamic_imports array<struct<kind: string, lineno: int, argument: string>>, functions array<{_FN_DDL}>, "
    f"classes array<struct<name: string, lineno: int, is_public: boolean, bases: array<string>, decorators: array<string>, methods: array<{_FN_DDL}>, is_abstract: boolean>>, "
    "calls array<struct<dotted: string, lineno: int, shell_true: boolean, is_definition: boolean>>"
)


def qualname(path: str) -> str:
    return ".".join(p for p in path.removesuffix(".py").split("/") if p != "__init__")


def dotted(node: ast.AST) -> str:
    """a.b.c of names and attributes; empty for anything else, and an attribute of anything else is its own name."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


#: Nodes inside which nothing is looked for.
_LEAVES = frozenset({ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del})


def _walk(node: ast.AST) -> list[ast.AST]:
    """ast.walk() in its order, without leaves."""
    out = [node]
    for n in out:
        for f in n._fields:
            v = getattr(n, f, None)
            if v.__class__ is list:
                out += [x for x in v if isinstance(x, ast.AST) and x.__class__ not in _LEAVES]
            elif isinstance(v, ast.AST) and v.__class__ not in _LEAVES:
                out.append(v)
    return out


def _unfinished(fn: ast.AST) -> bool:
    """Whether a NotImplementedError is raised anywhere inside."""
    for n in _walk(fn):
        if isinstance(n, ast.Raise) and n.exc is not None:
            what = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
            if dotted(what).rpartition(".")[2] == "NotImplementedError":
                return True
    return False


def _function(n: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    decorators = [dotted(d) for d in n.decorator_list]
    return {
        "name": n.name, "lineno": n.lineno, "is_public": not n.name.startswith("_"), "decorators": decorators, "args": [a.arg for a in n.args.args],
        "raises_notimplemented": _unfinished(n), "is_stub": any(d.rpartition(".")[2] == "overload" for d in decorators),
    }


def collapse(functions: list[dict]) -> list[dict]:
    """Overload stubs go where the name has an implementation; else the first of them stays."""
    whole = {f["name"] for f in functions if not f["is_stub"]}
    seen: set[str] = set()
    out = []
    for f in functions:
        if f["is_stub"]:
            if f["name"] in whole or f["name"] in seen:
                continue
            seen.add(f["name"])
        out.append(f)
    return out


def _class(n: ast.ClassDef) -> dict:
    bases = [dotted(b) for b in n.bases]
    methods = collapse([_function(m) for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))])
    abstract = any(b.rpartition(".")[2] in ("ABC", "ABCMeta") for b in bases) or any("abstractmethod" in d for m in methods for d in m["decorators"])
    return {"name": n.name, "lineno": n.lineno, "is_public": not n.name.startswith("_"), "bases": bases, "decorators": [dotted(d) for d in n.decorator_list], "methods": methods, "is_abstract": abstract}


def parse_module(path: str, text: str) -> dict:
    tree = ast.parse(text)
    imports, exports, functions, classes = [], None, [], []
    for n in tree.body:
        if isinstance(n, ast.Import):
            imports += [{"module": a.name, "name": a.asname or a.name, "fromlist": False} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports += [{"module": "." * n.level + (n.module or ""), "name": a.asname or a.name, "fromlist": True} for a in n.names]
        elif isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
            exports = [e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            functions.append(_function(n))
        elif isinstance(n, ast.ClassDef):
            classes.append(_class(n))
    dynamic, calls = [], []
    for n in _walk(tree):
        if isinstance(n, ast.Call):
            name = dotted(n.func)
            kind = RUNTIME.get(name.rpartition(".")[2])
            if kind:
                first = n.args[0] if n.args else None
                dynamic.append({"kind": kind, "lineno": n.lineno, "argument": first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None})
            if name:
                shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in n.keywords)
                calls.append({"dotted": name, "lineno": n.lineno, "shell_true": shell, "is_definition": False})
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            calls.append({"dotted": n.name, "lineno": n.lineno, "shell_true": False, "is_definition": True})
    return {"path": path, "qualname": qualname(path), "parse_error": None, "all_exports": exports, "imports": imports, "dynamic_imports": dynamic, "functions": collapse(functions), "classes": classes, "calls": calls}


def modules(spark: SparkSession, root: str, exclude: Paths = ()) -> DataFrame:
    """One row per Python file of a tree; a file that can't be parsed has parse_error, and its name all the same."""
    return walk.parse(walk.paths(spark, root, ENDINGS, exclude), root, _with_name, SCHEMA, DDL)


def modules_of(files: DataFrame, *columns: str) -> DataFrame:
    """modules() of a table of sources (path, content), or those columns of it."""
    return walk.parse_table(files, _with_name, SCHEMA, DDL, columns)


def _with_name(path: str, text: str) -> dict:
    try:
        return parse_module(path, text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return {"path": path, "qualname": qualname(path), "parse_error": f"{type(e).__name__}: {e}"}
