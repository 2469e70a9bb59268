"""Java modules by a small scanner: top-level declarations, imports, typed calls, constructors and deserialization hooks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sinks

from . import walk
from .lexer import Token, angle, closing, join, split, tokens, unquote
from .walk import Paths

ENDINGS = (".java",)
_KINDS = frozenset("class interface enum record".split())
_NOT_TYPES = frozenset("return new throw else case package import assert extends implements instanceof yield goto".split())
_DECL = [("kind", pa.string()), ("name", pa.string()), ("lineno", pa.int32()), ("is_public", pa.bool_()), ("is_abstract", pa.bool_()), ("bases", pa.list_(pa.string())), ("decorators", pa.list_(pa.string()))]
_CALL = [("receiver", pa.string()), ("method", pa.string()), ("is_new", pa.bool_()), ("is_hook", pa.bool_()), ("lineno", pa.int32()), ("shell_true", pa.bool_()), ("visit_ord", pa.int32())]
SCHEMA = pa.schema([("path", pa.string()), ("qualname", pa.string()), ("parse_error", pa.string()), ("declarations", pa.list_(pa.struct(_DECL))), ("calls", pa.list_(pa.struct(_CALL))), ("types", pa.list_(pa.struct([("variable", pa.string()), ("type", pa.string())]))), ("imports", pa.list_(pa.string()))])
DDL = (
    "path string, qualname string, parse_error string, declarations array<struct<kind: string, name: string, lineno: int, is_public: boolean, is_abstract: boolean, bases: array<string>, decorators: array<string>>>, "
    "calls array<struct<receiver: string, method: string, is_new: boolean, is_hook: boolean, lineno: int, shell_true: boolean, visit_ord: int>>, types array<struct<variable: string, type: string>>, imports array<string>"
)
#: Parameters that make a method a hook of deserialization, by its name.
_HOOKS = {"readObject": "ObjectInputStream", "readResolve": "", "readExternal": "ObjectInput"}


def bare(ts: list[Token]) -> str:
    """A type without arguments and package."""
    return join(ts).split("<", 1)[0].strip().rpartition(".")[2]


def parse_module(path: str, text: str) -> dict:
    ts = tokens(text)
    n = len(ts)
    at = lambda k: ts[k].text if 0 <= k < n else ""
    decls, calls, types, imports = [], [], [], []
    depth, parens, modifiers, annotations = 0, 0, set(), []
    i = 0
    while i < n:
        t = ts[i]
        if t.text == "{" and t.kind == "sign":
            depth += 1
        elif t.text == "}" and t.kind == "sign":
            depth = max(0, depth - 1)
            modifiers, annotations = set(), []
        elif t.text in "()" and t.kind == "sign":
            parens = max(0, parens + (1 if t.text == "(" else -1))
        elif t.text == ";" and t.kind == "sign":
            modifiers, annotations = set(), []
        elif t.text == "import" and depth == 0:
            end = next((k for k in range(i, n) if at(k) == ";"), n)
            imports.append(join([x for x in ts[i + 1 : end] if x.text != "static"]))
            i = end
        elif t.text == "@" and i + 1 < n and ts[i + 1].kind == "name" and at(i + 1) != "interface":
            k = i + 1
            while at(k + 1) == ".":
                k += 2
            annotations.append(bare(ts[i + 1 : k + 1]))
            i = closing(ts, k + 1) if at(k + 1) == "(" else k
        elif depth == 0 and t.text in ("public", "abstract"):
            modifiers.add(t.text)
        elif depth == 0 and t.text in _KINDS and i + 1 < n and ts[i + 1].kind == "name" and at(i - 1) != "@":
            head = next((k for k in range(i, n) if at(k) == "{"), n)
            k = angle(ts, i + 2)
            if at(k) == "(":
                k = closing(ts, k) + 1
            bases, part, on = [], [], False
            for x in [*ts[k:head], Token("sign", "", 0)]:
                if x.text in ("extends", "implements", "permits", ""):
                    bases += [bare(p) for p in split(part)] if on else []
                    part, on = [], x.text != "permits"
                else:
                    part.append(x)
            decls.append({"kind": t.text, "name": at(i + 1), "lineno": t.line, "is_public": "public" in modifiers, "is_abstract": t.text == "interface" or "abstract" in modifiers, "bases": bases, "decorators": annotations})
            modifiers, annotations = set(), []
            i = head - 1
        elif t.kind == "name":
            args = lambda k: ts[k + 1 : closing(ts, k)]
            shell = lambda xs: any(x.kind == "string" and unquote(x) in sinks.JAVA_SHELLS for x in xs)
            if at(i - 1) == "new":
                k = i
                while at(k + 1) == ".":
                    k += 2
                p = angle(ts, k + 1)
                if at(p) == "(":
                    calls.append({"receiver": None, "method": at(k), "is_new": True, "is_hook": False, "lineno": t.line, "shell_true": shell(args(p)), "visit_ord": len(calls)})
                    end = closing(ts, p)
                    if at(end + 1) == "." and at(end + 3) == "(":
                        calls.append({"receiver": at(k), "method": at(end + 2), "is_new": False, "is_hook": False, "lineno": t.line, "shell_true": shell(args(end + 3)), "visit_ord": len(calls) - 2})
            elif at(i + 1) == "(" and at(i - 1) == "." and i >= 2:
                receiver = at(i - 2) if ts[i - 2].kind == "name" and at(i - 3) != "." else None
                if at(i - 2) == ")" and i >= 6 and at(i - 3) == "(" and at(i - 5) == ".":
                    receiver = at(i - 6)  # Runtime.getRuntime().exec(..)
                if receiver:
                    calls.append({"receiver": receiver, "method": t.text, "is_new": False, "is_hook": False, "lineno": t.line, "shell_true": shell(args(i + 1)), "visit_ord": len(calls)})
            elif at(i + 1) == "(" and depth == 1 and t.text in _HOOKS and at(closing(ts, i + 1) + 1) in ("{", "throws"):
                kinds = [bare(p[:-1]) for p in split([x for x in args(i + 1) if x.text != "final"])]
                if kinds == ([_HOOKS[t.text]] if _HOOKS[t.text] else []):
                    calls.append({"receiver": None, "method": t.text, "is_new": False, "is_hook": True, "lineno": t.line, "shell_true": False, "visit_ord": len(calls)})
            elif depth >= 1 and parens == 0 and t.text not in _NOT_TYPES:
                k = angle(ts, i + 1)
                if k < n and ts[k].kind == "name" and at(k) not in _NOT_TYPES and at(k + 1) in ("=", ";") and at(i - 1) != ".":
                    types.append({"variable": at(k), "type": t.text})
        i += 1
    return {"path": path, "qualname": path.rpartition(".")[0].replace("/", "."), "parse_error": None, "declarations": decls, "calls": calls, "types": types, "imports": imports}


def modules(spark: SparkSession, root: str, exclude: Paths = ()) -> DataFrame:
    return walk.parse(walk.paths(spark, root, ENDINGS, exclude), root, parse_module, SCHEMA, DDL)


def modules_of(files: DataFrame, *columns: str) -> DataFrame:
    """modules() of a table of sources (path, content), or those columns of it."""
    return walk.parse_table(files, parse_module, SCHEMA, DDL, columns)


def audit(modules: DataFrame) -> DataFrame:
    """(module, lineno, id, category, severity, confidence): typed calls, constructors and hooks, once per line and id, the first visited."""
    ok = modules.filter("parse_error IS NULL")
    declared = lambda c: F.array_min(F.transform(F.filter("types", lambda t: t["variable"] == c["receiver"]), lambda t: t["type"]))
    calls = ok.select(F.col("qualname").alias("module"), F.explode(F.transform("calls", lambda c: c.withField("type", F.coalesce(declared(c), c["receiver"])))).alias("c")).select("module", "c.*")
    method = F.col("method")
    spec = F.when(F.col("receiver").isNotNull(), sinks.entry(F.concat("type", F.lit("."), method), sinks.JAVA_TYPED)).when(F.col("is_new"), sinks.entry(method, sinks.JAVA_NEW)).when(F.col("is_hook"), sinks.entry(method, sinks.JAVA_HOOK))
    out = sinks.elevate(calls.withColumn("_s", spec).filter("_s IS NOT NULL").select("*", "_s.*"))
    return sinks.dedupe(out.select("module", "lineno", "id", "category", "severity", "confidence", "visit_ord"))
