"""TypeScript and JavaScript modules by a small scanner of declarations, imports, exports and calls; no grammar is needed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sinks

from . import walk
from .lexer import Token, angle, closing, join, split, tokens, unquote
from .walk import Paths

ENDINGS = tuple(f".{m}{kind}" for kind in ("ts", "js") for m in ("", "m", "c")) + (".tsx", ".jsx")
DECLARATIONS = (".d.ts", ".d.mts", ".d.cts")
_KEYWORDS = frozenset("if for while switch catch function return typeof await of in new delete void super import case do else throw yield".split())

_DECL = [("kind", pa.string()), ("name", pa.string()), ("lineno", pa.int32()), ("is_public", pa.bool_()), ("is_abstract", pa.bool_()), ("bases", pa.list_(pa.string())), ("decorators", pa.list_(pa.string())), ("args", pa.list_(pa.string()))]
_CALL = [("obj", pa.string()), ("prop", pa.string()), ("name", pa.string()), ("lineno", pa.int32()), ("has_arg", pa.bool_()), ("literal_arg", pa.bool_()), ("visit_ord", pa.int32())]
_BIND = [("local", pa.string()), ("module", pa.string()), ("member", pa.string())]
SCHEMA = pa.schema([("path", pa.string()), ("qualname", pa.string()), ("parse_error", pa.string()), ("declarations", pa.list_(pa.struct(_DECL))), ("calls", pa.list_(pa.struct(_CALL))), ("bindings", pa.list_(pa.struct(_BIND))), ("imports", pa.list_(pa.string()))])
DDL = (
    "path string, qualname string, parse_error string, declarations array<struct<kind: string, name: string, lineno: int, is_public: boolean, is_abstract: boolean, bases: array<string>, decorators: array<string>, args: array<string>>>, "
    "calls array<struct<obj: string, prop: string, name: string, lineno: int, has_arg: boolean, literal_arg: boolean, visit_ord: int>>, bindings array<struct<local: string, module: string, member: string>>, imports array<string>"
)


def _parameters(ts: list[Token]) -> list[str]:
    return [join(split(p, ":")[0]) for p in split(ts)]


def _heritage(ts: list[Token]) -> list[str]:
    """Bases behind extends and implements, as written."""
    out, part, on = [], [], False
    for t in [*ts, Token("sign", "", 0)]:
        if t.text in ("extends", "implements", ""):
            out += [join(p) for p in split(part)] if on else []
            part, on = [], True
        else:
            part.append(t)
    return out


def parse_module(path: str, text: str) -> dict:
    ts = tokens(text)
    n = len(ts)
    at = lambda k: ts[k].text if 0 <= k < n else ""
    decls, calls, binds, imports, exported = [], [], [], [], set()
    depth, decorators, i = 0, [], 0
    while i < n:
        t = ts[i]
        top = depth == 0
        if t.kind == "sign":
            if t.text in "([{":
                depth += 1
            elif t.text in ")]}":
                depth = max(0, depth - 1)
            elif t.text == "@" and top and i + 1 < n and ts[i + 1].kind == "name":
                k = i + 1
                while at(k + 1) == "." and k + 2 < n:
                    k += 2
                decorators.append(join(ts[i + 1 : k + 1]))
                i = closing(ts, k + 1) + 1 if at(k + 1) == "(" else k + 1
                continue
        elif t.kind == "name":
            public = at(i - 1) == "export" or at(i - 1) in ("default", "abstract", "declare", "async") and "export" in (at(i - 2), at(i - 3))
            if top and t.text in ("class", "interface") and i + 1 < n and ts[i + 1].kind == "name":
                head = next((k for k in range(i + 2, n) if at(k) == "{"), n)
                decls.append({"kind": t.text, "name": at(i + 1), "lineno": t.line, "is_public": public, "is_abstract": t.text == "interface" or at(i - 1) == "abstract", "bases": _heritage(ts[angle(ts, i + 2) : head]), "decorators": decorators, "args": []})
                decorators = []
                i = head
                continue
            if top and t.text == "function" and i + 1 < n:
                k = i + 2 if at(i + 1) == "*" else i + 1
                p = angle(ts, k + 1)
                if k < n and ts[k].kind == "name" and at(p) == "(":
                    decls.append({"kind": "function", "name": at(k), "lineno": t.line, "is_public": public, "is_abstract": False, "bases": [], "decorators": decorators, "args": _parameters(ts[p + 1 : closing(ts, p)])})
                    decorators = []
            if t.text == "import" and at(i - 1) != ".":
                end = next((k for k in range(i + 1, min(n, i + 200)) if ts[k].kind == "string" or at(k) in (";", "(")), n)
                if end < n and ts[end].kind == "string":
                    binds += _import_bindings(ts[i + 1 : end], unquote(ts[end]))
                    imports.append(unquote(ts[end]))
                    i = end + 1
                    continue
            if t.text == "require" and at(i + 1) == "(" and i + 2 < n and ts[i + 2].kind == "string" and at(i - 1) == "=":
                binds += _require_bindings(ts, i - 1, unquote(ts[i + 2]))
                imports.append(unquote(ts[i + 2]))
            if t.text == "exports":
                exported |= _exports(ts, i)
            k = angle(ts, i + 1) if at(i - 1) == "new" else i + 1
            if at(k) == "(" and t.text not in _KEYWORDS - {"import"} and at(i - 1) != "function":
                arg = ts[k + 1 : closing(ts, k)]
                owner = at(i - 2) if at(i - 1) == "." and i >= 2 and ts[i - 2].kind == "name" and at(i - 3) != "." else None
                if at(i - 1) != "." or owner:
                    first = split(arg)[0] if arg else []
                    literal = len(first) == 1 and first[0].kind == "string" and (first[0].text[0] != "`" or "${" not in first[0].text)
                    calls.append({"obj": owner, "prop": t.text if owner else None, "name": None if owner else t.text, "lineno": t.line, "has_arg": bool(arg), "literal_arg": literal, "visit_ord": len(calls)})
        if top and t.text in (";", "}"):
            decorators = []
        i += 1
    for d in decls:
        d["is_public"] = d["is_public"] or d["name"] in exported
    stem = path.rpartition(".")[0]
    return {"path": path, "qualname": stem, "parse_error": None, "declarations": decls, "calls": calls, "bindings": binds, "imports": imports}


def _import_bindings(ts: list[Token], module: str) -> list[dict]:
    ts = [t for t in ts if t.text not in ("from", "type")]
    out = []
    for part in split(ts):
        if part[0].text == "{":
            out += [{"local": p[-1].text, "module": module, "member": p[0].text} for p in split(part[1:-1])]
        elif part[0].text == "*":
            out.append({"local": part[-1].text, "module": module, "member": None})
        elif part[0].kind == "name":
            out.append({"local": part[0].text, "module": module, "member": None})
    return out


def _require_bindings(ts: list[Token], eq: int, module: str) -> list[dict]:
    """What stands before the sign of 'x = require(..)': a name, or names in braces."""
    if ts[eq - 1].kind == "name":
        return [{"local": ts[eq - 1].text, "module": module, "member": None}]
    if ts[eq - 1].text == "}":
        k = eq - 1
        while k and ts[k].text != "{":
            k -= 1
        return [{"local": p[-1].text, "module": module, "member": p[0].text} for p in split(ts[k + 1 : eq - 1])]
    return []


def _exports(ts: list[Token], i: int) -> set[str]:
    """Names given by exports.x = y, module.exports = y, module.exports.x = y and module.exports = {a, b: c}."""
    n = len(ts)
    at = lambda k: ts[k].text if k < n else ""
    if at(i + 1) == "=" and at(i + 2) == "{":
        return {p[0].text if len(p) == 1 else p[-1].text for p in split(ts[i + 3 : closing(ts, i + 2)])}
    if at(i + 1) == "=" and i + 2 < n and ts[i + 2].kind == "name":
        return {at(i + 3)} if at(i + 2) in ("class", "function") else {at(i + 2)}
    if at(i + 1) == "." and at(i + 3) == "=":
        return {at(i + 2), at(i + 5) if at(i + 4) in ("class", "function") else at(i + 4)}
    return set()


def modules(spark: SparkSession, root: str, exclude: Paths = ()) -> DataFrame:
    files = walk.paths(spark, root, ENDINGS, exclude)
    for e in DECLARATIONS:
        files = files.filter(~F.col("path").endswith(e))
    return walk.parse(files, root, parse_module, SCHEMA, DDL)


def modules_of(files: DataFrame, *columns: str) -> DataFrame:
    """modules() of a table of sources (path, content), or those columns of it."""
    return walk.parse_table(files.filter(~F.lower("path").rlike(r"\.d\.[mc]?ts$")), parse_module, SCHEMA, DDL, columns)


def audit(modules: DataFrame) -> DataFrame:
    """(module, lineno, id, category, severity, confidence, call): members of risky modules through bindings, risky globals, computed loads, and
    timers with a text body."""
    ok = modules.filter("parse_error IS NULL")
    calls = ok.select(F.col("qualname").alias("module"), "bindings", F.explode("calls").alias("c"))
    c, name, bare = F.col("c"), F.col("c.name"), F.col("c.obj").isNull()
    globals_ = F.when(bare, sinks.entry(name, sinks.TS_GLOBAL))
    loads = F.when(bare & F.col("c.has_arg") & ~F.col("c.literal_arg"), sinks.entry(name, sinks.TS_LOADER))
    timers = F.when(bare & F.col("c.literal_arg"), sinks.entry(name, sinks.TS_TIMER))
    found = F.array_compact(F.concat(sinks.bound_entries(c, F.col("bindings")), F.array(globals_, loads, timers)))
    call = F.coalesce(F.concat("c.obj", F.lit("."), "c.prop"), name)
    return calls.select("module", "c", F.explode(found).alias("s")).select("module", "c.lineno", "s.id", "s.category", "s.severity", "s.confidence", call.alias("call"), "c.visit_ord")
