"""Two tools for other programs, called by JSON-RPC lines on standard input and output: ranked points, and risk findings. No model is asked and no code executed."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import render
from tessera.operators import scoring

from . import trees


def rank(spark: SparkSession, path: str, language: str = "python", min_score: float = 0.0, limit: int | None = None) -> list[dict]:
    """The points of a source tree, best first, loaders among them: id, category, score, kind and signals; the limit is over all."""
    points: DataFrame = trees.points_of(spark, path, language, min_score).orderBy(*scoring.order())
    rows = (points if limit is None else points.limit(limit)).toLocalIterator()
    return [{"id": f"{r.module or path}:{r.name}", "category": r.category, "score": round(r.score, 4), "kind": r.kind, "signals": list(r.signals)} for r in rows]


def audit(spark: SparkSession, path: str, language: str = "python", limit: int | None = None) -> dict:
    """The risk findings of a source tree, worst first, with what they don't cover: the same as audit --json gives."""
    return json.loads(render.audit_json(trees.findings_of(spark, path, language), os.path.basename(os.path.abspath(path)), limit))


TOOLS: dict[str, Callable] = {"rank_points": rank, "audit_surface": audit}
_ARGUMENTS = {"path": "string", "language": "string", "min_score": "number", "limit": "integer"}


def _described() -> list[dict]:
    of = lambda f: [a for a in f.__code__.co_varnames[1 : f.__code__.co_argcount]]
    return [{"name": n, "description": f.__doc__, "inputSchema": {"type": "object", "required": ["path"], "properties": {a: {"type": _ARGUMENTS[a]} for a in of(f)}}} for n, f in TOOLS.items()]


def answer(spark: SparkSession, ask: dict) -> dict | None:
    """The reply to one request; none to a notification."""
    if "id" not in ask:
        return None
    out = {"jsonrpc": "2.0", "id": ask["id"]}
    method, given = ask.get("method"), ask.get("params") or {}
    if method == "initialize":
        return out | {"result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}}}
    if method == "tools/list":
        return out | {"result": {"tools": _described()}}
    if method != "tools/call" or given.get("name") not in TOOLS:
        return out | {"error": {"code": -32601, "message": f"no {method} {given.get('name', '')}".strip()}}
    try:
        made = TOOLS[given["name"]](spark, **given.get("arguments", {}))
        return out | {"result": {"content": [{"type": "text", "text": json.dumps(made, ensure_ascii=False)}]}}
    except Exception as e:  # whatever a tool raises is the caller's to see
        return out | {"result": {"isError": True, "content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}]}}


def serve(spark: SparkSession, asked: TextIO, said: TextIO) -> None:
    """Answer line by line until the input ends; a line that is no JSON gets an error without an id."""
    for line in asked:
        if line.strip():
            try:
                reply = answer(spark, json.loads(line))
            except json.JSONDecodeError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if reply:
                print(json.dumps(reply, ensure_ascii=False), file=said, flush=True)
