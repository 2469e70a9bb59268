"""Tokens of brace languages (TypeScript, JavaScript, Java): strings and comments are told from code; templates and regular expressions simply."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, string, number, sign
    text: str
    line: int


_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"""
    r"""|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\.\.\.|.)""",
    re.DOTALL,
)


def tokens(text: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind not in ("space", "comment"):
            out.append(Token(kind, m[0], line))
        line += m[0].count("\n")
    return out


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def closing(ts: list[Token], i: int) -> int:
    """Place of the bracket that closes the one at i; the end where none does."""
    depth = 0
    for k in range(i, len(ts)):
        if ts[k].kind == "sign":
            if ts[k].text in _OPEN:
                depth += 1
            elif ts[k].text in _CLOSE:
                depth -= 1
                if not depth:
                    return k
    return len(ts)


def angle(ts: list[Token], i: int) -> int:
    """Place behind the type arguments that begin at i, if any do."""
    if i < len(ts) and ts[i].text == "<":
        depth = 0
        for k in range(i, len(ts)):
            depth += (ts[k].text == "<") - (ts[k].text == ">")
            if not depth:
                return k + 1
            if ts[k].text in ("{", ";", "}"):
                break
    return i


def join(ts: list[Token]) -> str:
    return "".join(t.text for t in ts)


def split(ts: list[Token], sign: str = ",") -> list[list[Token]]:
    """Pieces between signs that are in no bracket or type argument; empty pieces are left out."""
    out, part, depth = [], [], 0
    for t in ts:
        depth += (t.text in "([{<") - (t.text in ")]}>") if t.kind == "sign" and len(t.text) == 1 else 0
        if t.text == sign and t.kind == "sign" and depth == 0:
            out.append(part)
            part = []
        else:
            part.append(t)
    return [p for p in [*out, part] if p]


def unquote(t: Token) -> str:
    return t.text[1:-1] if len(t.text) > 1 and t.text[-1] == t.text[0] else t.text[1:]
