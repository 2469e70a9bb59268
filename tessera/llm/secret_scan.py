"""Operator 3, secret scan: base patterns, and a token-efficiency test for random strings.

A string of which a byte-pair vocabulary needs many tokens for few characters is not made of words: runs of letters, digits and +/_=- with fewer
than CHARS_PER_TOKEN characters per token are reported as kind 'token'. Words of a language that one vocabulary doesn't know look random to it, so
a run must be inefficient under each of several tiktoken vocabularies, an English one and one of many languages. Every run of MIN_RUN characters or more is tested,
but for such as are known to be something else: numbers (runs that hold no letter); hexadecimal digests of the usual lengths and UUIDs; identifiers
and paths, whose parts between - _ / + and = are letters with up to four digits or numbers, if the letters pass the test by themselves, that is,
are words; and runs that touch a base span.

Spans are code points, end exclusive.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, as_text, by_row, project

RANKS = (f"{TOKENIZERS}/byte_bpe_50k.tiktoken", f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
#: The word split that the vocabularies were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHARS_PER_TOKEN = 2.1
MIN_RUN = 16
KINDS = ("assign", "access", "hex", "token")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more are found whole: a run's start is tried first
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_DIGESTS = frozenset((32, 40, 48, 56, 64, 96, 128))
_HEXRUN = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z")
_PART = re.compile(r"(?:([A-Za-z]+)[0-9]{0,4}|[0-9]+)?\Z")
_CUT = re.compile(r"[-_/=+]+")
_ENCODINGS: dict[str, object] = {}
Span = tuple[str, int, int]
#: What both scanners return; base tells the patterns' spans from those that the method adds.
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("base", pa.bool_())]))
FOUND_SCHEMA = "doc_id long, found array<struct<kind: string, start: int, end: int, text: string, base: boolean>>"


def encodings(paths: tuple[str, ...] = RANKS) -> list:
    """The vocabularies of rank files, each read once per worker."""
    for path in paths:
        if path not in _ENCODINGS:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [_ENCODINGS[p] for p in paths]


def base_spans(text: str) -> list[Span]:
    """The patterns' matches, leftmost and non-overlapping per kind; failing matches are dropped, not tried again."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return in_order(out)


def dense(parts: list[str], encs: list, ratio: float) -> bool:
    """Whether texts, all together, have fewer characters per token than words have, under each vocabulary."""
    chars = sum(map(len, parts))
    return all(chars < ratio * sum(len(e.encode_ordinary(p)) for p in parts) for e in encs)


def known(run: str, encs: list, ratio: float = CHARS_PER_TOKEN) -> bool:
    """Whether a run is a number, a digest, an identifier or a path rather than a random string."""
    if not any(c.isalpha() for c in run):
        return True
    if len(run) in _DIGESTS and _HEXRUN.match(run) or _UUID.match(run):
        return True
    parts = [_PART.match(p) for p in _CUT.split(run)]
    return all(parts) and not dense([m[1] for m in parts if m[1]], encs, ratio)


class Cover:
    """Tells whether a stretch of text overlaps any of a list of spans."""

    def __init__(self, spans: list[Span]):
        at = sorted((a, b) for _, a, b in spans)
        self.start = [a for a, _ in at]
        self.reach = list(accumulate((b for _, b in at), max))  # how far the spans up to each one go

    def touches(self, a: int, b: int) -> bool:
        k = bisect_left(self.start, b)
        return k > 0 and self.reach[k - 1] > a


def token_spans(text: str, base: list[Span], encs: list, ratio: float = CHARS_PER_TOKEN) -> list[Span]:
    out = []
    cover = Cover(base)
    for m in _RUN.finditer(text):
        run = m[0]
        if cover.touches(*m.span()):
            continue
        if dense([run], encs, ratio) and not known(run, encs, ratio):
            out.append(("token", *m.span()))
    return out


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame, ranks: tuple[str, ...] = RANKS, id_col: str = "doc_id", text_col: str = "text", ratio: float = CHARS_PER_TOKEN) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, text, base>>) of every row, without a shuffle; spans by start, then kind.

    Null and empty texts hold none; repeated rows are scanned each; other columns are ignored; an empty table gives an empty one.
    """

    def make():
        encs = encodings(ranks)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for t in as_text(b.column(1)):
                base = base_spans(t)
                found.append([{"kind": k, "start": x, "end": y, "text": t[x:y], "base": k != "token"} for k, x, y in in_order(base + token_spans(t, base, encs, ratio))])
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, FOUND)], ["doc_id", "found"])

        return f

    return by_row(project(docs, id_col, text_col), FOUND_SCHEMA, make)


def digest_columns(found: DataFrame, base: tuple[str, ...] = KINDS[:3]) -> DataFrame:
    """Counts and hashes of (doc_id, found): n_<kind> per base kind, base_sha256 over the base spans, and all spans."""
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("found", lambda s: s["base"] & s["kind"].isin(*kinds))
    return found.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base), F.sha2(text(of(*base)), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))

