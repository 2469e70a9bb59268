"""Operator 10, personal data: base patterns, and a semi-Markov conditional random field over candidate segments.

The base patterns are matched over whole texts, in time proportional to their length. The model looks at windows around digits and at-signs: a window's tokens are cut into
segments, each an entity of up to MAX_TOKENS tokens, MAX_DIGITS digits and MAX_CHARS characters or a single token outside. A segment's score comes from features of the whole span (its shape, digit
groups, checksum, context) per type; a dynamic programme over segment ends picks boundaries and types jointly. Spans that the patterns miss, such
as telephone numbers without a country code or spelled-out addresses, are added; base spans always stay, and a model span that touches one is dropped.

It is trained on the driver by maximum likelihood (semi-Markov forward-backward, stochastic gradient) from a bounded sample: windows of the SAMPLE_TEXTS texts with
the smallest hash of their id among those with a digit group or at-sign, of SAMPLE_CHARS characters at most where there are enough such. Gold segments are the base
spans of the window and of altered copies of it: forms that people write but the patterns miss (labelled with their type), and look-alikes that fail a check
(labelled outside). Every window that holds a span is trained on, with COPIES altered copies of each of its spans; of the windows without a span at most EMPTY_WINDOWS
of a text, drawn at random.

Spans are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, by_row, hash_below, project, ship
from .secret_scan import FOUND, FOUND_SCHEMA, Cover

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 20
#: Digits of an entity, at least (but for addresses of four numbers) and at most, and characters at most.
MIN_DIGITS, MAX_DIGITS, MAX_CHARS = 7, 25, 320
#: Characters around a digit or at-sign that a window holds.
REACH = 48
SAMPLE_TEXTS = 300
SAMPLE_CHARS = 20_000
#: Altered copies of a span, forms in turn.
COPIES = 3
#: Windows without a span that a text gives at most.
EMPTY_WINDOWS = 20
EPOCHS = 5
RATE = 0.02
RIDGE = 1e-4

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"[0-9]+|@|[\[(]\x20?at\x20?[\])]", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]|_")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """A match is an at-sign with a domain after it and all the pattern's characters before it, back to the last match or at-sign; without a domain
    none of these characters can begin one."""
    out, low = [], 0
    p = text.find("@")
    while p >= 0:
        m = _DOMAIN.match(text, p + 1)
        if m:
            a, reach = p, 64
            while a > low:
                from_ = max(low, p - reach)
                a = from_ + len(text[from_:p].rstrip(_LOCAL))
                if a > from_:
                    break
                reach *= 2
            if a < p:
                out.append(("email", a, m.end()))
                low = m.end()
        low = max(low, p + 1)
        p = text.find("@", low)
    return out


def _addresses(text: str) -> list[Span]:
    """Four numbers at a time of each run of numbers with dots between them."""
    out = []
    for m in _DOTTED.finditer(text):
        part = m[0].split(".")
        a = m.start()
        for k in range(0, len(part) - 3, 4):
            four = part[k : k + 4]
            b = a + sum(map(len, four)) + 3
            if all(_at_most_255(p) for p in four):
                out.append(("ip", a, b))
            a = b + 1
    return out


def _at_most_255(number: str) -> bool:
    return int(number.lstrip("0")[:4] or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The patterns' matches, leftmost and non-overlapping per kind; failing matches are dropped, not tried again."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += _addresses(text)
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


class Window:
    """Tokens of a piece of text (from begin on) and its candidate segments."""

    def __init__(self, text: str, begin: int, end: int):
        self.text, self.begin = text, begin
        self.tokens = [m.span() for m in _TOKEN.finditer(text, begin, end)]
        self.word = [text[a:b] for a, b in self.tokens]
        self._cut()

    def _cut(self) -> None:
        """Candidates by end token: (first token, features). A candidate is a run of digit groups with joining marks, or surrounds one at-sign."""
        n, w, at = len(self.word), self.word, self.tokens
        digit = [x[0].isdigit() and x.isascii() for x in w]
        self.ends: list[list[tuple[int, tuple[str, ...]]]] = [[] for _ in range(n)]
        for i in range(n):
            if digit[i] or w[i] in "+(":
                digits = 0
                for j in range(i, min(n, i + MAX_TOKENS)):
                    if not digit[j] and w[j] not in "+-.() /" or j > i and at[j][0] - at[j - 1][1] > 1:
                        break
                    if digit[j]:
                        digits += len(w[j])
                        if digits > MAX_DIGITS:
                            break
                        if digits >= MIN_DIGITS or j == i + 6 and digit[i] and w[i + 1] == w[i + 3] == w[i + 5] == ".":
                            self.ends[j].append((i, self._number(i, j, digits)))
        for m in range(n):
            if w[m] == "@" or w[m].lower() == "at" and 0 < m < n - 1 and w[m - 1] in "[(" and w[m + 1] in "])":
                for i in range(m - 1, max(-1, m - MAX_TOKENS // 2), -1):
                    x = w[i]
                    if i < m - 2 and at[i + 1][0] - at[i][1] > 0 or not (x.isalnum() or x in "._%+-[(") or x == "\n":
                        break
                    if x.isalnum():
                        for j in range(m + 1, min(n, i + MAX_TOKENS)):
                            y = w[j]
                            if not (y.isalnum() or y in ".-])[(") or at[j][0] - at[j - 1][1] > (1 if y in "[(" or w[j - 1] in "])" or j == m + 1 else 0) or at[j][1] - at[i][0] > MAX_CHARS:
                                break
                            if y.isalnum() and j > m + 1:
                                self.ends[j].append((i, self._address(i, j)))

    def _around(self, i: int, j: int) -> tuple[str, str, str]:
        a, b = self.tokens[i][0], self.tokens[j][1]
        near = self.word[i - 1].lower() if i else ""
        return _edge(self.text[a - 1 : a] if a else ""), _edge(self.text[b : b + 1]), near if near.isalpha() and len(near) < 8 else ""

    def _number(self, i: int, j: int, digits: int) -> tuple[str, ...]:
        """Features of a span without letters; all but the checks are those of its shape."""
        s = self.text[self.tokens[i][0] : self.tokens[j][1]]
        checks = (f"l={14 <= digits <= 19 and luhn(_digits(s))}", f"i={j == i + 6 and s.count('.') == 3 and all(x.isdigit() and _at_most_255(x) for x in s.split('.'))}")
        return checks + _shape(s.translate(_NINES), digits, *self._around(i, j))

    def _address(self, i: int, j: int) -> tuple[str, ...]:
        """Features of a span with letters."""
        s = self.text[self.tokens[i][0] : self.tokens[j][1]]
        before, after, near = self._around(i, j)
        coarse = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", s))[:40]
        low = s.lower()
        return (f"c={coarse}", "g=text", "n=text", "l=False", "i=False", f"@={'@' in s or 'at' in low},{bool(re.search(r'[a-z]{2,6}$', s))},{'.' in s or 'dot' in low}", f"+={s[0] == '+'},{'(' in s},{s.count('(') == s.count(')')}", f"e={before},{after}", f"w={near}")

    def outside(self, j: int) -> str:
        x = self.word[j]
        return "o=9" if x[0].isdigit() else f"o={x}" if x in "@+()" else "o=."


_NINES = str.maketrans("012345678", "999999999")


@lru_cache(65_536)
def _shape(s: str, digits: int, before: str, after: str, near: str) -> tuple[str, ...]:
    """Of a span with all its digits made 9."""
    groups = ".".join(str(len(x)) for x in re.findall("9+", s)[:6])
    return (f"c={re.sub('9+', '9', s)[:40]}", f"g={groups}", f"n={min(digits, 20)}", "@=False,False," + str("." in s), f"+={s[0] == '+'},{'(' in s},{s.count('(') == s.count(')')}", f"e={before},{after}", f"w={near}")


def _edge(c: str) -> str:
    return "0" if not c or c.isspace() else "a" if c.isalnum() else c if c in "+-.@/" else "."


def windows(text: str) -> list[Window]:
    """Around digits and at-signs; neighbouring ones share a window, whatever its length."""
    out: list[list[int]] = []
    for m in _AT.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [Window(text, a, b) for a, b in out]


class Field:
    """The semi-Markov field: a weight per (type, span feature) and per outside feature."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = {} if weights is None else weights
        self._known: dict[tuple[str, ...], list[float]] = {}

    def _scores(self, win: Window) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        """Outside scores by token, and entity scores by end token: (first token, type, score)."""
        get = self.w.get
        out = [get(win.outside(j), 0.0) for j in range(len(win.word))]
        ent = [[(i, k, sum(get(f"{kind}|{f}", 0.0) for f in feats)) for i, feats in c for k, kind in enumerate(KINDS)] for c in win.ends]
        return out, ent

    def decode(self, win: Window) -> list[Span]:
        n = len(win.word)
        if not any(win.ends):
            return []
        get, known = self.w.get, self._known
        out = [get(win.outside(j), 0.0) for j in range(n)]
        if len(known) > 100_000:
            known.clear()
        best, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
        for j in range(n):
            top, at = best[j] + out[j], (j, -1)
            for i, feats in win.ends[j]:
                scores = known.get(feats)
                if scores is None:
                    scores = known[feats] = [sum(get(f"{kind}|{f}", 0.0) for f in feats) for kind in KINDS]
                for k, s in enumerate(scores):
                    if best[i] + s > top:
                        top, at = best[i] + s, (i, k)
            best[j + 1], back[j + 1] = top, at
        spans, j = [], n
        while j:
            i, k = back[j]
            if k >= 0:
                spans.append((KINDS[k], win.tokens[i][0], win.tokens[j - 1][1]))
            j = i
        return spans[::-1]

    def gradient(self, win: Window, gold: dict[tuple[int, int], int]) -> dict[str, float]:
        """Of the log likelihood: features of the gold segmentation less those expected. gold: (first token, last token) -> type."""
        n = len(win.word)
        out, ent = self._scores(win)
        fore, rear = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for j in range(n):
            fore[j + 1] = _lse([fore[j] + out[j], *(fore[i] + s for i, _, s in ent[j])])
        for j in range(n - 1, -1, -1):
            rear[j] = _lse([rear[j], rear[j + 1] + out[j]])
            for i, _, s in ent[j]:
                rear[i] = _lse([rear[i], rear[j + 1] + s])
        z = fore[n]
        g: dict[str, float] = {}
        inside = {t for (i, j) in gold for t in range(i, j + 1)}
        for j in range(n):
            p = (j not in inside) - math.exp(min(0.0, fore[j] + out[j] + rear[j + 1] - z))
            if p:
                g[win.outside(j)] = g.get(win.outside(j), 0.0) + p
            at = 0
            for i, feats in win.ends[j]:
                for k, kind in enumerate(KINDS):
                    s = ent[j][at][2]
                    at += 1
                    p = (gold.get((i, j)) == k) - math.exp(min(0.0, fore[i] + s + rear[j + 1] - z))
                    if abs(p) > 1e-6:
                        for f in feats:
                            g[f"{kind}|{f}"] = g.get(f"{kind}|{f}", 0.0) + p
        return g


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m if m == -math.inf else m + math.log(sum(math.exp(x - m) for x in xs))


def _gold(win: Window, spans: list[Span]) -> dict[tuple[int, int], int]:
    """Spans as token segments, longest first where they overlap; such as aren't candidates are left out."""
    first = {a: i for i, (a, _) in enumerate(win.tokens)}
    last = {b: j for j, (_, b) in enumerate(win.tokens)}
    out: dict[tuple[int, int], int] = {}
    used: set[int] = set()
    for kind, a, b in sorted(spans, key=lambda s: (s[1] - s[2], KINDS.index(s[0]))):
        i, j = first.get(a), last.get(b)
        if i is None or j is None or not used.isdisjoint(range(i, j + 1)) or all(x != i for x, _ in win.ends[j]):
            continue
        out[i, j] = KINDS.index(kind)
        used.update(range(i, j + 1))
    return out


def _within(win: Window, spans: list[Span]) -> list[Span]:
    """Those of the spans, which are in order, that lie in the window."""
    lo, hi = win.begin, win.tokens[-1][1] if win.tokens else win.begin
    first, last = (bisect.bisect_left(spans, x, key=lambda s: s[1]) for x in (lo, hi + 1))
    return [s for s in spans[first:last] if s[2] <= hi]


def forms(kind: str, s: str, rng: random.Random) -> list[tuple[str, str | None]]:
    """Other ways of writing a span, and look-alikes (type None)."""
    d = _digits(s)
    if kind == "email":
        name, host = s.split("@", 1)
        return [(f"{name} [at] {host.replace('.', ' [dot] ')}", kind), (f"{name} (at) {host}", kind), (f"{name} @ {host}", kind), (f"{name}@{host.replace('.', '')}", None)]
    if kind == "phone":
        local = d[-10:]
        return [(f"({local[:3]}) {local[3:6]}-{local[6:]}", kind), (f"{local[:3]}-{local[3:6]}-{local[6:]}", kind), (f"{local[:3]}.{local[3:6]}.{local[6:]}", kind), (d[: rng.randint(3, 9)], None), (f"{d[:4]}-{d[4:6]}-{d[6:8]}", None)]
    if kind == "card":
        off = d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10)
        return [(".".join(d[k : k + 4] for k in range(0, len(d), 4)), kind), (off, None), (" ".join(off[k : k + 4] for k in range(0, len(off), 4)), None), (d[: rng.randint(5, 12)], None)]
    part = s.split(".")
    return [(".".join(part[:3]), None), (".".join([*part[:3], str(rng.randint(256, 999))]), None), (".".join([*part, part[0]]), None)]


def training_data(texts: list[str], rng: random.Random, empty: int = EMPTY_WINDOWS, copies: int = COPIES) -> list[tuple[Window, dict[tuple[int, int], int]]]:
    """Windows with their gold segments: all that hold a span, altered copies of each span, and up to empty ones without a span per text."""
    data: list[tuple[Window, dict]] = []
    turn: Counter[str] = Counter()
    pick = random.Random(8)
    for t in texts:
        base = base_spans(t)
        held = [(win, _within(win, base)) for win in windows(t)]
        none = [k for k, (_, here) in enumerate(held) if not here]
        left_out = set(none) - set(pick.sample(none, empty)) if len(none) > empty else set()
        for k, (win, here) in enumerate(held):
            if k in left_out:
                continue
            data.append((win, _gold(win, here)))
            for kind, a, b in here:
                every = forms(kind, t[a:b], rng)
                for _ in range(min(copies, len(every))):
                    new, label = every[turn[kind] % len(every)]
                    turn[kind] += 1
                    data.append(_copy(t, kind, a, b, new, label))
    rng.shuffle(data)
    return data


def _copy(t: str, kind: str, a: int, b: int, new: str, label: str | None) -> tuple[Window, dict[tuple[int, int], int]]:
    """What surrounds the span from a to b, with new in its place."""
    piece = t[max(0, a - REACH) : a] + new + t[b : b + REACH]
    at = min(a, REACH)
    spans = [(label, at, at + len(new))] if label else []
    for k, x, y in base_spans(piece):
        if label is None and x < at + len(new) and at < y and (k != kind or (x, y) != (at, at + len(new))) or y <= at or x >= at + len(new):
            spans.append((k, x, y))
    alt = Window(piece, 0, len(piece))
    return alt, _gold(alt, spans)


def train(texts: list[str], epochs: int = EPOCHS, empty: int = EMPTY_WINDOWS) -> dict[str, float]:
    """Weights from texts; deterministic. Without any spans there is nothing to learn and nothing will be found."""
    data = training_data(texts, random.Random(7), empty)
    if not any(g for _, g in data):
        return {}
    data = [x for x in data if any(x[0].ends)]  # without candidates there is one segmentation, and nothing to learn
    w: dict[str, float] = {}
    field = Field(w)
    for epoch in range(epochs):
        rate = RATE / (1 + epoch / 2)
        for win, gold in data:
            for f, x in field.gradient(win, gold).items():
                w[f] = w.get(f, 0.0) + rate * (x - RIDGE * w.get(f, 0.0))
    return {f: round(x, 6) for f, x in sorted(w.items()) if abs(x) > 1e-4}


def model_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Segments that the model finds and that touch no base span."""
    if not field.w:
        return []
    cover = Cover(base)
    return [s for win in windows(text) for s in field.decode(win) if not cover.touches(s[1], s[2])]


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: int = SAMPLE_TEXTS) -> list[str]:
    """Texts with a digit group or at-sign, by the hash of their id, those of more than SAMPLE_CHARS characters last and the shortest first.

    Only the texts in the lowest share of all hashes are looked at, so that few go to the driver; the share grows until it gives enough.
    """
    d = project(docs, id_col, text_col)
    share = min(1.0, 16 * texts / max(1, d.count()))
    while True:
        some = d.filter(hash_below("doc_id", share)).filter(F.col("text").rlike("@|[0-9]{3}"))
        got = some.orderBy(F.greatest(F.length("text"), F.lit(SAMPLE_CHARS)), F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(texts).select("text").collect()
        if share >= 1 or len(got) >= texts:
            return [r[0] for r in got]
        share = min(1.0, share * max(2.0, 1.5 * texts / max(1, len(got))))


def personal_data(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", empty: int = EMPTY_WINDOWS) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, text, base>>) of every row, without a shuffle; spans by start, then kind.

    weights: of a trained field; without them one is trained on a sample of docs, with up to empty windows of a text that hold no span. Null and empty texts hold none; repeated rows are scanned each;
    other columns are ignored; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    trained = train(sample(docs, id_col, text_col), empty=empty) if weights is None else weights

    def make():
        field = Field(trained)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for t in as_text(b.column(1)):
                base = base_spans(t)
                spans = in_order(base + model_spans(t, base, field)) if base or _AT.search(t) else []
                own = set(base)
                found.append([{"kind": k, "start": x, "end": y, "text": t[x:y], "base": (k, x, y) in own} for k, x, y in spans])
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, FOUND)], ["doc_id", "found"])

        return f

    return by_row(project(docs, id_col, text_col), FOUND_SCHEMA, make)
