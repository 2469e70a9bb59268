"""Operator 5, language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives, at each position, the longest match; cross-parsing cuts a text into phrases of
longest matches, and the language whose sample needs fewest phrases, normalised by what it needs for text of its own, wins.

The sample is bounded: of each language SAMPLE_ROWS labelled texts, those with the smallest hash of their id among those with MIN_CHARS to
MAX_CHARS characters; where a language has fewer such, others too, the shortest of some with small hashes first, while they have SAMPLE_CHARS characters together (two texts
at least). Texts of the sample are used whole. Half of them make the automaton, half the normalising rate. Prediction reads every text whole.

Cross-parsing runs for all texts of a batch at once: texts are cut into lanes of LANE characters, and every step moves all lanes of all
languages by one character through one transition table, in which a missing transition leads on from the root and counts a phrase. A lane is first
parsed as if a phrase began with it; then it is parsed again from the state that the lane before ends in, beside the first parse, until both are in the same
state, from which on they agree. Phrases are thus those of the whole text, whatever LANE is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, by_row, project, ship

SAMPLE_ROWS = 24
MIN_CHARS, MAX_CHARS = 200, 3000
SAMPLE_CHARS = SAMPLE_ROWS * MAX_CHARS
LANE = 1024
#: Characters of a batch that are parsed at once.
BLOCK_CHARS = 4_000_000
#: How much better the best language must be for a score near 1.
SHARPNESS = 12.0
HOLD_OUT = 5
UNDETERMINED = "und"
_LETTER = re.compile(r"[A-Za-z]")
_OTHERS = re.compile(r"[\W\d_]+")
_MODELS: dict[tuple, "Model"] = {}


def fold(text: str) -> str:
    """Lower case; runs of anything but letters become one space."""
    return _OTHERS.sub(" ", text.lower())


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


class SuffixAutomaton:
    """Transitions of the minimal automaton of all substrings of a text."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Model:
    """Automata of all languages in one transition table: entry (state, character) is twice the next state, plus 1 where a phrase begins."""

    def __init__(self, samples: tuple[tuple[str, tuple[str, ...]], ...]):
        """samples: (language, texts) by language."""
        self.langs = [lang for lang, _ in samples]
        learn = [fold(" ".join(t for t in texts[::2])) for _, texts in samples]
        tune = [[fold(t) for t in (texts[1::2] or texts)] for _, texts in samples]
        alphabet = sorted({c for t in learn for c in t})
        #: Character code -> column; 0 is any character that no sample holds.
        self.column = np.zeros(0x110000, np.uint8 if len(alphabet) < 255 else np.uint16)
        for i, c in enumerate(alphabet):
            self.column[ord(c)] = i + 1
        self.width = len(alphabet) + 1
        machines = [SuffixAutomaton(t) for t in learn]
        self.root = np.cumsum([0, *(len(m.next) for m in machines)])[:-1].astype(np.int32)
        tables = []
        for m, root in zip(machines, self.root):
            t = np.full((len(m.next), self.width), -1, np.int64)
            for s, edges in enumerate(m.next):
                for c, to in edges.items():
                    t[s, self.column[ord(c)]] = to
            begin = np.where(t[0] >= 0, t[0], 0)
            t = np.where(t >= 0, (t + root) * 2, (begin + root)[None, :] * 2 + 1)
            t[0] |= 1  # what leaves the root begins a phrase, also after a character that the sample doesn't hold
            tables.append(t)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.empty(0, np.int32)
        self.rate = np.ones(len(self.langs))
        if tables:
            for i, texts in enumerate(tune):
                n = self.phrases(texts)[:, i].sum()
                self.rate[i] = max(n, 1) / max(1, sum(map(len, texts)))

    @classmethod
    def load(cls, samples: tuple) -> "Model":
        if samples not in _MODELS:
            _MODELS.clear()
            _MODELS[samples] = cls(samples)
        return _MODELS[samples]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases (text x language) of folded texts."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b]) <= BLOCK_CHARS):
                n += len(texts[b])
                b += 1
            self._parse(texts[a:b], out[a:b])
            a = b
        return out

    def _parse(self, texts: list[str], out: np.ndarray) -> None:
        codes = self.column[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        lanes = -(-size // LANE)
        of = np.repeat(np.arange(len(texts)), lanes)
        k = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = begin[of] + k * LANE
        length = np.minimum(size[of] - k * LANE, LANE)
        n, langs = len(of), len(self.langs)
        if not n:
            return
        order = np.argsort(-length, kind="stable")
        at, left = start[order], length[order]
        state = np.repeat(self.root[:, None], n, axis=1)  # language x lane
        count = np.zeros((langs, n), np.int32)
        alive = np.searchsorted(-left, -np.arange(LANE), side="left")  # lanes longer than each step
        for step in range(int(left[0])):
            m = alive[step]
            x = self.table.take(state[:, :m] * self.width + codes[at[:m] + step])
            count[:, :m] += x & 1
            state[:, :m] = x >> 1
        total, end = np.empty_like(count), np.empty_like(state)
        total[:, order], end[:, order] = count, state
        self._join(codes, start, length, k > 0, total, end)
        for i in range(langs):
            out[:, i] = np.bincount(of, total[i], len(texts)).astype(np.int64)

    def _join(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, goes_on: np.ndarray, total: np.ndarray, end: np.ndarray) -> None:
        """Put right total and end (language x lane) of the lanes that go on with the text of the lane before."""
        later = np.flatnonzero(goes_on)
        begin = np.repeat(self.root[:, None], len(start), axis=1)  # the state that each lane was parsed from
        while True:
            i, j = np.nonzero(begin[:, later] != end[:, later - 1])
            if not len(i):
                return
            lane = later[j]
            old, new = begin[i, lane], end[i, lane - 1]
            begin[i, lane] = new
            extra = np.zeros(len(i), np.int32)
            run = np.arange(len(i))  # those that still differ
            step = 0
            while len(run):
                c = codes[start[lane[run]] + step]
                x, y = self.table.take(old[run] * self.width + c), self.table.take(new[run] * self.width + c)
                extra[run] += (y & 1) - (x & 1)
                old[run], new[run] = x >> 1, y >> 1
                step += 1
                differ = x >> 1 != y >> 1
                over = differ & (length[lane[run]] == step)
                end[i[run[over]], lane[run[over]]] = new[run[over]]
                run = run[differ & ~over]
            np.add.at(total, (i, lane), extra)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        plain = [fold(t) if t else "" for t in texts]
        known = [bool(self.langs) and has_letter(t) for t in plain]
        per = self.phrases(plain) / self.rate / np.maximum(1, np.array([len(t) for t in plain], np.int64))[:, None] if self.langs else np.zeros((len(plain), 1))
        best = per.argmin(1)  # of equal ones the first language by name
        weight = np.exp(-SHARPNESS * (per - per.min(1, keepdims=True)))
        score = 1 / weight.sum(1)
        return [self.langs[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), known)], [s if ok else 0.0 for s, ok in zip(score.tolist(), known)]


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string")) % HOLD_OUT) == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple:
    """The bounded sample: ((lang, (text, ...)), ...), from rows that are not held out and have a label. Of rows that repeat an id one counts."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    d = d.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.length(F.trim("text")) > 0))
    fit = F.length("text").between(MIN_CHARS, MAX_CHARS)
    counts = {r.lang: (r.fit, r.n) for r in d.groupBy("lang").agg(F.count(F.when(fit, 1)).alias("fit"), F.count(F.lit(1)).alias("n")).collect()}
    got: dict[str, list[tuple[bool, int, int, str]]] = {}
    times = 4
    while counts:
        # a few times as many as are used, by a share of all hashes: texts of fitting length, and where those don't do others
        share = {lang: (min(1.0, times * rows / max(1, n)), min(1.0, times * rows / (m - n)) if n < rows and m > n else 0.0) for lang, (n, m) in counts.items()}
        few = d.sparkSession.createDataFrame([(lang, *x) for lang, x in share.items()], "lang string, fitting double, others double")
        near = (F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5) <= F.when(fit, F.col("fitting")).otherwise(F.col("others"))
        some = d.join(F.broadcast(few), "lang").filter(near).groupBy("lang", "doc_id").agg(F.min("text").alias("text"), F.min(F.xxhash64("doc_id")).alias("h"))
        got = {}
        for r in some.collect():
            got.setdefault(r.lang, []).append((not MIN_CHARS <= len(r.text) <= MAX_CHARS, len(r.text), r.h, r.text))
        if all(len(got.get(lang, [])) >= min(rows, n) or min(a or 1, b or 1) >= 1 for lang, (a, b) in share.items() for n in [counts[lang][1]]):
            break
        times *= 8
    return tuple((lang, _whole(got[lang], rows, chars)) for lang in sorted(got))


def _whole(texts: list[tuple[bool, int, int, str]], rows: int, chars: int) -> tuple[str, ...]:
    """The first few texts while they have so many characters together: such of fitting length by hash, then others by length."""
    out: list[str] = []
    for odd, size, _, t in sorted(texts, key=lambda x: (x[0], x[1] if x[0] else 0, x[2], x[3])):
        if len(out) < rows and (len(out) < 2 or sum(map(len, out)) + size <= chars):
            out.append(t)
    return tuple(out)


def identify(docs: DataFrame, samples: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, without a shuffle.

    A null text, or one without letters, is 'und' with score 0, as is every text if no labelled sample exists. score: the share of the
    best language if each weighs exp(-SHARPNESS x normalised phrases). Ties go to the first language by name. Repeated rows are predicted
    each; a null id is not held out; other columns are ignored; an empty table gives an empty one.
    """
    src = project(docs, id_col, text_col)

    def make():
        model = Model.load(samples)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, lang, score = as_text(b.column(1)), [], []
            for a in range(0, len(texts), 2048):
                x, y = model.predict(texts[a : a + 2048])
                lang += x
                score += y
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

        return f

    out = by_row(src, "doc_id long, lang_pred string, score double", make)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def language_id(docs: DataFrame) -> DataFrame:
    """identify() with what learn() gives of the same table: nulls, empty texts, ties, repeated rows and empty tables as there. A table without labelled texts
    that aren't held out makes every text 'und'."""
    ship(docs.sparkSession)
    return identify(docs, learn(docs))
