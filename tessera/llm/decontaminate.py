"""Operator 4, benchmark decontamination: a BM25 inverted index of the test items, queried with every training passage by block-max WAND.

Test items are the indexed documents, passages of the corpus are the queries. A passage is two neighbouring blocks of BLOCK words, so every
run of up to BLOCK words lies whole in one. An item's score is divided by the score that it would have if the passage held all of it, so one
threshold serves items of any length. All items at or above RETRIEVE are retrieved: none is cut off by a top-k.

The search is exact and goes in three steps, each of which only leaves out what can't reach the threshold:
 1. Block bounds: the items form GROUPS runs of neighbours, and a block's bound for a run is the sum, over its distinct words, of the largest
    impact that the word has in any item of the run. A passage whose two bounds together stay below the threshold for every run is left out.
    All blocks of a batch are bounded at once.
 2. WAND over the rest: postings lists ordered by item, with the largest impact of each run of POSTINGS postings. Cursors move to the pivot;
    a pivot whose block maxima stay below the threshold is jumped over.
 3. Retrieved items are verified on the text around the passage: the question part and the answer part of the item (columns, or the first
    two thirds and the rest of the words) must each have VERIFY of their 3-word sequences there. One changed word takes up to three of those,
    so a part of two to SHORT - 1 words is also held if it stands there with one word changed, missing or added.

The index goes to every task, in pieces of at most ITEM_ROWS items and ITEM_CHARS characters. Up to PIECES pieces are broadcast together and searched in one pass over
the corpus; a benchmark beyond that, of some 30,000 items, takes a pass per so many. The driver holds one such group of pieces at a time. Nothing is shuffled.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, by_row, project, ship

BLOCK = 64
RETRIEVE = 0.5
VERIFY = 0.5
SHINGLE = 3
#: From so many words on a part with one changed word keeps half of its sequences.
SHORT = 8
K1, B = 1.2, 0.75
POSTINGS = 32
GROUPS = 256
#: Blocks are bounded for so many pairs of block and word at a time, which bounds the memory that long texts take.
PAIRS = 32_768
ITEM_ROWS = 2_000
ITEM_CHARS = 400_000
PIECES = 16
_WORD = re.compile(r"\w+")
_INDEXES: dict[tuple, list["Index"]] = {}
Item = tuple[int | None, str, str]  # id, question, answer
Pieces = tuple[tuple[Item, ...], ...]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _shingles(w: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(w))
    return set(zip(*(w[k:] for k in range(n)))) if n else set()


class Part:
    """The question or the answer of an item."""

    def __init__(self, w: list[str]):
        self.shingles = _shingles(w)
        self.short = w if 2 <= len(w) < SHORT else []

    def share(self, near: list[str], here: dict[int, set]) -> float:
        """Share of the part that is there, in words near and their sequences."""
        share = _share(self.shingles, here)
        return max(share, _in_order(self.short, near)) if self.short and share < VERIFY else share


def _in_order(part: list[str], near: list[str]) -> float:
    """Share of a part's words that stand in order in neighbouring words, if one at most is changed, missing or added; else 0."""
    n, known, best = len(part), set(part), 0
    for k in range(len(near)):
        if near[k] in known or k + 1 < len(near) and near[k + 1] in known:
            row = [0] * (n + 1)  # longest common subsequence with the part's first words
            for i, x in enumerate(near[k : k + n + 1]):
                old = row[:]
                for j in range(n):
                    row[j + 1] = old[j] + 1 if part[j] == x else max(old[j + 1], row[j])
                if i < n or row[n] == n:
                    best = max(best, row[n])
    return best / n if best >= n - 1 else 0.0


@dataclass
class Verified:
    item: int
    score: float
    question: float
    answer: float


class Index:
    """Postings of test items. Items of more than BLOCK words are indexed in overlapping segments and verified whole."""

    def __init__(self, items: tuple[Item, ...]):
        self.items = items
        self.parts: list[tuple[Part, Part]] = []
        self.length: list[int] = []
        entries: list[tuple[int, Counter]] = []  # item's place, words
        for i, (_, q, a) in enumerate(items):
            qw, aw = words(q), words(a)
            self.parts.append((Part(qw), Part(aw)))
            w = qw + aw
            self.length.append(len(w))
            for k in range(0, max(1, len(w) - BLOCK // 2), BLOCK // 2) if len(w) > BLOCK else [0]:
                if w:
                    entries.append((i, Counter(w[k : k + BLOCK])))
        self.owner = [i for i, _ in entries]
        n = len(entries)
        df = Counter(t for _, c in entries for t in c)
        mean = sum(sum(c.values()) for _, c in entries) / max(1, n)
        self.term: dict[str, int] = {t: k for k, t in enumerate(sorted(df))}
        self.docs: list[list[int]] = [[] for _ in self.term]
        self.impact: list[list[float]] = [[] for _ in self.term]
        for e, (_, c) in enumerate(entries):
            size = sum(c.values())
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in c.items()}
            whole = sum(raw.values())
            for t, x in raw.items():
                k = self.term[t]
                self.docs[k].append(e)
                self.impact[k].append(x / whole)
        self.top = np.array([max(x) for x in self.impact] or [0.0])
        #: Largest impact of each term in each run of entries.
        self.run_max = np.zeros((max(1, len(self.term)), max(1, min(GROUPS, n))), np.float32)
        for k, (d, x) in enumerate(zip(self.docs, self.impact)):
            np.maximum.at(self.run_max[k], np.array(d) * self.run_max.shape[1] // max(1, n), np.array(x) + 1e-6)
        self.block_max = [[max(x[a : a + POSTINGS]) for a in range(0, len(x), POSTINGS)] for x in self.impact]

    @classmethod
    def load(cls, pieces: Pieces) -> list["Index"]:
        """The indexes of a group of pieces; a worker keeps those of the group it used last."""
        key = tuple((len(p), hash(p)) for p in pieces)
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = [cls(p) for p in pieces]
        return _INDEXES[key]

    def wand(self, terms: list[int], threshold: float = RETRIEVE) -> list[tuple[int, float]]:
        """(entry, score) of all entries that score threshold or more for a passage of distinct terms."""
        end = 1 << 60
        lists = [[self.docs[t][0], t, 0] for t in terms]  # current entry, term, position
        out = []
        slack = threshold - 1e-9
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(lists):
                bound += self.top[t]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            e = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == e:
                pivot += 1
            # block maxima of the lists up to the pivot, at the blocks in which e lies
            bound, until = 0.0, end
            for cur in lists[: pivot + 1]:
                d = self.docs[cur[1]]
                p = bisect.bisect_left(d, e, cur[2])
                if p < len(d):
                    b = p // POSTINGS
                    bound += self.block_max[cur[1]][b]
                    until = min(until, d[min(len(d), (b + 1) * POSTINGS) - 1] + 1)
            if pivot + 1 < len(lists):
                until = min(until, lists[pivot + 1][0])
            if bound < slack:
                to = max(until, e + 1)
            else:
                score, to = 0.0, e + 1
                for cur in lists[: pivot + 1]:
                    d = self.docs[cur[1]]
                    p = bisect.bisect_left(d, e, cur[2])
                    if p < len(d) and d[p] == e:
                        score += self.impact[cur[1]][p]
                if score >= slack:
                    out.append((e, score))
            alive = []
            for cur in lists[: pivot + 1]:
                d = self.docs[cur[1]]
                p = bisect.bisect_left(d, to, cur[2])
                if p < len(d):
                    cur[0], cur[2] = d[p], p
                    alive.append(cur)
            lists = alive + lists[pivot + 1 :]
        return out

    def passages(self, terms: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, first word, distinct terms) of the passages whose block bounds reach the threshold. terms: those of all texts in a row, -1 where
        unknown; begin: where each text begins, and the end."""
        size = np.diff(begin)
        blocks = -(-size // BLOCK)
        first = np.cumsum(blocks) - blocks
        known = np.flatnonzero(terms >= 0)
        if not len(known):
            return
        text = np.searchsorted(begin, known, side="right") - 1
        block = first[text] + (known - begin[text]) // BLOCK
        pair = np.unique(block * len(self.top) + terms[known])
        block, term = pair // len(self.top), pair % len(self.top)
        # a passage is a block and the next one of the same text
        of = np.repeat(np.arange(len(size)), blocks)
        edge = np.searchsorted(block, np.arange(len(of) + 2))
        ahead = np.append(of[1:] == of[:-1], False)
        a = 0
        while a < len(of):  # blocks a to b, and one more for the passages that begin at the last
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + PAIRS)) - 1)
            b = min(b, len(of))
            top = min(b + 1, len(of))
            rows = self.run_max.take(term[edge[a] : edge[top]], axis=0)
            filled = np.flatnonzero(edge[a + 1 : top + 1] > edge[a:top])
            bound = np.zeros((top - a, self.run_max.shape[1]), np.float32)
            if len(filled):
                bound[filled] = np.add.reduceat(rows, edge[a + filled] - edge[a], axis=0)
            both = bound[: b - a].copy()
            both[: top - a - 1] += bound[1:] * ahead[a : top - 1, None]
            for k in (a + np.flatnonzero(both.max(axis=1) >= RETRIEVE - 1e-6)).tolist():
                last = k + 2 if ahead[k] else k + 1
                yield int(of[k]), int(k - first[of[k]]) * BLOCK, np.unique(term[edge[k] : edge[last]])
            a = b

    def search(self, texts: list[str]) -> list[list[Verified]]:
        """Of each text the items that it holds, each with its best score."""
        got: list[dict[int, Verified]] = [{} for _ in texts]
        if not self.term:
            return [[] for _ in texts]
        find, split, flat, begin = self.term.get, [], [], [0]
        for t in texts:
            w = words(t)
            split.append(w)
            flat.extend([find(x, -1) for x in w])
            begin.append(len(flat))
        for i, at, distinct in self.passages(np.array(flat, np.int64), np.array(begin, np.int64)):
            for e, score in self.wand(distinct.tolist()):
                o = self.owner[e]
                old = got[i].get(o)
                if old is None or score > old.score:
                    reach = max(BLOCK, self.length[o])
                    near = split[i][max(0, at - reach) : at + 2 * BLOCK + reach]
                    here = _shingles_near(near)
                    q, a = (p.share(near, here) for p in self.parts[o])
                    if q >= VERIFY and a >= VERIFY:
                        got[i][o] = Verified(o, score, q, a)
        return [[x[o] for o in sorted(x)] for x in got]


def _shingles_near(w: list[str]) -> dict[int, set]:
    return {n: set(zip(*(w[k:] for k in range(n)))) for n in range(1, SHINGLE + 1)}


def _share(part: set, here: dict[int, set]) -> float:
    """Share of a part's word sequences that are there; an empty part asks for nothing."""
    if not part:
        return 1.0
    there = here[len(next(iter(part)))]
    return sum(x in there for x in part) / len(part)


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", question_col: str | None = None, answer_col: str | None = None) -> Iterator[tuple[Item, ...]]:
    """Pieces of the benchmark, each bounded in rows and characters. Rows without words are left out, such without an id aren't."""
    if question_col and answer_col:
        cols = [F.col(question_col), F.col(answer_col)]
    else:
        cols = [F.col(text_col), F.lit(None).cast("string")]
    piece: list[Item] = []
    chars = 0
    for i, q, a in benchmark.select(F.col(id_col).cast("long"), *cols).orderBy(id_col, cols[0]).toLocalIterator():
        if a is None:
            w = words(q or "")
            k = -(-2 * len(w) // 3)
            q, a = " ".join(w[:k]), " ".join(w[k:])
        if not words((q or "") + " " + a):
            continue
        piece.append((i, q or "", a))
        chars += len(q or "") + len(a)
        if len(piece) >= ITEM_ROWS or chars >= ITEM_CHARS:
            yield tuple(piece)
            piece, chars = [], 0
    if piece:
        yield tuple(piece)


def grouped(pieces: Iterator[tuple[Item, ...]]) -> Iterator[Pieces]:
    """As many pieces at a time as are searched together."""
    while group := tuple(islice(pieces, PIECES)):
        yield group


def search(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row per document and item of the pieces that it holds. Null and empty texts hold none, nor does an
    empty group of pieces give any; a repeated document repeats its rows; other columns are ignored."""
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)

    def make():
        indexes = Index.load(shipped.value)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            texts, ids = as_text(b.column(1)), b.column(0).to_pylist()
            for a in range(0, len(texts), 512):
                for index in indexes:
                    for d, hits in zip(ids[a : a + 512], index.search(texts[a : a + 512])):
                        rows += [(d, index.items[h.item][0], h.score, h.question, h.answer) for h in hits]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return f

    return by_row(project(docs, id_col, text_col), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double", make)


def contamination(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row per document and test item that it holds, with its best score.

    Documents that hold none have no row. Null and empty texts hold none; a repeated document repeats its rows; items with equal texts are
    each reported, and one without an id with a null item_id; other columns are ignored; an empty table on either side gives an empty result.
    """
    ship(docs.sparkSession)
    parts = [search(docs, p) for p in grouped(items_of(benchmark, **columns))] or [search(docs, ())]
    return reduce(DataFrame.unionByName, parts)


def is_contaminated(spark: SparkSession, pieces: Pieces):
    """A column function: text -> boolean, for filters. A text counts as soon as one piece has an item that it holds."""
    shipped = spark.sparkContext.broadcast(pieces)

    @F.arrow_udf("boolean")
    def f(text: pa.Array) -> pa.Array:
        indexes, out = Index.load(shipped.value), []
        for a in range(0, len(text), 512):
            texts = as_text(text[a : a + 512])
            held = [False] * len(texts)
            for index in indexes:
                held = [x or bool(h) for x, h in zip(held, index.search(texts))]
            out += held
        return pa.array(out, pa.bool_())

    return f
