"""Piece vocabularies: segmentation of marked words by an Aho-Corasick machine and dynamic programming, count only (operator 1) and with ids (operator 7).

The vocabulary is a SentencePiece file, read for its pieces, scores and kind; the result equals that of the sentencepiece library on the same file.

 * A unigram file: the best sum of piece scores (Viterbi). A piece ending at a position replaces the best one so far only if its score is strictly
   larger, and starts are visited in ascending order, so of equal scores the longest last piece wins. Scores are summed exactly (float64).
 * A BPE file: merges, best score first and of equal ones the leftmost. A best sum isn't what they give (the best sum of this file's scores has 14 % more
   pieces), so the programme carries for each prefix the last piece of its encoding instead. A sequence of pieces is the encoding of a text if and only if each
   two neighbours are that of their own concatenation; of the pieces that end at a position exactly one is compatible with the last piece of the prefix
   before it. Compatibility of two pieces is found once by merging them.

Both programmes go through prefixes, so what is known of a shared prefix serves all words that begin with it.

Rules taken over from the tokenizer: one space is put before the text unless it is empty; spaces become the mark U+2581; nothing else is normalised; a
character of which no one-character piece exists (by the unigram rule it costs the smallest score less 10) becomes one byte piece per UTF-8 byte.

No piece holds a mark after another character (checked when the file is loaded), so a text's segmentation passes every boundary before a mark, and that of
a text is the concatenation of those of its marked words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from struct import pack
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, as_text, by_row, project, ship

MARK = "▁"
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
#: A worker remembers at most so many words, none of them longer than MEMO_CHARS; beyond it forgets all of them and starts again.
MEMO_WORDS = 200_000
MEMO_CHARS = 64
#: Pairs of pieces of which a worker remembers whether they are compatible.
MEMO_PAIRS = 500_000
UNK_PENALTY = 10.0
#: Texts of which the new words are segmented together.
TEXTS = 256
T = TypeVar("T")
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_LOADED: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Pieces (text -> (id, score)), the byte pieces' ids, and the tables that decoding needs."""

    def __init__(self, pieces: Iterable[tuple[str, float, str]], merges: bool = False):
        """pieces: (text, score, kind) in the order of their ids; kind is normal, byte, unused, unknown or control. merges: of a BPE file."""
        self.merges = merges
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_id = [-1] * 256
        self.raw: list[bytes] = []
        low = 0.0
        for i, (p, s, kind) in enumerate(pieces):
            self.raw.append(b"")
            if kind == "byte":
                self.byte_id[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif kind == "normal":
                if MARK in p.lstrip(MARK) or "\n" in p:
                    raise ValueError(f"piece {p!r} crosses a word boundary")
                self.score[p], self.ids[p] = s, i
                self.raw[i] = p.replace(MARK, " ").encode()
                low = min(low, s)
        if min(self.byte_id) < 0:
            raise ValueError("the vocabulary has no byte pieces to fall back on")
        self.unk = low - UNK_PENALTY
        if merges and not all(c in self.score for p in self.score for c in p):
            raise ValueError("a piece holds a character that is no piece")
        #: When merges make a piece; single characters are there from the beginning.
        self.order = {p: -1 if len(p) == 1 else k for k, p in enumerate(sorted(self.score, key=lambda p: -self.score[p]))} if merges else {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        #: Whether pieces are compatible: by the id of the first plus 1 (0: the word's begin), 32 bits up, and that of the second.
        self.pairs: dict[int, bool] = {}
        self._build()

    def _build(self) -> None:
        """Aho-Corasick machine over the pieces: follow[state] maps characters to states, found[state] lists (length, score, id) of the pieces that end
        there, longest first, and alone[state] tells whether one of them is a single character."""
        follow: list[dict[str, int]] = [{}]
        own: list[tuple[int, float, int] | None] = [None]
        for p, score in self.score.items():
            at = 0
            for c in p:
                to = follow[at].get(c)
                if to is None:
                    to = follow[at][c] = len(follow)
                    follow.append({})
                    own.append(None)
                at = to
            own[at] = (len(p), score, self.ids[p])
        fail = [0] * len(follow)
        found: list[tuple[tuple[int, float, int], ...]] = [()] * len(follow)
        layer = [0]
        while layer:
            after = []
            for at in layer:
                for c, to in follow[at].items():
                    if at:
                        f = fail[at]
                        while f and c not in follow[f]:
                            f = fail[f]
                        fail[to] = follow[f].get(c, 0)
                    found[to] = ((own[to],) if own[to] is not None else ()) + found[fail[to]]
                    after.append(to)
            layer = after
        self.follow, self.fail, self.found = follow, fail, found
        self.alone = [bool(x) and x[-1][0] == 1 for x in found]

    def step(self, at: int, c: str) -> int:
        """The state after a character that follow has no entry for; the entry is added, unless it leads to the root."""
        f = at
        while f:
            f = self.fail[f]
            to = self.follow[f].get(c)
            if to is not None:
                self.follow[at][c] = to
                return to
        return 0

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        if path not in _LOADED:
            import sentencepiece
            from sentencepiece.sentencepiece_model_pb2 import ModelProto

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "unused" if sp.is_unused(i) else "normal"
            model = ModelProto.FromString(sp.serialized_model_proto()).trainer_spec.model_type
            if model not in (1, 2):
                raise ValueError("neither a unigram nor a BPE file")
            _LOADED[path] = cls(((sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())), merges=model == 2)
        return _LOADED[path]

    def merged(self, word: str) -> list[str]:
        """Pieces, and unknown characters, of a word by its merges."""
        part: list[str | None] = list(word)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        score, end = self.score.get, len(part)
        todo = [(-s, k, a + b) for k, (a, b) in enumerate(zip(word, word[1:])) if (s := score(a + b)) is not None]
        heapify(todo)
        while todo:
            _, k, whole = heappop(todo)
            n = after[k]
            if part[k] is None or n == end or len(part[k]) + len(part[n]) != len(whole) or part[k] + part[n] != whole:
                continue
            part[k], part[n] = whole, None
            after[k] = n = after[n]
            if n < end:
                before[n] = k
                if (s := score(whole + part[n])) is not None:
                    heappush(todo, (-s, k, whole + part[n]))
            if (b := before[k]) >= 0 and (s := score(part[b] + whole)) is not None:
                heappush(todo, (-s, b, part[b] + whole))
        return [p for p in part if p is not None]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces of which merges make a piece (itself twice if it is one character); None if they don't make it."""
        if piece not in self.halves:
            got = (piece, piece) if len(piece) == 1 else None
            if not got and self.merged(piece) == [piece]:
                # of the cuts into two pieces the one whose halves are compatible until the piece is made
                made = self.order[piece]
                got = next((x for k in range(1, len(piece)) if (x := (piece[:k], piece[k:])) and x[0] in self.order and x[1] in self.order and self.split(x[0]) and self.split(x[1]) and self._stay(*x, made)), None)
            self.halves[piece] = got
        return self.halves[piece]

    def _stay(self, a: str, b: str, limit: float = float("inf")) -> bool:
        """Whether nothing merges across the border of a and b before limit: the pieces beside the border are taken apart again, the latest made first."""
        order = self.order
        while True:
            whole = order.get(a + b)
            if whole is not None and whole < limit:
                return False
            x, y = order[a], order[b]
            if x > y:
                limit, a = x, self.split(a)[1]
            elif y >= 0:
                limit, b = y + 1, self.split(b)[0]
            else:
                return True

    def compatible(self, key: int, first: str, second: str) -> bool:
        """Whether first (empty at a word's begin) and second are the encoding of their concatenation; remembered under key."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        ok = self.pairs[key] = self.split(second) is not None and (not first or self._stay(first, second))
        return ok

    def codes(self, pieces: Iterable[str]) -> list[int]:
        """Ids of pieces and unknown characters."""
        return [i for p in pieces for i in ([self.ids[p]] if p in self.ids else [self.byte_id[x] for x in p.encode("utf-8", "surrogatepass")])]


class Path:
    """Segmentations of the prefixes of a word: of each the best score, the number of pieces, the length of the last piece (0: an unknown character), its id
    (-1: unknown; -2 at the begin) and the machine's state."""

    def __init__(self, v: Vocabulary):
        self.v, self.word = v, ""
        self.best, self.count, self.back, self.last, self.state = [0.0], [0], [0], [-2], [0]

    def to(self, word: str, shared: int) -> None:
        """Go to another word, of which the first shared characters are those of the one before."""
        for x in (self.best, self.count, self.back, self.last, self.state):
            del x[shared + 1 :]
        self.word = word
        (self._merge if self.v.merges else self._add)(shared)

    def _add(self, e: int) -> None:
        """The machine lists the pieces that end at each position, longest first; the best score wins."""
        v, best, count, back, last, state = self.v, self.best, self.count, self.back, self.last, self.state
        follow, found, alone, step, unk = v.follow, v.found, v.alone, v.step, v.unk
        at = state[-1]
        for c in self.word[e:]:
            to = follow[at].get(c)
            at = step(at, c) if to is None else to
            e += 1
            top, n, size, own = None, 0, 0, -1
            for length, s, i in found[at]:
                x = best[e - length] + s
                if top is None or x > top:
                    top, n, size, own = x, count[e - length] + 1, length, i
            if not alone[at]:
                x = best[-1] + unk
                if top is None or x > top:
                    top, n, size, own = x, count[-1] + len(c.encode("utf-8", "surrogatepass")), 0, -1
            best.append(top)
            count.append(n)
            back.append(size)
            last.append(own)
            state.append(at)

    def _merge(self, e: int) -> None:
        """Of the listed pieces the one that is compatible with the last piece of the prefix before it. An unknown character never merges."""
        v, word, count, back, last, state = self.v, self.word, self.count, self.back, self.last, self.state
        follow, found, step, pairs, compatible = v.follow, v.found, v.step, v.pairs, v.compatible
        at = state[-1]
        for c in word[e:]:
            to = follow[at].get(c)
            at = step(at, c) if to is None else to
            e += 1
            for length, _, own in found[at]:
                k = e - length
                was = last[k]
                key = (was + 1 if was >= 0 else 0) << 32 | own
                ok = pairs.get(key)
                if ok is None:
                    ok = compatible(key, word[k - back[k] : k] if was >= 0 else "", word[k:e])
                if ok:
                    last.append(own)
                    back.append(length)
                    count.append(count[k] + 1)
                    break
            else:
                last.append(-1)
                back.append(0)
                count.append(count[-1] + len(c.encode("utf-8", "surrogatepass")))
            state.append(at)

    def ids(self) -> bytes:
        """int32, little endian, along the back pointers."""
        back, last = self.back, self.last
        e, path = len(self.word), []
        while e:
            if last[e] >= 0:
                path.append(last[e])
                e -= back[e]
            else:
                path.extend(self.v.byte_id[x] for x in reversed(self.word[e - 1].encode("utf-8", "surrogatepass")))
                e -= 1
        path.reverse()
        return pack("<%di" % len(path), *path)


def _tied(v: Vocabulary, word: str) -> bool:
    """Whether pieces of equal score, which runs of marks are, may merge: then neighbours don't tell, and the word is merged as a whole."""
    return v.merges and word.startswith(MARK + MARK)


def _each(v: Vocabulary, words: Iterable[str], of_path: Callable[[Path], T], of_codes: Callable[[list[int]], T]) -> dict[str, T]:
    """Of each word what of_path makes of its segmentation. The sorted words are the paths of a trie in depth-first order; what is known of the prefix shared
    with the word before is reused."""
    out: dict[str, T] = {}
    p = Path(v)
    for w in sorted(words):
        if _tied(v, w):
            out[w] = of_codes(v.codes(v.merged(w)))
            continue
        k, m, before = 0, min(len(w), len(p.word)), p.word
        while k < m and w[k] == before[k]:
            k += 1
        p.to(w, k)
        out[w] = of_path(p)
    return out


def count_words(v: Vocabulary, words: Iterable[str]) -> dict[str, int]:
    """Numbers of pieces of marked words."""
    return _each(v, words, lambda p: p.count[-1], len)


def encode_words(v: Vocabulary, words: Iterable[str]) -> dict[str, bytes]:
    """Ids (int32, little endian) of marked words."""
    return _each(v, words, Path.ids, lambda ids: pack("<%di" % len(ids), *ids))


def units(text: str) -> list[str]:
    """Marked words of a text; a line feed is one of its own. Their concatenation is the marked text."""
    return _UNIT.findall((" " + text).replace(" ", MARK)) if text else []


#: Of each file, what this worker has found out about words; kept from task to task.
_COUNTS: dict[str, dict[str, int]] = {}
_CODES: dict[str, dict[str, bytes]] = {}


def _by_batch(texts: list[str], memo: dict[str, T], find: Callable[[set[str]], dict[str, T]]) -> Iterator[list[T]]:
    """What memo has of the units of each text; those that are new in a batch are found together. Long words aren't kept, so that the memo is bounded in bytes too."""
    for a in range(0, len(texts), TEXTS):
        part = [split_marked(t) for t in texts[a : a + TEXTS]]
        new = set().union(*part).difference(memo)
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = set().union(*part)
        memo.update(find(new))
        got = [list(map(memo.__getitem__, u)) for u in part]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        yield from got


def split_marked(text: str) -> list[str]:
    """units(text), fast where single spaces separate the words."""
    if not text:
        return []
    if MARK in text:
        return units(text)
    out: list[str] = []
    for line in (" " + text).split("\n"):
        if "  " in line:
            out += _UNIT.findall(line.replace(" ", MARK))
        elif line:
            w = line.replace(" ", " " + MARK).split(" ")
            out += w if w[0] else w[1:]
        out.append("\n")
    out.pop()
    return out


def token_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_units, n_chars) of every row, without a shuffle; units are the marked words and line feeds.

    Null and empty texts have no tokens; repeated rows are counted each; other columns are ignored; an empty table gives an empty one.
    """

    def make():
        v = Vocabulary.load(model)
        memo = _COUNTS.setdefault(model, {})

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_text(b.column(1))
            tokens, words = [], []
            for n in _by_batch(texts, memo, lambda new: count_words(v, new)):
                tokens.append(sum(n))
                words.append(len(n))
            chars = list(map(len, texts))
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (tokens, words, chars))], ["doc_id", "n_tokens", "n_units", "n_chars"])

        return f

    return by_row(project(docs, id_col, text_col), "doc_id long, n_tokens long, n_units long, n_chars long", make)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, round_trip) of every row: the ids, and whether decoding them gives the text back byte for byte.

    Null and empty texts have no ids (round trip true). A text that itself holds the mark U+2581 decodes to a space there (round trip
    false), as in the tokenizer. Repeated rows are encoded each; other columns are ignored; an empty table gives an empty one.
    """

    def make():
        v = Vocabulary.load(model)
        memo = _CODES.setdefault(model, {})

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_text(b.column(1))
            ids, ok, sizes = [], [], [0]
            for t, codes in zip(texts, _by_batch(texts, memo, lambda new: encode_words(v, new))):
                x = np.frombuffer(b"".join(codes), "<i4")
                ids.append(x)
                sizes.append(len(x))
                ok.append(decode_ids(v, x) == t)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, "<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
            return pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(sizes[1:], pa.int64()), pa.array(ok, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

        return f

    return by_row(project(docs, id_col, text_col), "doc_id long, ids array<int>, n_tokens long, round_trip boolean", make)


def decode_ids(v: Vocabulary, ids: Iterable[int]) -> str:
    """The text of a list of ids: byte pieces are bytes, the others their text with marks as spaces; the space put first goes."""
    raw = b"".join(map(v.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids. A null list gives an empty text; bytes that aren't UTF-8 give U+FFFD; an id outside the vocabulary raises."""
    ship(encoded.sparkSession)

    def make():
        v = Vocabulary.load(model)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(v, x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

        return f

    return by_row(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), "doc_id long, text string", make)
