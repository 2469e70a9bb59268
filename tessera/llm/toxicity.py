"""Operator 6, toxicity: cumulative-link (proportional odds) ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds t_1 < t_2 < ...; the result is the expected severity, the sum
of these probabilities. Features of a text are its distinct words and the 3- to 7-letter prefixes of its longer words (a prefix counts
once per distinct word), of which the model keeps those that tell grades apart in the sample.

The model is fitted from a bounded sample: at most SAMPLE_ROWS labelled texts of each label, those with the smallest hash of
their text, one of each set of near copies (texts with the same two least hashes of 3-word sequences), so that a text that was copied often weighs once. The sample's words stay
on the executors: they count how many texts hold each feature, and the driver gets the features that tell grades apart and, of each text, which of those it holds.

Where labels say only toxic or not, the toxic ones are graded 1 or 2 by how many distinct indicator words they hold, split at the median. Grade 2 is thus no label: it orders
toxic texts by how much of what the model learnt they hold, and severity above 1 isn't more than that. What is decided (toxic) rests on the labelled threshold alone.

Prediction reads every text whole, and runs without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, as_text, by_row, hash_below, materialise, project, ship

SAMPLE_ROWS = 2_000
FEATURES = 400
#: A feature is kept if the shares of toxic and of other texts that hold it are at least so many standard errors apart, and the log odds at least those.
ERRORS = 5.0
LOG_ODDS = 1.0
RIDGE = 2e-4
STEPS = 400
PREFIXES = (3, 4, 5, 6, 7)
MIN_TEXTS = 3
#: Texts of which features are counted at once.
TEXTS = 128
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def parts(word: str) -> list[str]:
    """Features of a word: itself, and prefixes with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


@dataclass(frozen=True)
class Ordinal:
    """Weights by feature, ascending thresholds, and the probability of a grade above 0 from which a text counts as toxic."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    cut: float = 0.5

    @cached_property
    def heads(self) -> frozenset[str]:
        """The first three letters of each feature; a word that begins otherwise holds none."""
        return frozenset(f.rstrip("*")[:3] for f in self.weights)

    def latent(self, text: str) -> float:
        heads, get = self.heads, self.weights.get
        return math.fsum(get(p, 0.0) for w in words(text) if w[:3] in heads for p in parts(w))  # the order of a set doesn't show

    def exceed(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - np.array(self.thresholds)[None, :], -40, 40)))


def strength(a: int, b: int, toxic: int, other: int) -> tuple[float, float]:
    """Log odds of a feature that a of the toxic texts and b of the others hold, and how many standard errors the shares are apart."""
    toxic, other = max(1, toxic), max(1, other)
    odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))
    share = (a + b) / (toxic + other)
    return odds, abs(a / toxic - b / other) / math.sqrt(max(share * (1 - share), 1e-12) * (1 / other + 1 / toxic))


def choose(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> list[str]:
    """Features that tell toxic texts apart, at most FEATURES, the strongest first. counts: by feature, how many toxic and other texts hold it.

    What fewer than MIN_TEXTS texts hold is left out. Of a word and its prefixes only the one that tells most is kept, of about equal ones the longest.
    """
    scored = {f: x for f, (a, b) in counts.items() if a + b >= MIN_TEXTS and abs((x := strength(a, b, toxic, other))[0]) >= LOG_ODDS and x[1] >= ERRORS}
    kept: list[str] = []
    taken: set[str] = set()  # of what is kept: the prefixes it has, and it itself
    for f in sorted(scored, key=lambda f: (-round(abs(scored[f][0]) * scored[f][1] * (1 + len(f) / 100), 9), f)):
        chain = parts(f.rstrip("*"))[1:] if not f.endswith("*") else [f[:k] + "*" for k in PREFIXES if k < len(f) - 1]
        if f in taken or any(g in kept for g in chain):
            continue
        kept.append(f)
        taken.update([f, *chain])
    return kept[:FEATURES]


def count_features(texts: Iterable[Iterable[str]], toxic: Iterable[bool]) -> dict[str, tuple[int, int]]:
    """Of the words of texts: by feature, how many toxic and other texts hold it."""
    have = (Counter(), Counter())
    for w, y in zip(texts, toxic):
        have[int(y)].update({p for x in w for p in parts(x)})
    return {f: (have[1][f], have[0][f]) for f in have[0].keys() | have[1].keys()}


def hold(w: Iterable[str], column: dict[str, int]) -> list[int]:
    """Columns of the features that words hold, once per word."""
    return sorted(column[p] for x in w for p in parts(x) if p in column)


def dense(rows: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), np.float32)
    for r, at in enumerate(rows):
        for k in at:
            x[r, k] += 1
    return x


def fit(texts: list[str], grades: list[int] | np.ndarray, names: list[str] | None = None, steps: int = STEPS, ridge: float = RIDGE) -> Ordinal:
    """fit_rows() of texts; grades are whole numbers from 0."""
    y = np.asarray(grades, np.int64)
    w = [words(t) for t in texts]
    names = choose(count_features(w, y > 0), int((y > 0).sum()), int((y <= 0).sum())) if names is None else names
    column = {f: i for i, f in enumerate(names)}
    return fit_rows([hold(x, column) for x in w], y, names, steps, ridge)


def fit_rows(rows: list[list[int]], y: np.ndarray, names: list[str], steps: int = STEPS, ridge: float = RIDGE) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam. rows: features of each text. With fewer than two grades nothing exceeds 0."""
    top = int(y.max()) if len(y) else 0
    if top < 1 or y.min() == top:
        return Ordinal({}, (40.0,))
    x = dense(rows, len(names))
    each = len(y) / (top + 1) / np.maximum(1, np.bincount(y, minlength=top + 1))[y]  # grades weigh alike
    params = np.zeros(len(names) + top)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        grad = -likelihood(params, x, y, top, each, ridge)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weight, t = params[: len(names)], thresholds(params[len(names) :])
    p = 1 / (1 + np.exp(-np.clip(x @ weight.astype(np.float32) - t[0], -40, 40).astype(np.float64)))
    return Ordinal({f: float(w) for f, w in zip(names, weight) if abs(w) > 1e-4}, tuple(float(a) for a in t), best_cut(p, y > 0))


def thresholds(params: np.ndarray) -> np.ndarray:
    """The first threshold, and the logarithms of the gaps between neighbouring ones."""
    return params[0] + np.concatenate([[0.0], np.cumsum(np.exp(params[1:]))])


def likelihood(params: np.ndarray, x: np.ndarray, y: np.ndarray, top: int, each: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean log likelihood of the grades less the ridge, and its gradient. params: weights, then the thresholds."""
    n = x.shape[1]
    weight, t = params[:n], thresholds(params[n:])
    z = (x @ weight.astype(x.dtype)).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -40, 40)))
    # probability of the row's grade: upper (exceeds y-1) less lower (exceeds y)
    upper = np.where(y > 0, p[np.arange(len(y)), np.maximum(y - 1, 0)], 1.0)
    lower = np.where(y < top, p[np.arange(len(y)), np.minimum(y, top - 1)], 0.0)
    like = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) * (y > 0), lower * (1 - lower) * (y < top)
    g = each * (du - dl) / like / len(y)
    gt = np.zeros(top)
    np.add.at(gt, np.maximum(y - 1, 0), -each * du / like / len(y))
    np.add.at(gt, np.minimum(y, top - 1), each * dl / like / len(y))
    tail = np.cumsum(gt[::-1])[::-1]
    return float((each * np.log(like)).mean() - ridge / 2 * weight @ weight), np.concatenate([(g.astype(x.dtype) @ x).astype(np.float64) - ridge * weight, [tail[0]], tail[1:] * np.exp(params[n + 1 :])])


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cut that makes the sum of both error rates least in the sample; in the widest gap where several do."""
    values = np.unique(p)
    if len(values) < 2:
        return 0.5
    cuts, gaps = (values[1:] + values[:-1]) / 2, np.diff(values)
    yes, no = np.sort(p[toxic]), np.sort(p[~toxic])
    errors = np.searchsorted(yes, cuts) / len(yes) + 1 - np.searchsorted(no, cuts) / len(no)
    return float(cuts[np.lexsort((-gaps, errors.round(9)))[0]])


def indicators(w: Iterable[str], strong: set[str]) -> int:
    """How many words are, or begin with, one of the strong features."""
    return sum(any(p in strong for p in parts(x)) for x in w)


def grade(toxic: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Grades 0, 1 and 2 from labels 0 and 1: toxic texts with more distinct indicator words than the median are 2."""
    if not toxic.any() or toxic.all():
        return toxic.astype(np.int64)
    middle = np.median(many[toxic])
    return toxic.astype(np.int64) + (toxic & (many > middle))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label_col: str = "toxic") -> tuple[DataFrame, DataFrame]:
    """(texts, chosen), both written: what is known of some labelled texts (id, y, h, k, words): label, hash, sketch and distinct words; and of those that are used (id, y).

    Of rows that repeat an id or a text, and of labels that contradict each other, the largest label counts. Words are never shuffled: texts are chosen by their narrow columns.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    n = known.agg(F.count(F.when(F.col("y") > 0, 1)), F.count(F.when(F.col("y") <= 0, 1))).first()
    # a few times as many ids as are used, since copies of a text count once; picked by hash, each label on its own
    share = [min(1.0, 2 * rows / max(1, x)) for x in n]
    ids = known.filter(F.when(F.col("y") > 0, hash_below("doc_id", share[0])).otherwise(hash_below("doc_id", share[1]))).select("doc_id").distinct()
    picked = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"))
    held = project(docs).join(F.broadcast(picked), "doc_id").filter("text IS NOT NULL").select("y", "text")

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_text(b.column(1))
            cols = [b.column(0), pa.array(map(hash_of, texts), pa.uint64()).view(pa.int64()), pa.array(map(sketch, texts), pa.binary()), pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, ["y", "h", "k", "words"])

        return f

    texts = materialise(by_row(held, "y int, h long, k binary, words array<string>", make).withColumn("id", F.monotonically_increasing_id()), "op6-texts")
    each = texts.groupBy("k").agg(F.max("y").alias("y"), F.min(F.struct("h", "id")).alias("s")).select("y", "s.h", "k", "s.id")
    rank = F.row_number().over(Window.partitionBy(F.col("y") > 0).orderBy("h", "k"))
    return texts, materialise(each.withColumn("r", rank).filter(F.col("r") <= rows).select("id", "y"), "op6-chosen")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label_col: str = "toxic") -> Ordinal:
    """Fit from labels (doc_id, label_col) of docs; rows with a null on either side take no part. The same tables give the same model."""
    ship(docs.sparkSession)
    known, chosen = sample(docs, labels, rows, label_col)
    used = known.drop("y").join(F.broadcast(chosen), "id")
    n = chosen.agg(F.count(F.when(F.col("y") > 0, 1)), F.count(F.when(F.col("y") <= 0, 1)), F.max("y")).first()
    if not n[0] or not n[1]:
        return Ordinal({}, (40.0,))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(a, TEXTS) for whole in batches for a in range(0, whole.num_rows, TEXTS)):
            have = count_features(b.column(1).to_pylist(), [y > 0 for y in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array([x for x, _ in have.values()], pa.int64()), pa.array([x for _, x in have.values()], pa.int64())], ["f", "a", "b"])

    a, b, ones = F.col("a"), F.col("b"), F.lit(1.0)
    sums = used.select("y", "words").mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(a + b >= MIN_TEXTS)
    # a little below the bounds that choose() draws, so that rounding doesn't decide here
    far = F.abs(a / n[0] - b / n[1]) / F.sqrt(F.greatest((a + b) / (n[0] + n[1]) * (ones - (a + b) / (n[0] + n[1])), F.lit(1e-12)) * (1 / n[0] + 1 / n[1])) >= ERRORS * 0.999
    counts = {r.f: (r.a, r.b) for r in sums.filter(far).collect()}
    names = choose(counts, n[0], n[1])
    column, strong = {f: i for i, f in enumerate(names)}, set(names[:200])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([hold(x, column) for x in w], pa.list_(pa.int32())), pa.array([indicators(x, strong) for x in w], pa.int64())], ["y", "h", "k", "at", "many"])

    got = sorted(used.select("y", "h", "k", "words").mapInArrow(held, "y int, h long, k binary, at array<int>, many long").collect(), key=lambda r: (r.h, r.k))
    y = np.array([r.y for r in got], np.int64)
    return fit_rows([r.at for r in got], y if n[2] > 1 else grade(y > 0, np.array([r.many for r in got])), names)


def hash_of(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def sketch(text: str) -> bytes:
    """The two least hashes of the text's 3-word sequences; where there are none, the text's own hash."""
    w = text.lower().split()
    least = nsmallest(2, {hash_of(" ".join(x)) for x in zip(w, w[1:], w[2:])})
    return b"".join(x.to_bytes(8, "big") for x in least) or hash_of(text).to_bytes(8, "big") + hash_of(text, 1).to_bytes(8, "big") + b"t"


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity double, p_toxic double, toxic boolean) of every row.

    expected_severity: the sum of the probabilities of exceeding each grade; above 1 it tells how much of what was learnt a toxic text holds, not a labelled grade.
    toxic: the probability of a grade above 0 is at least the model's cut. Null and empty texts hold no features and get the score of a text without any; repeated
    rows are scored each; other columns are ignored; an empty table gives an empty one.
    """

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            p = model.exceed(np.array([model.latent(t) for t in as_text(b.column(1))], np.float64))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= model.cut)], ["doc_id", "expected_severity", "p_toxic", "toxic"])

        return f

    return by_row(project(docs, id_col, text_col), "doc_id long, expected_severity double, p_toxic double, toxic boolean", make)


def is_toxic(model: Ordinal):
    """A column function: text -> boolean, for filters."""

    @F.arrow_udf("boolean")
    def f(text: pa.Array) -> pa.Array:
        latent = [model.latent(t) for a in range(0, len(text), SLICE) for t in as_text(text[a : a + SLICE])]
        return pa.array(model.exceed(np.array(latent, np.float64))[:, 0] >= model.cut)

    return f


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() by what learn() gives of the same table: nulls, empty texts, ties, repeated rows and empty tables as there. Without labels of both kinds nothing is toxic."""
    return score(docs, learn(docs, labels))


