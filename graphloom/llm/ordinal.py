"""Cumulative-link ordinal regression on sparse text features.

Grades 0 < 1 < ... < K - 1 share one weight per feature; K - 1 ascending
thresholds tell them apart: P(grade >= k) = sigmoid(score - threshold_k).

Features are hashed to 32 bits: a text's words and their beginnings, beginnings
that many of its words have, and shares of odd words in coarse steps. They count
once, however often they occur. Of all features of the training rows only those
are kept whose frequency differs clearly between low and high grades, so that a
model is a few thousand weights. A model may replace features that mark a grade
by their number, in coarse steps, so that a text with many of them isn't pushed
beyond the grade that they mark.

A model is fitted on the driver from a bounded sample of labelled rows; all
else is one narrow pass over all texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready

#: Labelled rows that a model is fitted on, about; and how clearly a kept feature must differ (chi-squared).
SAMPLE_ROWS, LEAST_CHI2, LEAST_ROWS = 9_000, 24.0, 6
#: Words whose features a worker remembers.
KEEP = 200_000

_WORDS = re.compile(r"\w+")
#: Upper bounds of the steps in which shares are told apart.
STEPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)
#: Letters of the beginnings whose share of a text's words counts, and the shares from which on they have a feature.
STEM, RATES = 5, (0.005, 0.01)
#: Numbers of marking features that are told apart.
MARKS = (1, 2, 4)


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def word_names(word: str) -> list[str]:
    """The features of a lower-cased word: itself, and its first 4, 5 and 6 letters."""
    return [word, *["^" + word[:n] for n in (4, 5, 6) if len(word) >= n]]


def shape_names(text: str) -> list[str]:
    """Features of how a text looks: shares of words that are in capitals, repeated, without letters, or end in symbols."""
    words = text.split()
    if not words:
        return ["#empty"]
    n = len(words)
    shares = {
        "upper": sum(map(str.isupper, words)) / n,
        "again": sum(a == b for a, b in zip(words, words[1:])) / n,
        "bare": sum(not any(map(str.isalnum, (w[0], w[-1]))) for w in words) / n,
        "symbol": sum(not w[-1].isalnum() and w[-1] not in ".,;:?!\"')»”" or w[-2:] == "!!" for w in words) / n,
        "kinds": len(set(words)) / n if n >= 40 else 1.0,
        "spaced": 1 - text.count(" ") / len(text) * 4 if len(text) > 40 else 1.0,
    }
    return [f"#{k}{sum(v > s for s in STEPS)}" for k, v in shares.items()]


def rate_names(stem: str, share: float) -> list[str]:
    """The features of a beginning that this share of a text's words has."""
    return [f"^{stem}%{k}" for k, least in enumerate(RATES) if share >= least]


def text_counts(text: str) -> dict[int, int]:
    """The distinct hashed features of a text, with the words that each stands for.

    A word counts once: for its beginning of STEM letters or, if it is shorter,
    for itself. All other features have 0.
    """
    found = dict.fromkeys(map(_hash, shape_names(text)), 0)
    words = Counter(_WORDS.findall(text.lower()))
    stems: Counter[str] = Counter()
    for word, times in words.items():
        found.update(dict.fromkeys(map(_hash, word_names(word)), 0))
        if len(word) >= STEM:
            stems[word[:STEM]] += times
    for stem, times in stems.items():
        found.update(dict.fromkeys(map(_hash, rate_names(stem, times / words.total())), 0))
    found.update((_hash("^" + stem), times) for stem, times in stems.items())
    found.update((_hash(word), times) for word, times in words.items() if len(word) < STEM)
    return found


def text_features(text: str) -> list[int]:
    """The distinct hashed features of a text, ascending."""
    return sorted(text_counts(text))


#: The features that say how many marking features a text has.
MARK_HASHES = [_hash(f"#marks{k}") for k in MARKS]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class CumulativeLink:
    """weights by hashed feature, the thresholds between grades, and the features that only count (MARKS)."""

    weights: dict[int, float]
    thresholds: list[float]
    marks: frozenset[int] = frozenset()

    def score(self, found: Iterable[int]) -> float:
        """The sum of the weights of distinct features, those of the steps of MARKS that they reach included."""
        weights, marks = self.weights, self.marks
        total, n = 0.0, 0
        for h in sorted(found):
            if h in marks:
                n += 1
            else:
                total += weights.get(h, 0.0)
        return total + sum(weights.get(h, 0.0) for h, least in zip(MARK_HASHES, MARKS) if n >= least)

    def tails(self, score: float | np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... in the last axis."""
        return sigmoid(np.asarray(score)[..., None] - np.array(self.thresholds))

    def expected(self, score: float | np.ndarray) -> np.ndarray:
        """The expected grade: the sum of the tails."""
        return self.tails(score).sum(axis=-1)


def select_features(rows: np.ndarray, features: np.ndarray, high: np.ndarray, least_chi2: float = LEAST_CHI2, least_rows: int = LEAST_ROWS) -> np.ndarray:
    """The features whose share of rows differs clearly between high and other rows. rows, features: one entry per feature of a row."""
    names, at = np.unique(features, return_inverse=True)
    n, n_high = len(high), high.sum()
    total = np.bincount(at, minlength=len(names)).astype(float)
    a = np.bincount(at, weights=high[rows].astype(float), minlength=len(names))
    expected = total * n_high / max(n, 1)
    variance = expected * (1 - n_high / max(n, 1)) * (1 - total / (n + 1))
    chi2 = (a - expected) ** 2 / np.maximum(variance, 1e-9)
    return names[(chi2 >= least_chi2) & (total >= least_rows)]


def among(kept: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which features are kept ones, and these features' places in kept). kept: ascending. Needs little memory."""
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(kept, features), len(kept) - 1)
    mine = np.flatnonzero(kept[at] == features)
    return mine, at[mine]


def marked(rows: np.ndarray, features: np.ndarray, n: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows, features of n texts, the marking ones replaced by the steps of MARKS that their number reaches."""
    mine = among(marks, features)[0]
    count = np.bincount(rows[mine], minlength=n)
    others = np.ones(len(rows), bool)
    others[mine] = False
    reached = [np.flatnonzero(count >= k) for k in MARKS]
    more = np.repeat(np.array(MARK_HASHES, features.dtype), [len(x) for x in reached])
    return np.concatenate([rows[others], *reached]), np.concatenate([features[others], more])


def fit(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, *, kept: np.ndarray, rounds: int = 500, ridge: float = 1e-5, step: float = 0.15) -> CumulativeLink:
    """Fits shared weights and ordered thresholds by full-batch Adam. Rows of rare grades count more."""
    k = max(2, int(grades.max(initial=0)) + 1)
    n = len(grades)
    mine, c = among(kept, features)
    r = rows[mine]
    counts = np.maximum(np.bincount(grades, minlength=k), 1)
    weight = np.sqrt(n / (k * counts))[grades]
    weight = weight / max(weight.sum(), 1e-9)
    # thresholds: the first, then logarithms of the steps between them
    shares = np.clip(1 - np.cumsum(counts)[:-1] / counts.sum(), 1e-3, 1 - 1e-3)
    base = -np.log(shares / (1 - shares))
    theta = np.concatenate([np.zeros(len(kept)), base[:1], np.log(np.maximum(np.diff(base), 0.5))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    d = len(kept)
    index = np.arange(n)
    for t in range(1, rounds + 1):
        w, gaps = theta[:d], np.exp(theta[d + 1 :])
        cut = theta[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(r, weights=w[c], minlength=n)
        tail = np.concatenate([np.ones((n, 1)), sigmoid(score[:, None] - cut), np.zeros((n, 1))], axis=1)
        low, high = tail[index, grades], tail[index, grades + 1]
        p = np.maximum(low - high, 1e-12)
        slope = weight * (low + high - 1)
        gw = np.bincount(c, weights=slope[r], minlength=d) + ridge * w
        gcut = np.zeros(k - 1)
        for j in range(1, k):
            f = tail[:, j] * (1 - tail[:, j])
            gcut[j - 1] = (weight * f / p)[grades == j].sum() - (weight * f / p)[grades == j - 1].sum()
        beyond = np.cumsum(gcut[::-1])[::-1]
        g = np.concatenate([gw, beyond[:1], beyond[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cut = theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])
    return CumulativeLink(dict(zip(kept.tolist(), theta[:d].tolist())), cut.tolist())


@dataclass
class Sample:
    """Labelled texts: their grades; row and feature of each feature of a text, and in how many words (toxic texts' only, if asked for)."""

    rows: np.ndarray
    features: np.ndarray
    grades: np.ndarray
    words: np.ndarray


def sample_features(docs: DataFrame, graded: DataFrame, sample_rows: int = SAMPLE_ROWS, words_from: int | None = None) -> Sample:
    """About sample_rows labelled documents, each different text once.

    graded(doc_id, grade). Rows are chosen by a hash of the id, so that all
    labelled rows have the same chance, and any run chooses alike. Of labels that
    differ for one text the lowest counts. Words are counted for rows of this
    grade or more.
    """
    ready(docs.sparkSession)
    n = graded.count()
    chosen = graded
    if n > sample_rows:
        chosen = graded.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 4) < F.lit(int(sample_rows / n * 2**60)))
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("grade").cast("int").alias("grade")).where("_id is not null and grade is not null").distinct()

    def run(batches):
        for batch in batches:
            grades, texts = batch.column("grade").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
            counts = [sorted(text_counts(x).items()) for x in texts]
            found = [np.array([h for h, _ in x], np.uint32).view(np.int32) for x in counts]
            times = [[n for _, n in x] if words_from is not None and g >= words_from else [] for g, x in zip(grades, counts)]
            names = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(names), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["grade", "text", "features", "words"])

    # about sample_rows ids, which is a bound whatever the tables' sizes
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("grade", "text")
    table = labelled.mapInArrow(run, "grade int, text long, features array<int>, words array<int>").toArrow()
    grades, texts = table["grade"].to_numpy(), table["text"].to_numpy()
    order = np.lexsort((grades, texts))
    first = np.ones(len(order), bool)
    first[1:] = texts[order][1:] != texts[order][:-1]
    use = np.sort(order[first])

    def flat(name: str) -> tuple[list[np.ndarray], np.ndarray]:
        lists = table[name].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return [values[offsets[i] : offsets[i + 1]] for i in use], np.diff(offsets)[use]

    feats, sizes = flat("features")
    counts, counted = flat("words")
    features = np.concatenate(feats).view(np.uint32) if len(use) else np.zeros(0, np.uint32)
    words = np.zeros(len(features), np.int32)
    if counted.any():
        words[np.repeat(counted > 0, sizes)] = np.concatenate(counts)
    return Sample(np.repeat(np.arange(len(use), dtype=np.int32), sizes), features, grades[use].astype(np.int64), words)


#: What is remembered of most words.
_NOTHING: tuple[tuple[int, ...], bool] = ((), False)


class Scorer:
    """Scores texts with a model; remembers which words have weights."""

    def __init__(self, model: CumulativeLink):
        self.model = model
        self._counts = model.marks.union(model.weights)
        self._known: dict[str, tuple[tuple[int, ...], bool]] = {}

    def _word(self, word: str) -> tuple[tuple[int, ...], bool]:
        """(the word's features that count, whether the share of its beginning does)."""
        if len(self._known) > KEEP:
            self._known.clear()
        counts = self._counts
        got = tuple(h for h in map(_hash, word_names(word)) if h in counts)
        rated = len(word) >= STEM and any(_hash(x) in counts for x in rate_names(word[:STEM], 1.0))
        self._known[word] = found = (got, rated) if got or rated else _NOTHING
        return found

    def features(self, text: str) -> set[int]:
        """The features of a text that count in the model."""
        counts, known = self._counts, self._known
        found = {h for h in map(_hash, shape_names(text)) if h in counts}
        words = _WORDS.findall(text.lower())
        stems: dict[str, int] = {}
        for word in set(words):
            of_word = known.get(word)
            if of_word is None:
                of_word = self._word(word)
            if of_word[0]:
                found.update(of_word[0])
            if of_word[1]:
                stems[word[:STEM]] = 0
        if stems:
            for word in words:
                if (stem := word[:STEM]) in stems and len(word) >= STEM:
                    stems[stem] += 1
            for stem, times in stems.items():
                found.update(h for h in map(_hash, rate_names(stem, times / len(words))) if h in counts)
        return found

    def score(self, text: str) -> float:
        return self.model.score(self.features(text))


def score_all(docs: DataFrame, model: CumulativeLink, columns: list[str], names: tuple[str, str, str]) -> DataFrame:
    """doc_id, the named columns, and the expected grade, P(grade >= 1) and P(grade >= 2) of every row, by these names.

    One narrow pass. A null text is empty; a very long one is scored whole. A
    column that has one of the new names is left out. A model of two grades
    gives 0 for the last.
    """
    keep = [c for c in dict.fromkeys(columns) if c != "doc_id" and c not in names]
    # a text that is asked for is moved once
    texts = ["doc_id", *keep].index("text") if "text" in keep else len(keep) + 1
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, *([] if "text" in keep else [F.col("text").alias("_scored_text")]))
    fields = source.schema.fields[: len(keep) + 1]

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores = np.array([scorer.score(x.as_py() or "") for x in batch.column(texts)], dtype=float)
            tails = model.tails(scores).reshape(len(scores), len(model.thresholds))
            second = tails[:, 1] if tails.shape[1] > 1 else np.zeros(len(scores))
            kept = [batch.column(k) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(second)], [*[f.name for f in fields], *names])

    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    ready(docs.sparkSession)
    return source.mapInArrow(run, schema)
