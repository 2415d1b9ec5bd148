"""Operator 1: expected severity of toxic language, by cumulative-link ordinal regression.

Grades are 0 for clean rows and 1, 2, ... for toxic ones of growing severity.
Labels that say no more than toxic or not leave the severity open. It is then
how much abuse a toxic text has: the number of its words, repeated ones
counted, that are marked as abuse by the rows of the other half of the sample;
2 is more than half of the toxic rows have. So no row is graded by what was
learnt from itself, and the model, which sees only whether a word is there, has
to infer the amount.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels
from .ordinal import SAMPLE_ROWS, CumulativeLink, Sample, among, fit, sample_features, score_all, select_features

#: A document is rejected from this probability of grade 1 or more on. It is above a half, as rows of rare grades count more in the fit.
REJECT = 0.6
#: How much large weights cost: a word that is in few rows alone decides nothing.
RIDGE = 1e-3


def marks(rows: np.ndarray, features: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The kept features that more high than other rows have, ascending."""
    kept = select_features(rows, features, high)
    mine, place = among(kept, features)
    n = np.maximum(np.bincount(place, minlength=len(kept)), 1)
    return kept[np.bincount(place, weights=high[rows[mine]].astype(float), minlength=len(kept)) > 0.5 * n]


def abuse(sample: Sample, high: np.ndarray) -> np.ndarray:
    """For each row the number of its words that the other half of the rows marks as abuse."""
    out = np.zeros(len(high))
    half = np.arange(len(high)) % 2
    for k in (0, 1):
        other = half[sample.rows] != k
        found = marks(sample.rows[other], sample.features[other], high & (half != k))
        at = np.flatnonzero(~other)
        at = at[among(found, sample.features[at])[0]]
        out += np.bincount(sample.rows[at], weights=sample.words[at].astype(float), minlength=len(high))
    return out


def train(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> CumulativeLink:
    """A model from labelled(doc_id, toxic). Rows without a label or a document are left out; with no labels nothing is toxic.

    toxic may have more than two grades, which then are the severity.
    """
    sample = sample_features(docs, labelled.select("doc_id", F.greatest(F.col("toxic").cast("int"), F.lit(0)).alias("grade")).where("toxic is not null"), sample_rows, words_from=1)
    high = sample.grades > 0
    if not high.any() or high.all():
        return CumulativeLink({}, [6.0, 8.0] if not high.any() else [-6.0, 6.0])
    grades = sample.grades
    if grades.max() < 2:
        amount = abuse(sample, high)
        grades = high.astype(np.int64) + (high & (amount > np.median(amount[high])))
        if grades.max() < 2:
            grades[np.flatnonzero(high)[:1]] = 2
    return fit(sample.rows, sample.features, grades, kept=select_features(sample.rows, sample.features, high), ridge=RIDGE)


def severity(docs: DataFrame, model: CumulativeLink, columns: list[str] = ()) -> DataFrame:
    """A row per row of `docs`: doc_id, the named columns, severity (expected grade), p_toxic, p_severe, rejected.

    A null or empty text has no words, only the feature of being empty; a very
    long one is scored whole. An empty table gives no rows; rows alike in their
    text, repeated ones too, get alike results; a text with p_toxic of just
    REJECT is rejected. Other columns are ignored, and one of `columns` that has
    a result's name is left out.
    """
    scored = score_all(docs, model, [c for c in columns if c != "rejected"], ("severity", "p_toxic", "p_severe"))
    return scored.withColumn("rejected", F.col("p_toxic") >= REJECT)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return severity(docs, train(docs, labels(spark, sf_dir)))
