"""Operator 4: expected quality grade and tail probability, by cumulative-link ordinal regression.

Grades come from two labels: 0 is bad text, 1 good text that is toxic, 2 good
and clean text. P(grade >= 1) says whether a text is fit to read, and selects.

Weights are shared by both thresholds, so a text with many words that mark
toxic text would fall below bad text. These words are replaced by their number
in coarse steps (ordinal.MARKS), whose weights move a text from grade 2 to 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels
from .ordinal import MARK_HASHES, SAMPLE_ROWS, CumulativeLink, fit, marked, sample_features, score_all, select_features
from .toxicity import marks

#: A document is kept from this tail probability on.
KEEP_FROM = 0.5


def grades(labelled: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, quality, toxic)."""
    good = F.col("quality") > 0
    return labelled.select("doc_id", F.when(~good, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2).alias("grade")).where(F.col("quality").isNotNull())


def train(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> CumulativeLink:
    """A model from labelled(doc_id, quality, toxic). Without labels everything is kept."""
    sample = sample_features(docs, grades(labelled), sample_rows)
    grade = sample.grades
    if not len(grade) or grade.min() == grade.max():
        bad = len(grade) and grade.max() == 0
        return CumulativeLink({}, [6.0, 8.0] if bad else [-8.0, -6.0])
    good = grade >= 1
    numbers = np.cumsum(good) - 1
    of_good = good[sample.rows]
    toxic = marks(numbers[sample.rows[of_good]], sample.features[of_good], grade[good] == 1)
    rows, features = marked(sample.rows, sample.features, len(grade), toxic)
    kept = np.union1d(select_features(rows, features, good), np.array(MARK_HASHES, np.uint32))
    model = fit(rows, features, grade, kept=kept)
    model.marks = frozenset(toxic.tolist())
    return model


def rated(docs: DataFrame, model: CumulativeLink, columns: list[str] = ()) -> DataFrame:
    """A row per row of `docs`: doc_id, the named columns, expected_grade (0 to 2), p_good, p_clean, kept.

    A null or empty text has only the feature of being empty; a very long one is
    scored whole. An empty table gives no rows; rows alike in their text,
    repeated ones too, get alike results; a text with p_good of just KEEP_FROM
    is kept. Other columns are ignored, and one of `columns` that has a result's
    name is left out.
    """
    scored = score_all(docs, model, [c for c in columns if c != "kept"], ("expected_grade", "p_good", "p_clean"))
    return scored.withColumn("kept", F.col("p_good") >= KEEP_FROM)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rated(docs, train(docs, labels(spark, sf_dir)))
