"""Sorting whole numbers with their positions."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import kept


def index_sort(elements: DataFrame, *, value: str = "val", pos: str = "pos", max_value: int | None = None, buckets: int = 256) -> DataFrame:
    """(rank, val, perm): the values in ascending order, each with the position it came from. Stable.

    Values are cut into ranges at approximate quantiles, so that outliers don't
    crowd the others into one; a value that many elements have is cut by their
    positions too. Ranks are made within a range and from the ranges' counts, so
    no task sorts everything. `max_value` bounds the values, and isn't needed.
    """
    if not isinstance(elements.schema[value].dataType, T.IntegralType):
        raise ValueError("index_sort takes one column of whole numbers")
    shares = [k / buckets for k in range(1, buckets)]
    cuts, low, high = elements.agg(F.percentile_approx(F.col(value).cast("long"), shares, 4 * buckets), F.min(F.col(pos).cast("long")), F.max(F.col(pos).cast("long"))).first()
    times = Counter(cuts or [])
    bounds = []
    for v in sorted(times):
        # a value that is k quantiles is cut into k parts of like widths of positions
        bounds += [(v, -(1 << 63))] + [(v, low + (high - low + 1) * k // times[v]) for k in range(1, times[v])] + [(v + 1, -(1 << 63))]
    # how many bounds are at most the row's key, by halving: each row is compared with eight of 256; a bound is a literal's element, since plans with hundreds of literals take long
    ends, bucket = sorted({b for b in bounds if b[0] < 1 << 63}), F.lit(0)
    if ends:
        values, places = (F.lit(np.array(x, dtype=np.int64)) for x in zip(*ends))
        v, p = F.col(value).cast("long"), F.col(pos).cast("long")
        below = lambda i: (F.get(values, i) < v) | ((F.get(values, i) == v) & (F.get(places, i) <= p))
        steps = F.lit(np.array([1 << k for k in reversed(range(len(ends).bit_length()))], dtype=np.int32))
        bucket = F.aggregate(steps, bucket, lambda at, step: F.when(below(at + step - 1), at + step).otherwise(at))
    rows = elements.select(F.col(value).alias("val"), F.col(pos).alias("perm"), bucket.alias("_b"))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    base = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")
    inside = F.row_number().over(W.partitionBy("_b").orderBy("val", "perm")) - 1
    ranked = rows.withColumn("_k", inside).join(F.broadcast(counts.select("_b", base.alias("_base"))), "_b")  # at most two for each of `buckets`
    return ranked.select((F.col("_base") + F.col("_k")).cast("long").alias("rank"), "val", "perm")


def distinct_ranks(values: DataFrame, value: str = "val") -> DataFrame:
    """(rank, val): the distinct values in ascending order, kept as a table, for values that are used more than once.

    One shuffle, by ranges of values: a range is sorted in its task, and its
    ranks start where those of the ranges before end. Equal values meet in one
    task, which only passes over them.
    """
    ranged = values.select(F.col(value).alias("val")).repartitionByRange("val").distinct().sortWithinPartitions("val")
    # the number of the task, and the row's number in it
    placed = kept(ranged.withColumn("_id", F.monotonically_increasing_id()).select("val", F.shiftright("_id", 33).alias("_b"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_k")))
    counts = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    base = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")
    ranked = placed.join(F.broadcast(counts.select("_b", base.alias("_base")).checkpoint()), "_b")  # a row for each range
    return ranked.select((F.col("_base") + F.col("_k")).cast("long").alias("rank"), "val")
