"""Biased choice: cumulative tables, alias tables, draws from either, and uniform engines.

Draws are functions of a seed and keys, so they are the same on every run and
however the rows are partitioned.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .core import keyed_bits, keyed_uniform


def biased_to_cdf(weights: DataFrame, *, row: str = "row", edge: str = "edge_id", bias: str = "bias") -> DataFrame:
    """(row, edge_id, cdf): within each row the share of the weights before this one."""
    group = W.partitionBy(row)
    before = F.sum(bias).over(group.orderBy(edge).rowsBetween(W.unboundedPreceding, -1))
    return weights.select(row, edge, (F.coalesce(before, F.lit(0.0)) / F.sum(bias).over(group)).alias("cdf"))


def biased_to_alias(weights: DataFrame, *, row: str = "row", edge: str = "edge_id", bias: str = "bias", eps: float = 1e-6) -> DataFrame:
    """(row, edge_id, k, prob, alias): Walker's table. Place k keeps itself with probability `prob`, else gives place `alias`.

    Places are numbered within the row. Sequential within a row, hence a grouped function.
    """

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("edge_id", ignore_index=True)
        n, total = len(group), float(group["bias"].sum())
        share = [float(b) * n / total for b in group["bias"]]
        prob, alias = share[:], [0] * n
        above = [k for k in range(n) if share[k] > 1 + eps]
        below = [k for k in range(n) if share[k] < 1 - eps]
        for k in range(n):
            if abs(share[k] - 1) <= eps:
                prob[k], alias[k] = 1.0, k
        while above and below:
            big, small = above.pop(), below.pop()
            prob[small], alias[small] = share[small], big
            share[big] -= 1 - share[small]
            if share[big] > 1 + eps:
                above.append(big)
            elif share[big] < 1 - eps:
                below.append(big)
            else:
                prob[big], alias[big] = 1.0, big
        for k in above + below:
            prob[k], alias[k] = 1.0, k
        return pd.DataFrame({"row": group["row"], "edge_id": group["edge_id"], "k": range(n), "prob": prob, "alias": alias})

    plain = weights.select(F.col(row).cast("long").alias("row"), F.col(edge).cast("long").alias("edge_id"), F.col(bias).cast("double").alias("bias"))
    return plain.groupBy("row").applyInPandas(build, "row long, edge_id long, k long, prob double, alias long")


def biased_random_cdf(requests: DataFrame, cdf: DataFrame, *, row: str = "row", edge: str = "edge_id", seed: int = 0) -> DataFrame:
    """(draw, row, edge_id) for each request (draw, row): the last entry of the row whose share is not above a uniform number."""
    u = keyed_uniform(seed, "draw", row)
    drawn = requests.select("draw", row, u.alias("_u")).join(cdf, row).where("cdf <= _u")
    return drawn.groupBy("draw", row).agg(F.max(F.struct("cdf", edge)).alias("_b")).select("draw", row, F.col(f"_b.{edge}").alias(edge))


def biased_random_alias(requests: DataFrame, alias: DataFrame, *, row: str = "row", seed: int = 0) -> DataFrame:
    """(draw, row, k): a uniform place of the row, kept or swapped for its alias."""
    sizes = alias.groupBy(row).agg(F.count("*").alias("_n"))
    picked = requests.join(sizes, row).withColumn("k", F.floor(keyed_uniform(seed, "draw", row, F.lit("place")) * F.col("_n")).cast("long"))
    table = alias.select(F.col(row), "k", "prob", "alias")
    keep = keyed_uniform(seed, "draw", row, F.lit("keep")) < F.col("prob")
    return picked.join(table, [row, "k"]).select("draw", row, F.when(keep, F.col("k")).otherwise(F.col("alias")).alias("k"))


def randint(low: int, high: int, seed: int | str, *keys: str | Column) -> Column:
    """A whole number in [low, high) for each combination of keys."""
    if high <= low:
        raise ValueError("high must be above low")
    return (F.lit(low) + F.floor(keyed_bits(seed, *keys) * F.lit((high - low) / 4294967296.0))).cast("long")


def randreal(seed: int | str, *keys: str | Column) -> Column:
    """A number in [0, 1) for each combination of keys."""
    return keyed_bits(seed, *keys) / F.lit(4294967296.0)
