"""Group statistics: softmax, log-softmax, standard deviation, log-sum-exp, and softmax over CSR ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import assign_ranges, axis, densify, extent, ranges_from_ptr

EPSILON = 1e-12


def _floats(df: DataFrame, value: str) -> None:
    if not isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"{value} must be floating point")


def _raised(elements: DataFrame, by: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(elements with `_c` = x - max of the group, (group, `_s` = sum(exp(x - max)), `_n`)).

    Two aggregations joined back: their partial sums absorb a group that has most
    rows, and a join, other than a window, can be split on such a group.
    """
    top = elements.groupBy(*by).agg(F.max(value).alias("_m"))
    centred = _joined(elements, top, by).withColumn("_c", F.col(value) - F.col("_m")).drop("_m")
    return centred, centred.groupBy(*by).agg(F.sum(F.exp("_c")).alias("_s"), F.count("*").alias("_n"))


def _joined(elements: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """The elements with their group's columns."""
    named = groups.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return elements.join(named, same).drop(*[f"_by_{c}" for c in by])


def scatter_softmax(elements: DataFrame, *, index: str = "idx", value: str = "val", keys: Sequence[str] = ()) -> DataFrame:
    """Adds `out` = exp(x - max) / sum(exp(x - max)) within each group."""
    _floats(elements, value)
    centred, sums = _raised(elements, [*keys, index], value)
    return _joined(centred, sums, [*keys, index]).withColumn("out", F.exp("_c") / F.col("_s")).drop("_c", "_s", "_n")


def scatter_log_softmax(elements: DataFrame, *, index: str = "idx", value: str = "val", keys: Sequence[str] = (), eps: float = EPSILON) -> DataFrame:
    """Adds `out` = (x - max) - log(sum(exp(x - max)) + eps)."""
    _floats(elements, value)
    centred, sums = _raised(elements, [*keys, index], value)
    return _joined(centred, sums, [*keys, index]).withColumn("out", F.col("_c") - F.ln(F.col("_s") + F.lit(eps))).drop("_c", "_s", "_n")


def scatter_std(elements: DataFrame, *, index: str = "idx", value: str = "val", keys: Sequence[str] = (), dim_size: int | None = None, out: DataFrame | None = None, unbiased: bool = True) -> DataFrame:
    """Standard deviation of each bucket; 0 for buckets of one or no element.

    `out` has sums of squares to start from.
    """
    _floats(elements, value)
    by = [*keys, index]
    n, spread = F.count(value), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0))
    grouped = elements.groupBy(*by).agg(n.alias("_n"), spread.alias("_ss"))
    if out is None:
        line = axis(elements, extent(elements, index) if dim_size is None else dim_size, index, keys)
        line = line.withColumn("_out", F.lit(0.0))
    else:
        line = out.select(*by, F.col(value).alias("_out"))
    dense = densify(grouped, line, by, {"_n": 0, "_ss": 0.0})
    freedom = F.greatest(F.col("_n") - (1 if unbiased else 0), F.lit(1))
    return dense.select(*by, F.sqrt((F.col("_out") + F.col("_ss")) / freedom).alias(value))


def scatter_logsumexp(elements: DataFrame, *, index: str = "idx", value: str = "val", keys: Sequence[str] = (), dim_size: int | None = None, out: DataFrame | None = None, eps: float = EPSILON) -> DataFrame:
    """max + log(sum(exp(x - max)) + eps) of each bucket; an empty bucket is 0, or what `out` has."""
    _floats(elements, value)
    by = [*keys, index]
    top = elements.groupBy(*by).agg(F.max(value).alias("_m"))
    centred = elements.join(top, by).withColumn("_e", F.exp(F.col(value) - F.col("_m")))
    total = centred.groupBy(*by).agg(F.max("_m").alias("_m"), F.sum("_e").alias("_s"))
    result = F.col("_m") + F.ln(F.col("_s") + F.lit(eps))
    finite = F.when(F.isnan(result) | (F.abs(result) == float("inf")), None).otherwise(result)
    grouped = total.select(*by, finite.alias(value))
    if out is not None:
        return out.select(*by, F.col(value).alias("_out")).join(grouped, by, "left").select(*by, F.coalesce(value, "_out").alias(value))
    line = axis(elements, extent(elements, index) if dim_size is None else dim_size, index, keys)
    return densify(grouped, line, by, {value: 0.0})


def softmax_csr(elements: DataFrame, ptr: DataFrame, *, value: str = "val", pos: str = "pos", keys: Sequence[str] = ()) -> DataFrame:
    """(pos, keys, out): softmax within each range. A range of one element gives just 1; positions in no range give 0."""
    _floats(elements, value)
    inside = assign_ranges(elements, ranges_from_ptr(ptr), pos)
    centred, sums = _raised(inside, [*keys, "r"], value)
    share = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.exp("_c") / F.col("_s"))
    return densify(_joined(centred, sums, [*keys, "r"]).select(pos, *keys, share.alias("out")), elements.select(pos, *keys), [pos, *keys], {"out": 0.0})


def softmax_csr_backward(elements: DataFrame, ptr: DataFrame, *, out: str = "out", grad: str = "grad", pos: str = "pos", keys: Sequence[str] = ()) -> DataFrame:
    """(pos, keys, grad_in): out * (grad - sum(out * grad)) within each range, 0 outside."""
    inside = assign_ranges(elements, ranges_from_ptr(ptr), pos)
    sums = inside.groupBy(*keys, "r").agg(F.sum(F.col(out) * F.col(grad)).alias("_s"))
    grads = _joined(inside, sums, [*keys, "r"]).select(pos, *keys, (F.col(out) * (F.col(grad) - F.col("_s"))).alias("grad_in"))
    return densify(grads, elements.select(pos, *keys), [pos, *keys], {"grad_in": 0.0})
