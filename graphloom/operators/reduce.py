"""Scatter and segment reductions: GROUP BY with a dense result.

Elements are rows (pos, idx[, keys...], val). `keys` are further axes, such as
a feature number. Results have a row for every index 0..dim_size-1 (and key):
buckets without elements get 0 (product: 1), and for arg reductions the
position `size`, one past the last element.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import assign_ranges, axis, densify, extent, ranges_from_ptr

#: The largest finite double; an infinity can't win a reduction, nor can NaN.
DOUBLE_MOST = 1.7976931348623157e308

SCATTER = ("sum", "add", "mul", "mean", "min", "max")
SEGMENT = ("sum", "add", "mean", "min", "max")


def _whole(df: DataFrame, value: str) -> bool:
    return isinstance(df.schema[value].dataType, T.IntegralType)


def _floor_mean(total: Column, n: Column) -> Column:
    return ((total - F.pmod(total, n)) / n).cast("long")


def _eligible(df: DataFrame, value: str, least: bool) -> Column:
    """Values that can win min or max: strictly inside the type's limits, and no NaN."""
    v = F.col(value)
    kind = df.schema[value].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return ~F.isnan(v) & ((v < DOUBLE_MOST) if least else (v > -DOUBLE_MOST))
    bits = {"byte": 8, "short": 16, "integer": 32, "long": 64}.get(kind.typeName(), 64)
    return v < (1 << (bits - 1)) - 1 if least else v > -(1 << (bits - 1))


#: A product of more whole numbers beyond 1 and -1 than this overflows.
MOST_FACTORS = 63


def _whole_products(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact products of whole numbers, which raise on overflow.

    Zeros and minus ones are counted. Only a group's other factors are listed, if
    there are no more than a product can have, so no list grows with a group.
    """
    v = F.col(value).cast("long")
    factor = (v > 1) | (v < -1)
    counts = df.groupBy(*by).agg(F.count_if(v == 0).alias("_zeros"), F.count_if(v == -1).alias("_minus"), F.count(v).alias("_n"), F.count_if(factor).alias("_many"))
    named = lambda t: t.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    listed = df.where(factor).join(named(counts.where(f"_zeros = 0 and _many <= {MOST_FACTORS}").select(*by)), same, "left_semi")
    products = listed.groupBy(*by).agg(F.aggregate(F.collect_list(v), F.lit(1).cast("long"), lambda a, x: a * x).alias("_p"))
    sign = F.when(F.col("_minus") % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).cast("long")
    overflow = F.raise_error(F.lit("a product of whole numbers overflows")).cast("long")
    result = F.when(F.col("_n") == 0, F.lit(None).cast("long")).when(F.col("_zeros") > 0, F.lit(0).cast("long")).when(F.col("_many") > MOST_FACTORS, overflow)
    return counts.join(named(products), same, "left").select(*by, result.otherwise(F.coalesce("_p", F.lit(1).cast("long")) * sign).alias(value))


def _grouped(df: DataFrame, reduce: str, by: list[str], value: str, pos: str) -> DataFrame:
    """One row for each group that has elements: the value, and for min and max the position `arg`."""
    v = F.col(value)
    if reduce in ("sum", "add"):
        return df.groupBy(*by).agg(F.sum(v).alias(value))
    if reduce == "mul":
        if _whole(df, value):
            return _whole_products(df, by, value)
        return df.groupBy(*by).agg(F.product(v).alias(value))
    if reduce == "mean":
        mean = _floor_mean(F.sum(v), F.count(v)) if _whole(df, value) else F.avg(v)
        return df.groupBy(*by).agg(mean.alias(value))
    if reduce == "min":
        best = F.min(F.struct(v.alias("v"), F.col(pos).alias("p")))
        sign = 1
    elif reduce == "max":
        best = F.max(F.struct(v.alias("v"), (-F.col(pos)).alias("p")))
        sign = -1
    else:
        raise ValueError(f"unknown reduction {reduce!r}")
    won = df.where(_eligible(df, value, reduce == "min")).groupBy(*by).agg(best.alias("_best"))
    return won.select(*by, F.col("_best.v").alias(value), (F.col("_best.p") * sign).alias("arg"))


def _fills(reduce: str, value: str, size) -> dict[str, object]:
    return {value: 1 if reduce == "mul" else 0} | ({"arg": size} if reduce in ("min", "max") else {})


def _merge_out(dense: DataFrame, out: DataFrame, reduce: str, by: list[str], value: str, size: int, counted: DataFrame | None, overwrite: bool) -> DataFrame:
    """Combines the reduction with the values that are there already. `dense` has nulls where no element was."""
    before = out.select(*by, F.col(value).alias("_out"))
    joined = before.join(dense, by, "left")
    v, o = F.col(value), F.col("_out")
    if reduce in ("sum", "add"):
        return joined.select(*by, (o + F.coalesce(v, F.lit(0))).alias(value))
    if reduce == "mul":
        return joined.select(*by, (o * F.coalesce(v, F.lit(1))).alias(value))
    if reduce == "mean":
        if overwrite:
            return joined.select(*by, F.coalesce(v, o).alias(value))
        return joined.join(counted, by, "left").select(*by, ((o + F.coalesce("_sum", F.lit(0))) / F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))).alias(value))
    # min and max: the value that is there wins ties and has no position
    wins = (v < o) if reduce == "min" else (v > o)
    return joined.select(*by, F.when(wins, v).otherwise(o).alias(value), F.when(wins, F.col("arg")).otherwise(F.lit(size)).alias("arg"))


def scatter(elements: DataFrame, reduce: str, *, index: str = "idx", value: str = "val", pos: str = "pos", keys: Sequence[str] = (), dim_size: int | None = None, out: DataFrame | None = None) -> DataFrame:
    """Reduces elements by index: sum (add), mul, mean, min or max.

    min and max also give `arg`, the first position of the winning value. The
    mean of whole numbers is rounded down. `out` holds values to start from:
    sums and products go on, means are (out + sum) / count, minima and maxima
    are kept where no element is better.
    """
    if reduce not in SCATTER:
        raise ValueError(f"unknown reduction {reduce!r}")
    by = [*keys, index]
    grouped = _grouped(elements, reduce, by, value, pos)
    size = _size(elements, pos) if reduce in ("min", "max") else 0
    if out is not None:
        counted = elements.groupBy(*by).agg(F.sum(value).alias("_sum"), F.count("*").alias("_n")) if reduce == "mean" else None
        return _merge_out(grouped, out, reduce, by, value, size, counted, False)
    line = axis(elements, extent(elements, index) if dim_size is None else dim_size, index, keys)
    return densify(grouped, line, by, _fills(reduce, value, size))


def _size(elements: DataFrame, pos: str) -> int:
    """Elements along the axis: one more than the last position. One small job."""
    return extent(elements, pos)


def scatter_sum(elements: DataFrame, **options) -> DataFrame:
    return scatter(elements, "sum", **options)


def scatter_add(elements: DataFrame, **options) -> DataFrame:
    return scatter(elements, "add", **options)


def scatter_mul(elements: DataFrame, **options) -> DataFrame:
    return scatter(elements, "mul", **options)


def scatter_mean(elements: DataFrame, **options) -> DataFrame:
    return scatter(elements, "mean", **options)


def scatter_min(elements: DataFrame, **options) -> DataFrame:
    return scatter(elements, "min", **options)


def scatter_max(elements: DataFrame, **options) -> DataFrame:
    return scatter(elements, "max", **options)


def fused_scatter_reduce(elements: DataFrame, reductions: Sequence[str], *, index: str = "idx", feature: str = "k", value: str = "val", dim_size: int | None = None) -> DataFrame:
    """Several of sum, mean, min and max in one pass: (index, k, val), the reductions' features one after another.

    With F features, feature f of the r-th reduction is number r * F + f.
    """
    known = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    if not reductions or any(r not in known for r in reductions):
        raise ValueError(f"reductions are some of {sorted(known)}")
    if _whole(elements, value):
        raise ValueError("values must be floating point")
    width = extent(elements, feature)
    grouped = elements.groupBy(index, feature).agg(*[known[r](value).alias(f"_r{i}") for i, r in enumerate(reductions)])
    line = axis(elements, extent(elements, index) if dim_size is None else dim_size, index, (feature,))
    dense = densify(grouped, line, (feature, index), {f"_r{i}": 0.0 for i in range(len(reductions))})
    parts = F.explode(F.array(*[F.struct((F.col(feature) + i * width).alias("k"), F.col(f"_r{i}").alias("v")) for i in range(len(reductions))]))
    return dense.select(F.col(index), parts.alias("x")).select(index, F.col("x.k").alias(feature), F.col("x.v").alias(value))


def segment_coo(elements: DataFrame, reduce: str, *, index: str = "idx", value: str = "val", pos: str = "pos", keys: Sequence[str] = (), dim_size: int | None = None, out: DataFrame | None = None) -> DataFrame:
    """Reductions over a sorted index. As scatter (no mul), but a mean replaces what is in `out` where elements are."""
    if reduce not in SEGMENT:
        raise ValueError(f"unknown reduction {reduce!r}")
    if reduce == "mean" and out is not None:
        by = [*keys, index]
        return _merge_out(_grouped(elements, reduce, by, value, pos), out, reduce, by, value, 0, None, True)
    return scatter(elements, reduce, index=index, value=value, pos=pos, keys=keys, dim_size=dim_size, out=out)


def segment_sum_coo(elements: DataFrame, **options) -> DataFrame:
    return segment_coo(elements, "sum", **options)


def segment_add_coo(elements: DataFrame, **options) -> DataFrame:
    return segment_coo(elements, "add", **options)


def segment_mean_coo(elements: DataFrame, **options) -> DataFrame:
    return segment_coo(elements, "mean", **options)


def segment_min_coo(elements: DataFrame, **options) -> DataFrame:
    return segment_coo(elements, "min", **options)


def segment_max_coo(elements: DataFrame, **options) -> DataFrame:
    return segment_coo(elements, "max", **options)


def segment_csr(elements: DataFrame, ptr: DataFrame, reduce: str, *, value: str = "val", pos: str = "pos", keys: Sequence[str] = (), out: DataFrame | None = None) -> DataFrame:
    """Reductions over the ranges of a pointer table (r, offset), one row for each range.

    Elements outside all ranges are ignored; `arg` is the position along the
    whole axis. A sum goes on from `out`; a mean replaces it (0 where a range
    is empty).
    """
    if reduce not in SEGMENT:
        raise ValueError(f"unknown reduction {reduce!r}")
    ranges = ranges_from_ptr(ptr)
    by = [*keys, "r"]
    grouped = _grouped(assign_ranges(elements, ranges, pos).select(*by, pos, value), reduce, by, value, pos)
    size = _size(elements, pos) if reduce in ("min", "max") else 0
    if out is not None and reduce != "mean":
        return _merge_out(grouped, out, reduce, by, value, size, None, False)
    line = ranges.select("r")
    line = elements.select(*keys).distinct().crossJoin(line) if keys else line
    return densify(grouped, line, by, _fills(reduce, value, size))


def segment_sum_csr(elements: DataFrame, ptr: DataFrame, **options) -> DataFrame:
    return segment_csr(elements, ptr, "sum", **options)


def segment_add_csr(elements: DataFrame, ptr: DataFrame, **options) -> DataFrame:
    return segment_csr(elements, ptr, "add", **options)


def segment_mean_csr(elements: DataFrame, ptr: DataFrame, **options) -> DataFrame:
    return segment_csr(elements, ptr, "mean", **options)


def segment_min_csr(elements: DataFrame, ptr: DataFrame, **options) -> DataFrame:
    return segment_csr(elements, ptr, "min", **options)


def segment_max_csr(elements: DataFrame, ptr: DataFrame, **options) -> DataFrame:
    return segment_csr(elements, ptr, "max", **options)
