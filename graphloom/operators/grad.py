"""Backward queries of the forward operators: each is one more join or aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import assign_ranges, ieee_divide, ranges_from_ptr


def _at(elements: DataFrame, table: DataFrame, index: str, **columns: str) -> DataFrame:
    """Joins columns of a per-bucket table to the elements, under new names."""
    looked_up = table.select(F.col(index).alias("_i"), *[F.col(c).alias(name) for name, c in columns.items()])
    return elements.join(looked_up, F.col(index) == F.col("_i")).drop("_i")


def scatter_sum_backward(grad: DataFrame, elements: DataFrame, *, index: str = "idx", pos: str = "pos") -> DataFrame:
    """(pos, grad): each element gets its bucket's gradient. grad(idx, grad)."""
    return _at(elements.select(pos, index), grad, index, grad="grad").select(pos, "grad")


def scatter_mul_backward(grad: DataFrame, elements: DataFrame, out: DataFrame, *, index: str = "idx", pos: str = "pos", value: str = "val") -> DataFrame:
    """(pos, grad): grad * out / val, and 0 where val is 0."""
    rows = _at(_at(elements.select(pos, index, value), grad, index, grad="grad"), out, index, _out=value)
    v = F.col(value)
    return rows.select(pos, F.when(v == 0, F.lit(0.0)).otherwise(F.col("grad") * F.col("_out") / F.when(v == 0, F.lit(1.0)).otherwise(v)).alias("grad"))


def scatter_mean_backward(grad: DataFrame, elements: DataFrame, *, index: str = "idx", pos: str = "pos") -> DataFrame:
    """(pos, grad): grad / number of elements of the bucket."""
    counted = grad.join(elements.groupBy(index).agg(F.count("*").alias("_n")), index)
    rows = _at(elements.select(pos, index), counted, index, grad="grad", _n="_n")
    return rows.select(pos, (F.col("grad") / F.col("_n")).alias("grad"))


def scatter_arg_backward(grad: DataFrame, elements: DataFrame, arg: DataFrame, *, index: str = "idx", pos: str = "pos") -> DataFrame:
    """(pos, grad) for min and max: the gradient goes to the winning position, all others get 0. arg(idx, arg)."""
    won = grad.join(arg, index).groupBy(F.col("arg").alias("_p")).agg(F.sum("grad").alias("grad"))
    return elements.select(pos).join(won, F.col(pos) == F.col("_p"), "left").select(pos, F.coalesce("grad", F.lit(0.0)).alias("grad"))


#: A sorted index makes no difference to these queries.
segment_sum_coo_backward = scatter_sum_backward
segment_mean_coo_backward = scatter_mean_backward
segment_arg_coo_backward = scatter_arg_backward


def gather_coo_backward(grad: DataFrame, source: DataFrame, *, index: str = "idx", pos: str = "pos") -> DataFrame:
    """(pos, grad) of the source: the sum of the gradients of the elements that took it. grad(idx, grad)."""
    total = grad.groupBy(F.col(index).alias("_i")).agg(F.sum("grad").alias("_g"))
    return source.select(pos).join(total, F.col(pos) == F.col("_i"), "left").select(pos, F.coalesce("_g", F.lit(0.0)).alias("grad"))


def segment_sum_csr_backward(grad: DataFrame, elements: DataFrame, ptr: DataFrame, *, pos: str = "pos") -> DataFrame:
    """(pos, grad): the gradient of the range, 0 outside all ranges. grad(r, grad)."""
    inside = assign_ranges(elements.select(pos), ranges_from_ptr(ptr), pos).join(grad, "r").select(pos, "grad")
    return elements.select(pos).join(inside, pos, "left").select(pos, F.coalesce("grad", F.lit(0.0)).alias("grad"))


def segment_mean_csr_backward(grad: DataFrame, elements: DataFrame, ptr: DataFrame, *, pos: str = "pos") -> DataFrame:
    """(pos, grad): the gradient of the range, divided by its length."""
    ranges = ranges_from_ptr(ptr)
    inside = assign_ranges(elements.select(pos), ranges, pos).join(grad, "r").select(pos, (F.col("grad") / (F.col("stop") - F.col("start"))).alias("grad"))
    return elements.select(pos).join(inside, pos, "left").select(pos, F.coalesce("grad", F.lit(0.0)).alias("grad"))


def gather_csr_backward(grad: DataFrame, ptr: DataFrame, *, pos: str = "pos") -> DataFrame:
    """(r, grad): the sum of the gradients over the range. grad(pos, grad)."""
    ranges = ranges_from_ptr(ptr)
    total = assign_ranges(grad, ranges, pos).groupBy("r").agg(F.sum("grad").alias("grad"))
    return ranges.select("r").join(total, "r", "left").select("r", F.coalesce("grad", F.lit(0.0)).alias("grad"))


def sampled_backward(op: str, grad: DataFrame, left: DataFrame, right: DataFrame, pairs: DataFrame, *, pos: str = "pos", feature: str = "feat") -> tuple[DataFrame, DataFrame]:
    """Gradients (pos, feat) of both sides of sampled add, sub, mul or div. grad(pos, feat), pairs(pos, li, ri)."""
    rows = pairs.join(grad.select(pos, F.col(feature).alias("_g")), pos)
    rows = rows.join(left.select(F.col(pos).alias("li"), F.col(feature).alias("_a")), "li").join(right.select(F.col(pos).alias("ri"), F.col(feature).alias("_b")), "ri")
    g, a, b = F.col("_g"), F.col("_a"), F.col("_b")
    both = {
        "add": (g, g),
        "sub": (g, F.transform(g, lambda x: -x)),
        "mul": (F.zip_with(g, b, lambda x, y: x * y), F.zip_with(g, a, lambda x, y: x * y)),
        "div": (F.zip_with(g, b, ieee_divide), F.zip_with(F.zip_with(g, a, lambda x, y: -x * y), b, lambda x, y: ieee_divide(x, y * y))),
    }[op]

    def total(key: str, values) -> DataFrame:
        parts = rows.select(F.col(key).alias(pos), F.posexplode(values).alias("_k", "_v")).groupBy(pos, "_k").agg(F.sum("_v").alias("_v"))
        return parts.groupBy(pos).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"]).alias(feature))

    return total("li", both[0]), total("ri", both[1])


def grouped_matmul_backward(grad: DataFrame, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gradients of left (grp, i, k, val) and right (grp, k, m, val) from grad(grp, i, m, val)."""
    g = grad.select("grp", "i", "m", F.col("val").alias("_g"))
    to_left = g.join(right, ["grp", "m"]).groupBy("grp", "i", "k").agg(F.sum(F.col("_g") * F.col("val")).alias("val"))
    to_right = g.join(left, ["grp", "i"]).groupBy("grp", "k", "m").agg(F.sum(F.col("_g") * F.col("val")).alias("val"))
    return to_left, to_right
