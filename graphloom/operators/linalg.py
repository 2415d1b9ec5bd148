"""Grouped matrix products and B-spline kernels, as joins and sums of products in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import assign_ranges, ranges_from_ptr


def grouped_matmul(left: DataFrame, right: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """(grp, i, m, val): for each group left(grp, i, k, val) times right(grp, k, m, val), plus bias(grp, m, val).

    Groups may have any shapes that fit.
    """
    b = right.select("grp", "k", "m", F.col("val").alias("_w"))
    out = left.join(b, ["grp", "k"]).groupBy("grp", "i", "m").agg(F.sum(F.col("val") * F.col("_w")).alias("val"))
    if bias is None:
        return out
    add = bias.select("grp", "m", F.col("val").alias("_add"))
    return out.join(add, ["grp", "m"], "left").select("grp", "i", "m", (F.col("val") + F.coalesce("_add", F.lit(0.0))).alias("val"))


def segment_matmul(rows: DataFrame, weights: DataFrame, bias: DataFrame | None = None, *, ptr: DataFrame | None = None) -> DataFrame:
    """(pos, feat): rows(pos, grp, feat array) times the group's matrix weights(grp, m, col array), plus bias(grp, bias array).

    Each row meets only its group's columns; the products are array
    expressions, and one aggregation puts a row's results together. With
    ptr(r, offset) the rows' groups are the ranges that their positions are in.
    """
    if ptr is not None:
        rows = assign_ranges(rows.drop("grp"), ranges_from_ptr(ptr)).select("pos", F.col("r").alias("grp"), "feat")
    products = rows.join(weights, "grp").select(
        "grp", "pos", "m", F.aggregate(F.zip_with("feat", "col", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x).alias("_v")
    )
    out = products.groupBy("grp", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "_v"))), lambda x: x["_v"]).alias("feat"))
    if bias is None:
        return out.select("pos", "feat")
    return out.join(bias, "grp", "left").select("pos", F.when(F.col("bias").isNull(), F.col("feat")).otherwise(F.zip_with("feat", "bias", lambda a, b: a + b)).alias("feat"))


def segment_matmul_backward(grad: DataFrame, rows: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gradients (pos, feat) of the rows and (grp, m, col) of the weights, from grad(pos, feat).

    A row's is its gradient times the transposed matrix; a column's is the sum
    over its group's rows of the gradient times the row, number by number, so
    that partial sums absorb a large group.
    """
    g = rows.select("pos", "grp", F.col("feat").alias("_x")).join(grad.select("pos", F.posexplode("feat").alias("m", "_g")), "pos")
    by_row = g.join(weights.select("grp", "m", "col"), ["grp", "m"]).select("pos", "_g", F.posexplode("col").alias("_k", "_w"))
    to_rows = by_row.groupBy("pos", "_k").agg(F.sum(F.col("_g") * F.col("_w")).alias("_v")).groupBy("pos")
    products = g.select("grp", "m", "_g", F.posexplode("_x").alias("_k", "_xk")).groupBy("grp", "m", "_k").agg(F.sum(F.col("_g") * F.col("_xk").cast("double")).alias("_v"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"])
    return to_rows.agg(listed.alias("feat")), products.groupBy("grp", "m").agg(listed.alias("col"))


def _basis(v: Column, digit: Column, degree: int) -> Column:
    """The digit-th B-spline polynomial of the degree at v in [0, 1)."""
    if degree == 1:
        return F.when(digit == 0, 1 - v).otherwise(v)
    if degree == 2:
        return F.when(digit == 0, 0.5 * v * v - v + 0.5).when(digit == 1, -v * v + v + 0.5).otherwise(0.5 * v * v)
    if degree == 3:
        w = 1 - v
        return (
            F.when(digit == 0, w * w * w / 6.0)
            .when(digit == 1, (3 * v * v * v - 6 * v * v + 4) / 6.0)
            .when(digit == 2, (-3 * v * v * v + 3 * v * v + 3 * v + 1) / 6.0)
            .otherwise(v * v * v / 6.0)
        )
    raise ValueError("degree must be 1, 2 or 3")


def _slope(v: Column, digit: Column, degree: int) -> Column:
    """The derivative of _basis."""
    if degree == 1:
        return F.when(digit == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    if degree == 2:
        return F.when(digit == 0, v - 1).when(digit == 1, 1 - 2 * v).otherwise(v)
    w = 1 - v
    return F.when(digit == 0, -w * w / 2.0).when(digit == 1, (3 * v * v - 4 * v) / 2.0).when(digit == 2, (-3 * v * v + 2 * v + 1) / 2.0).otherwise(v * v / 2.0)


def _grid(points: DataFrame, kernel_size: list[int], is_open: list[bool], degree: int, pseudo: str):
    """A row for each point and combination s of digits; and for each dimension (scaled coordinate, digit)."""
    if degree not in (1, 2, 3):
        raise ValueError("degree must be 1, 2 or 3")
    dims, base = len(kernel_size), degree + 1
    rows = points.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(base**dims - 1))))
    parts = []
    for d in range(dims):
        digit = F.floor(F.col("s") / F.lit(base**d)).cast("int") % base
        parts.append((F.col(pseudo)[d].cast("double") * F.lit(float(kernel_size[d] - degree * bool(is_open[d]))), digit))
    return rows, parts


def spline_basis(points: DataFrame, kernel_size: list[int], is_open: list[bool], degree: int, *, pos: str = "pos", pseudo: str = "pseudo") -> DataFrame:
    """(pos, s, basis, weight_index): the (degree + 1)**D basis products of each point and the weights they belong to."""
    rows, parts = _grid(points, kernel_size, is_open, degree, pseudo)
    basis, index, offset = F.lit(1.0), F.lit(0).cast("long"), 1
    for size, (v, digit) in zip(kernel_size, parts):
        basis = basis * _basis(v - F.floor(v), digit, degree)
        index = index + ((v.cast("long") + digit) % size) * offset
        offset *= size
    return rows.select(pos, F.col("s").cast("long").alias("s"), basis.alias("basis"), index.alias("weight_index"))


def spline_basis_backward(points: DataFrame, grad: DataFrame, kernel_size: list[int], is_open: list[bool], degree: int, *, pos: str = "pos", pseudo: str = "pseudo") -> DataFrame:
    """(pos, d, grad): the gradient with regard to each coordinate, from grad(pos, s, grad) of the basis."""
    rows, parts = _grid(points, kernel_size, is_open, degree, pseudo)
    terms = []
    for d in range(len(parts)):
        product = F.lit(float(kernel_size[d] - degree * bool(is_open[d])))
        for e, (v, digit) in enumerate(parts):
            product = product * (_slope if e == d else _basis)(v - F.floor(v), digit, degree)
        terms.append(F.struct(F.lit(d).alias("d"), product.alias("x")))
    long = rows.select(pos, F.col("s").cast("long").alias("s"), F.explode(F.array(*terms)).alias("t"))
    return long.join(grad.select(pos, F.col("s").cast("long").alias("s"), F.col("grad").alias("_g")), [pos, "s"]).groupBy(pos, F.col("t.d").alias("d")).agg(F.sum(F.col("_g") * F.col("t.x")).alias("grad"))


def spline_weighting(x: DataFrame, weight: DataFrame, basis: DataFrame) -> DataFrame:
    """(pos, m, val): sum over s and k of basis * weight[weight_index, k, m] * x[k].

    x(pos, k, val), weight(weight_index, k, m, val), basis(pos, s, basis, weight_index).
    """
    return _spline_terms(x, weight, basis).groupBy("pos", "m").agg(F.sum(F.col("_b") * F.col("_w") * F.col("_x")).alias("val"))


def _spline_terms(x: DataFrame, weight: DataFrame, basis: DataFrame) -> DataFrame:
    b = basis.select("pos", "s", F.col("basis").alias("_b"), "weight_index")
    w = weight.select("weight_index", "k", "m", F.col("val").alias("_w"))
    return b.join(x.select("pos", "k", F.col("val").alias("_x")), "pos").join(w, ["weight_index", "k"])


def _with_grad(x: DataFrame, weight: DataFrame, basis: DataFrame, grad: DataFrame) -> DataFrame:
    return _spline_terms(x, weight, basis).join(grad.select("pos", "m", F.col("val").alias("_g")), ["pos", "m"])


def spline_weighting_backward_x(grad: DataFrame, x: DataFrame, weight: DataFrame, basis: DataFrame) -> DataFrame:
    """(pos, k, val)."""
    return _with_grad(x, weight, basis, grad).groupBy("pos", "k").agg(F.sum(F.col("_g") * F.col("_b") * F.col("_w")).alias("val"))


def spline_weighting_backward_weight(grad: DataFrame, x: DataFrame, weight: DataFrame, basis: DataFrame) -> DataFrame:
    """(weight_index, k, m, val); weights that no point uses have no row."""
    return _with_grad(x, weight, basis, grad).groupBy("weight_index", "k", "m").agg(F.sum(F.col("_g") * F.col("_b") * F.col("_x")).alias("val"))


def spline_weighting_backward_basis(grad: DataFrame, x: DataFrame, weight: DataFrame, basis: DataFrame) -> DataFrame:
    """(pos, s, val)."""
    return _with_grad(x, weight, basis, grad).groupBy("pos", "s").agg(F.sum(F.col("_g") * F.col("_w") * F.col("_x")).alias("val"))
