"""Gathers, fused gather-and-arithmetic, and the dictionary (hash map)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import RANGE_BUCKET, ieee_divide, ranges_from_ptr


def gather_coo(elements: DataFrame, source: DataFrame, *, index: str = "idx", pos: str = "pos", value: str = "val", keys: Sequence[str] = (), out: DataFrame | None = None) -> DataFrame:
    """(elements' columns, val): val of the source row whose position is the element's index.

    out(pos, keys, val): positions that no element has keep its values.
    """
    looked_up = source.select(F.col(pos).alias(index), *keys, value)
    found = elements.join(looked_up, [index, *keys])
    return found if out is None else _over(out, found, [pos, *keys], value)


def _over(out: DataFrame, found: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """`out` (by, value), with the found rows' values in their places."""
    new = found.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(value).alias("_new"), F.lit(True).alias("_there"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in by])
    return out.join(new, same, "left").select(*by, F.when(F.col("_there"), F.col("_new")).otherwise(F.col(value)).alias(value))


def gather_csr(source: DataFrame, ptr: DataFrame, *, row: str = "r", value: str = "val", keys: Sequence[str] = (), out: DataFrame | None = None) -> DataFrame:
    """(pos, keys, val): val of source row r at every position of its range.

    out(pos, keys, val): positions in no range keep its values.
    """
    full = ranges_from_ptr(ptr).where("stop > start")
    # long ranges are first cut into pieces, so that no row's list of positions is long
    starts = F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(RANGE_BUCKET).cast("long")))
    pieces = full.select("r", "stop", starts.alias("_from"))
    last = F.least(F.col("stop"), F.col("_from") + RANGE_BUCKET) - 1
    rows = source.select(F.col(row).alias("r"), *keys, value).join(pieces, "r")
    found = rows.select(F.explode(F.sequence("_from", last)).alias("pos"), *keys, value)
    return found if out is None else _over(out, found, ["pos", *keys], value)


_BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": ieee_divide,
}


def sampled(op: str, left: DataFrame, right: DataFrame, pairs: DataFrame, *, left_index: str | None = "li", right_index: str | None = "ri", pos: str = "pos", feature: str = "feat") -> DataFrame:
    """(pos, feat): left[li] op right[ri] for each pair (pos, li, ri), on array<double> features of equal length.

    An index of None means the pair's own position. op: add, sub, mul, div.
    """
    if op not in _BINARY:
        raise ValueError(f"op is one of {sorted(_BINARY)}")
    own = lambda name: F.col(pos) if name is None else F.col(name)
    at = pairs.select(F.col(pos), own(left_index).alias("_l"), own(right_index).alias("_r"))
    a = left.select(F.col(pos).alias("_l"), F.col(feature).alias("_a"))
    b = right.select(F.col(pos).alias("_r"), F.col(feature).alias("_b"))
    return at.join(a, "_l").join(b, "_r").select(pos, F.zip_with("_a", "_b", _BINARY[op]).alias(feature))


def sampled_add(left: DataFrame, right: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    return sampled("add", left, right, pairs, **options)


def sampled_sub(left: DataFrame, right: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    return sampled("sub", left, right, pairs, **options)


def sampled_mul(left: DataFrame, right: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    return sampled("mul", left, right, pairs, **options)


def sampled_div(left: DataFrame, right: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    return sampled("div", left, right, pairs, **options)


class HashMap:
    """A dictionary from keys to their first positions, kept as a DataFrame (key, value).

    `keys` has (pos, key). With `unique`, duplicate keys raise when the map is
    read; else the smallest position counts. num_submaps, a hint for maps in
    memory, is checked and otherwise left to Spark's partitions. A map is pickled
    as its rows, so it must be small enough for the driver.
    """

    def __init__(self, keys: DataFrame, *, key: str = "key", pos: str = "pos", unique: bool = True, num_submaps: int = 0):
        if num_submaps < -1:
            raise ValueError("num_submaps must be -1, 0 or positive")
        kind = keys.schema[key].dataType
        if not isinstance(kind, (T.ShortType, T.IntegerType, T.LongType)):
            raise ValueError("keys must be short, int or long")
        self.dtype = kind
        grouped = keys.groupBy(F.col(key).alias("key")).agg(F.min(pos).alias("value"), F.count("*").alias("_n"))
        if unique:
            checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col("key").cast("string")))).otherwise(F.col("value"))
            grouped = grouped.withColumn("value", checked.cast("long"))
        self._table = grouped.select("key", F.col("value").cast("long").alias("value"))

    def table(self) -> DataFrame:
        return self._table

    def __getstate__(self) -> dict:
        return {"dtype": self.dtype, "rows": [tuple(r) for r in self._table.select("key", "value").collect()]}

    def __setstate__(self, state: dict) -> None:
        self.dtype = state["dtype"]
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("a map is unpickled where there is a session")
        schema = T.StructType([T.StructField("key", self.dtype), T.StructField("value", T.LongType())])
        self._table = spark.createDataFrame(state["rows"], schema)

    def get(self, query: DataFrame, *, key: str = "key") -> DataFrame:
        """The query's columns and `value`: the key's position, -1 for unknown keys."""
        found = self._table.select(F.col("key").alias("_key"), "value")
        return query.join(found, query[key] == F.col("_key"), "left").select(*query.columns, F.coalesce("value", F.lit(-1).cast("long")).alias("value"))

    def keys(self) -> DataFrame:
        """(value, key), to be read in the order of value."""
        return self._table.select("value", "key")

    def size(self) -> int:
        return self._table.count()


def relabel_ids(nodes: DataFrame, *, node: str = "node", order: str = "pos", batch: str | None = None) -> DataFrame:
    """(batch, node, local_id): nodes numbered in the order in which they first occur.

    `order` is a total order of the rows, kept as positions. Numbers are made
    from ranges of first positions: within a range, and over the ranges' counts.
    """
    by = [batch, node] if batch else [node]
    first = nodes.groupBy(*by).agg(F.min(order).alias("_first"))
    block = F.floor(F.col("_first") / (16 * RANGE_BUCKET))
    first = first.withColumn("_block", block)
    inside = W.partitionBy("_block").orderBy("_first")
    ranked = first.withColumn("_rank", F.row_number().over(inside) - 1)
    counts = first.groupBy("_block").agg(F.count("*").alias("_n"))
    base = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_block")) - F.col("_n")
    counts = counts.select("_block", base.alias("_base"))
    return ranked.join(counts, "_block").select(*by, (F.col("_base") + F.col("_rank")).cast("long").alias("local_id"))


def elementwise(op: str) -> "callable[[Column, Column], Column]":
    """The arithmetic behind `sampled`, for single columns."""
    return _BINARY[op]
