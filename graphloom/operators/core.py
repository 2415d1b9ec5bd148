"""Shared building blocks: dense axes, CSR ranges, keyed randomness.

Rows carry their position explicitly. Every function is lazy unless it says
otherwise, and returns a new DataFrame.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions per bucket of a range join.
RANGE_BUCKET = 4096

#: Keys per block in which a group's rows are numbered.
NUMBER_BLOCK = 1 << 16

#: A table with at most so many rows and bytes may be broadcast whole.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Makes sure checkpoint() has a folder: the cluster's shared one. On one machine, as in tests, a temporary one where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return spark


def kept(df: DataFrame) -> DataFrame:
    """df as a compressed table in the checkpoint folder, which cuts its lineage. For rows that are too many to checkpoint as they are."""
    spark = ready(df.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def extent(df: DataFrame, index: str) -> int:
    """max(index) + 1, or 0 for an empty table. One small job."""
    top = df.agg(F.max(index)).first()[0]
    return 0 if top is None else int(top) + 1


def axis(df: DataFrame, size: int, index: str, keys: Sequence[str] = ()) -> DataFrame:
    """The dense axis 0..size-1, for every combination of `keys` that occurs in df."""
    line = df.sparkSession.range(size).select(F.col("id").alias(index))
    return df.select(*keys).distinct().crossJoin(line) if keys else line


def densify(reduced: DataFrame, line: DataFrame, on: Sequence[str], fill: dict[str, object]) -> DataFrame:
    """Left-joins the reduced rows to the dense axis; buckets without rows get the fill values."""
    joined = line.join(reduced, list(on), "left")
    filled = [F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)).alias(c) if (v := fill.get(c)) is not None else F.col(c) for c in joined.columns]
    return joined.select(*filled)


def ranges_from_ptr(ptr: DataFrame, row: str = "r", offset: str = "offset") -> DataFrame:
    """(r, start, stop) of a CSR pointer table (r, offset): row r is [offset[r], offset[r + 1]). An equi-join, no global window."""
    after = ptr.select((F.col(row) - 1).alias(row), F.col(offset).alias("stop"))
    return ptr.select(row, F.col(offset).alias("start")).join(after, row)


def ptr_from_counts(counts: DataFrame, row: str, count: str) -> DataFrame:
    """CSR pointers of dense rows 0..R-1 with their counts.

    Running sums are made in blocks of rows and then over the blocks, so that
    no task sees more than a block's rows or the blocks' totals.
    """
    from pyspark.sql import Window as W

    block = F.floor(F.col(row) / RANGE_BUCKET)
    inside = W.partitionBy("_block").orderBy(row).rowsBetween(W.unboundedPreceding, 0)
    rows = counts.select(row, F.col(count).alias("_n"), block.alias("_block")).withColumn("_upto", F.sum("_n").over(inside))
    totals = rows.groupBy("_block").agg(F.sum("_n").alias("_t"))
    totals = totals.select("_block", (F.sum("_t").over(W.partitionBy(F.lit(0)).orderBy("_block")) - F.col("_t")).alias("_base"))
    ends = rows.join(totals, "_block").select((F.col(row) + 1).alias(row), (F.col("_base") + F.col("_upto")).alias("offset"))
    first = counts.sparkSession.range(1).select(F.lit(0).cast("long").alias(row), F.lit(0).cast("long").alias("offset"))
    return first.unionByName(ends)


def number_within(rows: DataFrame, by: Sequence[str], key: str, name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... within each group of `by`, in the order of the whole-number key, which has no ties in a group.

    A group is numbered in blocks of NUMBER_BLOCK neighbouring keys side by side,
    and over the blocks' counts, so that a hub isn't one task. Groups or keys
    that are null are left out.
    """
    from pyspark.sql import Window as W

    blocked = rows.withColumn("_block", F.floor(F.col(key) / NUMBER_BLOCK))
    counts = blocked.groupBy(*by, "_block").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(*by).orderBy("_block")) - F.col("_c")
    bases = counts.select(*by, "_block", before.alias("_base"))
    inside = F.row_number().over(W.partitionBy(*by, "_block").orderBy(key)) - 1
    return blocked.withColumn("_in", inside).join(bases, [*by, "_block"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_block", "_base", "_in")


def assign_ranges(elements: DataFrame, ranges: DataFrame, pos: str = "pos", row: str = "r") -> DataFrame:
    """Adds the range (row, start, stop) that holds each element's position; elements in no range are left out.

    A range join done as an equi-join on buckets of positions: each range is
    listed once for each bucket it touches.
    """
    full = ranges.where("stop > start")
    first, last = F.floor(F.col("start") / RANGE_BUCKET), F.floor((F.col("stop") - 1) / RANGE_BUCKET)
    listed = full.withColumn("_bucket", F.explode(F.sequence(first, last)))
    placed = elements.withColumn("_bucket", F.floor(F.col(pos) / RANGE_BUCKET))
    inside = (F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("stop"))
    return placed.join(listed, "_bucket").where(inside).drop("_bucket")


def csr_to_edges(ptr: DataFrame, col: DataFrame) -> DataFrame:
    """(edge_id, src, dst) of a CSR graph: ptr(r, offset) and col(pos, dst). The edge id is the position in col."""
    return assign_ranges(col, ranges_from_ptr(ptr)).select(F.col("pos").alias("edge_id"), F.col("r").alias("src"), "dst")


def edges_to_csr(edges: DataFrame, num_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(ptr, col) of an edge list ordered by (src, edge_id)."""
    from pyspark.sql import Window as W

    counts = edges.groupBy("src").agg(F.count("*").alias("n"))
    line = edges.sparkSession.range(num_nodes).select(F.col("id").alias("src"))
    dense = line.join(counts, "src", "left").select("src", F.coalesce("n", F.lit(0)).alias("n"))
    ptr = ptr_from_counts(dense, "src", "n").withColumnRenamed("src", "r")
    rank = F.row_number().over(W.partitionBy("src").orderBy("edge_id")) - 1
    col = edges.withColumn("_k", rank).join(ptr, F.col("src") == F.col("r")).select((F.col("offset") + F.col("_k")).alias("pos"), "dst", "edge_id")
    return ptr, col


def keyed_bits(seed: int | str, *keys: str | Column) -> Column:
    """A pseudo-random whole number in [0, 2**32) that depends on the seed and the keys alone.

    The first 8 hexadecimal digits of an MD5, so that SQL can make the same.
    """
    parts = [k if isinstance(k, Column) else F.col(k) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def keyed_uniform(seed: int | str, *keys: str | Column) -> Column:
    """A pseudo-random number in (0, 1), see keyed_bits."""
    return (keyed_bits(seed, *keys) + 1) / F.lit(4294967297.0)


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 has it: division by zero gives an infinity or NaN, not an error."""
    zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def floor_divide(a: Column, b: Column) -> Column:
    """Whole-number division rounded down."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows and, by the sizes of its arrays and strings, `most_bytes` (one small job), else as it is."""
    wide = [c.name for c in df.schema.fields if isinstance(c.dataType, (T.ArrayType, T.StringType, T.BinaryType))]
    size = lambda c: F.size(c) * 8 if isinstance(df.schema[c].dataType, T.ArrayType) else F.octet_length(c)
    width = reduce(lambda a, b: a + b, [F.coalesce(size(c), F.lit(0)) for c in wide], F.lit(16 * len(df.columns)))
    n, total = df.limit(most + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if n <= most and (total or 0) <= most_bytes else df
