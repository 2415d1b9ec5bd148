"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space, as the contracts define it: the bytes 0x20 and 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_U = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Makes sure that checkpoint() has a shared folder, and that Arrow batches are small.

    The folder is the cluster's (spark.checkpoint.dir); only on one machine, as in
    tests, a temporary one is made where that is unset.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def saved(df: DataFrame) -> DataFrame:
    """df as a compressed table in the checkpoint folder, which cuts its lineage. For rows that are too many to checkpoint as they are."""
    spark = ready(df.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder, compression="zstd")
    return spark.read.schema(df.schema).parquet(folder)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; all others are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column without nulls, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(offs):
        return np.zeros(0, np.uint8), offs if len(offs) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit changes every output bit about half of the time."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A pseudo-random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1


def window_hashes(raw: np.ndarray, log_width: int) -> np.ndarray:
    """Polynomial hashes of all windows of 2**log_width bytes: out[i] is that of raw[i : i + width].

    Built by doubling: two neighbouring windows make one of twice the width.
    """
    h = BYTE_VALUES[raw]
    for k in range(log_width):
        step = 1 << k
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * _U(pow(_BASE, step, 1 << 64)) + h[step:]
    return h


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of an edge list (a, b): the smallest node that can be reached.

    Large-star and small-star rounds over DataFrames, checkpointed each round;
    neither nodes nor edges come to the driver. Nodes without edges have no row.
    """
    ready(spark)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    size, weight = edges.agg(F.count("*"), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0))).first()
    while True:
        # large star: each neighbour above u points to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
        edges = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        joined = edges.join(least, F.col("u") == F.col("w"))
        edges = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
            .checkpoint()
        )
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0))).first()
        if (now[0], now[1]) == (size, weight):
            break
        size, weight = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
