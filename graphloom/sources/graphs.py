"""Graph files and helpers: compressed sparse matrices, heterogeneous dictionaries, the folder for downloads."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_home: str | None = None


def get_home_dir() -> str:
    """The folder for cached files: what set_home_dir set, else $GRAPHLOOM_HOME, else ~/.cache/graphloom."""
    return _home or os.environ.get("GRAPHLOOM_HOME") or os.path.join(os.path.expanduser("~"), ".cache", "graphloom")


def set_home_dir(path: str) -> None:
    global _home
    _home = path


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """edges(edge_id, src, dst, weight) of a sparse matrix in coordinate text format, 0-based, in (src, dst) order of ids.

    Comment lines and the line of sizes are left out. Symmetric files list one half, and both directions are made.
    """
    lines = spark.read.text(path)
    head = lines.where("value like '%%MatrixMarket%'").select(F.lower("value")).first()
    symmetric = head is not None and "symmetric" in head[0]
    pattern = head is not None and "pattern" in head[0]
    body = lines.where("value not like '\\%%' and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    weight = F.lit(1.0) if pattern else F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(1.0))
    entries = body.select((F.col("p")[0].cast("long") - 1).alias("src"), (F.col("p")[1].cast("long") - 1).alias("dst"), weight.alias("weight"), F.size("p").alias("n"))
    if pattern:
        entries = entries.where("n = 2")  # the sizes have three numbers
    else:
        sizes = lines.where("value not like '\\%%' and trim(value) <> ''").select("value").first()
        rows, cols, count = (int(x) for x in sizes[0].split()[:3])
        entries = entries.where(~((F.col("src") == rows - 1) & (F.col("dst") == cols - 1) & (F.col("weight") == float(count)))) if count > max(rows, cols) else entries.where("n >= 2")
    if symmetric:
        entries = entries.unionByName(entries.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "n"))
    from ..operators.order import index_sort

    width = entries.agg(F.max("dst")).first()[0]
    keyed = entries.select((F.col("src") * F.lit(int(width or 0) + 1) + F.col("dst")).alias("val"), "weight")
    ranks = index_sort(keyed.select("val").distinct().select("val", F.col("val").alias("pos")))
    return keyed.join(ranks, "val").select(F.col("rank").alias("edge_id"), F.floor(F.col("val") / F.lit(int(width or 0) + 1)).alias("src"), F.pmod("val", F.lit(int(width or 0) + 1)).alias("dst"), "weight")


def write_graph(edges: DataFrame, path: str) -> None:
    """Writes edges as Parquet, sorted within files by source so that scans can skip."""
    edges.sortWithinPartitions("src", "edge_id").write.mode("overwrite").parquet(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def hetero_edges(table: DataFrame) -> dict[tuple[str, str, str], DataFrame]:
    """A dictionary by edge type of one table with a column etype, "source__relation__destination"."""
    kinds = sorted(r[0] for r in table.select("etype").distinct().collect())  # a schema's few names
    return {tuple(k.split("__")): table.where(F.col("etype") == k).drop("etype") for k in kinds}


def remap_keys(mapping: Mapping, names: Mapping) -> dict:
    """The mapping with its keys renamed; keys without a new name stay."""
    return {names.get(k, k): v for k, v in mapping.items()}
