"""Reading the tables that the queries run on, and views of them as elements, points and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.core import ptr_from_counts, ready
from ..operators.order import index_sort


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as elements: position = order, index = customer, value = price."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("idx"), F.col("o_totalprice").alias("val"))


def event_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as elements: position = event, index = user, value = value / 100."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("idx"), (F.col("value") / 100).alias("val"))


def points(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """Embeddings as points (id, pos, label), of all or the first dimensions."""
    pos = F.col("embedding") if dims is None else F.slice("embedding", 1, dims)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), pos.alias("pos"), F.col("label").cast("long").alias("label"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph customer to order: edge id = order, with the order's date and price."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderdate").alias("etime"), F.col("o_totalprice").alias("weight")
    )


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph on the embeddings' ids: edges 4i + j from i to i + 1, i + 7, i - 1, i - 7, modulo their number."""
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    steps = F.posexplode(F.array(*[F.lit(s) for s in (1, 7, -1, -7)])).alias("j", "s")
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src")).crossJoin(F.broadcast(n))  # one row
    return ids.select("src", "n", steps).select((F.col("src") * 4 + F.col("j")).alias("edge_id"), "src", F.pmod(F.col("src") + F.col("s"), F.col("n")).alias("dst"))


def conversation_ptr(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as elements (pos, val = length of the text), and the pointers of conversations with an empty range after each."""
    ready(spark)
    turns = table(spark, sf_dir, "conversations")
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n")).checkpoint()
    ranks = index_sort(counts.select(F.col("conv_id").alias("val"), F.col("conv_id").alias("pos")))
    dense = ranks.select(F.col("rank").alias("c"), F.col("val").alias("conv_id")).join(counts, "conv_id").checkpoint()
    starts = ptr_from_counts(dense, "c", "n").checkpoint()
    own = dense.join(starts.withColumnRenamed("offset", "start"), "c")
    inside = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    elements = turns.withColumn("_k", inside).join(own, "conv_id").select((F.col("start") + F.col("_k")).alias("pos"), F.length("text").cast("long").alias("val"))
    both = F.array(F.struct((F.col("c") * 2).alias("r"), F.col("start").alias("offset")), F.struct((F.col("c") * 2 + 1).alias("r"), (F.col("start") + F.col("n")).alias("offset")))
    end = starts.agg((F.max("c") * 2).alias("r"), F.max("offset").alias("offset"))
    return elements, own.select(F.explode(both).alias("x")).select("x.r", "x.offset").unionByName(end)
