"""A corpus from raw documents to tokens, in five stages.

1. toxicity: documents that the ordinal model rejects go.
2. exact: of documents that are equal without white space one stays.
3. near: of documents that the n-gram join connects, that with the smallest id stays.
4. mix: documents are repeated or left out so that sources near their target weights.
5. tokens: each document that is left is encoded, and decoded again.

Each stage reads what the one before has written; its own input is then removed.
All but the last return the columns of documents.

In all stages null texts count as empty, very long texts are taken whole, an
empty table gives no rows, and columns other than those of documents go, so
that their names clash with none. Rows that are alike in all are one document to
the stages that go by ids: exact leaves one of them; toxicity, mix and tokens
treat them alike. Ties are decided by the smallest id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, exact, mixing, ngram_join, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model trained on the labelled ones rejects. Without labels all stay; empty texts stay."""
    model = toxicity.train(docs, common.labels(spark, sf_dir))
    return toxicity.severity(docs, model, COLUMNS).where("not rejected").select(*COLUMNS)


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that the exact operator keeps: the longest, then that of the smallest id. Empty texts are equal; a row without an id gives way."""
    groups = exact.exact_groups(docs).select(F.col("doc_id").alias("_id"), "kept", "text_sha256").checkpoint()
    by_id = groups.groupBy("_id").agg(F.max("kept").alias("_any"), F.count("*").alias("_n"))
    gone = by_id.where("not _any").select("_id")
    left = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*COLUMNS)
    several = by_id.where("_any and _n > 1").select("_id")
    if several.isEmpty():
        return left
    # Some ids (or none at all) stand for several rows: of these the rows of kept texts stay, the longest of each.
    alone = left.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    rows = left.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    rows = rows.withColumn("_sha", F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), common.SPACE_CLASS, ""), 256))
    kept = groups.where("kept").select(F.col("_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).distinct()
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha")), "left_semi")
    first = W.partitionBy("doc_id", "_sha").orderBy(F.length("text").desc_nulls_last())
    rows = rows.withColumn("_turn", F.row_number().over(first)).where("_turn = 1")
    return alone.unionByName(rows.select(*COLUMNS))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram join the document with the smallest id. Documents without an id stay."""
    others = ngram_join.components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(others, F.col("doc_id") == F.col("_id"), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without words aren't taken or left; they stay once."""
    taken = mixing.mix_sources(docs).select(F.col("doc_id").alias("_id"), F.when(F.col("size") == 0, 1).otherwise((F.col("taken") / F.col("size")).cast("int")).alias("times"))
    times = taken.groupBy("_id").agg(F.max("times").alias("_times")).where("_times > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("_times")))
    return docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_copy", copies).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, as often as it is in the mix."""
    return bpe.round_trip(docs, bpe.default_file())


STAGES = [("toxicity", drop_toxic), ("exact", drop_equal), ("near", drop_near), ("mix", mix), ("tokens", tokens)]

#: A trained model and an encoder aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written to the shared folder and read again."""
    common.ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
