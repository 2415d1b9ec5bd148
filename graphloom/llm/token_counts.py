"""Operator 6: token counts of documents in flat token files, by scanning for separators.

A token file is a stream of ids without an index; each document ends in an
end-of-document id. It is read in blocks of fixed size, a range of bytes each,
so that no task has a whole file. In each block the separators are found at
once; the lengths of documents that lie within it follow. A document that goes
on over blocks is stitched together from the blocks' heads and tails by a prefix
scan over the blocks' summaries, in two levels: within spans of blocks, and over
the spans' totals. The lengths themselves never go through the scan.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import default_file, encoder
from .common import documents, ready

#: Ids in a block, and the type of an id in a file.
BLOCK, KIND = 1 << 18, "<u2"
#: The end-of-document id that most files of the 50k vocabulary use.
END = 50256
#: Blocks in a span of the prefix scan.
SPAN = 1024


def _store(uri: str) -> tuple[stores.FileSystem, str]:
    """The store of a URI, and the path in it, as tasks open them."""
    if uri.startswith(("/", "file:")):
        return stores.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return stores.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _hadoop(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _resolved(spark: SparkSession, uri: str) -> str:
    """Where a path lies once mounts (viewfs) are followed."""
    system, path = _hadoop(spark, uri)
    return system.resolvePath(path).toString()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, length) of the flat binary token files of a path, of any length.

    Spark lists the files, from any of its stores, without their content. Tasks
    open them through Arrow, at `at`: local and mounted files, viewfs that leads
    to them, s3, gs, abfs, and hdfs where libhdfs is installed.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").collect()
    return spark.createDataFrame([(r.path, _resolved(spark, r.path), r.length) for r in listed], "file string, at string, length long")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """(file, number, doc_id, length, end): writes the ids of `docs` (doc_id, text) to a flat file for each partition.

    A row per document, number counting from 0 in its file; length is that of the
    file in bytes up to the document's end. Each ends in the id `end`, the first
    beyond the vocabulary, since texts may hold the vocabulary's own separator.
    Each try of a task has a file of its own; only that of the try that
    succeeded is listed. So the list must be made once: checkpoint it.
    """

    def run(batches):
        from pyspark import TaskContext

        coder, context = encoder(vocabulary), TaskContext.get()
        end = len(coder.bytes_of)
        if end > np.iinfo(KIND).max:
            raise ValueError(f"the vocabulary's {end} ids don't fit {KIND}")
        at = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        out, number, length = None, 0, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    store, path = _store(at)
                    out = store.open_output_stream(path)
                sizes = []
                for text in batch.column("text").to_pylist():
                    ids = coder.encode(text)
                    out.write(np.append(ids, np.uint32(end)).astype(KIND).tobytes())
                    sizes.append(len(ids) + 1)
                n = len(sizes)
                lengths = length + np.cumsum(sizes) * np.dtype(KIND).itemsize
                yield pa.RecordBatch.from_arrays([pa.array([at] * n), pa.array(np.arange(number, number + n)), batch.column("doc_id"), pa.array(lengths), pa.array([end] * n, pa.int32())], ["file", "number", "doc_id", "length", "end"])
                number, length = number + n, int(lengths[-1])
        finally:
            if out is not None:
                out.close()

    return docs.select("doc_id", "text").mapInArrow(run, "file string, number long, doc_id long, length long, end int")


def scan_blocks(files: DataFrame, end: int = END, block: int = BLOCK, kind: str = KIND) -> DataFrame:
    """(file, block, n, ends, head, tail, lengths) of files (file, at, length in bytes), in blocks of so many ids.

    Of each block the ids, the separators, the ids before the first and after the
    last; lengths: the documents between two separators of the block. Without a
    separator head is all the block, and tail is 0. A task reads one block's
    range at a time, and none of its ids leave it. A file that ends within an id
    is refused.
    """
    wide = np.dtype(kind).itemsize
    size = block * wide
    n_blocks, n_bytes = files.agg(F.sum(F.ceil(F.col("length") / size)), F.sum("length")).first()
    # the blocks are dealt out one by one, so that a long file is many tasks' work
    tasks = max(1, min(n_blocks or 1, max(files.sparkSession.sparkContext.defaultParallelism, (n_bytes or 0) >> 26)))

    def scanned(file, at, b, length):
        store, path = _store(at)
        with store.open_input_file(path) as f:
            f.seek(b * size)
            body = f.read(min(size, length - b * size))
        if len(body) % wide:
            raise ValueError(f"{file} ends within an id")
        tokens = np.frombuffer(body, kind)
        at = np.flatnonzero(tokens == end)
        if len(at):
            return file, b, len(tokens), len(at), int(at[0]), len(tokens) - 1 - int(at[-1]), np.diff(at) - 1
        return file, b, len(tokens), 0, len(tokens), 0, np.zeros(0, np.int64)

    def run(batches):
        kinds = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64())]
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("file", "at", "block", "length")]):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(scanned(*row), kinds)], ["file", "block", "n", "ends", "head", "tail", "lengths"])

    last = F.ceil(F.col("length") / size).cast("long") - 1
    blocks = files.where("length > 0").select("file", "at", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return blocks.repartition(tasks, "file", "block").mapInArrow(run, "file string, block long, n long, ends long, head long, tail long, lengths array<long>")


def stitched(scanned: DataFrame, span: int = SPAN) -> DataFrame:
    """(file, block, first, open, last): the number of the document that is open at a block's start, its ids so far, and whether the block is the file's last.

    Running sums of ids and separators number the documents; what is open is the
    ids up to the block, less those up to the last separator before it. Both are
    made within spans of blocks and then over the spans' totals, so no window has
    more rows than a span or a file's spans.
    """
    numbers = scanned.select("file", F.floor(F.col("block") / span).alias("span"), "block", "n", "ends", "tail")
    inside = W.partitionBy("file", "span").orderBy("block")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    upto = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, 0))
    rows = numbers.withColumn("_upto", upto).withColumn("_closed", F.when(F.col("ends") > 0, F.col("_upto") - F.col("tail")))
    rows = rows.withColumn("_closed_before", F.max("_closed").over(before)).withColumn("_ends_before", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    totals = numbers.groupBy("file", "span").agg(F.sum("n").alias("_n"), F.sum("ends").alias("_ends"), F.max("block").alias("_top"))
    closed = rows.groupBy("file", "span").agg(F.max("_closed").alias("_closed_in"))
    along = W.partitionBy("file").orderBy("span")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    spans = totals.join(closed, ["file", "span"]).withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    spans = spans.withColumn("_at", F.col("_start") + F.col("_closed_in"))
    spans = spans.select(
        F.col("file").alias("_f"), F.col("span").alias("_s"), "_start", F.coalesce(F.sum("_ends").over(earlier), F.lit(0)).alias("_first"),
        F.coalesce(F.max("_at").over(earlier), F.lit(0)).alias("_closed_earlier"), F.max("_top").over(W.partitionBy("file")).alias("_last"),
    )
    rows = rows.join(spans, (F.col("file") == F.col("_f")) & (F.col("span") == F.col("_s")))
    closed_upto = F.coalesce(F.col("_start") + F.col("_closed_before"), F.col("_closed_earlier"))
    return rows.select("file", "block", (F.col("_first") + F.col("_ends_before")).alias("first"), (F.col("_start") + F.col("_upto") - F.col("n") - closed_upto).alias("open"), (F.col("block") == F.col("_last")).alias("last"))


def document_lengths(scanned: DataFrame, span: int = SPAN) -> DataFrame:
    """(file, number, n_tokens) of each document; number counts from 0 in the order of the file.

    A document that no separator ends is the file's last. The scan is read
    twice: checkpoint it.
    """
    offsets = stitched(scanned, span).select(F.col("file").alias("_f"), F.col("block").alias("_b"), "first", "open", "last")
    rows = scanned.join(offsets, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    whole = F.when(F.col("ends") > 0, F.concat(F.array(F.col("open") + F.col("head")), F.col("lengths"))).otherwise(F.array().cast("array<long>"))
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("n"))
    whole = F.when(F.col("last") & (left > 0), F.concat(whole, F.array(left))).otherwise(whole)
    return rows.select("file", "first", F.posexplode(whole).alias("_k", "n_tokens")).select("file", (F.col("first") + F.col("_k")).alias("number"), "n_tokens")


def token_counts(docs: DataFrame, vocabulary: str, block: int = BLOCK) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, n_tokens.

    The texts' ids are written to token files in the checkpoint folder; the files
    are read back by ranges, scanned and then removed, and the counts come from
    the scan alone. Documents are known by their number in their file, so rows
    that are alike, repeated rows and rows without an id each have their own
    count. A null text is empty and has no tokens; a very long one goes on over
    blocks. An empty table gives no rows. Other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    system, path = _hadoop(spark, folder)
    system.mkdirs(path)
    try:
        written = write_token_files(plain, _resolved(spark, folder), vocabulary).checkpoint()
        files = written.groupBy("file").agg(F.max("length").alias("length")).withColumn("at", F.col("file"))
        end = written.agg(F.max("end")).first()[0] or END
        scanned = scan_blocks(files, end, block).checkpoint()
    finally:
        system.delete(path, True)
    counts = document_lengths(scanned).select(F.col("file").alias("_f"), F.col("number").alias("_k"), "n_tokens")
    return written.join(counts, (F.col("file") == F.col("_f")) & (F.col("number") == F.col("_k"))).select("doc_id", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), default_file())
