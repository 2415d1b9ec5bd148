"""Operator 5: exact duplicates by content-defined chunk recipes.

A text without its white space is cut into chunks where a rolling hash of the
last 32 bytes says so. A text's recipe is the ordered list of its chunks'
identifiers, about a hundredth of the text. Identifiers are verified: each
distinct chunk is moved once, and if two different chunks have one identifier,
all is done again with wider identifiers. Then equal recipes are equal texts,
and only recipes are compared; long texts aren't moved again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, documents, ready, spans, window_hashes

#: Bytes: the shortest chunk, the longest; a cut is expected every AVERAGE bytes after the shortest.
SHORTEST, AVERAGE, LONGEST = 512, 2048, 16384
_WINDOW_LOG = 5
#: Bytes whose rolling hashes, 8 bytes each, are in memory at once.
PIECE = 1 << 19


def cuts(raw: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text raw[offsets[i] : offsets[i + 1]] the ends of its chunks within it."""
    width, found = 1 << _WINDOW_LOG, [np.zeros(0, np.int64)]
    for at in range(0, len(raw), PIECE):
        hashes = window_hashes(raw[at : at + PIECE + width - 1], _WINDOW_LOG)
        found.append(np.flatnonzero(hashes >> np.uint64(40) & np.uint64(AVERAGE - 1) == 0) + at + width)
    marks = np.concatenate(found)
    firsts = np.searchsorted(marks, offsets)
    out = []
    for i in range(len(offsets) - 1):
        start, end = int(offsets[i]), int(offsets[i + 1])
        own, last, ends = marks[firsts[i] : firsts[i + 1]].tolist() if end - start > SHORTEST else [], start, []
        for at in own:
            while at - last > LONGEST:
                last += LONGEST
                ends.append(last - start)
            if at - last >= SHORTEST:
                last = at
                ends.append(last - start)
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last - start)
        if end > last:
            ends.append(end - start)
        out.append(ends)
    return out


def _chunked(batch: pa.RecordBatch):
    """For each row its text without white space and the chunks of that."""
    raw, offsets = spans(batch.column("text"))
    whole = raw.tobytes()
    plain = [whole[a:b].translate(None, SPACE_BYTES) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    joined = np.frombuffer(b"".join(plain), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in plain])]).astype(np.int64)
    for text, ends in zip(plain, cuts(joined, starts)):
        yield text, [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _identifier(chunk: bytes, width: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def recipes(docs: DataFrame, width: int = 8) -> DataFrame:
    """doc_id, n_chars, recipe (identifiers of `width` bytes, joined), text_sha256."""

    def run(batches):
        for batch in batches:
            lists, sha = [], []
            for text, chunks in _chunked(batch):
                lists.append(b"".join(_identifier(c, width) for c in chunks))
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(lists, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "n_chars", "recipe", "text_sha256"])

    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.char_length("text").cast("long"))
    return plain.mapInArrow(run, "doc_id long, n_chars long, recipe binary, text_sha256 string")


def chunk_table(docs: DataFrame, width: int = 8) -> DataFrame:
    """(id, chunk): the distinct chunks of all texts. Equal chunks are merged before and after they are moved."""

    def run(batches):
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            for _, chunks in _chunked(batch):
                for c in chunks:
                    seen.setdefault(c, _identifier(c, width))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.binary()), pa.array(list(seen), pa.binary())], ["id", "chunk"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "id binary, chunk binary").groupBy("id", "chunk").agg(F.lit(1).alias("_"))


def verified(docs: DataFrame, width: int) -> bool:
    """Whether no two different chunks have one identifier."""
    twice = chunk_table(docs, width).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return twice.isEmpty()


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of the texts that are equal without white space, that with the most code
    points stays, then that with the smallest doc_id (null last, whose keep_id
    is null), then any one of rows alike in both. Null and empty texts are equal
    to each other. An empty table gives no rows. Other columns are ignored.
    """
    ready(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = next((w for w in (8, 16, 32, 64) if verified(plain, w)), None)
    if width is None:
        raise ValueError("two chunks with the same 512-bit identifier")
    rows = recipes(plain, width).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("i"), (-F.col("row")).alias("r"))).alias("best")
    groups = rows.groupBy("recipe").agg(best, F.count("*").alias("group_size"), F.first("text_sha256").alias("sha"))
    groups = groups.select(F.col("recipe").alias("_recipe"), F.col("sha").alias("_sha"), (-F.col("best.i")).alias("keep_id"), (-F.col("best.r")).alias("keep_row"), "group_size")
    # Joined by two columns, so that both sides are dealt out for the join itself and a hot recipe can be split.
    joined = rows.join(groups, (F.col("recipe") == F.col("_recipe")) & (F.col("text_sha256") == F.col("_sha")))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r
"""
