"""Operator 7: shards under a byte limit by extendible hashing.

A directory is indexed by the first bits of a document's hash. A bucket whose
documents have more bytes than the limit is split on one more bit, and only
such a bucket, until every one fits. Documents don't move for it: splits are
made on sums of bytes by prefix, which are tables too.

The bytes under a prefix are no less than those under a longer one. So a
document's bucket is its shortest prefix whose bytes fit, and all buckets are
found at once: each fine prefix adds its bytes to all prefixes it begins with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, ready

LIMIT = 32 << 20
#: Bits of a hash; prefixes are looked at so many more bits at a time.
BITS, STEP = 52, 4
#: Bits by which buckets are dealt out to be numbered.
DEAL = 10


def _prefix(hash_: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hash_, BITS - bits) if bits else F.lit(0).cast("long")


def hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, hash) of `docs` (doc_id, text), checkpointed: BITS bits of a hash of id, text and turn.

    Rows that are alike in id and text take turns, so they can be told apart.
    Turns are counted within a task's rows and over the tasks' numbers; which of
    such rows has which turn is all one.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.lit("|"), text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), name.alias("name"), F.spark_partition_id().alias("task")).checkpoint()
    alike = rows.groupBy("name", "task").agg(F.count("*").alias("_n"))
    several = alike.groupBy("name").agg(F.sum("_n").alias("_m")).where("_m > 1").select(F.col("name").alias("_name"))
    by_task = W.partitionBy("name").orderBy("task")
    offsets = alike.join(several, F.col("name") == F.col("_name"), "left_semi").select(F.col("name").alias("_name"), F.col("task").alias("_task"), (F.sum("_n").over(by_task) - F.col("_n")).alias("_before"))
    mine = (F.col("name") == F.col("_name")) & (F.col("task") == F.col("_task"))
    inside = W.partitionBy("name", "task").orderBy("name")
    repeated = rows.join(offsets, mine).withColumn("turn", F.col("_before") + F.row_number().over(inside) - 1)
    single = rows.join(several, F.col("name") == F.col("_name"), "left_anti").withColumn("turn", F.lit(0).cast("long"))
    both = single.select("doc_id", "n_bytes", "name", "turn").unionByName(repeated.select("doc_id", "n_bytes", "name", "turn"))
    digits = F.substring(F.md5(F.concat_ws("|", "name", F.col("turn").cast("string"))), 1, BITS // 4)
    return both.select("doc_id", "n_bytes", F.conv(digits, 16, 10).cast("long").alias("hash")).checkpoint()


def directory(sizes: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """(buckets (prefix, bits, bytes), [(depth, (fine, prefix, bits) for prefixes of that depth)]), from sizes (hash, n_bytes).

    Sums are taken for prefixes of enough bits for buckets of the limit, and of
    STEP more for those that are still too large. Prefixes are a few for each
    bucket. A bucket of one row isn't split and may exceed the limit.
    """
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, (-(-total // limit) - 1).bit_length() + 2))
    from_bits, rest, found, places = 0, sizes, [], []
    while True:
        sums = rest.groupBy(_prefix(F.col("hash"), depth).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).checkpoint()
        steps = F.explode(F.sequence(F.lit(from_bits), F.lit(depth))).alias("bits")
        above = sums.select("fine", "b", "n", steps).select("fine", "b", "n", "bits", F.expr(f"shiftright(fine, {depth} - bits)").alias("prefix"))
        nodes = above.groupBy("bits", "prefix").agg(F.sum("b").alias("bytes"), F.sum("n").alias("n"))
        # a node that fits, or can't be split, under one that doesn't fit
        fits = (F.col("bytes") <= limit) | (F.col("n") == 1) | (F.col("bits") == BITS)
        leaves = nodes.where(fits).select(F.col("bits").alias("_bits"), F.col("prefix").alias("_prefix"))
        below = above.join(leaves, (F.col("bits") == F.col("_bits")) & (F.col("prefix") == F.col("_prefix")))
        placed = below.groupBy("fine").agg(F.min(F.struct("bits", "prefix")).alias("x"), F.first("b").alias("b")).select("fine", "b", "x.prefix", "x.bits").checkpoint()
        found.append(placed.groupBy("prefix", "bits").agg(F.sum("b").alias("bytes")))
        places.append((depth, placed.select("fine", "prefix", "bits")))
        deeper = sums.join(placed.select(F.col("fine").alias("_fine")), F.col("fine") == F.col("_fine"), "left_anti").select(F.col("fine").alias("_fine"))
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, found), places
        rest = rest.join(deeper, _prefix(F.col("hash"), depth) == F.col("_fine"), "left_semi")
        from_bits, depth = depth + 1, min(BITS, depth + STEP)


def numbered(buckets: DataFrame) -> DataFrame:
    """The buckets with `shard`, their number in the order of their prefixes: counted in groups by first bits, and over the groups."""
    start = F.expr(f"shiftleft(prefix, {BITS} - bits)")
    rows = buckets.withColumn("_start", start).withColumn("_group", _prefix(F.col("_start"), DEAL))
    groups = rows.groupBy("_group").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_group")) - F.col("_n")  # at most 2**DEAL rows
    groups = groups.select(F.col("_group").alias("_g"), before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_group").orderBy("_start"))
    return rows.withColumn("_k", inside).join(groups, F.col("_group") == F.col("_g")).select("prefix", "bits", "bytes", (F.col("_before") + F.col("_k") - 1).alias("shard"))


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, n_bytes, shard, prefix, bits, shard_bytes.

    shard numbers the buckets in the order of their prefixes; prefix is written
    in binary digits. The hash is of the id, the text and, for rows alike in
    both, their turn, so all can be told apart; a text longer than the limit has
    a shard of its own, which exceeds it (shard_bytes says so). Null and empty texts have 0 bytes. An empty table gives no rows.
    Other columns are ignored.
    """
    ready(docs.sparkSession)
    sizes = hashes(docs)
    buckets, places = directory(sizes, limit)
    names = numbered(buckets).select(F.col("prefix").alias("_prefix"), F.col("bits").alias("_bits"), "bytes", "shard").checkpoint()
    out, rest = [], sizes
    for depth, fine in places:
        table = fine.join(names, (F.col("prefix") == F.col("_prefix")) & (F.col("bits") == F.col("_bits"))).select("fine", "prefix", "bits", "bytes", "shard")
        mine = rest.withColumn("_fine", _prefix(F.col("hash"), depth))
        out.append(mine.join(table, F.col("_fine") == F.col("fine")))
        rest = mine.join(table, F.col("_fine") == F.col("fine"), "left_anti").drop("_fine")
    digits = F.when(F.col("bits") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("bits"), F.lit("0")))
    return reduce(DataFrame.unionByName, out).select("doc_id", "n_bytes", "shard", digits.alias("prefix"), F.col("bits").cast("int").alias("bits"), F.col("bytes").alias("shard_bytes"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))


OP7_SQL = f"""
WITH a AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, md5(coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(text, '')) AS name FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY name) - 1 AS turn FROM a),
c AS (SELECT *, ('0x' || substr(md5(name || '|' || turn), 1, {BITS // 4}))::BIGINT AS h FROM b),
n AS (
  SELECT c.*, bits, h >> ({BITS} - bits) AS p, sum(n_bytes) OVER (PARTITION BY bits, h >> ({BITS} - bits))::BIGINT AS shard_bytes,
         count(*) OVER (PARTITION BY bits, h >> ({BITS} - bits)) AS own
  FROM c, (SELECT unnest(range({BITS + 1}))::INTEGER AS bits)),
o AS (
  SELECT * FROM n WHERE shard_bytes <= {LIMIT} OR own = 1 OR bits = {BITS} QUALIFY row_number() OVER (PARTITION BY name, turn ORDER BY bits) = 1)
SELECT doc_id, n_bytes, (dense_rank() OVER (ORDER BY p << ({BITS} - bits)) - 1)::BIGINT AS shard,
       CASE WHEN bits = 0 THEN '' ELSE lpad(bin(p), bits, '0') END AS prefix, bits, shard_bytes
FROM o
"""
