"""Operator 3: mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a keyed random order, repeated up
to `most` times. The n-th item of a queue gets a virtual finish time: the
source's words up to and with it, divided by the source's target. Items are
merged in the order of finish times and cut where the budget of words is used.

Only DataFrame functions. A source with a third of all rows isn't one task:
running sums are made in two levels, within random slots of a source and
across the slots' totals. The cut is found from totals by range of finish
time; rows are ordered exactly only in the range where the budget ends. Slots
and ranges get more with the rows, so that one holds about as many at any size.
Sources may be many, too: they are ordered in ranges and over the ranges' totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_CLASS, documents, ready

#: Target weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Each source's rows are dealt to 2**SLOT_BITS slots, and finish times to RANGES ranges; to more where there are more than so many rows for each.
SLOT_BITS, RANGES, SLOT_ROWS = 10, 4096, 1 << 16
#: Bits of a key by which slots are told apart.
KEY_BITS = 52


def _with_sums_before(rows: DataFrame, order: list, sums: list[str]) -> DataFrame:
    """rows with `_nth` (0, 1, ...) and, for each named column c, `_before_c`: its sum over the rows before in this order, which has no ties.

    Rows are put in ranges, numbered and added up in each side by side, and over
    the ranges' totals, of which there are no more than shuffle partitions.
    """
    ranged = rows.withColumn("_one", F.lit(1).cast("long")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    added = {"_one": "_nth", **{c: f"_before_{c}" for c in sums}}
    by_part = W.partitionBy(F.lit(0)).orderBy("_part")
    totals = ranged.groupBy(F.col("_part").alias("_part")).agg(*[F.sum(c).alias(c) for c in added])
    totals = totals.select(F.col("_part").alias("_p"), *[(F.sum(c).over(by_part) - F.col(c)).alias(f"_base_{c}") for c in added])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    upto = ranged.select(*rows.columns, "_part", *[(F.sum(c).over(inside) - F.col(c)).alias(name) for c, name in added.items()])
    return upto.join(totals, F.col("_part") == F.col("_p")).select(*rows.columns, *[(F.col(f"_base_{c}") + F.col(name)).alias(name) for c, name in added.items()])


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Targets share the total of all sizes by weight; none exceeds `most` times
    its source's size, what is above goes to the others by weight. The level at
    which that ends is found in one pass over the sources in the order of their
    limit per weight. A row per source; null is the last source.
    """
    n = len(weights)
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = _with_sums_before(sources, by_name, []).withColumn("_k", F.col("_nth") % n)
    weight = F.lit(float(weights[n - 1]))
    for k in range(n - 1):
        weight = F.when(F.col("_k") == k, F.lit(float(weights[k]))).otherwise(weight)
    ranked = ranked.select("source", "source_size", weight.alias("_w"), (F.col("source_size").cast("double") * most).alias("_cap")).withColumn("_limit", F.col("_cap") / F.col("_w"))
    ranked = _with_sums_before(ranked, ["_limit", *by_name], ["_cap", "_w"])
    ranked = ranked.crossJoin(F.broadcast(sources.agg(F.sum("source_size").alias("_total"))))  # one row
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.sum("_w").alias("_all_w"))))
    level = (F.col("_total") - F.col("_before__cap")) / (F.col("_all_w") - F.col("_before__w"))
    ranked = ranked.withColumn("_level", level).withColumn("_capped", F.col("_limit") <= F.col("_level"))
    final = ranked.agg(F.min(F.when(~F.col("_capped"), F.struct("_limit", "_level")))["_level"].alias("_final"))
    ranked = ranked.crossJoin(F.broadcast(final))
    return ranked.select("source", "source_size", F.when(F.col("_capped") | F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_final"))).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """A row per row of `docs` (doc_id, text, source): doc_id, size, source_size, target, taken.

    size: the text's words (null or empty: 0). taken: words of it in the mix,
    copies counted, so a multiple of size up to `most` times. An empty table
    gives no rows; a source of only empty texts has target 0. Rows that are
    alike in id, source and size may be swapped with each other, which leaves
    the same result. Other columns of `docs` are ignored.
    """
    spark = ready(docs.sparkSession)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_CLASS)).cast("long").alias("size"),
    )
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    sized = sized.withColumn("_key", key).checkpoint()  # the texts are read once; what follows has a few numbers a row
    more = max(0, -(-sized.count() // SLOT_ROWS) - 1).bit_length()  # 2**more times SLOT_ROWS rows
    # A queue's order is by four digits of the key modulo 2**10, then by the key. Slots are the first bits of that order.
    digits = F.conv(F.substring("_key", 1, KEY_BITS // 4), 16, 10).cast("long")
    low = KEY_BITS - 16
    in_order = F.shiftleft(F.shiftright(digits, low) % 1024, KEY_BITS - 10) + F.shiftleft(F.shiftright(digits, low + 10), low) + digits % (1 << low)
    sized = sized.withColumn("_slot", F.shiftright(in_order, KEY_BITS - min(KEY_BITS, max(SLOT_BITS, more))))
    ranges_of_time = max(RANGES, 1 << more)
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).checkpoint()
    slots = sized.groupBy("source", "_slot").agg(F.sum("size").alias("_sum"))
    # a slot for some 2**16 rows at most
    offset = F.sum("_sum").over(W.partitionBy("source").orderBy("_slot")) - F.col("_sum")
    slots = slots.select(F.col("source").alias("_s"), F.col("_slot").alias("_t"), offset.alias("_offset"))
    plan = plan.select(F.col("source").alias("_p"), "source_size", "target")
    slots = slots.join(plan, F.col("_s").eqNullSafe(F.col("_p")))
    placed = sized.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slot") == F.col("_t")))
    inside = W.partitionBy("source", "_slot").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.select("doc_id", "source", "_key", "size", "source_size", "target", (F.col("_offset") + F.sum("size").over(inside)).alias("_reach"))
    placed = placed.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    turn = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    items = placed.where("size > 0").select("_row", "_key", "doc_id", "source", "size", "source_size", "target", "_reach", turn.alias("_turn"))
    items = items.withColumn("_finish", (F.col("_turn") * F.col("source_size") + F.col("_reach")) / F.col("target"))
    # No item is needed that finishes long after its source has had its target.
    items = items.withColumn("_range", F.least(F.lit(2 * ranges_of_time), F.floor(F.col("_finish") * ranges_of_time)).cast("long"))
    ranges = items.groupBy("_range").agg(F.sum("size").alias("_sum"))
    reach = F.sum("_sum").over(W.partitionBy(F.lit(0)).orderBy("_range"))
    ranges = ranges.select("_range", "_sum", reach.alias("_upto"))
    budget = sized.agg(F.sum("size").alias("_budget"))
    cut = ranges.crossJoin(F.broadcast(budget)).where("_upto > _budget").agg(
        F.min(F.struct("_range", (F.col("_budget") - F.col("_upto") + F.col("_sum")).alias("_left"))).alias("_c")
    ).select(F.coalesce("_c._range", F.lit(1 << 62)).alias("_at"), F.coalesce("_c._left", F.lit(0)).alias("_left"))
    items = items.crossJoin(F.broadcast(cut))  # one row
    sure = items.where("_range < _at").select("_row")
    by_time = W.partitionBy("_range").orderBy("_finish", F.col("source").isNull(), "source", "_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    last = items.where("_range = _at").withColumn("_used", F.sum("size").over(by_time)).where("_used <= _left").select("_row")
    times = sure.unionByName(last).groupBy("_row").agg(F.count("*").alias("_times")).withColumnRenamed("_row", "_r")
    return placed.join(times, F.col("_row") == F.col("_r"), "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("_times", F.lit(0))).alias("taken")
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || doc_id) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, (SELECT sum(source_size)::DOUBLE FROM s) AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN cap / w <= level THEN cap
              ELSE least(cap, w * (SELECT arg_min(level, cap / w) FROM l WHERE cap / w > level)) END AS target FROM l),
p AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(k, 1, 4))::BIGINT % 1024, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS reach
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY (turn * source_size + reach)::DOUBLE / target, source NULLS LAST, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS used
  FROM p, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0),
n AS (SELECT doc_id, count(*) AS times FROM i WHERE used <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(n.times, 0))::BIGINT AS taken
FROM p LEFT JOIN n ON p.doc_id = n.doc_id
"""
