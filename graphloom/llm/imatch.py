"""Operator 2: document fingerprints by I-Match, with DataFrame functions only.

Terms are the text's lower-cased words. The lexicon holds the terms whose share
of documents lies in a band: terms that nearly all documents have say nothing,
and rare ones change with any edit. The distinct lexicon terms of a text,
sorted, are hashed as a whole and once for each of several random subsets of
the lexicon: a subset's hash stays if the edit touched none of its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, ready

#: The band: shares of all documents that have the term.
LEAST_SHARE, MOST_SHARE = 1 / 2048, 1 / 8
#: A lexicon of so many terms, 8 MB, is broadcast; a larger one is joined by shuffling. Its terms are in so large a share of
#: the documents that there are at most the mean number of distinct terms of a document / LEAST_SHARE, however many documents.
BROADCAST_TERMS = 1 << 20
#: Subsets: for each tier the share of the lexicon is 2**-bits, and there are so many subsets.
#: Subset k looks at the bits of a term's hash from k * STRIDE on; that of a finer tier is part of that of a coarser one.
TIERS = (4, 6, 8, 10)
SUBSETS, STRIDE = 8, 6
#: Buckets of neighbouring ids have about so many rows; there are at most COARSE * FINE of them, whose first ids are broadcast (4 MB).
BUCKET_ROWS, COARSE, FINE = 256, 512, 256


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text, as 64-bit hashes."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """The hashes `term` of all terms in the band. Counts are over all documents."""
    ready(docs.sparkSession)
    n = docs.count()
    terms = docs.select(F.explode(term_hashes(F.coalesce("text", F.lit("")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).where((F.col("n") >= max(2, n * least_share)) & (F.col("n") <= max(2, n * most_share))).select("term").checkpoint()


def prints(kept: Column, otherwise: Column) -> Column:
    """array<long> of a text's lexicon terms: their hash, then that of each subset's terms (0: none of them).

    A text without lexicon terms has `otherwise` in the first place.
    """

    def chosen(bits: int, k: int):
        return lambda t: F.shiftrightunsigned(t, k * STRIDE).bitwiseAND((1 << bits) - 1) == 0

    def hashed(own: Column) -> Column:
        return F.when(F.size(own) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(own))

    def tiers(k: int):
        # Each tier is sought in the terms that the tier before has left.
        def of(own: Column) -> Column:
            lists = [own]
            for bits in TIERS[1:]:
                lists.append(F.filter(lists[-1], chosen(bits, k)))
            return F.array(*[hashed(x) for x in lists])

        return of

    def all_prints(sorted_terms: Column) -> Column:
        whole = F.when(F.size(sorted_terms) == 0, otherwise).otherwise(F.xxhash64(sorted_terms))
        by_subset = [F.get(F.transform(F.array(F.filter(sorted_terms, chosen(TIERS[0], k))), tiers(k)), 0) for k in range(SUBSETS)]
        by_tier = F.transform(F.array(F.array(*by_subset)), lambda x: F.array(*[F.get(F.get(x, k), tier) for tier in range(len(TIERS)) for k in range(SUBSETS)]))
        return F.concat(F.array(whole), F.get(by_tier, 0))

    return F.get(F.transform(F.array(F.sort_array(kept)), all_prints), 0)


def shown(values: Column) -> Column:
    """The fingerprint as text: 8 hexadecimal digits each, joined by '-'."""
    return F.array_join(F.transform(values, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0"))), "-")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1. 1 if the whole hashes agree, else the largest share, over the tiers, of the subsets that agree.

    Counted are subsets that have terms of either text; a tier with fewer than 4 of them counts as if it had 4.
    """
    shares = []
    for tier in range(len(TIERS)):
        pairs = F.arrays_zip(F.slice(a, 2 + tier * SUBSETS, SUBSETS).alias("a"), F.slice(b, 2 + tier * SUBSETS, SUBSETS).alias("b"))
        same = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != 0)))
        used = F.size(F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0)))
        shares.append(same / F.greatest(used, F.lit(4)))
    return F.when(F.get(a, 0) == F.get(b, 0), F.lit(1.0)).otherwise(F.greatest(*shares))


def _place(cuts: Column) -> Column:
    """How many of the cuts are not above the doc_id."""
    return F.size(F.filter(cuts, lambda x: x <= F.col("doc_id")))


def buckets(rows: DataFrame) -> tuple[DataFrame, Column]:
    """`rows`, with a column of cuts where there are many, and the number of a row's bucket: -1 for null ids, then in the order of ids.

    Cuts are approximate quantiles of the ids, so that buckets have like numbers
    of rows however the ids are spread: COARSE ones at most, and if these buckets
    are large, quantiles of each of them.
    """
    n, top = rows.count(), F.lit(-1)
    many = -(-n // BUCKET_ROWS)
    shares = [k / min(many, COARSE) for k in range(1, min(many, COARSE))]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 8 * COARSE)).first()[0] if shares else None
    coarse = _place(F.lit(sorted(set(cuts)))) if cuts else F.lit(0)
    coarse = F.when(F.col("doc_id").isNull(), top).otherwise(coarse)
    fine = min(FINE, -(-many // COARSE))
    if fine <= 1:
        return rows, coarse
    within = rows.where("doc_id is not null").groupBy(coarse.alias("_coarse")).agg(F.percentile_approx("doc_id", [k / fine for k in range(1, fine)], 8 * FINE).alias("_cuts"))
    placed = rows.withColumn("_own", coarse).join(F.broadcast(within), F.col("_own") == F.col("_coarse"), "left")
    return placed, F.when(F.col("doc_id").isNull(), top).otherwise(F.col("_own") * FINE + _place(F.array_distinct("_cuts")))


def in_buckets(rows: DataFrame) -> DataFrame:
    """Adds _at and _copy: within each _at, ordered by (_copy, doc_id), the row after a row is that of the next larger doc_id.

    A bucket's first row is copied to the end of the bucket before it, so each
    bucket can be put in order by itself; rows with _copy are there to be next
    only. After the last id comes the first. Null ids come first.
    """
    placed, bucket = buckets(rows)
    firsts = placed.groupBy(bucket.alias("_b")).agg(F.min("doc_id").alias("_first"))
    order = W.partitionBy(F.lit(0)).orderBy("_b")  # a row for each bucket
    before = F.coalesce(F.lag("_b").over(order), F.max("_b").over(W.partitionBy(F.lit(0))))
    firsts = firsts.select(F.col("_b").alias("_fb"), "_first", before.alias("_before")).checkpoint()
    placed = placed.select(*rows.columns, bucket.alias("_bucket"))
    placed = placed.join(F.broadcast(firsts), (F.col("_bucket") == F.col("_fb")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    here = F.struct(F.col("_bucket").alias("at"), F.lit(False).alias("copy"))
    there = F.struct(F.col("_before").alias("at"), F.lit(True).alias("copy"))
    placed = placed.withColumn("_place", F.explode(F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return placed.select(*rows.columns, F.col("_place.at").alias("_at"), F.col("_place.copy").alias("_copy"))


def imatch(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """A row per row of `docs` (doc_id, text), with the fingerprints of its text and of its edited text.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Edited: the last quarter (rounded down) of the code points is
    replaced by as many from the start of the next document. A null text is
    empty; a very long one is taken whole; an only document is its own next one;
    among rows of one id any is next. Ids may be any longs. Texts that are equal,
    repeated rows too, have equal fingerprints. An empty table gives no rows.
    Other columns are ignored.

    The texts move once, to the buckets of neighbouring ids; all that follows
    stays in these partitions.
    """
    ready(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(plain, least_share, most_share).withColumnRenamed("term", "_term")
    if words.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    order = W.partitionBy("_at").orderBy("_copy", "doc_id", "_row")
    rows = in_buckets(plain).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select("_at", "_copy", "doc_id", "_row", "text", F.lead("text").over(order).alias("next_text"), F.char_length("text").cast("long").alias("n_chars"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited).select("_at", "_copy", "doc_id", "_row", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), term_hashes(F.col("text")).alias("a"), term_hashes(F.col("edited")).alias("b"))

    def tag(kind: int):
        return lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"))

    none = F.array(F.struct(F.lit(2).alias("kind"), F.lit(None).cast("long").alias("term")))
    keys = ["_at", "_copy", "doc_id", "_row", "n_chars", "edited_sha256"]
    # Hashed before the terms are dealt out, so that no exploded row carries the lists.
    rows = rows.select(*keys, "a", "b", F.xxhash64(F.lit("none"), F.sort_array("a")).alias("else_a"), F.xxhash64(F.lit("none"), F.sort_array("b")).alias("else_b"))
    rows = rows.select(*keys, "else_a", "else_b", F.explode(F.concat(F.transform("a", tag(0)), F.transform("b", tag(1)), none)).alias("x"))
    hits = rows.join(words, F.col("x.term") == F.col("_term"), "left").where("_term is not null or x.kind = 2")
    of = lambda kind: F.collect_list(F.when(F.col("x.kind") == kind, F.col("_term")))
    found = hits.groupBy(*keys, "else_a", "else_b").agg(of(0).alias("a"), of(1).alias("b"))
    found = found.select(*keys, prints(F.col("a"), F.col("else_a")).alias("prints"), prints(F.col("b"), F.col("else_b")).alias("edited_prints"))
    found = found.withColumn("next_prints", F.lead("prints").over(order)).where("not _copy")
    return found.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), shown(F.col("prints")).alias("fingerprint"), shown(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(documents(spark, sf_dir))
