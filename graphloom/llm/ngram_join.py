"""Operator 9: exact Jaccard join of shingle sets by T-occurrence search, and its components.

Two sets with a Jaccard likeness of 0.75 or more share an element among the
first quarter of either, whatever the order of elements. The order used has
shingles last that several texts may have, so that only texts which consist
of such for the most part come together at all, and a passage that many texts
have brings none of them together. Sets that share such an element belong to the block of the
smallest document that has it; each pair that can link is in some block.

Within a block the T-occurrence search (DivideSkip) finds what links to the
block's leader: short inverted lists are merged by a heap, long ones are probed
by binary search. What the leader didn't reach gets a leader of its own, and so
on. Only links that join two groups are kept, fewer than there are sets. If there
are several groups at last, all sets but those of the largest one search too, so
that no link between groups is missed. Large blocks are cut into chunks, which
the leader visits all, and so do the sets that no links in their chunk join to it.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected, documents, mix, ready, saved
from .shingles import shingle_sets

#: Numerator and denominator of the least Jaccard likeness.
LIKENESS = (75, 100)
#: Bits of the fixed-size map of documents that is sent to all tasks: 2 MB.
MAP_BITS = 24
#: Shingles are counted in 2**28 slots, dealt out in ranges; the map of those that are common is 32 MB, whatever the input.
SLOT_BITS, RANGE_BITS = 28, 10
#: Counts from which on a slot may be called common; the first is taken that calls less than this share of all shingles so.
COMMON_FROM, MOST_COMMON = (2, 3, 4, 6, 8, 12, 16, 32, 64, 128, 255), 0.65
#: Shingles that a task gathers before it sends their slots on; tasks, and then counts, that are merged together.
GATHER, MERGE = 2_000_000, 256
#: Shingles (8 MB) and sets in a chunk of a block.
CHUNK, CHUNK_SETS = 1 << 20, 512
#: Rows of a table that may be broadcast, at 40 bytes or less each.
BROADCAST_ROWS = 100_000
#: A prefix is longer by one element for so many: what is linked shares as many elements of such prefixes.
LONGER = 20


def least_share(n: int, likeness=LIKENESS) -> int:
    """The fewest elements that a set of n shares with any set that is like it."""
    a, b = likeness
    return -(-n * a // b)


def longer(n: int) -> int:
    """By how many elements, less one, the prefix of a set of n is longer than it must be to share one with any set like it."""
    return max(1, n // LONGER)


def linked(shared: int, m: int, n: int, likeness=LIKENESS) -> bool:
    a, b = likeness
    return b * shared >= a * (m + n - shared)


class OccurrenceIndex:
    """Inverted lists of a collection of sets; finds the sets that share enough elements with a query.

    `sizes` are the sets' true sizes, where elements that no other set has were left out.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int] | None = None):
        self.sizes = [len(s) for s in sets] if sizes is None else list(sizes)
        elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(elements, kind="stable")
        members = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])[order]
        names, starts = np.unique(elements[order], return_index=True)
        starts = np.append(starts, len(elements))
        # An element of one set alone can only be found by that set.
        self._names, self._low, self._high = names, starts[:-1], starts[1:]
        self._members = members.tolist()

    def search(self, query: np.ndarray, size: int | None = None, likeness=LIKENESS) -> list[int]:
        """The numbers of the sets like the query (of the given true size), by DivideSkip."""
        n = len(query) if size is None else size
        needed = least_share(n, likeness)
        if n == 0 or len(query) < needed or not len(self._names):
            return []
        at = np.minimum(np.searchsorted(self._names, query), len(self._names) - 1)
        at = at[self._names[at] == query]
        if len(at) < needed:
            return []
        low, high = self._low[at], self._high[at]
        by_length = np.argsort(high - low, kind="stable")
        low, high, members = low[by_length].tolist(), high[by_length].tolist(), self._members
        # The longest lists are only probed: so many that a set must still occur in the others.
        aside = min(needed - 1, int(needed / (0.0085 * math.log2(high[-1] - low[-1] + 1) + 1)))
        cut = len(low) - aside
        found, sizes = [], self.sizes
        for i, count in _merged_counts([members[a:b] for a, b in zip(low[:cut], high[:cut])]):
            m = sizes[i]
            if count < needed - aside or m * likeness[1] < n * likeness[0] or n * likeness[1] < m * likeness[0]:
                continue
            left = aside
            for a, b in zip(low[cut:], high[cut:]):
                k = bisect_left(members, i, a, b)
                left -= 1
                if k < b and members[k] == i:
                    count += 1
                elif not linked(count + left, n, m, likeness):
                    break  # even all lists that are left aren't enough
            if linked(count, n, m, likeness):
                found.append(i)
        return found


def _merged_counts(lists: list[list[int]]) -> Iterable[tuple[int, int]]:
    """(number, in how many of the ascending lists it is), by merging them with a heap."""
    last, count = -1, 0
    for i in heapq.merge(*lists):
        if i == last:
            count += 1
        else:
            if count:
                yield last, count
            last, count = i, 1
    if count:
        yield last, count


class Groups:
    """Numbers 0..n-1, joined into groups."""

    def __init__(self, n: int):
        self._up = list(range(n))

    def of(self, i: int) -> int:
        """The group's name, which is one of its numbers."""
        while self._up[i] != i:
            self._up[i] = self._up[self._up[i]]
            i = self._up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were in two groups until now."""
        i, j = self.of(i), self.of(j)
        self._up[max(i, j)] = min(i, j)
        return i != j


def spanning_links(sets: list[np.ndarray], sizes: list[int], first: int = 0, likeness=LIKENESS) -> tuple[list[tuple[int, int]], Groups]:
    """(links that connect all that links connect among the sets, fewer than there are sets; the groups). first leads."""
    index, groups, out, asked = OccurrenceIndex(sets, sizes), Groups(len(sets)), [], set()
    reached = [False] * len(sets)

    def ask(i: int) -> None:
        asked.add(i)
        for j in index.search(sets[i], sizes[i], likeness):
            reached[j] = True
            if groups.join(i, j):
                out.append((i, j))

    for i in [first, *range(len(sets))] if sets else []:
        if not reached[i] and i not in asked:
            ask(i)
    members = np.bincount([groups.of(i) for i in range(len(sets))], minlength=1)
    if len(sets) and members.max() < len(sets):
        largest = int(members.argmax())
        for i in [i for i in range(len(sets)) if groups.of(i) != largest and i not in asked]:
            ask(i)
    return out, groups


def _bit_map(df: DataFrame, bit: str) -> np.ndarray:
    """A map of 2**MAP_BITS bits, as whole numbers of 64: set for each value of the column. Its size doesn't depend on df's."""
    words = df.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bit} & 63 as int))")).alias("b"))
    table = words.toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[table["w"].to_numpy()] = table["b"].to_numpy()
    return out.view(np.uint64)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _survey(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, bool]:
    """(rows (doc_id, n, digest), a map of the slots that are common, whether that has all slots of two shingles or more).

    A slot is a shingle's first SLOT_BITS bits. All shingles of all texts count. Each
    task sends the slots of its shingles, sorted, as compressed differences,
    about a byte for each. Each range of slots is counted by itself, first for
    MERGE tasks together and then for MERGE such counts, so that no group grows
    with the input. Where there are so many shingles that most slots have
    several, the map has those with the higher counts. One pass over the texts.
    """
    inner = SLOT_BITS - RANGE_BITS
    salts = -(-docs.rdd.getNumPartitions() // MERGE)
    sent = ["range", "salt", "slots", "doc_id", "n", "digest"]

    def gather(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() // MERGE

        def send(parts):
            slots = np.sort(np.concatenate(parts))
            at = np.searchsorted(slots, np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64) << np.uint64(inner))
            pack = zstandard.ZstdCompressor(level=1)
            full = [r for r in range(1 << RANGE_BITS) if at[r + 1] > at[r]]
            packed = [pack.compress(np.diff(slots[at[r] : at[r + 1]], prepend=np.uint64(r << inner)).astype(np.uint32).tobytes()) for r in full]
            m = len(full)
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([salt] * m, pa.int32()), pa.array(packed, pa.binary()), none, none, pa.nulls(m, pa.binary())], sent)

        parts, held = [], 0
        for batch in batches:
            sets, ids = shingle_sets(batch.column("text"), k), batch.column("doc_id")
            # documents travel with the ranges, evenly
            group = (mix(ids.to_numpy().astype(np.uint64)) >> np.uint64(64 - RANGE_BITS)).astype(np.int32)
            m = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array([salt] * m, pa.int32()), pa.nulls(m, pa.binary()), ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary())], sent)
            for s in sets:
                if len(s):
                    parts.append(s >> np.uint64(64 - SLOT_BITS))
                    held += len(s)
            if held > GATHER:
                yield send(parts)
                parts, held = [], 0
        if parts:
            yield send(parts)

    def counted(key, counts, docs):
        """A row with the counts up to 255, and the documents' rows."""
        d = len(docs)
        pack = zstandard.ZstdCompressor(level=1)
        return pa.table({
            "range": pa.array([key[0].as_py()] + [None] * d, pa.int32()), "salt": pa.array([key[1].as_py()] + [None] * d, pa.int32()),
            "counts": pa.array([pack.compress(np.minimum(counts, 255).astype(np.uint8).tobytes())] + [None] * d, pa.binary()),
            "doc_id": pa.array([None, *docs["doc_id"].to_pylist()], pa.int64()), "n": pa.array([None, *docs["n"].to_pylist()], pa.int64()), "digest": pa.array([None, *docs["digest"].to_pylist()], pa.binary()),
        })

    def count(key, table):
        unpack = zstandard.ZstdDecompressor()
        counts = np.zeros(1 << inner, np.int64)
        for packed in table["slots"].drop_null().to_pylist():
            counts += np.bincount(np.cumsum(np.frombuffer(unpack.decompress(packed), np.uint32).astype(np.int64)), minlength=1 << inner)
        return counted(key, counts, table.filter(table["doc_id"].is_valid()))

    def merge(key, table):
        unpack = zstandard.ZstdDecompressor()
        counts = np.zeros(1 << inner, np.int64)
        for packed in table["counts"].to_pylist():
            counts += np.frombuffer(unpack.decompress(packed), np.uint8)
        return counted(key, counts, table.slice(0, 0))

    def choose(batches):
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for r, packed in zip(batch.column("range").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(unpack.decompress(packed), np.uint8)
                maps = [counts >= c for c in COMMON_FROM]
                m = len(maps)
                mass = [int(counts[x].sum()) for x in maps]
                bits = [pack.compress(np.packbits(x, bitorder="little").tobytes()) for x in maps]
                yield pa.RecordBatch.from_arrays([pa.array([r] * m, pa.int32()), pa.array(COMMON_FROM, pa.int32()), pa.array(mass, pa.int64()), pa.array([int(counts.sum())] * m, pa.int64()), pa.array(bits, pa.binary())], ["range", "from", "mass", "total", "bits"])

    schema = "range int, salt int, counts binary, doc_id long, n long, digest binary"
    both = docs.mapInArrow(gather, "range int, salt int, slots binary, doc_id long, n long, digest binary").groupBy("range", "salt").applyInArrow(count, schema).checkpoint()
    counts = both.where("doc_id is null")
    while salts > 1:
        salts = -(-salts // MERGE)
        counts = counts.select("range", F.floor(F.col("salt") / MERGE).cast("int").alias("salt"), "counts", "doc_id", "n", "digest").groupBy("range", "salt").applyInArrow(merge, schema)
    maps = counts.select("range", "counts").mapInArrow(choose, "range int, from int, mass long, total long, bits binary")
    masses = {r["from"]: (r["mass"], r["total"]) for r in maps.groupBy("from").agg(F.sum("mass").alias("mass"), F.sum("total").alias("total")).collect()}
    out, chosen = np.zeros(1 << (SLOT_BITS - 3), np.uint8), COMMON_FROM[0]
    if masses:
        chosen = next((c for c in COMMON_FROM if masses[c][0] <= MOST_COMMON * masses[c][1]), COMMON_FROM[-1])
        unpack, width = zstandard.ZstdDecompressor(), 1 << (inner - 3)
        table = maps.where(F.col("from") == chosen).select("range", "bits").toArrow()  # at most 1,024 rows, 32 MB before compression
        for r, bits in zip(table["range"].to_pylist(), table["bits"].to_pylist()):
            out[r * width : (r + 1) * width] = np.frombuffer(unpack.decompress(bits), np.uint8)
    return both.where("doc_id is not null").select("doc_id", "n", "digest"), out.view(np.uint64), chosen == 2


def _prefixes(docs: DataFrame, common, complete: bool, k: int, likeness) -> DataFrame:
    """(token, doc_id, needs): each set's first elements in the order in which common ones are last. Of equal sets in a task the first stands for all.

    If the map of common slots is complete, elements that aren't in it are in no other set, and aren't sent.
    """

    def run(batches):
        bits = common.value
        seen: set[bytes] = set()
        for batch in batches:
            ids, tokens, needs = [], [], []
            for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), k)):
                if not len(s) or (d := _digest(s)) in seen:
                    continue
                seen.add(d)
                many = _has(bits, s >> np.uint64(64 - SLOT_BITS))
                alone = s[~many]
                n = len(s) - least_share(len(s), likeness) + longer(len(s))
                first = np.concatenate([alone[: 0 if complete else n], s[many][: max(0, n - len(alone))]])
                tokens.append(first)
                ids.append(np.full(len(first), i, np.int64))
                needs.append(np.full(len(first), longer(least_share(len(s), likeness)), np.int32))
            if len(seen) > 1_000_000:
                seen.clear()
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(needs))], ["token", "doc_id", "needs"])

    return docs.mapInArrow(run, "token long, doc_id long, needs int")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _sets(docs: DataFrame, wanted: np.ndarray, common, only_common: bool, k: int) -> DataFrame:
    """(doc_id, n, elements) of the documents whose bit is set; with only_common, without the elements that no other set has."""

    def run(batches):
        for batch in batches:
            mine = np.flatnonzero(_has(wanted, batch.column("bit").to_numpy()))
            if not len(mine):
                continue
            batch = batch.take(pa.array(mine))
            sets = shingle_sets(batch.column("text"), k)
            sizes = [len(s) for s in sets]
            if only_common:
                sets = [s[_has(common.value, s >> np.uint64(64 - SLOT_BITS))] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "elements"])

    bit = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - MAP_BITS).alias("bit")
    return docs.select("doc_id", "text", bit).mapInArrow(run, "doc_id long, n long, elements binary")


def _search_chunks(rows: DataFrame, likeness) -> DataFrame:
    """(block, a, b, open) for each chunk of rows (block, chunk, doc_id, n, elements, query).

    query: 1 for the leader, 2 for sets that only ask, 0 for all others. Where
    there is a leader, the links that connect the chunk's sets, and as open the
    sets that these don't connect to it. Else the links of those that ask.
    """

    def run(key, table):
        ids, query, sizes = table["doc_id"].to_pylist(), table["query"].to_pylist(), table["n"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table["elements"].to_pylist()]
        if 1 in query:
            first = query.index(1)
            pairs, groups = spanning_links(sets, sizes, first, likeness)
            open_ = [i for i in range(len(ids)) if groups.of(i) != groups.of(first)]
        else:
            members, groups, pairs, open_ = [i for i in range(len(ids)) if not query[i]], Groups(len(ids)), [], []
            index = OccurrenceIndex([sets[i] for i in members], [sizes[i] for i in members])
            for i in [i for i in range(len(ids)) if query[i]]:
                found = [members[j] for j in index.search(sets[i], sizes[i], likeness)]
                pairs += [(i, j) for j in found if groups.join(i, j)]
        a, b = [ids[i] for i, _ in pairs] + [ids[i] for i in open_], [ids[j] for _, j in pairs] + [ids[i] for i in open_]
        return pa.table({"block": pa.array([key[0].as_py()] * len(a), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "open": pa.array([False] * len(pairs) + [True] * len(open_), pa.bool_())})

    return rows.groupBy("block", "chunk").applyInArrow(run, "block long, a long, b long, open boolean")


def links(docs: DataFrame, k: int = 5, likeness=LIKENESS) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b) that connect just what the join's links connect, summaries (doc_id, n, digest)).

    `docs` has doc_id and text without nulls.
    """
    ready(docs.sparkSession)
    rows, bits, complete = _survey(docs, k)
    common = docs.sparkSession.sparkContext.broadcast(bits)  # 32 MB, see SLOT_BITS
    least = _small(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("digest").alias("_d"), "_first").checkpoint())
    equal = rows.join(least, F.col("digest") == F.col("_d")).select(F.col("doc_id").alias("a"), F.col("_first").alias("b")).where("a <> b")

    prefixes = saved(_prefixes(docs, common, complete, k, likeness))
    shared = prefixes.groupBy("token").agg(F.min("doc_id").alias("leader"), F.count("*").alias("_n")).where("_n > 1").select(F.col("token").alias("_t"), "leader")
    blocks = prefixes.join(shared, F.col("token") == F.col("_t")).groupBy("leader", "doc_id", "needs").agg(F.count("*").alias("_c"))
    enough = blocks.groupBy("doc_id", "needs").agg(F.sum("_c").alias("_c")).where("_c >= needs").select(F.col("doc_id").alias("_id"))
    blocks = blocks.join(enough, F.col("doc_id") == F.col("_id"), "left_semi")
    # Each set leaves the blocks with which it shares least, as long as these are fewer than half of the elements that it
    # needs: whatever two sets that are like each other leave, they still share one in a block that both are in.
    least_first = W.partitionBy("doc_id", "needs").orderBy("_c", "leader").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.withColumn("_left", F.sum("_c").over(least_first)).where(F.col("_left") > F.floor((F.col("needs") - 1) / 2))
    blocks = blocks.select(F.col("leader").alias("block"), "doc_id")
    # Of sets that are the same the smallest document stands for all.
    alone = rows.groupBy("doc_id").agg(F.count("*").alias("_n"), F.first("digest").alias("_own")).where("_n = 1")
    others = alone.join(least, F.col("_own") == F.col("_d")).where("doc_id <> _first").select(F.col("doc_id").alias("_a"), F.col("_first").alias("_b"))
    blocks = blocks.join(others, F.col("doc_id") == F.col("_a"), "left").select("block", F.coalesce("_b", "doc_id").alias("doc_id")).distinct().checkpoint()
    # A block is left out if another, of a smaller number, has all its members.
    smallest = blocks.groupBy("doc_id").agg(F.min("block").alias("_m"))
    inside = blocks.join(smallest, "doc_id").groupBy("block").agg(F.min("_m").alias("lo"), F.max("_m").alias("hi"), F.count("*").alias("n")).where("n = 1 or lo = hi and lo < block").select("block")
    blocks = blocks.join(inside, "block", "left_anti")
    sizes = blocks.join(rows.select("doc_id", "n"), "doc_id").groupBy("block").agg(F.sum("n").alias("_total"), F.count("*").alias("_sets"), F.min("doc_id").alias("leader"))
    sizes = sizes.select(F.col("block").alias("_l"), "leader", F.ceil(F.greatest(F.col("_total") / F.lit(CHUNK), F.col("_sets") / F.lit(CHUNK_SETS))).cast("int").alias("chunks"))
    blocks = blocks.join(sizes, F.col("block") == F.col("_l")).select("block", "leader", "chunks", "doc_id").checkpoint()
    wanted = _bit_map(blocks.select(F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - MAP_BITS).alias("bit")).distinct(), "bit")
    full = blocks.join(_sets(docs, wanted, common, complete, k), "doc_id")
    is_leader = F.col("doc_id") == F.col("leader")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    own = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    # The leader asks in all chunks; it is a member of one of them, which changes nothing.
    members = full.withColumn("chunk", F.explode(F.when(is_leader, every).otherwise(F.array(own)))).withColumn("query", F.when(is_leader, 1).otherwise(0))
    sent = ["block", "chunk", "doc_id", "n", "elements", "query"]
    found = _search_chunks(members.select(*sent), likeness).checkpoint()
    edges = found.where("not open").select("a", "b")
    # What isn't connected to the leader in a chunk of a cut block asks in all its chunks; in a whole block all is known.
    asking = found.where("open").join(blocks.where("chunks > 1").select(F.col("block").alias("_b")).distinct(), F.col("block") == F.col("_b"), "left_semi")
    asking = asking.select(F.col("block").alias("_l"), F.col("a").alias("_a")).distinct().checkpoint()
    if not asking.isEmpty():
        cut = members.where("chunks > 1 and query = 0")
        again = cut.join(asking, (F.col("block") == F.col("_l")) & (F.col("doc_id") == F.col("_a")))
        again = again.withColumn("chunk", F.explode(every)).withColumn("query", F.lit(2))
        asked = cut.join(asking.select("_l").distinct(), F.col("block") == F.col("_l"), "left_semi")
        edges = edges.unionByName(_search_chunks(asked.select(*sent).unionByName(again.select(*sent)), likeness).where("not open").select("a", "b"))
    return edges.unionByName(equal), rows


def components(docs: DataFrame, k: int = 5, likeness=LIKENESS) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    The component's id is the smallest doc_id that links reach. Null and empty
    texts have no shingles and no links, and so have rows whose doc_id is null.
    Rows with one id are one document to the links. An empty table gives no
    rows. Other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    edges, rows = links(plain.where("doc_id is not null"), k, likeness)
    found = connected(docs.sparkSession, edges)
    known = rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = plain.where("doc_id is null")

    def count(batches):
        for batch in batches:
            sizes = [len(s) for s in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return known.unionByName(nameless.mapInArrow(count, "doc_id long, n_shingles long, component_id long"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))


