"""Operator 10: removal of repeated byte strings, by suffix arrays built from Lyndon groups.

Bytes are removed that a string of WIDTH bytes covers which also starts earlier.

Every window of WIDTH bytes has an anchor: the 32-byte string in it with the
least hash. Equal windows have equal anchors at equal places, so only windows
with one anchor need be compared. Neighbouring windows mostly share their anchor;
they and their bytes are its context. There is a context for about 35 bytes, and
it is named by the hashes of its anchor and of itself.

1. Each task finds the contexts of its texts that are the same as an earlier one
   of its own; their bytes are compared, and they leave as runs. The others are
   dealt out by anchor, as 32 bytes of numbers.
2. A context with the anchor and name of an earlier one is a member of it. Runs
   of members of one document are fetched and compared with the bytes of those
   whose members they are. A run that isn't the same after all joins 3.
3. Where an anchor has several different contexts, the first of each is fetched.
   The contexts of an anchor make a text, whose suffixes are put in order; windows
   that are equal follow one another, and all but the earliest are repeated.
   An anchor with many different contexts is split by the letters that its windows
   have next to it, as often as it takes, and sorted by parts.
4. What is repeated is cut out of the texts that have any.

So each byte is removed for a window or a context whose bytes were compared.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BYTE_VALUES, documents, mix, ready, saved, spans, window_hashes
from .ngram_join import MAP_BITS, _bit_map, _has
from .shingles import _tables
from .suffixes import suffix_arrays

WIDTH = 100
_ANCHOR_LOG = 5
_ANCHOR = 1 << _ANCHOR_LOG
#: Windows' starts differ by less than this within a context.
_REACH = WIDTH - _ANCHOR + 1
#: Bytes that are looked at together; a longer text is looked at in overlapping pieces.
PIECE = 1 << 20
#: Contexts that a task gathers before it merges those that are the same.
GATHER = 400_000
#: Groups of more different contexts are split, into so many parts by the anchor's place in the window.
MANY, PARTS = 64, 4
#: Keys of groups to be split that may be broadcast (8 bytes each).
BROADCAST_KEYS = 200_000
#: Letters whose suffixes are put in order together.
TOGETHER = 800_000

_U = np.uint64


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """out[i] = the least of keys[i : i + width]."""
    least, have = keys, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def contexts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, low, more, at, anchor, name) of the contexts of texts raw[offsets[i] : offsets[i + 1]].

    A context's windows start at low, low + 1, ..., low + more, counted from the
    text's start; its anchor at low + at. Contexts are in the order of the texts.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(raw) < WIDTH:
        return none
    hashes = mix(window_hashes(raw, _ANCHOR_LOG))
    keys = (hashes & ~_U((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_least(keys, _REACH)
    sizes = np.diff(offsets)
    n_windows = np.maximum(sizes - WIDTH + 1, 0)
    text = np.repeat(np.arange(len(sizes)), n_windows)
    if not len(text):
        return none
    at = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + offsets[:-1][text]
    anchor_at = (least[at] & _U((1 << 24) - 1)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (anchor_at[1:] != anchor_at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(first)
    count = np.diff(np.append(first, len(at)))
    start, end = at[first], at[first] + count - 1 + WIDTH
    powers, inverses = _tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[raw] * powers[: len(raw)], dtype=np.uint64)])
    name = mix((sums[end] - sums[start]) * inverses[start] + mix((end - start).astype(np.uint64) * _U(256) + (anchor_at[first] - start).astype(np.uint64)))
    return text[first], start - offsets[:-1][text[first]], count - 1, anchor_at[first] - start, hashes[anchor_at[first]], name


def _pieces(raw: np.ndarray, offsets: np.ndarray):
    """(text numbers, places in their texts, bytes, offsets) of at most about PIECE bytes; long texts come in overlapping pieces."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > PIECE:
            for a in range(int(offsets[i]), int(offsets[i + 1]) - WIDTH + 1, PIECE):
                b = min(a + PIECE + WIDTH - 1, int(offsets[i + 1]))
                yield np.array([i]), np.array([a - offsets[i]]), raw[a:b], np.array([0, b - a])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        yield np.arange(i, j), np.zeros(j - i, np.int64), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _same(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether raw[a : a + length] and raw[b : b + length] are the same bytes, for lengths below 256."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 50_000):
        part = slice(k, k + 50_000)
        for at in range(0, int(length[part].max(initial=0)), 32):
            step = at + np.arange(32)
            inside = step < length[part][:, None]
            x, y = (raw[np.minimum(z[part][:, None] + step, len(raw) - 1)] for z in (a, b))
            out[part] &= ((x == y) | ~inside).all(axis=1)
    return out


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop) of the runs of spans that touch; of a document's spans, one that starts later doesn't stop earlier."""
    order = np.lexsort((stop, start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
    head = np.flatnonzero(new)
    return doc[head], start[head], np.maximum.reduceat(stop, head) if len(head) else stop


#: A context, or a run of repeated ones (run: place is its start, name its stop, and anchor deals it out).
_CONTEXT = "anchor long, name long, doc_id long, place long, run boolean"


def _place(low, more, at):
    return (low << 16) + (more << 8) + at


def _unplaced(place):
    """(low, more, at) of a place; for numbers or arrays."""
    return place >> 16, place >> 8 & 255, place & 255


def _context_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        def send(rows, pieces):
            anchor, name, doc, place, begin = (np.concatenate(x) for x in zip(*rows))
            order = np.lexsort((place, doc, anchor, name))
            anchor, name, doc, place, begin = anchor[order], name[order], doc[order], place[order], begin[order]
            again = np.zeros(len(order), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (name[1:] == name[:-1])
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
            # rows of one id at one place are one occurrence
            again &= (doc != doc[head]) | (place != place[head])
            low, more, _ = _unplaced(place)
            maybe = np.flatnonzero(again & (more == more[head]))
            again[:] = False
            again[maybe] = _same(np.concatenate(pieces), begin[maybe], begin[head[maybe]], more[maybe] + WIDTH)
            doc_of, start, stop = _merged(doc[again], low[again], low[again] + more[again] + WIDTH)
            left, n = ~again, len(doc_of)
            flat = [
                np.concatenate([anchor[left], mix(doc_of.astype(np.uint64) + start.astype(np.uint64))]).view(np.int64), np.concatenate([name[left].view(np.int64), stop]),
                np.concatenate([doc[left], doc_of]), np.concatenate([place[left], start]), np.arange(left.sum() + n) >= left.sum(),
            ]
            for a in range(0, len(flat[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000]) for x in flat], ["anchor", "name", "doc_id", "place", "run"])

        rows, pieces, n, base = [], [], 0, 0
        for batch in batches:
            raw, offsets = spans(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for texts, shift, part, offs in _pieces(raw, offsets):
                text, low, more, at, anchor, name = contexts(part, offs)
                if not len(text):
                    continue
                rows.append((anchor, name, ids[texts[text]], _place(low + shift[text], more, at), base + offs[:-1][text] + low))
                pieces.append(part.copy())
                n, base = n + len(text), base + len(part)
                if n > GATHER:
                    yield from send(rows, pieces)
                    rows, pieces, n, base = [], [], 0, 0
        if n:
            yield from send(rows, pieces)

    return docs.mapInArrow(run, _CONTEXT)


def _packed_texts(docs: DataFrame, wanted) -> DataFrame:
    """(doc_id, packed) of the documents whose bit is set: the text, compressed to be moved."""

    def run(batches):
        bits, pack = wanted.value, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            mine = np.flatnonzero(_has(bits, batch.column("bit").to_numpy()))
            if len(mine):
                batch = batch.take(pa.array(mine))
                raw, offsets = spans(batch.column("text"))
                whole = memoryview(raw)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack.compress(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())], ["doc_id", "packed"])

    return docs.select("doc_id", "text", _bit()).mapInArrow(run, "doc_id long, packed binary")


def _bit():
    return F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - MAP_BITS).alias("bit")


def _wanted(spark: SparkSession, rows: DataFrame):
    return spark.sparkContext.broadcast(_bit_map(rows.select(_bit()).distinct(), "bit"))  # 2 MB, see MAP_BITS


def _fetch(asked: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, start, stop, the keys and `bytes` for rows with all but the last: the bytes of the documents' spans.

    What a text is asked for goes to it as one list, which is smaller than the
    text: contexts are 35 bytes apart, and runs longer. Rows of one id may have
    texts that are too short for a span; these are passed over.
    """
    names = ["doc_id", "start", "stop", *keys]
    schema = ", ".join(f"{c} long" for c in names) + ", bytes binary"

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, out, size = [], [], 0
            wants = batch.column("wants")
            for doc, text, asked_of in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), wants.to_pylist()):
                text = unpack.decompress(text)
                for w in asked_of:
                    if w["stop"] <= len(text):
                        rows.append((doc, *[w[c] for c in names[1:]]))
                        out.append(text[w["start"] : w["stop"]])
                        size += w["stop"] - w["start"]
                if size > 8 << 20:
                    yield table(rows, out)
                    rows, out, size = [], [], 0
            if rows:
                yield table(rows, out)

    def table(rows, out):
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in zip(*rows)], pa.array(out, pa.binary())], [*names, "bytes"])

    wants = asked.groupBy("doc_id").agg(F.collect_list(F.struct(*names[1:])).alias("wants"))
    return wants.join(packed, "doc_id").select("doc_id", "packed", "wants").mapInArrow(run, schema)


def _checked(spark: SparkSession, members: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, same) of runs of the members (doc_id, start, stop, of, of_start): whether both have the same bytes."""
    along = W.partitionBy("doc_id", "of", "shift").orderBy("start")
    new = (F.coalesce(F.lag("stop").over(along), F.lit(-1)) < F.col("start")).cast("int")
    rows = members.withColumn("shift", F.col("of_start") - F.col("start")).withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    runs = rows.groupBy("doc_id", "of", "shift", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run").checkpoint()
    bytes_of = _fetch(runs.select("doc_id", "start", "stop", "of", "shift"), _packed_texts(docs, _wanted(spark, runs)), ["of", "shift"])
    firsts = runs.select(F.col("of").alias("doc_id"))
    texts = _packed_texts(docs, _wanted(spark, firsts)).select(F.col("doc_id").alias("_id"), "packed")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            same, last, text = [], None, b""
            for packed, start, shift, body in zip(*[batch.column(c) for c in ("packed", "start", "shift", "bytes")]):
                if not (last is not None and packed.equals(last)):
                    last, text = packed, unpack.decompress(packed.as_py())
                at = start.as_py() + shift.as_py()
                same.append(text[at : at + len(body.as_py())] == body.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("stop"), pa.array(same, pa.bool_())], ["doc_id", "start", "stop", "same"])

    both = bytes_of.join(texts, F.col("of") == F.col("_id")).select("doc_id", "start", "stop", "shift", "bytes", "packed")
    return both.mapInArrow(run, "doc_id long, start long, stop long, same boolean").checkpoint()


def repeated_windows(group: np.ndarray, doc: np.ndarray, low: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, window in it) of the windows that also start earlier in a context of the same group.

    group: ascending. The contexts of a group make a text of letters: a byte b is
    b + 2, 1 ends a context, and 0 the text.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends_group = np.ones(len(group), bool)
    ends_group[:-1] = group[1:] != group[:-1]
    room = sizes + 1 + ends_group
    starts = np.cumsum(room) - room
    letters = np.ones(int(room.sum()), np.uint16)
    inside = np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 2
    letters[(starts + room - 1)[ends_group]] = 0
    heads = np.flatnonzero(np.concatenate([[True], ends_group[:-1]]))
    bounds = np.append(starts[heads], len(letters))
    order = suffix_arrays(letters, bounds)
    # of the suffixes, those that begin a window
    owner = np.repeat(np.arange(len(group)), room)
    window = np.arange(len(letters)) - starts[owner]
    full = window <= sizes[owner] - WIDTH
    order = order[full[order]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(letters, WIDTH)
    same = np.zeros(len(order), bool)
    of = group[owner[order]]
    for a in range(1, len(order), 100_000):
        x, y = order[a : a + 100_000], order[a - 1 : a - 1 + len(order[a : a + 100_000])]
        near = np.flatnonzero(of[a : a + len(x)] == of[a - 1 : a - 1 + len(x)])
        # a quick look at a few letters, and then at all
        for k in (WIDTH - 1, WIDTH // 2, 0):
            near = near[letters[x[near] + k] == letters[y[near] + k]]
        same[a + near] = (view[x[near]] == view[y[near]]).all(axis=1)
    run = np.cumsum(~same) - 1
    docs, at = doc[owner[order]], low[owner[order]] + window[order]
    sort = np.lexsort((at, docs, run))
    run, order, docs, at = run[sort], order[sort], docs[sort], at[sort]
    head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    first = np.repeat(head, np.diff(np.append(head, len(run))))
    later = (docs != docs[first]) | (at != at[first])
    return owner[order[later]], window[order[later]]


def _runs(owner: np.ndarray, window: np.ndarray, doc: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, start, stop) of the bytes that runs of neighbouring windows of a context cover."""
    if not len(owner):
        return (np.zeros(0, np.int64),) * 3
    sort = np.lexsort((window, owner))
    owner, window = owner[sort], window[sort]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(owner)) - 1
    start = low[owner[head]] + window[head]
    return doc[owner[head]], start, low[owner[head]] + window[last] + WIDTH


def _sorted_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, start, stop) of what is repeated among the contexts (key, doc_id, start, bytes), compared within keys."""

    def run(batches):
        def work(tables):
            table = pa.Table.from_batches(tables)
            key, doc, low = (table[c].to_numpy() for c in ("key", "doc_id", "start"))
            found = repeated_windows(key, doc, low, table["bytes"].to_pylist())
            docs, start, stop = _runs(*found, doc, low)
            return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start), pa.array(stop)], ["doc_id", "start", "stop"])

        held, size, last = [], 0, None
        for batch in batches:
            key = batch.column("key").to_numpy()
            if size > TOGETHER and len(key):
                # a key may go on in this batch
                cut = int(np.searchsorted(key, last, side="right"))
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < len(key):
                    yield work(held)
                    held, size = [], 0
                    batch, key = batch.slice(cut), key[cut:]
                else:
                    continue
            if len(key):
                held.append(batch)
                size += batch.nbytes
                last = key[-1]
        if held:
            yield work(held)

    return rows.select("key", "doc_id", "start", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, start long, stop long")


_GROUP = ["key", "at", "lo", "hi", "bytes"]


def _split(rows: DataFrame) -> DataFrame:
    """Contexts (key, lo, hi, doc_id, start, at, bytes) cut into contexts of fewer windows, with keys of more letters.

    In all windows of a context the anchor is lo to hi bytes after the start. A
    part takes those of a narrower range, and all of these have the same bytes
    around the anchor, which make the part's key: windows that are equal come
    into groups of one key again. Parts that are the same, byte by byte, as an
    earlier one of the batch leave as repeated (key: null).
    """

    def run(batches):
        for batch in batches:
            seen: dict[tuple, tuple] = {}
            sure = []
            for lo, hi, doc, start, at, body in zip(*[batch.column(c).to_pylist() for c in ("lo", "hi", "doc_id", "start", "at", "bytes")]):
                width = -(-(hi - lo + 1) // PARTS)
                for a in range(lo, hi + 1, width):
                    b = min(hi, a + width - 1)
                    first, last = max(0, at - b), min(len(body) - WIDTH, at - a)  # windows with the anchor at b to a
                    if first > last:
                        continue
                    part = body[first : last + WIDTH]
                    letters = body[at - a : at - b + WIDTH]
                    key = int.from_bytes(hashlib.blake2b(letters, digest_size=8, salt=bytes([a, b])).digest(), "little", signed=True)
                    own, here = (key, at - first, a, b, part), (doc, start + first)
                    kept = seen.setdefault(own, here)
                    if kept != here:
                        seen[own] = min(kept, here)
                        sure.append((*max(kept, here), len(part)))
            out = [(*own, *here, here[1] + len(own[4])) for own, here in seen.items()]
            out += [(None, None, None, None, None, doc, start, start + n) for doc, start, n in sure]
            kinds = [*[pa.int64()] * 4, pa.binary(), *[pa.int64()] * 3]
            columns = zip(*out) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], [*_GROUP, "doc_id", "start", "stop"])

    return rows.select("lo", "hi", "doc_id", "start", "at", "bytes").mapInArrow(run, "key long, at long, lo long, hi long, bytes binary, doc_id long, start long, stop long")


def _sorted_by_parts(rows: DataFrame) -> DataFrame:
    """(doc_id, start, stop) of what is repeated among the contexts (key, lo, hi, doc_id, start, at, bytes) of a key, however many it has."""
    found, small = [], []
    while True:
        many = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("range")).where(f"n > {MANY} and range > 0").select(F.col("key").alias("_key")).checkpoint()
        if many.isEmpty():
            small.append(rows.select("key", "doc_id", "start", "bytes"))
            break
        keys = F.broadcast(many) if many.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else many
        mine = F.col("key") == F.col("_key")
        small.append(rows.join(keys, mine, "left_anti").select("key", "doc_id", "start", "bytes"))
        parts = saved(_split(rows.join(keys, mine, "left_semi")))
        found.append(parts.where("key is null").select("doc_id", "start", "stop"))
        named = parts.where("key is not null")
        # of parts that are the same byte by byte the first stands for all
        firsts = named.groupBy(*_GROUP).agg(F.min(F.struct("doc_id", "start", "stop")).alias("first"))
        other = firsts.select(*[F.col(c).alias(f"_{c}") for c in _GROUP], "first")
        same = [F.col(c) == F.col(f"_{c}") for c in _GROUP]
        later = named.join(other, same).where("doc_id <> first.doc_id or start <> first.start")
        found.append(later.select("doc_id", "start", "stop"))
        rows = saved(firsts.select(*_GROUP, "first.doc_id", "first.start"))
    for part in small:
        found.append(_sorted_spans(part))
    return reduce(DataFrame.unionByName, found)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop): bytes of the documents (doc_id, text, neither null) that a repeated string covers. Spans may overlap."""
    spark = ready(docs.sparkSession)
    rows = _context_rows(docs)
    by_anchor = W.partitionBy("anchor", "run")
    by_name = W.partitionBy("anchor", "run", "name").orderBy("doc_id", "place")
    rows = rows.withColumn("_several", F.min("name").over(by_anchor) != F.max("name").over(by_anchor)).withColumn("_first", F.first(F.struct("doc_id", "place")).over(by_name)).withColumn("_turn", F.row_number().over(by_name))
    again = ~F.col("run") & ((F.col("_first.doc_id") != F.col("doc_id")) | (F.col("_first.place") != F.col("place")))
    rows = rows.select("run", F.when(F.col("run"), F.col("name")).otherwise(F.col("anchor")).alias("key"), "doc_id", "place", F.when(again, F.col("_first")).alias("of"), (~F.col("run") & F.col("_several") & (F.col("_turn") == 1)).alias("candidate"))
    rows = saved(rows.where("run or of is not null or candidate"))
    low, more, at = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    stop = (low + more + WIDTH).alias("stop")
    runs = rows.where("run").select("doc_id", F.col("place").alias("start"), F.col("key").alias("stop"))
    members = rows.where("of is not null")
    checked = _checked(spark, members.select("doc_id", low.alias("start"), stop, F.col("of.doc_id").alias("of"), F.shiftright("of.place", 16).alias("of_start")), docs)
    found = [runs, checked.where("same").select("doc_id", "start", "stop")]
    candidates = rows.where("candidate").select("key", "doc_id", "place")
    wrong = checked.where("not same").select(F.col("doc_id").alias("_id"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    if not wrong.isEmpty():
        # Two different contexts of one anchor have one name: both are compared by their bytes.
        inside = (F.col("doc_id") == F.col("_id")) & (low >= F.col("_start")) & (low + more + WIDTH <= F.col("_stop"))
        mistaken = members.join(wrong, inside, "left_semi")
        candidates = candidates.unionByName(mistaken.select("key", "doc_id", "place")).unionByName(mistaken.select("key", "of.doc_id", "of.place")).distinct()
    asked = candidates.select("doc_id", low.alias("start"), stop, "key", at.alias("at"))
    fetched = saved(_fetch(asked, _packed_texts(docs, _wanted(spark, candidates)), ["key", "at"]))
    groups = fetched.select("key", F.lit(0).cast("long").alias("lo"), F.lit(_REACH - 1).cast("long").alias("hi"), "doc_id", "start", "at", "bytes")
    return reduce(DataFrame.unionByName, [*found, _sorted_by_parts(groups)])


def _cut(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    n = len(text)
    starts, stops = np.clip(starts, 0, n), np.clip(stops, 0, n)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)) == 1)
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), len(edges)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _results(rows, kept: list[bytes] | None = None) -> pa.RecordBatch:
    doc, n, removed, n_spans, sha = (list(x) for x in zip(*rows)) if rows else ([], [], [], [], [])
    more = [] if kept is None else [pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), *more], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + len(more)])


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept].

    With with_text, kept has the bytes that are left; a cut may split a character.

    A null text is empty; texts of fewer than WIDTH bytes stay whole; very long
    ones are looked at in overlapping pieces. A row with
    null doc_id has no place in the order: it stays whole, and nothing is
    removed for its sake. Rows with one doc_id count as one document: the same
    string at the same place in both is one occurrence, and if their texts
    differ, what is found in one is cut from the other too. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = _RESULT + ", kept binary" * with_text
    spans_found = repeated_spans(plain.where("doc_id is not null")).checkpoint()
    wanted = _wanted(spark, spans_found)

    def untouched(batches):
        bits = wanted.value
        for batch in batches:
            named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(~named | ~_has(bits, batch.column("bit").to_numpy()))))
            raw, offsets = spans(batch.column("text"))
            whole = memoryview(raw)
            ids = batch.column("doc_id").to_pylist()
            places = list(zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()))
            yield _results([(i, b - a, 0, 0, hashlib.sha256(whole[a:b]).hexdigest()) for i, a, b in places], [bytes(whole[a:b]) for _, a, b in places] if with_text else None)

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, left = [], [] if with_text else None
            for i, packed, lists in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
                text = unpack.decompress(packed)
                at = np.array([(s["start"], s["stop"]) for s in lists or []], np.int64).reshape(-1, 2)
                kept, removed, n = _cut(text, at[:, 0], at[:, 1])
                rows.append((i, len(text), removed, n, hashlib.sha256(kept).hexdigest()))
                if with_text:
                    left.append(kept)
            yield _results(rows, left)

    lists = spans_found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnRenamed("doc_id", "_id")
    packed = _packed_texts(plain.where("doc_id is not null"), wanted)
    touched = packed.join(lists, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "packed", "spans")
    whole = plain.select("doc_id", "text", _bit()).mapInArrow(untouched, schema)
    return whole.unionByName(touched.mapInArrow(cut, schema))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
