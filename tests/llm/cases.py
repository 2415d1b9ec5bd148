"""Documents with the cases that every corpus operator must stand, and plain versions of the operators."""

import hashlib
import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use for themselves.
CLASHES = ["row", "recipe", "kept", "leader", "n", "token", "_at", "_row", "size", "anchor", "bit", "packed", "prints", "hash", "tail_1", "score", "component", "_id", "target"]

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(seed=1, n=60):
    """Texts with exact copies, near copies, shared passages, nulls, empty texts, a long one, and a hot source."""
    rng = random.Random(seed)
    words = ["al", "Ber", "çon", "dé", "esto", "fin", "gor", "hul", "ib", "jon", "ka", "lum", "日本", "ov", "pri", "😀x"]

    def prose(k):
        return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(k))

    passage = prose(60)
    out = []
    for i in range(n):
        kind = i % 10
        text = prose(rng.randint(1, 120))
        if kind == 3 and out:
            text = rng.choice(out)[1]
        elif kind == 4 and out and out[-2][1]:
            parts = (out[-2][1]).split(" ")
            parts[rng.randrange(len(parts))] = "zz"
            text = " ".join(parts)
        elif kind == 5:
            text = prose(10) + "\n" + passage + " " + prose(10)
        elif kind == 6:
            text = [None, "", " \t\n", "ab", " ", "<|endoftext|> x"][i // 10 % 6]
        elif kind == 7 and out and out[-1][1]:
            text = out[-1][1].replace(" ", "  ")
        source = "hot" if kind < 4 else [None, "b", "é", "a"][i % 4]
        out.append((i, text, [None, "en"][i % 2], source, None if i % 7 == 0 else i))
    out.append((n, prose(3000), "en", "long", 1))
    return out


def edge_rows():
    """Repeated rows, one id for several texts, and no id at all."""
    base = rows(2, 30)
    same = "one two three four five six seven eight nine ten " * 6
    return [*base, base[5], base[5], (5, "another text of the same id", None, None, None), (None, same, None, "a", None), (None, None, None, None, None), (100, same, "en", "a", 3), (101, same, "en", "a", 3), (101, same, "en", "a", 3)]


def frame(spark, data, clash=False):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def plain_components(data):
    """doc_id to (n_shingles, component_id), by comparing all pairs."""
    sets = {i: shingles(t) for i, t, *_ in data}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            s = len(sets[a] & sets[b])
            if s and 100 * s >= 75 * (len(sets[a]) + len(sets[b]) - s):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def plain_removal(data, width=100):
    """doc_id to (n_bytes, n_removed, n_spans, kept_sha256), window by window."""
    seen, out = set(), {}
    for i, t, *_ in sorted(data):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for a in range(len(raw) - width + 1):
            w = raw[a : a + width]
            if w in seen:
                gone[a : a + width] = [True] * width
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
