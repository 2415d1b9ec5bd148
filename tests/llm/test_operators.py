"""The corpus operators against plain versions, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import os
import sys

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402
from graphloom.llm import bpe, exact, imatch, mixing, ngram_join, ordinal, quality, sharding, substrings, token_counts, toxicity  # noqa: E402


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def data():
    return cases.rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return cases.frame(spark, data).cache()


MODEL = ordinal.CumulativeLink({ordinal._hash("zz"): 5.0, ordinal._hash("^日本"): 1.0}, [2.0, 6.0])
FILE = bpe.default_file() if os.path.exists("/opt/tokenizers") else None
OPERATORS = {
    "toxicity": lambda d: toxicity.severity(d, MODEL),
    "imatch": lambda d: imatch.imatch(d, 1 / 64, 1 / 2),
    "mixing": lambda d: mixing.mix_sources(d),
    "quality": lambda d: quality.rated(d, MODEL),
    "exact": lambda d: exact.exact_groups(d),
    "token_counts": lambda d: token_counts.token_counts(d, FILE),
    "sharding": lambda d: sharding.shards(d, 2000),
    "bpe": lambda d: bpe.round_trip(d, FILE),
    "ngram_join": lambda d: ngram_join.components(d),
    "substrings": lambda d: substrings.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases(spark, name):
    """A row for every row, whatever it holds; the same with other columns, whose names clash."""
    data = cases.edge_rows()
    got = OPERATORS[name](cases.frame(spark, data))
    rows = collected(got)
    assert len(rows) == len(data)
    assert sorted(repr(r.doc_id) for r in got.select("doc_id").collect()) == sorted(repr(x[0]) for x in data)
    if name != "exact":  # which of rows alike in everything is kept is open
        assert collected(OPERATORS[name](cases.frame(spark, data, clash=True))) == rows


@pytest.mark.parametrize("name", OPERATORS)
def test_a_very_long_text(spark, name):
    """A text of more than 1 MiB, and its copy, beside short ones: each has its row."""
    import random

    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(50_000)}é" for _ in range(170_000))
    assert len(long.encode()) > 1 << 20
    data = [(1, "a b c d e f", "en", "a", 1), (2, long, "en", "a", 1), (3, long, "en", "b", 1), (4, None, None, None, None)]
    rows = {r.doc_id: r for r in OPERATORS[name](cases.frame(spark, data)).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    if name == "substrings":
        n = len(long.encode())
        assert rows[3].n_removed == n and rows[2].n_removed < n
    if name == "ngram_join":
        assert rows[3].component_id == 2 and rows[2].n_shingles > 160_000
    if name == "exact":
        assert rows[3].keep_id == 2 and rows[3].group_size == 2


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](cases.frame(spark, []).where("false")).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_only_null_and_empty_texts(spark, name):
    data = [(1, None, None, None, None), (2, "", None, None, None), (3, " ", None, None, None)]
    assert len(OPERATORS[name](cases.frame(spark, data)).collect()) == 3


# --- 1 and 4 -------------------------------------------------------------------


def test_thresholds_share_weights():
    assert MODEL.tails(3.0).shape == (2,) and MODEL.tails(3.0)[0] > MODEL.tails(3.0)[1]
    assert MODEL.expected(3.0) == pytest.approx(MODEL.tails(3.0).sum())


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows, feats = [], []
    for i, g in enumerate(grades):
        mine = {int(x) for x in rng.integers(10, 60, 5)} | ({1} if g >= 1 else set()) | ({2} if g == 2 else set())
        rows += [i] * len(mine)
        feats += sorted(mine)
    rows, feats = np.array(rows), np.array(feats)
    kept = ordinal.select_features(rows, feats, grades >= 1)
    assert 1 in kept and len(kept) < 10
    model = ordinal.fit(rows, feats, grades, kept=np.union1d(kept, [2]))
    score = lambda *f: sum(model.weights.get(x, 0) for x in f)
    assert model.expected(score()) < 0.3 < model.expected(score(1)) < 1.5 < model.expected(score(1, 2))
    assert model.thresholds == sorted(model.thresholds)


def auc(above, below):
    """The share of pairs in which the first is above; ties count half."""
    below = np.sort(below)
    return (np.searchsorted(below, above, "left") + np.searchsorted(below, above, "right")).sum() / (2 * len(above) * len(below))


def test_held_out_accuracy(spark, small):
    big = small.replace("sf0.001", "sf0.1")
    from graphloom.llm.common import documents, labels

    docs, marks = documents(spark, big), labels(spark, big)
    train, held = marks.where("doc_id % 3 <> 0"), marks.where("doc_id % 3 = 0")
    rejected = toxicity.severity(docs, toxicity.train(docs, train), ["text"]).join(held, "doc_id").toPandas()
    toxic, clean = rejected[rejected.toxic == 1], rejected[rejected.toxic == 0]
    assert clean.rejected.sum() <= 0.005 * len(rejected)
    assert toxic.rejected.sum() >= 0.9 * len(toxic)
    # Severity is higher where there is more abuse: the test's own list of what the tables' toxic texts hold.
    abuse = toxic.text.str.lower().str.count(r"\b(?:trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron|achli|achkei|réeux|boment)")
    some = toxic[abuse > 0].assign(n=abuse[abuse > 0])
    much = some.n > some.n.median()
    assert auc(some.severity[much], some.severity[~much]) > 0.75 and auc(toxic.severity, clean.severity) > 0.95
    rated = quality.rated(docs, quality.train(docs, train)).join(held, "doc_id").toPandas()
    assert (rated.kept & (rated.quality == 0)).sum() <= 0.05 * (rated.quality == 0).sum()
    assert (~rated.kept & (rated.quality == 1)).sum() <= 0.01 * len(rated)
    bad, mid, top = (rated[x] for x in (rated.quality == 0, (rated.quality == 1) & (rated.toxic == 1), (rated.quality == 1) & (rated.toxic == 0)))
    assert auc(top.p_clean, mid.p_clean) > 0.9 and auc(mid.p_good, bad.p_good) > 0.9
    assert bad.expected_grade.mean() < 0.5 < mid.expected_grade.mean() < 1.5 < top.expected_grade.mean()


def plain_loss(model, names, rows, features, grades, ridge):
    """Minus the mean weighted log-likelihood of the grades, text by text, as the fit weighs them, and the ridge."""
    k = len(model.thresholds) + 1
    counts = [list(grades).count(g) for g in range(k)]
    total = weights = 0.0
    for i, g in enumerate(grades):
        score = sum(model.weights[f] for r, f in zip(rows, features) if r == i and f in model.weights)
        tails = [1.0, *[1 / (1 + np.exp(-(score - t))) for t in model.thresholds], 0.0]
        w = np.sqrt(len(grades) / (k * counts[g]))
        total -= w * np.log(tails[g] - tails[g + 1])
        weights += w
    return total / weights + ridge / 2 * sum(model.weights[f] ** 2 for f in names)


def test_fit_is_a_minimum_of_the_likelihood():
    """No small change of any weight or threshold has a greater likelihood."""
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 3, 120)
    features = [sorted({int(x) for x in rng.integers(0, 6, 2)} | ({7} if rng.random() < 0.2 + 0.3 * g else set())) for g in grades]
    rows, flat = np.repeat(np.arange(120), [len(x) for x in features]), np.array([f for x in features for f in x])
    names = [0, 1, 2, 7]
    model = ordinal.fit(rows, flat, grades, kept=np.array(names), ridge=0.01, rounds=3000, step=0.02)
    least = plain_loss(model, names, rows, flat, grades, 0.01)
    for change in (-0.05, 0.05):
        for f in names:
            other = ordinal.CumulativeLink(model.weights | {f: model.weights[f] + change}, model.thresholds)
            assert plain_loss(other, names, rows, flat, grades, 0.01) > least
        for k in range(2):
            moved = [t + change * (j == k) for j, t in enumerate(model.thresholds)]
            assert plain_loss(ordinal.CumulativeLink(model.weights, moved), names, rows, flat, grades, 0.01) > least


def test_marks_are_counted_not_weighed():
    model = ordinal.CumulativeLink({ordinal.MARK_HASHES[0]: -2.0, ordinal.MARK_HASHES[1]: -1.0, 5: 3.0}, [0.0], frozenset({8, 9, 10}))
    assert [model.score(x) for x in ([], [5], [5, 8], [8, 9], [8, 9, 10])] == [0, 3, 1, -3, -3]
    rows, features = ordinal.marked(np.array([0, 0, 1, 1, 1]), np.array([5, 8, 8, 9, 5], np.uint32), 3, np.array([8, 9, 10], np.uint32))
    assert sorted(zip(rows.tolist(), features.tolist())) == sorted([(0, 5), (0, ordinal.MARK_HASHES[0]), (1, 5), (1, ordinal.MARK_HASHES[0]), (1, ordinal.MARK_HASHES[1])])


def test_scorer_finds_the_features_of_training():
    texts = ["", "achlichver achlichzu und die", "One two. ### ###", "déjà " * 300 + "réeuxment", "UPPER!! CASE!!"]
    names = sorted({h for t in texts for h in ordinal.text_features(t)})
    scorer = ordinal.Scorer(ordinal.CumulativeLink({h: 1.0 for h in names[::2]}, [0.0], frozenset(names[1::4])))
    counts = set(names[::2]) | set(names[1::4])
    for t in [*texts, *texts]:
        assert scorer.features(t) == set(ordinal.text_features(t)) & counts


@pytest.mark.parametrize("module,rated", [(toxicity, toxicity.severity), (quality, quality.rated)])
def test_training_with_few_labels(spark, docs, data, module, rated):
    """No labels, one class only, labels twice, for no document or null: a model all the same, and a row for each document."""
    flag = "rejected" if module is toxicity else "kept"
    schema = "doc_id long, quality int, toxic int"
    for marks, all_of in [([], module is quality), ([(1, 1, 0), (2, 1, 0)], module is quality), ([(1, 0, 1), (2, 0, 1)], module is toxicity)]:
        labelled = spark.createDataFrame(marks, schema)
        got = rated(docs, module.train(docs, labelled)).collect()
        assert len(got) == len(data) and all(r[flag] == all_of for r in got)
    twice = [(1, 1, 0), (1, 1, 0), (1, 0, 1), (2, 0, 1), (2, 0, 1), (999, 1, 0), (None, 1, 1), (3, None, None), (5, 1, 1), (8, 1, 0)]
    assert rated(docs, module.train(docs, spark.createDataFrame(twice, schema))).count() == len(data)


def test_asked_columns_do_not_clash(spark):
    """A caller's column with a result's name gives way to the result; others stay as they are."""
    from pyspark.sql import functions as F

    docs = cases.frame(spark, cases.edge_rows()).withColumns({c: F.lit("x") for c in ("score", "expected", "tail_1", "severity", "p_good", "kept", "rejected")})
    for rated, own in ((toxicity.severity, "rejected"), (quality.rated, "kept")):
        rows = rated(docs, MODEL, ["doc_id", "score", "expected", "tail_1", "severity", "p_good", "kept", "rejected", "lang"]).collect()
        assert all(r.score == r.expected == r.tail_1 == "x" and isinstance(r[own], bool) for r in rows)


# --- 2 ---------------------------------------------------------------------------


def test_imatch_against_plain(docs, data):
    least, most = 1 / 16, 1 / 2
    got = {r.doc_id: r for r in imatch.imatch(docs, least, most).collect()}
    h64 = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed=seed)
    terms = {i: {h64(w.encode()) for w in cases.words((t or "").lower())} for i, t, *_ in data}
    n = len(data)
    df = {}
    for s in terms.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    lexicon = {t for t, c in df.items() if max(2, n * least) <= c <= max(2, n * most)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def listed(values, seed=42):
        for v in values:
            seed = h64(int(v).to_bytes(8, "little", signed=True), seed)
        return seed

    def prints(words):
        kept = sorted(signed(t) for t in words & lexicon)
        if not kept:
            whole = listed(sorted(signed(t) for t in words), h64(b"none"))
        else:
            whole = listed(kept)
        out = [whole]
        for bits in imatch.TIERS:
            for k in range(imatch.SUBSETS):
                own = [t for t in kept if (t & ((1 << 64) - 1)) >> (k * imatch.STRIDE) & ((1 << bits) - 1) == 0]
                out.append(listed(own) if own else 0)
        return "-".join(f"{x & 0xFFFFFFFF:08x}" for x in out)

    ids = sorted(terms)
    by = dict((i, t or "") for i, t, *_ in data)
    for k, i in enumerate(ids):
        text, following = by[i], by[ids[(k + 1) % len(ids)]]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == prints(terms[i])
        assert r.edited_fingerprint == prints({h64(w.encode()) for w in cases.words(edited.lower())})
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_next_document_whatever_the_ids(spark, monkeypatch):
    """Ids at both ends of long and in clumps, many buckets, a null id; a lexicon that isn't broadcast."""
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 3)
    monkeypatch.setattr(imatch, "COARSE", 5)
    monkeypatch.setattr(imatch, "FINE", 4)
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 10)
    ids = [-(1 << 63), (1 << 63) - 1, 0, *range(1000, 1040), 1 << 50, (1 << 50) + 1, -5]
    data = [(i, f"{'abcdefgh'[k % 8]} word{k % 5} t{k} " * 4, None, None, None) for k, i in enumerate(ids)]
    by = {i: t for i, t, *_ in data}
    order = sorted(ids)
    got = {r.doc_id: r for r in imatch.imatch(cases.frame(spark, data), 1 / 64, 1 / 2).collect()}
    for k, i in enumerate(order):
        text, following = by[i], by[order[(k + 1) % len(order)]]
        q = len(text) // 4
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest()
    spread = imatch.in_buckets(cases.frame(spark, data).select("doc_id", "text")).where("not _copy").groupBy("_at").count().collect()
    assert len(spread) > 8 and max(r["count"] for r in spread) <= 8
    monkeypatch.undo()
    again = {r.doc_id: r for r in imatch.imatch(cases.frame(spark, data), 1 / 64, 1 / 2).collect()}
    assert again == got


# --- 3 ---------------------------------------------------------------------------


def test_mixing_targets_and_limits(docs, data):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(data)
    sizes = {i: len(cases.words(t)) for i, t, *_ in data}
    source = {i: s for i, _, _, s, _ in data}
    total = sum(sizes.values())
    by = {}
    for r in rows:
        assert r.size == sizes[r.doc_id] and 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by.setdefault(source[r.doc_id], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    own = {s: sum(r.size for r in by[s]) for s in names}
    # reshare the excess until none is above
    target, left, free = {}, float(total), set(names)
    while free:
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > 3 * own[s]]
        if not over:
            target |= {s: left * weights[s] / w for s in free}
            break
        for s in over:
            target[s] = 3.0 * own[s]
            free.discard(s)
        left = total - sum(target[s] for s in target)
    for s in names:
        assert all(r.target == pytest.approx(target[s]) and r.source_size == own[s] for r in by[s])
        longest = max(r.size for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= longest + max(sizes.values())
    assert collected(mixing.mix_sources(docs)) == sorted((tuple(r) for r in rows), key=repr)


def test_mixing_is_the_same_with_more_slots_and_ranges(spark, monkeypatch):
    """Neither how many slots and ranges there are nor how sources are dealt to tasks changes the mix; many sources, ties among them."""
    data = [(i, f"w{i} " * (i * 7 % 23), None, None if i % 41 == 0 else f"host{i % 40:02d}", None) for i in range(400)]
    plain = collected(mixing.mix_sources(cases.frame(spark, data)))
    assert len(plain) == 400
    monkeypatch.setattr(mixing, "SLOT_ROWS", 2)
    monkeypatch.setattr(mixing, "SLOT_BITS", 1)
    monkeypatch.setattr(mixing, "RANGES", 3)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        assert collected(mixing.mix_sources(cases.frame(spark, data))) == plain
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


# --- 5 ---------------------------------------------------------------------------


def test_exact_against_plain(docs, data):
    strip = lambda t: "".join(cases.words(t))
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(strip(t), []).append((-len(t or ""), i))
    for r in exact.exact_groups(docs).collect():
        text = strip(dict((i, t) for i, t, *_ in data)[r.doc_id])
        keep = min(groups[text])[1]
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(groups[text]), keep == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_collisions_widen_identifiers(spark, monkeypatch):
    """With identifiers that collide on purpose, the verified width is the next one."""
    docs = cases.frame(spark, [(1, "a", None, None, None), (2, "b", None, None, None)])
    assert exact.verified(docs, 8)
    true = exact._identifier
    monkeypatch.setattr(exact, "_identifier", lambda c, w: b"same" if w == 8 else true(c, w))
    table = spark.createDataFrame([(b"same", b"a"), (b"same", b"b")], "id binary, chunk binary")
    monkeypatch.setattr(exact, "chunk_table", lambda d, w: table if w == 8 else table.limit(1))
    assert not exact.verified(docs, 8) and exact.verified(docs, 16)


def test_cuts_make_up_the_text():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 200_000).astype(np.uint8)
    ends = exact.cuts(raw, np.array([0, 10, 10, 200_000]))
    assert ends[0] == [10] and ends[1] == [] and ends[2][-1] == 199_990
    sizes = np.diff([0, *ends[2]])
    assert sizes.max() <= exact.LONGEST and (sizes[:-1] >= exact.SHORTEST).all()


# --- 6 and 7 ---------------------------------------------------------------------


def library_counts(data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    return sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in data)


@pytest.mark.skipif(FILE is None, reason="no vocabulary")
@pytest.mark.parametrize("block", (token_counts.BLOCK, 64, 7))
def test_token_counts(docs, data, block):
    got = token_counts.token_counts(docs, FILE, block)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == library_counts(data)


def lengths(files, block, end=256, span=token_counts.SPAN):
    return [(r.number, r.n_tokens) for r in token_counts.document_lengths(token_counts.scan_blocks(files, end, block), span).orderBy("file", "number").collect()]


def test_token_files(spark, tmp_path):
    ids = np.array([5, 6, 256, 256, 7, 8, 9, 256, 1], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (2, 3, 100):
        for span in (1, 2, 1024):
            assert lengths(token_counts.read_token_files(spark, str(tmp_path)), block, span=span) == [(0, 2), (1, 0), (2, 3), (3, 1)]
    (tmp_path / "c.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends within an id"):
        lengths(token_counts.read_token_files(spark, str(tmp_path)), 2)


def test_separators_at_every_place(spark, tmp_path):
    """Against a plain loop, with separators before, at and after the edges of blocks and of spans."""
    rng = np.random.default_rng(8)
    expected = []
    for k in range(12):
        ids = rng.integers(1, 5, 40)
        ids[rng.random(40) < (0.05, 0.3, 0.8)[k % 3]] = 0
        ids[k] = 0
        ids.astype("<u2").tofile(tmp_path / f"f{k:02d}.bin")
        number, n = 0, 0
        for x in ids.tolist():
            if x == 0:
                expected.append((number, n))
                number, n = number + 1, 0
            else:
                n += 1
        if n:
            expected.append((number, n))
    for block, span in ((4, 1), (4, 2), (1, 3), (5, 4), (64, 2)):
        assert lengths(token_counts.read_token_files(spark, str(tmp_path)), block, 0, span) == expected


def test_token_files_beyond_what_spark_reads_whole(spark, tmp_path):
    size = (1 << 31) + 64  # bytes: zeros, but for three separators
    with open(tmp_path / "long.bin", "wb") as f:
        for at in (10, size - 20, size - 4):
            f.seek(at)
            f.write(np.array([256], "<u2").tobytes())
        f.truncate(size)
    assert [n for _, n in lengths(token_counts.read_token_files(spark, str(tmp_path)), 1 << 22)] == [5, (size - 30) // 2 - 1, 7, 1]


def test_token_files_behind_a_mount(spark, tmp_path):
    (tmp_path / "a b.bin").write_bytes(np.array([5, 256, 6, 7, 256], "<u2").tobytes())
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tokens.link./in", f"file://{tmp_path}")
    assert [n for _, n in lengths(token_counts.read_token_files(spark, "viewfs://tokens/in"), 2)] == [1, 2]


@pytest.mark.skipif(FILE is None, reason="no vocabulary")
def test_token_counts_read_files(docs, data, spark, monkeypatch):
    """The counts come from files that are read by ranges, and the files are gone afterwards."""
    made = []
    write = token_counts.write_token_files
    monkeypatch.setattr(token_counts, "write_token_files", lambda docs, folder, file: made.append(folder) or write(docs, folder, file))
    got = token_counts.token_counts(docs, FILE)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == library_counts(data)
    assert len(made) == 1 and not os.path.exists(made[0].removeprefix("file:"))


def plain_shards(data, limit):
    """Rows as the operator returns them, by splitting one bucket at a time, and only those over the limit."""
    turns, items = {}, []
    for i, t, *_ in data:
        name = hashlib.md5(f"{'-' if i is None else i}|{t or ''}".encode()).hexdigest()
        turns[name] = turns.get(name, -1) + 1
        bits = int(hashlib.md5(f"{name}|{turns[name]}".encode()).hexdigest()[: sharding.BITS // 4], 16)
        items.append((i, len((t or "").encode()), format(bits, f"0{sharding.BITS}b")))
    done, todo = [], [("", items)]
    while todo:
        prefix, own = todo.pop()
        if sum(n for _, n, _ in own) <= limit or len(own) <= 1:
            done += [(prefix, own)] if own else []
        else:
            todo += [(prefix + d, [x for x in own if x[2][len(prefix)] == d]) for d in "01"]
    return sorted(((i, n, k, p, len(p), sum(m for _, m, _ in own)) for k, (p, own) in enumerate(sorted(done)) for i, n, _ in own), key=repr)


@pytest.mark.parametrize("limit", (200, 500, 5000, 10**9))
def test_shards_against_splitting_by_hand(spark, docs, data, limit):
    """Also rows that are alike in all, which fill more than one shard."""
    assert collected(sharding.shards(docs, limit)) == plain_shards(data, limit)
    repeated = [*data[:20], *[(7, "the same text " * 5, "en", "a", 1)] * 50, *[(None, None, None, None, None)] * 5]
    assert collected(sharding.shards(cases.frame(spark, repeated), limit)) == plain_shards(repeated, limit)


# --- 8 ---------------------------------------------------------------------------


@pytest.mark.skipif(FILE is None, reason="no vocabulary")
def test_bpe_against_the_library(docs, data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    by = {i: t or "" for i, t, *_ in data}
    for r in bpe.round_trip(docs, FILE).collect():
        ids = library.encode(by[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, FILE).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, FILE), FILE).collect()}
    assert back == by and all(list(library.encode(by[i], add_special_tokens=False).ids) == list(x) for i, x in ids.items())


@pytest.mark.skipif(FILE is None, reason="no vocabulary")
def test_bpe_pieces_and_odd_texts():
    import random

    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(FILE), bpe.PrefixEncoder(FILE), random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("aab eth\n\t.,'s0é中 　\x1c\x85") for _ in range(rng.randint(0, 40)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.skipif(FILE is None, reason="no tokenizer files")
@pytest.mark.parametrize("part,key,value", [("model", "ignore_merges", True), ("model", "byte_fallback", True), ("pre_tokenizer", "add_prefix_space", True), (None, "normalizer", {"type": "NFC"})])
def test_tokenizer_files_that_ask_for_more_are_refused(tmp_path, part, key, value):
    import json

    with open(FILE, encoding="utf-8") as f:
        read = json.load(f)
    (read[part] if part else read)[key] = value
    (tmp_path / "other.json").write_text(json.dumps(read), encoding="utf-8")
    with pytest.raises(ValueError, match="unsupported"):
        bpe.PrefixEncoder(str(tmp_path / "other.json"))


# --- 9 and 10 --------------------------------------------------------------------


def test_components_against_all_pairs(docs, data):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect()} == cases.plain_components(data)


def test_components_of_cut_blocks(spark, monkeypatch):
    """A family of near copies in blocks that are cut into many chunks."""
    import random

    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    data = []
    for i in range(60):
        words = base[:]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"x{i}-{rng.randrange(99)}"
        data.append((i, " ".join(words), None, None, None))
    for chunk, sets, rows in ((500, 512, 100_000), (1 << 20, 7, 1)):
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        monkeypatch.setattr(ngram_join, "CHUNK_SETS", sets)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", rows)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(cases.frame(spark, data)).collect()}
        assert got == cases.plain_components(data)


def test_components_where_the_map_is_not_complete(spark, docs, data, monkeypatch):
    """With so few slots that most are common, elements of one set only are sent too."""
    monkeypatch.setattr(ngram_join, "MOST_COMMON", 0.1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect()} == cases.plain_components(data)


def family(n, changes, seed=9):
    """Texts that are near each other, but mostly not near the first."""
    import random

    rng = random.Random(seed)
    base = [f"w{k}" for k in range(160)]
    out = []
    for i in range(n):
        words = base[:]
        for _ in range(12 if i == 0 else changes):
            words[rng.randrange(160)] = f"x{i}-{rng.randrange(99)}"
        out.append((i, " ".join(words), None, None, None))
    return out


def test_a_family_makes_few_links(spark):
    data = family(200, 4)
    edges, _ = ngram_join.links(cases.frame(spark, data).select("doc_id", "text"))
    assert edges.count() < 1000
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(cases.frame(spark, data)).collect()} == cases.plain_components(data)


def test_spanning_links_against_all_pairs():
    rng = np.random.default_rng(12)
    for trial in range(30):
        bases = [rng.integers(0, 1 << 60, 40).astype(np.uint64) for _ in range(3)]
        sets = []
        for _ in range(40):
            s = bases[rng.integers(0, 3)].copy()
            s[rng.integers(0, 40, rng.integers(0, 9))] = rng.integers(0, 1 << 60)
            sets.append(np.unique(s))
        links = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
        found, groups = ngram_join.spanning_links(sets, [len(s) for s in sets], trial % 40)
        plain = ngram_join.Groups(40)
        for i, j in links:
            plain.join(i, j)
        assert [groups.of(i) for i in range(40)] == [plain.of(i) for i in range(40)]
        assert len(found) < 40 and {(max(x), min(x)) for x in found} <= set(links)


def test_divide_skip_finds_all():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 50).astype(np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        s[rng.integers(0, 50, rng.integers(0, 14))] = rng.integers(0, 1 << 60)
        sets.append(np.unique(s[: rng.integers(35, 51)]))
    index = ngram_join.OccurrenceIndex(sets)
    for i, s in enumerate(sets):
        expected = [j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))]
        assert index.search(s) == expected


def test_removal_against_every_window(docs, data, monkeypatch):
    expected = cases.plain_removal(data)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()}
    assert got == expected


def test_removal_in_pieces_and_split(docs, data, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 700)
    monkeypatch.setattr(substrings, "MANY", 1)
    monkeypatch.setattr(substrings, "GATHER", 50)
    monkeypatch.setattr(substrings, "BROADCAST_KEYS", 3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()}
    assert got == cases.plain_removal(data)


def test_removal_trusts_no_hash(docs, data, monkeypatch):
    """With names of contexts that are the same for most, the result is the same: bytes are compared."""
    true = substrings.contexts

    def alike(raw, offsets):
        *others, name = true(raw, offsets)
        return (*others, name & np.uint64(1))

    monkeypatch.setattr(substrings, "contexts", alike)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()}
    assert got == cases.plain_removal(data)


def test_a_line_of_many_documents(spark, monkeypatch):
    """A line that hundreds of texts have, each within its own words: groups that are split many times."""
    import random

    rng = random.Random(6)
    line = "this line of more than one hundred bytes stands in very many documents, whatever else there is in them, all of them. "
    data = [(i, " ".join(str(rng.random()) for _ in range(8)) + line[: rng.randint(90, 117)] + " ".join(str(rng.random()) for _ in range(8)), None, None, None) for i in range(300)]
    monkeypatch.setattr(substrings, "MANY", 5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(cases.frame(spark, data)).collect()}
    assert got == cases.plain_removal(data) and sum(r[1] > 0 for r in got.values()) > 150


def test_substrings_give_the_text_back(docs, data):
    """kept is the text without the repeats: its digest and length are those of the other columns."""
    rows = substrings.remove_repeats(docs, with_text=True).collect()
    assert len(rows) == len(data) and any(r.n_removed for r in rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in rows)
