"""Golden cases of reductions, segments, group statistics and lookups."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import compose, core, grad, linalg, lookup, order, reduce


def elements(spark, idx, val, kind="double"):
    return spark.createDataFrame([(p, i, v) for p, (i, v) in enumerate(zip(idx, val))], f"pos long, idx long, val {kind}")


def values(df, index="idx", column="val"):
    return [r[column] for r in df.orderBy(index).collect()]


@pytest.fixture(scope="module")
def six(spark):
    return elements(spark, [0, 1, 0, 1, 1, 3], [1.0, 2.0, 1.0, 5.0, 2.0, 7.0])


def test_inferred_size_and_empty_bucket(six):
    assert values(reduce.scatter_sum(six)) == [2.0, 9.0, 0.0, 7.0]
    assert values(reduce.scatter_mul(six)) == [1.0, 20.0, 1.0, 7.0]
    assert values(reduce.scatter_mean(six)) == [1.0, 3.0, 0.0, 7.0]
    assert values(reduce.scatter_sum(six, dim_size=6)) == [2.0, 9.0, 0.0, 7.0, 0.0, 0.0]


def test_first_position_wins_ties(six):
    low = reduce.scatter_min(six)
    assert values(low) == [1.0, 2.0, 0.0, 7.0] and values(low, column="arg") == [0, 1, 6, 5]
    high = reduce.scatter_max(six)
    assert values(high) == [1.0, 5.0, 0.0, 7.0] and values(high, column="arg") == [0, 3, 6, 5]


def test_out_seeds_the_minimum(spark):
    e = elements(spark, [0, 1, 0, 1, 1, 3], [5.0, -1.0, 3.0, -7.0, 2.0, 9.0])
    out = spark.createDataFrame([(i, 100.0) for i in range(4)], "idx long, val double")
    got = reduce.scatter_min(e, out=out)
    assert values(got) == [3.0, -7.0, 100.0, 9.0] and values(got, column="arg") == [2, 3, 6, 5]


def test_out_goes_on(spark, six):
    out = spark.createDataFrame([(i, 10.0) for i in range(4)], "idx long, val double")
    assert values(reduce.scatter_sum(six, out=out)) == [12.0, 19.0, 10.0, 17.0]
    assert values(reduce.scatter_mul(six, out=out)) == [10.0, 200.0, 10.0, 70.0]
    assert values(reduce.scatter_mean(six, out=out)) == pytest.approx([6.0, 19 / 3, 10.0, 17.0])
    assert values(reduce.segment_mean_coo(six, out=out)) == [1.0, 3.0, 10.0, 7.0]


def test_whole_numbers(spark):
    e = elements(spark, [0, 0, 1], [-7, 0, 3], "long")
    assert values(reduce.scatter_mean(e)) == [-4, 3]
    assert values(reduce.scatter_mul(e)) == [0, 3]


def test_nan_and_the_worst_infinity_never_win(spark):
    e = elements(spark, [0, 0, 1, 2], [math.nan, 2.0, math.nan, math.inf])
    low = reduce.scatter_min(e)
    assert values(low) == [2.0, 0.0, 0.0] and values(low, column="arg") == [1, 4, 4]
    # +inf is a maximum like any other; -inf never is
    assert values(reduce.scatter_max(e)) == [2.0, 0.0, math.inf]
    low = reduce.scatter_max(elements(spark, [0, 1], [-math.inf, -3.0]))
    assert values(low) == [0.0, -3.0] and values(low, column="arg") == [2, 1]


def test_empty_input(spark):
    e = elements(spark, [], [])
    for op in ("sum", "mean", "min", "max"):
        assert values(reduce.scatter(e, op, dim_size=3)) == [0.0, 0.0, 0.0]
    assert values(reduce.scatter_min(e, dim_size=3), column="arg") == [0, 0, 0]


def test_unknown_reduction_raises(six):
    for f in (reduce.scatter, reduce.segment_coo):
        with pytest.raises(ValueError):
            f(six, "median")
    with pytest.raises(ValueError):
        reduce.segment_coo(six, "mul")


def test_coo_csr_and_scatter_agree(spark):
    e = elements(spark, [0, 0, 0, 1, 1, 2, 3, 3], [3.0, 1.0, 1.0, 4.0, 4.0, 9.0, -2.0, 6.0])
    ptr = spark.createDataFrame([(0, 0), (1, 3), (2, 5), (3, 6), (4, 8)], "r long, offset long")
    for op in reduce.SEGMENT:
        a, b, c = reduce.scatter(e, op), reduce.segment_coo(e, op), reduce.segment_csr(e, ptr, op)
        assert values(a) == values(b) == values(c, "r")
        if op in ("min", "max"):
            assert values(a, column="arg") == values(b, column="arg") == values(c, "r", "arg")


def test_csr_with_empty_rows_and_elements_outside(spark):
    e = elements(spark, [0] * 6, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    ptr = spark.createDataFrame([(0, 1), (1, 1), (2, 4), (3, 4)], "r long, offset long")
    assert values(reduce.segment_sum_csr(e, ptr), "r") == [0.0, 9.0, 0.0]
    assert values(reduce.segment_max_csr(e, ptr), "r", "arg") == [6, 3, 6]


def test_long_ranges_cross_buckets(spark):
    n = 3 * core.RANGE_BUCKET + 5
    e = spark.range(n).select(F.col("id").alias("pos"), F.lit(1.0).alias("val"))
    ptr = spark.createDataFrame([(0, 0), (1, 10), (2, n - 1), (3, n)], "r long, offset long")
    assert values(reduce.segment_sum_csr(e, ptr), "r") == [10.0, n - 11.0, 1.0]
    assert lookup.gather_csr(ptr.select("r", F.col("offset").alias("val")), ptr).count() == n


def test_fused(spark):
    rows = [(p, i, k, float(p * 4 + k)) for p, i in enumerate([0, 1, 0, 1, 0]) for k in range(4)]
    e = spark.createDataFrame(rows, "pos long, idx long, k long, val double")
    got = {(r.idx, r.k): r.val for r in reduce.fused_scatter_reduce(e, ["sum", "max", "mean"]).collect()}
    assert len(got) == 24
    for i in (0, 1):
        for k in range(4):
            v = [x for _, j, kk, x in rows if j == i and kk == k]
            assert got[i, k] == sum(v) and got[i, k + 4] == max(v) and got[i, k + 8] == pytest.approx(sum(v) / len(v))
    with pytest.raises(ValueError):
        reduce.fused_scatter_reduce(e, ["mul"])


def test_softmax_sums_to_one(spark):
    e = elements(spark, [0, 1, 0, 1, 1, 3, 2, 0, 2, 3], [float(x) for x in range(10)])
    for r in compose.scatter_softmax(e).groupBy("idx").agg(F.sum("out").alias("s")).collect():
        assert r.s == pytest.approx(1)
    logs = compose.scatter_log_softmax(e).join(compose.scatter_softmax(e).select("pos", F.col("out").alias("p")), "pos")
    assert all(r.out == pytest.approx(math.log(r.p), abs=1e-9) for r in logs.collect())


def test_logsumexp(spark):
    e = elements(spark, [0, 0, 1, 1, 2], [1000.0, 1000.0, -1000.0, -1000.0, 5.0])
    assert values(compose.scatter_logsumexp(e)) == pytest.approx([1000 + math.log(2), -1000 + math.log(2), 5.0])
    holes = elements(spark, [0, 2, 0, 2], [1.0, 2.0, 3.0, 4.0])
    got = values(compose.scatter_logsumexp(holes, dim_size=4))
    assert got[1] == got[3] == 0.0
    out = spark.createDataFrame([(0, -999.0), (1, 42.0), (2, -7.0)], "idx long, val double")
    got = values(compose.scatter_logsumexp(elements(spark, [0, 0, 0], [1.0, 2.0, 3.0]), out=out))
    assert got == pytest.approx([math.log(math.e + math.e**2 + math.e**3), 42.0, -7.0])


def test_std(spark):
    e = elements(spark, [0, 0, 2], [1.0, 3.0, 5.0])
    assert values(compose.scatter_std(e, dim_size=4)) == pytest.approx([math.sqrt(2), 0.0, 0.0, 0.0])
    assert values(compose.scatter_std(e, dim_size=4, unbiased=False)) == pytest.approx([1.0, 0.0, 0.0, 0.0])


def test_composites_reject_whole_numbers(spark):
    e = elements(spark, [0], [1], "long")
    for f in (compose.scatter_softmax, compose.scatter_log_softmax, compose.scatter_std, compose.scatter_logsumexp):
        with pytest.raises(ValueError):
            f(e)


def test_softmax_csr_and_backward(spark):
    e = elements(spark, [0] * 6, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    ptr = spark.createDataFrame([(0, 1), (1, 2), (2, 5)], "r long, offset long")
    out = values(compose.softmax_csr(e, ptr), "pos", "out")
    assert out[0] == 0.0 and out[1] == 1.0 and out[5] == 0.0 and sum(out[2:5]) == pytest.approx(1)
    g = compose.softmax_csr(e, ptr).withColumn("grad", F.col("pos").cast("double"))
    back = values(compose.softmax_csr_backward(g, ptr), "pos", "grad_in")
    mean = sum(o * p for p, o in enumerate(out) if 2 <= p < 5)
    assert back == pytest.approx([0.0, 0.0, *[out[p] * (p - mean) for p in (2, 3, 4)], 0.0])


def test_hash_map(spark):
    keys = spark.createDataFrame([(0, 0), (1, 10), (2, 30), (3, 20)], "pos long, key long")
    table = lookup.HashMap(keys)
    query = spark.createDataFrame([(0, 30), (1, 10), (2, 20), (3, 40)], "q long, key long")
    assert values(table.get(query), "q", "value") == [2, 1, 3, -1]
    assert table.size() == 4 and values(table.keys(), "value", "key") == [0, 10, 30, 20]
    twice = spark.createDataFrame([(0, 5), (1, 5)], "pos long, key long")
    with pytest.raises(Exception, match="duplicate"):
        lookup.HashMap(twice).table().collect()
    assert values(lookup.HashMap(twice, unique=False).table(), "key", "value") == [0]
    with pytest.raises(ValueError):
        lookup.HashMap(keys.withColumn("key", F.lit("a")))


def test_sampled_ops(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "pos long, feat array<double>")
    b = spark.createDataFrame([(0, [0.0, 2.0]), (1, [1.0, 1.0])], "pos long, feat array<double>")
    pairs = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "pos long, li long, ri long")
    assert values(lookup.sampled_sub(a, b, pairs), "pos", "feat") == [[3.0, 2.0], [1.0, 0.0]]
    assert values(lookup.sampled_div(a, b, pairs), "pos", "feat")[0] == [math.inf, 2.0]
    assert values(lookup.sampled_add(a, b, pairs, left_index=None, right_index=None), "pos", "feat") == [[1.0, 4.0], [4.0, 5.0]]
    with pytest.raises(ValueError):
        lookup.sampled("pow", a, b, pairs)


def test_index_sort(spark):
    n = 5000
    e = spark.range(n).select(F.col("id").alias("pos"), F.pmod(F.col("id") * 7919, F.lit(1009)).alias("val"))
    rows = order.index_sort(e).orderBy("rank").collect()
    plain = sorted(((i * 7919) % 1009, i) for i in range(n))
    assert [(r.rank, r.val, r.perm) for r in rows] == [(k, v, p) for k, (v, p) in enumerate(plain)]
    assert order.index_sort(e, max_value=1009).count() == n
    with pytest.raises(ValueError):
        order.index_sort(e.withColumn("val", F.lit(0.5)))


def test_gradient_of_product_at_zero(spark):
    e = elements(spark, [0, 0, 1, 1, 2, 2], [2.0, 0.0, 3.0, 0.0, 5.0, 0.0])
    g = spark.createDataFrame([(i, 1.0) for i in range(3)], "idx long, grad double")
    assert values(grad.scatter_mul_backward(g, e, reduce.scatter_mul(e)), "pos", "grad") == [0.0] * 6


def test_first_seen_labels(spark):
    rows = spark.createDataFrame([(p, v) for p, v in enumerate([7, 3, 7, 9, 3, 1])], "pos long, node long")
    assert {r.node: r.local_id for r in lookup.relabel_ids(rows).collect()} == {7: 0, 3: 1, 9: 2, 1: 3}


def test_products_of_whole_numbers(spark):
    """Zeros, signs, nulls, many ones in one bucket, the least long; and an overflow raises."""
    lists = {0: [2, -3, 1], 1: [0, 5, 7], 2: [-1] * 301, 3: [-2] * 63, 4: [None], 5: [1] * 1000 + [9], 6: [0] + [3] * 100}
    rows = [(k, v) for k, values in lists.items() for v in values]
    df = spark.createDataFrame([(p, i, v) for p, (i, v) in enumerate(rows)], "pos long, idx long, val long")
    got = {r.idx: r.val for r in reduce._whole_products(df, ["idx"], "val").collect()}
    assert got == {0: -6, 1: 0, 2: -1, 3: -(1 << 63), 4: None, 5: 9, 6: 0}
    with pytest.raises(Exception, match="overflow"):
        reduce._whole_products(spark.createDataFrame([(0, 0, 2)] * 64, "pos long, idx long, val long"), ["idx"], "val").collect()


def test_sort_with_outliers_and_a_hot_value(spark):
    """An outlier and a value that most rows have don't put all in one range; ranks are those of a plain sort."""
    values = [5] * 400 + list(range(200)) + [1 << 60, -(1 << 60)]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, val long").repartition(5)
    got = sorted(tuple(r) for r in order.index_sort(df, buckets=16).select("rank", "val", "perm").collect())
    assert got == [(k, v, p) for k, (v, p) in enumerate(sorted((v, p) for p, v in enumerate(values)))]


def test_gathers_into_what_is_there(spark):
    source = spark.createDataFrame([(0, 1.5), (1, 2.5)], "pos long, val double")
    out = spark.createDataFrame([(p, -1.0) for p in range(5)], "pos long, val double")
    elements = spark.createDataFrame([(1, 1), (3, 0)], "pos long, idx long")
    assert sorted(map(tuple, lookup.gather_coo(elements, source, out=out).collect())) == [(0, -1.0), (1, 2.5), (2, -1.0), (3, 1.5), (4, -1.0)]
    ptr = spark.createDataFrame([(0, 1), (1, 3), (2, 4)], "r long, offset long")
    rows = source.withColumnRenamed("pos", "r")
    assert sorted(map(tuple, lookup.gather_csr(rows, ptr, out=out).collect())) == [(0, -1.0), (1, 1.5), (2, 1.5), (3, 2.5), (4, -1.0)]


def test_maps_are_pickled(spark):
    import pickle

    keys = spark.createDataFrame([(0, 7), (1, 9)], "pos long, key long")
    again = pickle.loads(pickle.dumps(lookup.HashMap(keys, num_submaps=4)))
    assert {r.key: r.value for r in again.get(spark.createDataFrame([(9,), (8,)], "key long")).collect()} == {9: 1, 8: -1}
    with pytest.raises(ValueError):
        lookup.HashMap(keys, num_submaps=-2)


def test_segment_matmul_by_ranges_and_backward(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, w, g = rng.normal(size=(6, 3)), rng.normal(size=(2, 3, 4)), rng.normal(size=(6, 4))
    group = [0, 0, 0, 0, 1, 1]
    rows = spark.createDataFrame([(p, group[p], x[p].tolist()) for p in range(6)], "pos long, grp long, feat array<double>")
    weights = spark.createDataFrame([(k, m, w[k][:, m].tolist()) for k in range(2) for m in range(4)], "grp long, m int, col array<double>")
    ptr = spark.createDataFrame([(0, 0), (1, 4), (2, 6)], "r long, offset long")
    for got in (linalg.segment_matmul(rows, weights), linalg.segment_matmul(rows.drop("grp"), weights, ptr=ptr)):
        for r in got.collect():
            assert r.feat == pytest.approx(x[r.pos] @ w[group[r.pos]])
    grads = spark.createDataFrame([(p, g[p].tolist()) for p in range(6)], "pos long, feat array<double>")
    to_rows, to_weights = linalg.segment_matmul_backward(grads, rows, weights)
    for r in to_rows.collect():
        assert r.feat == pytest.approx(w[group[r.pos]] @ g[r.pos])
    for r in to_weights.collect():
        own = [p for p in range(6) if group[p] == r.grp]
        assert r.col == pytest.approx(x[own].T @ g[own][:, r.m])


def test_distinct_ranks(spark):
    values = spark.range(40_000).select(F.when(F.col("id") < 20_000, F.lit(77)).otherwise(F.col("id") * 7919 % 10_007).alias("val"))  # one has half of the rows
    expected = sorted({77} | {i * 7919 % 10_007 for i in range(20_000, 40_000)})
    ranks = order.distinct_ranks(values)
    assert sorted((r.rank, r.val) for r in ranks.collect()) == list(enumerate(expected))
    assert order.distinct_ranks(values.where("val < 0")).count() == 0
