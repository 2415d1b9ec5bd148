"""Golden cases of graph sampling, similarity joins, matching, partitioning and biased choice."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.operators import cluster, core, linalg, randomness, sampling, spatial
from graphloom.sources import graphs


def cycle(spark, n=6):
    """Node i has edges 2i to i - 1 and 2i + 1 to i + 1; neighbour times and edge times are their numbers."""
    rows = [(2 * i + k, i, (i + (1 if k else -1)) % n) for i in range(n) for k in (0, 1)]
    return spark.createDataFrame(rows, "edge_id long, src long, dst long")


def sorted_cycle(spark, n=6):
    """The same with each node's neighbours ascending, and edges numbered so."""
    rows, e = [], 0
    for i in range(n):
        for j in sorted([(i - 1) % n, (i + 1) % n]):
            rows.append((e, i, j, e))
            e += 1
    return spark.createDataFrame(rows, "edge_id long, src long, dst long, etime long")


def seeds(spark, nodes, times=None):
    rows = [(p, n, (times or nodes)[p]) for p, n in enumerate(nodes)]
    df = spark.createDataFrame(rows, "pos long, node long, time long")
    return df if times else df.drop("time")


def edges_of(sample):
    rows = sample.edges.orderBy("hop", "row", "pick").collect()
    return [r.row for r in rows], [r.col for r in rows], [r.edge_id for r in rows]


def nodes_of(sample):
    return [(r.batch, r.node) for r in sample.nodes.orderBy("local_id").collect()]


def test_full_two_hops(spark):
    s = sampling.neighbor_sample(cycle(spark), seeds(spark, [2, 3]), [-1, -1])
    assert edges_of(s) == ([0, 0, 1, 1, 2, 2, 3, 3], [2, 1, 0, 3, 4, 0, 1, 5], [4, 5, 6, 7, 2, 3, 8, 9])
    assert [n for _, n in nodes_of(s)] == [2, 3, 1, 4, 0, 5]
    assert [r.num_nodes for r in s.nodes_per_hop().orderBy("hop").collect()] == [2, 2, 2]
    assert [r.num_edges for r in s.edges_per_hop().orderBy("hop").collect()] == [4, 4]


def test_no_edges(spark):
    none = spark.createDataFrame([], "edge_id long, src long, dst long")
    s = sampling.neighbor_sample(none, seeds(spark, [0, 1, 2, 3, 4]), [-1, -1])
    assert s.edges.count() == 0 and [n for _, n in nodes_of(s)] == [0, 1, 2, 3, 4]
    assert [r.num_nodes for r in s.nodes_per_hop().orderBy("hop").collect()] == [5, 0, 0]


def test_disjoint(spark):
    s = sampling.neighbor_sample(cycle(spark), seeds(spark, [2, 3]), [2, 2], disjoint=True)
    assert edges_of(s) == ([0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5], [2, 3, 4, 5, 6, 0, 0, 7, 8, 1, 1, 9], [4, 5, 6, 7, 2, 3, 6, 7, 4, 5, 8, 9])
    assert nodes_of(s) == [(0, 2), (1, 3), (0, 1), (0, 3), (1, 2), (1, 4), (0, 0), (0, 4), (1, 1), (1, 5)]


@pytest.mark.parametrize("strategy, counts", [("uniform", [2, 2]), ("last", [1, 2])])
def test_node_times(spark, strategy, counts):
    g = sorted_cycle(spark)
    times = spark.range(6).select(F.col("id").alias("node"), F.col("id").alias("time"))
    s = sampling.neighbor_sample(g, seeds(spark, [2, 3]), counts, disjoint=True, node_time=times, strategy=strategy)
    assert edges_of(s) == ([0, 1, 2, 2, 3, 3], [2, 3, 4, 0, 5, 1], [4, 6, 2, 3, 4, 5])
    assert nodes_of(s) == [(0, 2), (1, 3), (0, 1), (1, 2), (0, 0), (1, 1)]


def test_edge_times(spark):
    g = sorted_cycle(spark)
    s = sampling.neighbor_sample(g, seeds(spark, [2, 3], [5, 6]), [2, 2], disjoint=True, edge_time="etime")
    assert edges_of(s) == ([0, 0, 1, 2, 2, 4, 4], [2, 3, 4, 5, 0, 6, 1], [4, 5, 6, 2, 3, 4, 5])
    none = sampling.neighbor_sample(g, seeds(spark, [2, 3], [-1, -1]), [2, 2], disjoint=True, edge_time="etime", replace=True)
    assert none.edges.count() == 0 and nodes_of(none) == [(0, 2), (1, 3)]


def test_biased(spark):
    g = cycle(spark).withColumn("w", (1 - F.col("edge_id") % 2).cast("double"))
    s = sampling.neighbor_sample(g, seeds(spark, [0, 1]), [1], weight="w")
    assert edges_of(s) == ([0, 1], [2, 0], [0, 2]) and [n for _, n in nodes_of(s)] == [0, 1, 5]


def test_random_picks_are_neighbours_and_repeatable(spark):
    g = cycle(spark, 10)
    for replace in (False, True):
        a = sampling.neighbor_sample(g, seeds(spark, [2, 3]), [1, 1], replace=replace, seed=3)
        b = sampling.neighbor_sample(g.repartition(5), seeds(spark, [2, 3]), [1, 1], replace=replace, seed=3)
        assert edges_of(a) == edges_of(b) and a.edges.where("hop = 1").count() == 2
        ids = {r.edge_id for r in a.edges.collect()}
        assert ids <= set(range(20))
    assert sampling.neighbor_sample(g, seeds(spark, [2]), [5], replace=True).edges.count() == 5


def test_arguments_are_checked(spark):
    g = cycle(spark)
    times = spark.range(6).select(F.col("id").alias("node"), F.col("id").alias("time"))
    for options in ({"directed": False}, {"strategy": "first"}, {"node_time": times}, {"node_time": times, "disjoint": True, "weight": "w"}):
        with pytest.raises(ValueError):
            sampling.neighbor_sample(g, seeds(spark, [0]), [1], **options)
    with pytest.raises(ValueError):
        sampling.random_walk(g, seeds(spark, [0]), 3, p=2.0)


def test_hetero_of_one_type_is_homogeneous(spark):
    kind = ("paper", "to", "paper")
    s = sampling.hetero_neighbor_sample({kind: cycle(spark)}, {"paper": seeds(spark, [2, 3])}, {kind: [2, 2]})
    rows = s.edges.orderBy("hop", "row", "pick").collect()
    assert [r.col for r in rows] == [2, 1, 0, 3, 4, 0, 1, 5] and [r.edge_id for r in rows] == [4, 5, 6, 7, 2, 3, 8, 9]


def test_budget_is_kept_and_unused_quota_flows(spark):
    kind = ("a", "to", "b")
    rows = [(0, 0, 0)] + [(1 + k, 1, k) for k in range(10)]
    g = spark.createDataFrame(rows, "edge_id long, src long, dst long")
    two = {("s", "x", "a"): spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "edge_id long, src long, dst long"), kind: g}
    s = sampling.budget_sample(two, {"s": seeds(spark, [0])}, {("s", "x", "a"): [2, 0], kind: [0, 3]})
    assert s.edges.where("hop = 1").count() == 2
    assert s.edges.where("hop = 2").count() == 6  # 2 * 3: one from the node of degree 1, five from the other


def test_budget_of_a_hub_meets_only_what_it_takes(spark):
    # 200 examples reach a hub of 20,000 edges and take 3 of them each: 4,000,000 rows if each met all
    hub = spark.range(20_000).select(F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    to = spark.range(200).select(F.col("id").alias("edge_id"), F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    kinds = {("s", "x", "a"): to, ("a", "to", "b"): hub}
    core = spark.sparkContext._jsc.sc()

    def read():
        core.listenerBus().waitUntilEmpty(60_000)
        return core.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = read()
    s = sampling.budget_sample(kinds, {"s": seeds(spark, range(200))}, dict(zip(kinds, ([1, 0], [0, 3]))))
    assert read() - before < 20 << 20
    rows = s.edges.where("hop = 2").select("batch", "edge_id").collect()
    assert len(rows) == 600 == len(set(rows)) and len({r.edge_id for r in rows}) > 500


def test_distinct_numbers(spark):
    sizes = spark.range(3000).withColumn("n", F.lit(5)).withColumn("c", F.lit(2))
    got = [tuple(r.x) for r in sizes.select(sampling._distinct_numbers("c", "n", 3, "id").alias("x")).collect()]
    times = {pair: got.count(pair) for pair in set(got)}
    assert sorted(times) == [(a, b) for a in range(5) for b in range(a + 1, 5)] and all(230 < t < 370 for t in times.values())
    whole = spark.range(1).select("id", F.lit(4).alias("n"), F.lit(4).alias("c"))
    assert whole.select(sampling._distinct_numbers("c", "n", 3, "id").alias("x")).first().x == [0, 1, 2, 3]


def test_budget_moves_edges_with_ids_in_a_row_once(spark):
    # 30,000 nodes of 10 edges. The same edges with other ids are numbered first, which moves them twice, and are chosen alike
    core = spark.sparkContext._jsc.sc()

    def chosen(step):
        edges = spark.range(300_000).select((F.col("id") * step).alias("edge_id"), F.floor(F.col("id") / 10).alias("src"), (F.col("id") * 7919 % 1_000_003).alias("dst"))
        core.listenerBus().waitUntilEmpty(60_000)
        before = core.statusStore().executorList(True).apply(0).totalShuffleWrite()
        s = sampling.budget_sample({("a", "to", "b"): edges}, {"a": seeds(spark, range(0, 30_000, 100))}, {("a", "to", "b"): [3]})
        core.listenerBus().waitUntilEmpty(60_000)
        moved = core.statusStore().executorList(True).apply(0).totalShuffleWrite() - before
        return moved, sorted((r.batch, r.edge_id // step) for r in s.edges.select("batch", "edge_id").collect())

    (once, got), (_, other) = chosen(1), chosen(2)
    assert got == other and len(set(got)) == 900 and all(e // 1000 == b for b, e in got)
    assert once < 1 << 20, once


def test_numbers_drawn_in_columns_are_those_of_the_list(spark):
    sizes = spark.range(600).select("id", (1 + F.col("id") % 9).alias("n"), (1 + F.floor(F.col("id") / 9) % 7).alias("c")).where("c <= n")
    both = sampling._with_numbers(sizes.withColumn("x", sampling._distinct_numbers("c", "n", 3, "id")), "c", "n", 3, "id")
    assert both.columns == ["id", "n", "c", "x", "_list"] and both.where("c > 4").count() > 0
    assert all(r.x == r._list and len(set(r.x)) == r.c for r in both.collect())


def test_one_hop_merge_and_relabel(spark):
    g = cycle(spark)
    hop = sampling.dist_neighbor_sample(g, seeds(spark, [2, 3]), -1).orderBy("seed_pos", "j").collect()
    assert [r.node for r in hop if r.j > 0] == [1, 3, 2, 4] and [r.edge_id for r in hop if r.j > 0] == [4, 5, 6, 7]
    sampled = spark.createDataFrame([(0, 0, 1), (1, 0, 3), (2, 1, 2), (3, 1, 4)], "pos long, seed_pos long, node long")
    got = sampling.relabel_neighborhood(seeds(spark, [2, 3]), sampled).orderBy("pos").collect()
    assert [r.row for r in got] == [0, 0, 1, 1] and [r.col for r in got] == [2, 1, 0, 3]
    batched = sampled.withColumn("batch", F.col("seed_pos"))
    own = seeds(spark, [2, 3]).withColumn("batch", F.col("pos"))
    assert [r.col for r in sampling.relabel_neighborhood(own, batched, disjoint=True).orderBy("pos").collect()] == [2, 3, 4, 5]
    swapped = sampling.relabel_neighborhood(seeds(spark, [2, 3]), sampled, csc=True).orderBy("pos").collect()
    assert [r.row for r in swapped] == [2, 1, 0, 3]


def test_merge_of_partitions(spark):
    ids = {0: [[2, 7, 8]], 1: [[0, 4], [1, 5, 6]], 2: [[3, 9, 10]]}
    edges = {0: [17, 18], 1: [14, 15, 16], 2: [19, 20]}
    rows = []
    for part, lists in ids.items():
        e = iter(edges[part])
        for ord_, nodes in enumerate(lists):
            rows += [(part, ord_, j, n, None if j == 0 else next(e)) for j, n in enumerate(nodes)]
    results = spark.createDataFrame(rows, "part long, ord long, j int, node long, edge_id long")
    requests = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, 0), (3, 2, 0)], "seed_pos long, part long, ord long")
    got = sampling.merge_sampler_outputs(results, requests).orderBy("pos").collect()
    assert [r.node for r in got] == list(range(4, 11)) and [r.edge_id for r in got] == list(range(14, 21))
    counts = sampling.merged_counts(sampling.merge_sampler_outputs(results, requests), requests)
    assert [r["count"] for r in counts.orderBy("seed_pos").collect()] == [1, 2, 2, 2]


def test_subgraph(spark):
    chosen = spark.createDataFrame([(k, n) for k, n in enumerate([1, 2, 3, 4])], "local_id long, node long")
    got = sampling.subgraph(cycle(spark), chosen).orderBy("row", "edge_id").collect()
    assert [r.col for r in got] == [1, 0, 2, 1, 3, 2] and [r.edge_id for r in got] == [3, 4, 5, 6, 7, 8]


def test_walks_step_along_edges(spark):
    rows = sampling.random_walk(cycle(spark, 4), seeds(spark, [0, 1, 2, 3]), 5).collect()
    at = {(r.pos, r.step): r.node for r in rows}
    assert len(at) == 24 and all(at[p, 0] == p for p in range(4))
    assert all(abs(at[p, s + 1] - at[p, s]) in (1, 3) for p in range(4) for s in range(5))
    lonely = sampling.random_walk(cycle(spark, 4), seeds(spark, [9]), 2).collect()
    assert {r.node for r in lonely} == {9}


def points(spark, coordinates, batch=None):
    return spark.createDataFrame([(i, [float(v) for v in c], (batch or [0] * len(coordinates))[i]) for i, c in enumerate(coordinates)], "id long, pos array<double>, batch long")


def test_knn_radius_nearest(spark):
    x, y = points(spark, [(0, 0), (1, 0), (2, 0), (3, 0)]), points(spark, [(0.5, 0), (2.5, 0)])
    got = {}
    for r in spatial.knn(x, y, 2).collect():
        got.setdefault(r.query_id, set()).add(r.ref_id)
    assert got == {0: {0, 1}, 1: {2, 3}}
    far, one = points(spark, [(0, 0), (1, 0), (2, 0), (10, 0)]), points(spark, [(0.5, 0)])
    assert {r.ref_id for r in spatial.radius(far, one, 1.5, dims=2).collect()} == {0, 1}  # just r away is too far
    a, b = points(spark, [(0, 0), (3, 0)]), points(spark, [(1, 0), (2, 0)])
    assert {r.id: r.nearest_id for r in spatial.nearest(a, b).collect()} == {0: 0, 1: 1}
    with pytest.raises(ValueError):
        spatial.knn(x, y, 0)


def test_radius_grid_equals_brute_force(spark):
    rng = random.Random(2)
    c = [(rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(80)]
    p = points(spark, c, [i % 2 for i in range(80)])
    got = {(r.query_id, r.ref_id) for r in spatial.radius(p, p, 0.6, dims=4, batch="batch", max_num_neighbors=None, ignore_same_index=True).collect()}
    near = lambda i, j: sum((u - v) ** 2 for u, v in zip(c[i], c[j])) < 0.36
    assert got == {(i, j) for i in range(80) for j in range(80) if i != j and i % 2 == j % 2 and near(i, j)}
    capped = spatial.radius(p, p, 2.0, dims=4, max_num_neighbors=3).groupBy("query_id").count().collect()
    assert all(r["count"] == 3 for r in capped)


def test_batches_dont_meet(spark):
    rng = random.Random(1)
    x = points(spark, [(rng.random(), rng.random(), rng.random()) for _ in range(20)], [0] * 10 + [1] * 10)
    y = points(spark, [(rng.random(), rng.random(), rng.random()) for _ in range(15)], [0] * 8 + [1] * 7)
    rows = spatial.knn(x, y, 2, batch="batch").collect()
    assert len(rows) == 30 and all((r.query_id < 8) == (r.ref_id < 10) for r in rows)


def test_neighbours_within_one_table(spark):
    """Both sides are the whole table: neighbours of a point's own parity are found, itself isn't."""
    rng = random.Random(6)
    at = [(rng.random(), rng.random()) for _ in range(40)]
    p = points(spark, at)
    near = {i: sorted((j for j in range(40) if j != i), key=lambda j: ((at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2, j)) for i in range(40)}
    got = {}
    for r in spatial.knn(p, p, 3, ignore_same_index=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.ref_id)
    assert got == {i: x[:3] for i, x in near.items()}
    assert {r.id: r.nearest_id for r in spatial.nearest(p, p, ignore_same_index=True).collect()} == {i: x[0] for i, x in near.items()}


def test_grid(spark):
    p = points(spark, [(0, 0), (0.1, 0.1), (0.5, 0.5), (1, 1), (1.1, 1.1)])
    assert [r.cluster for r in spatial.grid_cluster(p, [0.5, 0.5]).orderBy("id").collect()] == [0, 0, 4, 8, 8]


def test_fps(spark):
    rng = random.Random(4)
    p = points(spark, [(rng.random(), rng.random()) for _ in range(30)], [0] * 10 + [1] * 20)
    rows = cluster.fps(p, ratio=0.5, random_start=False).orderBy("batch", "step").collect()
    by = {b: [r.id for r in rows if r.batch == b] for b in (0, 1)}
    assert [len(set(v)) for v in by.values()] == [5, 10] and by[0][0] == 0 and by[1][0] == 10
    assert all(i < 10 for i in by[0]) and all(i >= 10 for i in by[1])
    with pytest.raises(ValueError):
        cluster.fps(p, ratio=0.0)


def matched(spark, n, edges, weights=None):
    rows = [(a, b, float((weights or {}).get((a, b), 1))) for a, b in edges]
    g = spark.createDataFrame(rows, "src long, dst long, w double")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    return {r.node: r.cluster for r in cluster.graclus_cluster(nodes, g, weight="w").collect()}


def test_matching(spark):
    two = [(0, 1), (1, 0), (2, 3), (3, 2)]
    assert matched(spark, 4, two) == {0: 0, 1: 0, 2: 2, 3: 2}
    path = [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)]
    got = matched(spark, 4, path)
    size = {c: list(got.values()).count(c) for c in got.values()}
    assert max(size.values()) == 2 and all(c == min(n for n in got if got[n] == c) for c in got.values())
    assert all(abs(a - b) == 1 for a in got for b in got if a != b and got[a] == got[b])
    assert not any(size[got[a]] == size[got[b]] == 1 for a, b in path)
    star = [(0, k) for k in range(1, 5)] + [(k, 0) for k in range(1, 5)]
    got = matched(spark, 5, star, {(0, 1): 100, (1, 0): 100})
    assert got[0] == got[1] == 0 and [got[k] for k in (2, 3, 4)] == [2, 3, 4]


def test_partition_balances_and_cuts_less_than_chance(spark):
    n = 200
    rows = [(a, b) for c in range(4) for a in range(c * 50, c * 50 + 50) for b in (c * 50 + (a + 1) % 50, c * 50 + (a + 7) % 50)]
    g = spark.createDataFrame(rows + [(b, a) for a, b in rows], "src long, dst long")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    parts = cluster.metis(nodes, g, 4, imbalance=0.3, rounds=10).cache()
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert sum(sizes) == n and len(sizes) == 4 and max(sizes) <= 1.6 * n / 4
    cut = cluster.edge_cut(g, parts).first()
    assert cut.between < 0.7 * (cut.within + cut.between)


def test_partition_keeps_its_bound_with_unequal_weights(spark):
    # an edgeless graph: nothing but the last step moves a node out of a part that the start overfilled
    nodes = spark.range(120).select(F.col("id").alias("node"), F.when(F.col("id") % 10 == 0, 8.0).otherwise(1.0).alias("w"))
    edges = spark.createDataFrame([], "src long, dst long")
    parts = cluster.metis(nodes, edges, 4, node_weight="w", rounds=1)
    sizes = [r.w for r in parts.join(nodes, "node").groupBy("part").agg(F.sum("w").alias("w")).collect()]
    assert len(sizes) == 4 and sum(sizes) == 204 and max(sizes) <= 1.1 * 204 / 4, sizes


def long_ring(spark, n, name):
    at = lambda step: name(F.pmod(F.col("id") + step, F.lit(n)))
    edges = spark.range(n).select(at(0).alias("src"), F.explode(F.array(*[at(s) for s in (1, 7, -1, -7)])).alias("dst"))
    return spark.range(n).select(at(0).alias("node")), edges


def test_partition_takes_few_jobs(spark):
    # each job costs the driver memory, so that rounds of jobs for each level don't fit it
    nodes, edges = long_ring(spark, 5000, lambda c: c)
    spark.sparkContext.setJobGroup("partition", "")
    try:
        parts = cluster.metis(nodes, edges, 4)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("partition"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    cut = cluster.edge_cut(edges, parts).first()
    assert cut.within + cut.between == 20_000 and cut.between <= 160  # 64 is the best
    sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sorted(sizes) == [0, 1, 2, 3] and max(sizes.values()) <= 1.1 * 5000 / 4 and jobs < 200, (sizes, jobs)


def test_partition_of_ids_that_tell_no_neighbours(spark):
    nodes, edges = long_ring(spark, 5000, F.xxhash64)
    parts = cluster.metis(nodes, edges, 4, rounds=2).cache()
    cut = cluster.edge_cut(edges, parts).first()
    assert parts.count() == nodes.distinct().count() and cut.within + cut.between == 20_000 and cut.between <= 800
    assert max(r["count"] for r in parts.groupBy("part").count().collect()) <= 1.1 * 5000 / 4


def test_blocks_match_heavy_edges_within_their_weight():
    rows = pd.DataFrame([(i, i, 1.0, True) for i in (4, 5, 6, 9)] + [(4, 5, 1.0, False), (5, 6, 2.0, False), (6, 9, 1.0, False), (9, 12, 5.0, False)], columns=["u", "v", "w", "loop"])
    tops = lambda *a: cluster._block_matches(*a, 0)(None, rows).set_index("node")["top"].to_dict()
    assert tops(0.75, 9.0) == {4: 4, 5: 5, 6: 5, 9: 9}  # node 12 is in another block
    assert set(tops(0.01, 9.0).values()) == {4} and tops(0.01, 1.0) == {4: 4, 5: 5, 6: 6, 9: 9}


def test_edge_sample(spark):
    g = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "edge_id long, src long")
    starts = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "pos long, node long")
    rows = cluster.edge_sample(starts, g, count=2).collect()
    assert len(rows) == 6 and all((r.edge_id < 3) == (r.node == 0) for r in rows)
    ten = spark.range(10).select(F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("src"))
    one = spark.createDataFrame([(0, 0)], "pos long, node long")
    assert cluster.edge_sample(one, ten, factor=0.5).count() == 5
    assert cluster.edge_sample(one, ten.where("edge_id < 3"), count=10).count() == 3


def weights(spark, *rows):
    return spark.createDataFrame([(r, e, b) for r, row in enumerate(rows) for e, b in enumerate(row)], "row long, edge_id long, bias double")


def test_cdf_and_alias(spark):
    w = weights(spark, [1.5, 0.5], [1.0, 0.25], [0.125, 0.375], [1.0, 1.0])
    got = [r.cdf for r in randomness.biased_to_cdf(w).orderBy("row", "edge_id").collect()]
    assert got == [0, 0.75, 0, 0.8, 0, 0.25, 0, 0.5]
    w = weights(spark, [1.5, 0.5], [0.75, 0.25], [0.125, 0.375], [1.0, 1.0], [0.75, 0.5, 1.5, 1.25])
    rows = randomness.biased_to_alias(w).orderBy("row", "k").collect()
    assert [r.prob for r in rows[:8]] == [1, 0.5, 1, 0.5, 0.5, 1, 1, 1]
    assert [r.alias for r in rows[:8] if r.prob < 1] == [0, 0, 1]
    back = {}
    for r in rows:
        n = sum(x.row == r.row for x in rows)
        back[r.row, r.k] = back.get((r.row, r.k), 0) + r.prob / n
        back[r.row, r.alias] = back.get((r.row, r.alias), 0) + (1 - r.prob) / n
    assert [back[4, k] for k in range(4)] == pytest.approx([0.75 / 4, 0.5 / 4, 1.5 / 4, 1.25 / 4])


def test_biased_draws_follow_the_weights(spark):
    w = weights(spark, [3.0, 1.0])
    requests = spark.range(4000).select(F.col("id").alias("draw"), F.lit(0).cast("long").alias("row"))
    a = randomness.biased_random_cdf(requests, randomness.biased_to_cdf(w)).where("edge_id = 0").count() / 4000
    b = randomness.biased_random_alias(requests, randomness.biased_to_alias(w)).where("k = 0").count() / 4000
    assert a == pytest.approx(0.75, abs=0.04) and b == pytest.approx(0.75, abs=0.04)
    u = spark.range(2000).select(randomness.randint(5, 15, 1, "id").alias("i"), randomness.randreal(1, "id").alias("r"))
    low, high, mean = u.agg(F.min("i"), F.max("i"), F.avg("r")).first()
    assert (low, high) == (5, 14) and mean == pytest.approx(0.5, abs=0.05)
    with pytest.raises(ValueError):
        randomness.randint(3, 3, 1, "id")


def test_spline_partition_of_unity(spark):
    rng = random.Random(6)
    p = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(10)], "pos long, pseudo array<double>")
    for degree in (1, 2, 3):
        rows = linalg.spline_basis(p, [5, 4], [True, False], degree)
        assert rows.count() == 10 * (degree + 1) ** 2
        assert all(r.s == pytest.approx(1) for r in rows.groupBy("pos").agg(F.sum("basis").alias("s")).collect())
        assert rows.where("weight_index < 0 or weight_index >= 20").count() == 0
    with pytest.raises(ValueError):
        linalg.spline_basis(p, [5, 4], [True, False], 4)


def test_matmul_shapes(spark):
    def matrix(g, rows, cols, names):
        return [(g, i, k, float(i + 2 * k + g)) for i in range(rows) for k in range(cols)]

    shapes = [(5, 4, 6), (6, 3, 2)]
    left = [x for g, (n, k, _) in enumerate(shapes) for x in matrix(g, n, k, "ik")]
    right = [x for g, (_, k, m) in enumerate(shapes) for x in matrix(g, k, m, "km")]
    a = spark.createDataFrame(left, "grp long, i long, k long, val double")
    b = spark.createDataFrame(right, "grp long, k long, m long, val double")
    got = {(r.grp, r.i, r.m): r.val for r in linalg.grouped_matmul(a, b).collect()}
    for g, (n, kk, m) in enumerate(shapes):
        for i in range(n):
            for j in range(m):
                assert got[g, i, j] == pytest.approx(sum((i + 2 * k + g) * (k + 2 * j + g) for k in range(kk)))


def test_csr_and_back(spark):
    g = cycle(spark)
    ptr, col = core.edges_to_csr(g, 6)
    assert [r.offset for r in ptr.orderBy("r").collect()] == [0, 2, 4, 6, 8, 10, 12]
    assert [r.dst for r in col.orderBy("pos").collect()] == [5, 1, 0, 2, 1, 3, 2, 4, 3, 5, 4, 0]
    assert sorted(map(tuple, core.csr_to_edges(ptr, col.select("pos", "dst")).collect())) == sorted(map(tuple, g.collect()))


def test_home_and_keys(tmp_path):
    graphs.set_home_dir(str(tmp_path))
    assert graphs.get_home_dir() == str(tmp_path)
    assert graphs.remap_keys({"a": 1, "b": 2}, {"a": "c"}) == {"c": 1, "b": 2}


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% a comment\n3 3 2\n2 1\n3 2\n")
    got = graphs.read_matrix_market(spark, str(tmp_path / "m.mtx")).orderBy("edge_id").collect()
    assert [(r.edge_id, r.src, r.dst) for r in got] == [(0, 0, 1), (1, 1, 0), (2, 1, 2), (3, 2, 1)]


def test_uniform_is_inside_the_open_interval(spark):
    low, high = spark.range(1000).select(core.keyed_uniform(1, "id").alias("u")).agg(F.min("u"), F.max("u")).first()
    assert 0 < low < high < 1 and not math.isnan(low)


def test_numbers_within_groups_go_on_over_blocks(spark, monkeypatch):
    """A hub's rows are numbered in blocks of keys, with gaps and keys below zero; groups that are null are left out."""
    monkeypatch.setattr(core, "NUMBER_BLOCK", 8)
    data = [(g, k) for g in (0, 1) for k in range(-20, 60, 3 + g)] + [(2, 5), (None, 1)]
    got = {(r.g, r.k): r.n for r in core.number_within(spark.createDataFrame(data, "g long, k long").repartition(3), ["g"], "k", "n").collect()}
    assert got == {(g, k): n for g in (0, 1, 2) for n, k in enumerate(sorted(k for h, k in data if h == g))}


def test_weighted_draws_over_blocks(spark, monkeypatch):
    """Draws with replacement follow the weights, whichever block an edge is in; weight 0 is never drawn, and each draw gives one edge."""
    monkeypatch.setattr(sampling, "NUMBER_BLOCK", 4)
    weights = [1.0, 0.0, 3.0, 2.0, 0.0, 4.0, 1.0, 5.0, 0.0, 4.0]
    g = spark.createDataFrame([(k, 0, k + 1, w) for k, w in enumerate(weights)], "edge_id long, src long, dst long, weight double")
    start = spark.createDataFrame([(0, 0)], "pos long, node long")
    drawn = sampling.neighbor_sample(g, start, [4000], replace=True, weight="weight", seed=3).edges
    counts = {r.edge_id: r["count"] for r in drawn.groupBy("edge_id").count().collect()}
    assert sum(counts.values()) == 4000 and drawn.select("pick").distinct().count() == 4000
    for k, w in enumerate(weights):
        assert abs(counts.get(k, 0) / 4000 - w / sum(weights)) < 0.03 and (w or k not in counts)
