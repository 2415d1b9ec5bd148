"""Queries of the similarity joins, clustering, sampling, walks and biased choice on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cluster, core, lookup, order, randomness, sampling, spatial
from ..sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return put


def _bits(*keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::BIGINT"


# --- similarity joins --------------------------------------------------------


def _distance(a: str, b: str, dims: int) -> str:
    return f"list_sum(list_transform(range(1, {dims + 1}), lambda i: ({a}.embedding[i]::DOUBLE - {b}.embedding[i]::DOUBLE) * ({a}.embedding[i]::DOUBLE - {b}.embedding[i]::DOUBLE)))"


def _knn_sql(where: str, distance: str, k: int) -> str:
    return f"""SELECT query_id, ref_id, rank FROM (SELECT y.vec_id AS query_id, x.vec_id AS ref_id, row_number() OVER (PARTITION BY y.vec_id ORDER BY {distance}, x.vec_id)::INTEGER AS rank
      FROM embeddings y JOIN embeddings x ON x.vec_id <> y.vec_id{where}) WHERE rank <= {k}"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: {a}.embedding[i]::DOUBLE * {b}.embedding[i]::DOUBLE))"


def _nearest_sql(where: str) -> str:
    return f"""SELECT id, nearest_id FROM (SELECT x.vec_id AS id, y.vec_id AS nearest_id, row_number() OVER (PARTITION BY x.vec_id ORDER BY {_distance('x', 'y', 64)}, y.vec_id) AS rank
      FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id{where}) WHERE rank = 1"""


# Both sides are the whole table; a point isn't its own neighbour.


@query(_knn_sql("", _distance("y", "x", 64), 5))
def knn_k5(spark, sf):
    p = T.points(spark, sf)
    return spatial.knn(p, p, 5, ignore_same_index=True).select("query_id", "ref_id", "rank")


@query(_knn_sql(" AND x.label = y.label", _distance("y", "x", 64), 3))
def knn_batched(spark, sf):
    p = T.points(spark, sf)
    return spatial.knn(p, p, 3, batch="label", ignore_same_index=True).select("query_id", "ref_id", "rank")


@query(_knn_sql("", f"1.0 - {_dot('y', 'x')} / (sqrt({_dot('y', 'y')}) * sqrt({_dot('x', 'x')}))", 5))
def knn_cosine(spark, sf):
    p = T.points(spark, sf)
    return spatial.knn(p, p, 5, cosine=True, ignore_same_index=True).select("query_id", "ref_id", "rank")


@query(_nearest_sql(""))
def nearest(spark, sf):
    p = T.points(spark, sf)
    return spatial.nearest(p, p, ignore_same_index=True)


@query(_nearest_sql(" AND x.label = y.label"))
def nearest_batched(spark, sf):
    p = T.points(spark, sf)
    return spatial.nearest(p, p, batch="label", ignore_same_index=True)


@query(f"""SELECT query_id, ref_id FROM (SELECT y.vec_id AS query_id, x.vec_id AS ref_id, row_number() OVER (PARTITION BY y.vec_id ORDER BY x.vec_id) AS rank
  FROM embeddings y JOIN embeddings x ON x.vec_id <> y.vec_id AND {_distance('y', 'x', 3)} < 0.15::DOUBLE * 0.15::DOUBLE) WHERE rank <= 8""")
def radius_cap(spark, sf):
    p = T.points(spark, sf, 3)
    return spatial.radius(p, p, 0.15, dims=3, max_num_neighbors=8, ignore_same_index=True)


@query(f"SELECT y.vec_id AS query_id, x.vec_id AS ref_id FROM embeddings y JOIN embeddings x ON x.vec_id <> y.vec_id AND x.label = y.label AND {_distance('y', 'x', 3)} < 0.1::DOUBLE * 0.1::DOUBLE")
def radius_ignore_same(spark, sf):
    p = T.points(spark, sf, 3)
    return spatial.radius(p, p, 0.1, dims=3, batch="label", max_num_neighbors=None, ignore_same_index=True)


@query("""WITH b AS (SELECT min(embedding[1]::DOUBLE) AS a, max(embedding[1]::DOUBLE) AS c, min(embedding[2]::DOUBLE) AS d FROM embeddings)
 SELECT vec_id AS id, (trunc((embedding[1]::DOUBLE - a) / 0.1::DOUBLE) + trunc((embedding[2]::DOUBLE - d) / 0.2::DOUBLE) * (trunc((c - a) / 0.1::DOUBLE) + 1))::BIGINT AS cluster FROM embeddings, b""")
def grid_cluster_2d(spark, sf):
    return spatial.grid_cluster(T.points(spark, sf, 2), [0.1, 0.2])


@query("SELECT vec_id AS id, (trunc((embedding[1]::DOUBLE + 1) / 0.25::DOUBLE) + trunc((embedding[2]::DOUBLE + 1) / 0.5::DOUBLE) * 9)::BIGINT AS cluster FROM embeddings")
def grid_cluster_bounds(spark, sf):
    return spatial.grid_cluster(T.points(spark, sf, 2), [0.25, 0.5], start=[-1.0, -1.0], end=[1.0, 1.0])


# --- selection, matching, partitioning ---------------------------------------


def _far(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda d: ({a}[d] - {b}[d]) * ({a}[d] - {b}[d])))"


# k: the place of the point taken in a step; far: all points' squared distances from what is taken.
@query(f"""WITH RECURSIVE p AS (SELECT label::BIGINT AS batch, list(vec_id ORDER BY vec_id) AS ids, list(embedding::DOUBLE[] ORDER BY vec_id) AS pts, ceil((count(*)::FLOAT * 0.1::FLOAT)::FLOAT)::BIGINT AS n FROM embeddings GROUP BY 1),
  f AS (
    SELECT batch, 0::BIGINT AS step, 1::BIGINT AS k, list_transform(pts, lambda x: {_far('x', 'pts[1]')}) AS far FROM p
    UNION ALL
    SELECT batch, step, k, list_transform(range(1, len(far) + 1), lambda i: least(far[i], {_far('pts[i]', 'pts[k]')})) FROM
      (SELECT f.batch, f.step + 1 AS step, list_position(f.far, list_max(f.far))::BIGINT AS k, f.far, p.pts FROM f JOIN p ON p.batch = f.batch WHERE f.step + 1 < p.n))
  SELECT f.batch, f.step, p.ids[f.k] AS id FROM f JOIN p ON p.batch = f.batch""")
def fps_label(spark, sf):
    return cluster.fps(T.points(spark, sf), ratio=0.1, batch="label", random_start=False)


@query("SELECT label::BIGINT AS batch, ceil((count(*)::FLOAT * 0.1::FLOAT)::FLOAT)::BIGINT AS n, min(vec_id) AS first FROM embeddings GROUP BY 1")
def fps_sizes(spark, sf):
    found = fps_label(spark, sf)
    return found.groupBy("batch").agg(F.count("*").alias("n"), F.min(F.when(F.col("step") == 0, F.col("id"))).alias("first"))


def _nodes(spark, sf) -> DataFrame:
    return T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"))


def _near(spark, sf) -> DataFrame:
    """The mutual kNN graph of the embeddings: edges (src, dst, w) in both directions, heavier the nearer their ends."""
    core.ready(spark)
    p = T.points(spark, sf)
    found = spatial.knn(p, p, 5, ignore_same_index=True).select(F.col("query_id").alias("src"), F.col("ref_id").alias("dst"), (1.0 / (1.0 + F.col("distance"))).alias("w")).checkpoint()
    return found.join(found.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])


# Mutual proposals by one order of all edges are the same as taking edges in that order while both ends are free.
_MATCH = f"""WITH RECURSIVE q AS (SELECT query_id, ref_id, d FROM (SELECT y.vec_id AS query_id, x.vec_id AS ref_id, {_distance('y', 'x', 64)} AS d, row_number() OVER (PARTITION BY y.vec_id ORDER BY {_distance('y', 'x', 64)}, x.vec_id) AS rank
    FROM embeddings y JOIN embeddings x ON x.vec_id <> y.vec_id) WHERE rank <= 5),
  e AS (SELECT u, v, row_number() OVER (ORDER BY w DESC, {_bits("'0'", 'u', 'v')} DESC, u DESC, v DESC) AS i FROM
    (SELECT a.query_id AS u, a.ref_id AS v, greatest(1 / (1 + a.d), 1 / (1 + b.d)) AS w FROM q a JOIN q b ON a.query_id = b.ref_id AND a.ref_id = b.query_id WHERE a.query_id < a.ref_id)),
  g AS (
    SELECT 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS u, NULL::BIGINT AS v
    UNION ALL
    SELECT e.i, CASE WHEN list_has_any(g.used, [e.u, e.v]) THEN g.used ELSE list_concat(g.used, [e.u, e.v]) END, CASE WHEN NOT list_has_any(g.used, [e.u, e.v]) THEN e.u END, CASE WHEN NOT list_has_any(g.used, [e.u, e.v]) THEN e.v END
    FROM g JOIN e ON e.i = g.i + 1)
  SELECT n.vec_id AS node, coalesce(g.u, n.vec_id) AS cluster FROM embeddings n LEFT JOIN g ON g.u = n.vec_id OR g.v = n.vec_id"""


@query(_MATCH)
def graclus_match(spark, sf):
    return cluster.graclus_cluster(_nodes(spark, sf), _near(spark, sf), weight="w")


@query("SELECT 0::BIGINT AS oversized, 0::BIGINT AS unmatched_neighbours, (SELECT count(*) FROM embeddings)::BIGINT AS nodes")
def graclus_invariants(spark, sf):
    found = graclus_match(spark, sf)
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"))
    single = found.join(sizes.where("n = 1"), "cluster").select("node")
    pairs = _near(spark, sf).join(single.withColumnRenamed("node", "src"), "src").join(single.withColumnRenamed("node", "dst"), "dst")
    a = sizes.agg(F.count_if(F.col("n") > 2).alias("oversized"), F.sum("n").alias("nodes"))
    return a.crossJoin(pairs.agg(F.count("*").alias("unmatched_neighbours"))).select("oversized", "unmatched_neighbours", "nodes")


@query()
def metis_parts(spark, sf):
    return cluster.metis(_nodes(spark, sf), T.ring(spark, sf), 4)


@query("SELECT (SELECT count(*) FROM embeddings)::BIGINT AS nodes, 4::BIGINT AS parts, true AS balanced")
def metis_balance(spark, sf):
    sizes = metis_parts(spark, sf).groupBy("part").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("nodes"), F.count("*").alias("parts"), (F.max("n") <= 1.1 * F.avg("n")).alias("balanced"))


@query("SELECT count(*)::DOUBLE * 4 AS total, true AS well_below_chance FROM embeddings")
def metis_cut(spark, sf):
    # chance cuts three quarters of the edges; four arcs of the ring cut 16 directed edges at each of their four ends
    cut = cluster.edge_cut(T.ring(spark, sf), metis_parts(spark, sf))
    return cut.select((F.col("within") + F.col("between")).alias("total"), (F.col("between") <= 0.125 * (F.col("within") + F.col("between"))).alias("well_below_chance"))


@query()
def metis_cut_weights(spark, sf):
    return cluster.edge_cut(T.ring(spark, sf), metis_parts(spark, sf))


_RANKED = f"""SELECT o_custkey AS pos, o_custkey AS node, o_orderkey AS edge_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY {_bits("'7'", 'o_custkey', 'o_custkey', 'o_orderkey')}, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS deg FROM orders"""


def _customer_starts(spark, sf):
    return T.table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("node"))


@query(f"SELECT pos, node, edge_id FROM ({_RANKED}) WHERE rank <= 2")
def edge_sample_count(spark, sf):
    return cluster.edge_sample(_customer_starts(spark, sf), T.customer_orders(spark, sf), count=2, seed=7)


@query(f"SELECT pos, node, edge_id FROM ({_RANKED}) WHERE rank <= ceil(deg * 0.25)")
def edge_sample_factor(spark, sf):
    return cluster.edge_sample(_customer_starts(spark, sf), T.customer_orders(spark, sf), factor=0.25, seed=7)


# --- neighbour sampling --------------------------------------------------------

RING = """ring AS (SELECT vec_id * 4 + j AS edge_id, vec_id AS src, ((vec_id + s) % n + n) % n AS dst, (vec_id * 4 + j) % 50 AS etime, 1.0::DOUBLE + (vec_id * 4 + j) % 5 AS weight
  FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS j, unnest([1, 7, -1, -7]) AS s), (SELECT count(*) AS n FROM embeddings))"""


def _ring(spark, sf) -> DataFrame:
    return T.ring(spark, sf).withColumn("etime", F.col("edge_id") % 50).withColumn("weight", (F.lit(1.0) + F.col("edge_id") % 5).cast("double"))


def _hops_sql(fanouts: list[int], *, disjoint=False, first: str = "", keep: str = "", csc: bool = False, draws: bool = False, result: str = "edges") -> str:
    """SQL of neighbour sampling on the ring: a chain of hops from every node. first: the order in which a node's edges are taken. disjoint: each seed has nodes of its own."""
    batch = "vec_id" if disjoint else "0::BIGINT"
    parts = [RING, f"n0 AS (SELECT {batch} AS batch, vec_id AS node, vec_id AS local_id, 0 AS hop, vec_id % 8 * 4 + 15 AS root FROM embeddings)"]
    for h, count in enumerate(fanouts, 1):
        prev = f"n{h - 1}"
        parts.append(f"p{h} AS (SELECT f.batch, f.node, f.local_id AS row, e.dst, e.edge_id, e.etime, e.weight, f.root FROM {prev} f JOIN ring e ON e.src = f.node WHERE f.hop = {h - 1}{keep})")
        if draws:
            parts.append(f"""k{h} AS (SELECT x.*, d.pick FROM (SELECT *, row_number() OVER (PARTITION BY batch, node, row ORDER BY edge_id) - 1 AS nth, count(*) OVER (PARTITION BY batch, node, row) AS deg FROM p{h}) x,
              (SELECT unnest(range({count})) AS pick) d WHERE nth = floor(({_bits("'5'", str(h), 'batch', 'node', 'row', 'pick')} + 1) / 4294967297.0::DOUBLE * deg))""")
        elif count < 0:
            parts.append(f"k{h} AS (SELECT *, row_number() OVER (PARTITION BY batch, node, row ORDER BY edge_id) AS pick FROM p{h})")
        else:
            by = first.format(h=h) or f"{_bits(chr(39) + '5' + chr(39), str(h), 'batch', 'node', 'row', 'edge_id')}, edge_id"
            parts.append(f"k{h} AS (SELECT *, row_number() OVER (PARTITION BY batch, node, row ORDER BY edge_id) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY batch, node, row ORDER BY {by}) AS rk FROM p{h}) WHERE rk <= {count})")
        parts.append(f"""n{h} AS (SELECT batch, node, local_id, hop, root FROM {prev} UNION ALL
          SELECT batch, node, (SELECT count(*) FROM {prev}) + row_number() OVER (ORDER BY o) - 1, {h}, root FROM
            (SELECT k.batch, k.dst AS node, min(k.row * 1000000 + k.pick) AS o, min(k.root) AS root FROM k{h} k ANTI JOIN {prev} a ON a.batch = k.batch AND a.node = k.dst GROUP BY 1, 2))""")
    n = len(fanouts)
    if result == "nodes":
        return f"WITH {', '.join(parts)} SELECT batch, node, local_id, hop FROM n{n}"
    row, col = ("m.local_id", "k.row") if csc else ("k.row", "m.local_id")
    edges = " UNION ALL ".join(f"SELECT {row} AS row, {col} AS col, k.edge_id, {h} AS hop FROM k{h} k JOIN n{h} m ON m.batch = k.batch AND m.node = k.dst" for h in range(1, n + 1))
    return f"WITH {', '.join(parts)} SELECT row::BIGINT AS row, col::BIGINT AS col, edge_id, hop::INTEGER AS hop FROM ({edges})"


def _edges(sample) -> DataFrame:
    return sample.edges.select("row", "col", "edge_id", "hop")


def _node_time(spark, sf):
    return _nodes(spark, sf).withColumn("time", F.col("node") % 40)


@query("""SELECT o_custkey AS src, o_orderkey AS edge_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rk FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01') WHERE rk <= 2""")
def customer_last_orders(spark, sf):
    seeds = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("node"), F.expr("timestamp_ntz'1998-01-01 00:00:00'").alias("time"))
    hop = sampling.dist_neighbor_sample(T.customer_orders(spark, sf), seeds, 2, disjoint=True, edge_time="etime", strategy="last")
    return hop.where("j > 0").select(F.col("seed_pos").alias("src"), "edge_id")


# --- heterogeneous sampling ----------------------------------------------------

PLACES, CONTAINS, SUPPLIED = ("customer", "places", "order"), ("order", "contains", "part"), ("part", "supplied", "supplier")


def _dense_edges(spark, sf, a: str, b: str) -> DataFrame:
    """Distinct pairs of lineitem columns, numbered in the order of the pairs."""
    pairs = T.table(spark, sf, "lineitem").select(F.col(a).alias("src"), F.col(b).alias("dst"))
    width = core.extent(pairs, "dst")
    ranks = order.distinct_ranks(pairs.select((F.col("src") * width + F.col("dst")).alias("val")))
    return ranks.select(F.col("rank").alias("edge_id"), F.expr(f"val div {max(width, 1)}").alias("src"), (F.col("val") % max(width, 1)).alias("dst"))


def _hetero(spark, sf) -> dict:
    return {PLACES: T.customer_orders(spark, sf), CONTAINS: _dense_edges(spark, sf, "l_orderkey", "l_partkey"), SUPPLIED: _dense_edges(spark, sf, "l_partkey", "l_suppkey")}


def _hetero_sql(first: str | None, count: int, keep: str = "") -> str:
    cut = f"WHERE rk <= {count}" if first else ""
    return f"""WITH c AS (SELECT (row_number() OVER (ORDER BY l_orderkey, l_partkey) - 1)::BIGINT AS edge_id, l_orderkey AS src, l_partkey AS dst FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
  k1 AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY edge_id) AS pick FROM (SELECT o_custkey AS row, o_orderkey AS dst, o_orderkey AS edge_id, row_number() OVER (PARTITION BY o_custkey ORDER BY {first or 'o_orderkey'}) AS rk FROM orders{keep}) {cut}),
  n1 AS (SELECT dst AS node, row_number() OVER (ORDER BY o) - 1 AS local_id FROM (SELECT dst, min(row * 1000000 + pick) AS o FROM k1 GROUP BY 1)),
  k2 AS (SELECT n1.local_id AS row, c.dst, c.edge_id, row_number() OVER (PARTITION BY n1.local_id ORDER BY c.edge_id) AS pick FROM n1 JOIN c ON c.src = n1.node),
  n2 AS (SELECT dst AS node, row_number() OVER (ORDER BY o) - 1 AS local_id FROM (SELECT dst, min(row * 1000000 + pick) AS o FROM k2 GROUP BY 1))
  SELECT 'customer__places__order' AS etype, row::BIGINT AS row, local_id::BIGINT AS col, edge_id, 1::INTEGER AS hop FROM k1 JOIN n1 ON n1.node = k1.dst
  UNION ALL SELECT 'order__contains__part', row::BIGINT, local_id::BIGINT, edge_id, 2 FROM k2 JOIN n2 ON n2.node = k2.dst"""


def _two(spark, sf) -> dict:
    g = _hetero(spark, sf)
    return {k: g[k] for k in (PLACES, CONTAINS)}


def _temporal(spark, sf, seeds: dict) -> DataFrame:
    # batches are seeds, and each order has one customer, so that batches don't meet
    g = _two(spark, sf)
    s = sampling.hetero_neighbor_sample({PLACES: g[PLACES]}, seeds, {PLACES: [2]}, disjoint=True, strategy="last", edge_time="etime")
    orders = s.nodes.where("ntype = 'order'").select(F.col("local_id").alias("pos"), "node")
    # parts get negative numbers, since one with an order's number isn't that order
    contains = g[CONTAINS].withColumn("dst", -F.col("dst") - 1)
    parts = sampling.neighbor_sample(contains, orders, [-1])
    second = parts.edges.select("row", (F.col("col") - orders.count()).alias("col"), "edge_id")
    return s.edges.select("etype", "row", "col", "edge_id", "hop").unionByName(second.select(F.lit("__".join(CONTAINS)).alias("etype"), "row", "col", "edge_id", F.lit(2).alias("hop")))


# Every node or customer is a seed. Most samples are disjoint, each seed with nodes of its own: with all nodes in one sample no hop finds a new one.


def _every_node(spark, sf) -> DataFrame:
    ids = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").alias("node"))
    return ids.withColumn("time", F.col("pos") % 8 * 4 + 15)


def _every_sample(name: str, fanouts: list[int], sql: dict, options: dict, disjoint: bool = True) -> None:
    timed = "node_time" in options or "edge_time" in options

    def sample(spark, sf):
        seeds = _every_node(spark, sf) if timed else _every_node(spark, sf).drop("time")
        given = {k: v(spark, sf) if callable(v) else v for k, v in options.items()}
        return sampling.neighbor_sample(_ring(spark, sf), seeds, fanouts, disjoint=disjoint, **given)

    text = _hops_sql(fanouts, disjoint=disjoint, **sql)
    if name == "neighbor_nodes_per_hop":
        query(f"SELECT hop::INTEGER AS hop, count(*) AS num_nodes FROM ({text}) GROUP BY 1", name)(lambda spark, sf: sample(spark, sf).nodes_per_hop())
    elif sql.get("result") == "nodes":
        query(text, name)(lambda spark, sf: sample(spark, sf).nodes)
    else:
        query(text, name)(lambda spark, sf: _edges(sample(spark, sf)))


_every_sample("neighbor_full_2hop", [-1, -1], {}, {})
_every_sample("neighbor_full_nodes", [-1, -1], {"result": "nodes"}, {})
_every_sample("neighbor_nodes_per_hop", [-1, -1], {"result": "nodes"}, {})
_every_sample("neighbor_uniform_2hop", [2, 3], {}, {"seed": 5})
_every_sample("neighbor_replace", [3, 2], {"draws": True}, {"replace": True, "seed": 5})
_every_sample("neighbor_disjoint", [-1, 2], {}, {"seed": 5})
_every_sample("neighbor_shared", [2, 2], {}, {"seed": 5}, disjoint=False)
_every_sample("neighbor_csc", [-1, -1], {"csc": True}, {"csc": True})
_every_sample("neighbor_temporal_node_last", [2, 2], {"first": "dst % 40 DESC, edge_id DESC", "keep": " AND e.dst % 40 <= f.root"}, {"node_time": _node_time, "strategy": "last"})
_every_sample("neighbor_temporal_edge_last", [2, 2], {"first": "etime DESC, edge_id DESC", "keep": " AND e.etime <= f.root"}, {"edge_time": "etime", "strategy": "last"})
_every_sample("neighbor_temporal_uniform", [2, 2], {"keep": " AND e.etime <= f.root"}, {"edge_time": "etime", "seed": 5})
_every_sample("neighbor_biased", [2, 2], {"first": "ln((" + _bits("'5'", "{h}", "batch", "node", "row", "edge_id") + " + 1) / 4294967297.0::DOUBLE) / weight DESC, edge_id"}, {"weight": "weight", "seed": 5})


def _every_customer(spark, sf, time: str | None = None) -> dict:
    s = _customer_starts(spark, sf)
    return {"customer": s.withColumn("time", F.expr(f"timestamp_ntz'{time}'")) if time else s}


@query(_hetero_sql(None, -1))
def hetero_full(spark, sf):
    s = sampling.hetero_neighbor_sample(_two(spark, sf), _every_customer(spark, sf), {PLACES: [-1, 0], CONTAINS: [0, -1]})
    return s.edges.select("etype", "row", "col", "edge_id", "hop")


@query(_hetero_sql("o_orderdate DESC, o_orderkey DESC", 2, " WHERE o_orderdate <= TIMESTAMP '1998-01-01'"))
def hetero_temporal(spark, sf):
    return _temporal(spark, sf, _every_customer(spark, sf, "1998-01-01 00:00:00"))


@query(_hetero_sql("ln((" + _bits("'0'", "1", "0", "o_custkey", "o_custkey", "o_orderkey") + " + 1) / 4294967297.0::DOUBLE) / o_totalprice DESC, o_orderkey", 2))
def hetero_biased(spark, sf):
    s = sampling.hetero_neighbor_sample(_two(spark, sf), _every_customer(spark, sf), {PLACES: [2, 0], CONTAINS: [0, -1]}, weight={PLACES: "weight"})
    return s.edges.select("etype", "row", "col", "edge_id", "hop")


def _every_budget(spark, sf):
    return sampling.budget_sample(_hetero(spark, sf), _every_customer(spark, sf), {PLACES: [3, 0, 0], CONTAINS: [0, 2, 0], SUPPLIED: [0, 0, 1]})


@query()
def hetero_budget_sampler(spark, sf):
    return _every_budget(spark, sf).edges


@query("SELECT 'customer__places__order' AS etype, sum(least(n, 3))::BIGINT AS taken FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def hetero_budget_quota(spark, sf):
    return _every_budget(spark, sf).edges.where("hop = 1").groupBy("etype").agg(F.count("*").alias("taken"))


# --- pieces of a distributed run -------------------------------------------------

ONE_HOP = f"WITH {RING} SELECT vec_id AS seed_pos, 0::INTEGER AS j, vec_id AS node, NULL::BIGINT AS edge_id FROM embeddings UNION ALL SELECT src, row_number() OVER (PARTITION BY src ORDER BY edge_id)::INTEGER, dst, edge_id FROM ring"
RELABEL = f"SELECT seed_pos AS row, node AS col, edge_id FROM ({ONE_HOP}) WHERE j > 0"


@query(ONE_HOP)
def dist_one_hop(spark, sf):
    return sampling.dist_neighbor_sample(_ring(spark, sf), _every_node(spark, sf).drop("time"), -1).select("seed_pos", "j", "node", "edge_id")


def _merged(spark, sf):
    seeds = _every_node(spark, sf).drop("time")
    part = (F.col("node") % 3).alias("part")
    requests = seeds.select(F.col("pos").alias("seed_pos"), "node", part).withColumn("ord", F.row_number().over(W.partitionBy("part").orderBy("seed_pos")) - 1)
    results = None
    for p in range(3):
        own = requests.where(F.col("part") == p).select(F.col("ord").alias("pos"), "node")
        found = sampling.dist_neighbor_sample(_ring(spark, sf), own, -1).select(F.lit(p).cast("long").alias("part"), F.col("seed_pos").alias("ord"), "j", "node", "edge_id")
        results = found if results is None else results.unionByName(found)
    return sampling.merge_sampler_outputs(results, requests.select("seed_pos", "part", "ord")), requests


@query(f"SELECT (row_number() OVER (ORDER BY seed_pos, j) - 1)::BIGINT AS pos, seed_pos, j, node, edge_id FROM ({ONE_HOP}) WHERE j > 0")
def dist_merge(spark, sf):
    return _merged(spark, sf)[0]


@query(f"SELECT seed_pos, count(*) AS count FROM ({ONE_HOP}) WHERE j > 0 GROUP BY 1")
def dist_merge_counts(spark, sf):
    return sampling.merged_counts(*_merged(spark, sf))


@query(RELABEL)
def relabel(spark, sf):
    merged = _merged(spark, sf)[0]
    ids = sampling.relabel_neighborhood(_every_node(spark, sf), merged.select("pos", "seed_pos", "node"))
    return ids.join(merged.select("pos", "edge_id"), "pos").select("row", "col", "edge_id")


@query(RELABEL)
def hetero_relabel(spark, sf):
    merged = _merged(spark, sf)[0]
    kind = ("v", "to", "v")
    ids = sampling.hetero_relabel_neighborhood({"v": _every_node(spark, sf)}, {kind: merged.select("pos", "seed_pos", "node", F.col("pos").alias("order"))})[kind]
    return ids.join(merged.select("pos", "edge_id"), "pos").select("row", "col", "edge_id")


# --- subgraphs, walks, biased choice ---------------------------------------------


@query(f"WITH {RING}, s AS (SELECT vec_id AS node, row_number() OVER (ORDER BY vec_id) - 1 AS id FROM embeddings WHERE embedding[1] > 0) SELECT a.id AS row, b.id AS col, edge_id FROM ring JOIN s a ON a.node = src JOIN s b ON b.node = dst")
def subgraph_induced(spark, sf):
    chosen = T.table(spark, sf, "embeddings").where("embedding[0] > 0").select(F.col("vec_id").alias("node"))
    ids = lookup.relabel_ids(chosen.withColumn("pos", F.col("node")))
    return sampling.subgraph(_ring(spark, sf), ids)


def _walk_sql(length: int) -> str:
    parts = [RING, "a AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY edge_id) - 1 AS k FROM ring)", "w0 AS (SELECT vec_id AS pos, vec_id AS node FROM embeddings)"]
    for s in range(1, length + 1):
        parts.append(f"w{s} AS (SELECT w.pos, coalesce(a.dst, w.node) AS node FROM w{s - 1} w LEFT JOIN a ON a.src = w.node AND a.k = floor(({_bits(chr(39) + '9' + chr(39), 'w.pos', str(s))} + 1) / 4294967297.0::DOUBLE * 4))")
    rows = " UNION ALL ".join(f"SELECT pos, {s}::INTEGER AS step, node FROM w{s}" for s in range(length + 1))
    return f"WITH {', '.join(parts)} {rows}"


@query(_walk_sql(4))
def random_walk_len4(spark, sf):
    return sampling.random_walk(_ring(spark, sf), _nodes(spark, sf).select(F.col("node").alias("pos"), "node"), 4, seed=9)


def _order_weights(spark, sf):
    return T.customer_orders(spark, sf).select(F.col("src").alias("row"), "edge_id", F.col("weight").alias("bias"))


@query("SELECT o_custkey AS row, o_orderkey AS edge_id, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS cdf FROM orders")
def biased_cdf(spark, sf):
    return randomness.biased_to_cdf(_order_weights(spark, sf)).withColumn("cdf", F.round("cdf", 6))


@query()
def biased_alias(spark, sf):
    return randomness.biased_to_alias(_order_weights(spark, sf))


@query("SELECT o_custkey AS row, o_orderkey AS edge_id, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS share FROM orders")
def biased_alias_shares(spark, sf):
    table = randomness.biased_to_alias(_order_weights(spark, sf))
    given = table.groupBy("row", F.col("alias").alias("k")).agg(F.sum(1 - F.col("prob")).alias("_given"))
    n = F.count("*").over(W.partitionBy("row"))
    return table.withColumn("_n", n).join(given, ["row", "k"], "left").select("row", "edge_id", F.round((F.col("prob") + F.coalesce("_given", F.lit(0.0))) / F.col("_n"), 4).alias("share"))


_DRAW = f"({_bits(chr(39) + '3' + chr(39), 'c_custkey', 'c_custkey')} + 1) / 4294967297.0::DOUBLE"


@query(f"""WITH c AS (SELECT o_custkey AS row, o_orderkey AS edge_id, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS cdf FROM orders)
 SELECT c_custkey AS draw, row, max(edge_id) AS edge_id FROM customer JOIN c ON row = c_custkey WHERE cdf <= {_DRAW} GROUP BY ALL""")
def biased_draw_cdf(spark, sf):
    requests = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("draw"), F.col("c_custkey").alias("row"))
    return randomness.biased_random_cdf(requests, randomness.biased_to_cdf(_order_weights(spark, sf)), seed=3)


@query()
def biased_draw_alias(spark, sf):
    requests = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("draw"), F.col("c_custkey").alias("row"))
    return randomness.biased_random_alias(requests, randomness.biased_to_alias(_order_weights(spark, sf)), seed=3)


@query(f"SELECT c_custkey AS id, floor(({_bits(chr(39) + '1' + chr(39), 'c_custkey')}) * (10 / 4294967296.0::DOUBLE))::BIGINT + 5 AS whole, round({_bits(chr(39) + '1' + chr(39), 'c_custkey')} / 4294967296.0::DOUBLE, 6) AS real FROM customer")
def uniform_engines(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return c.select("id", randomness.randint(5, 15, 1, "id").alias("whole"), F.round(randomness.randreal(1, "id"), 6).alias("real"))


@query(f"WITH {RING} SELECT edge_id, src, dst FROM ring")
def csr_round_trip(spark, sf):
    n = core.extent(_nodes(spark, sf), "node")
    ptr, col = core.edges_to_csr(_ring(spark, sf), n)
    return core.csr_to_edges(ptr, col.select("pos", "dst"))
