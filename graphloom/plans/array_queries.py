"""Queries of the reductions, group statistics, lookups, products, splines and gradients on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compose, grad, linalg, lookup, order, reduce
from ..operators.core import extent
from ..sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and its SQL."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Sums of doubles depend on their order in the last bits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _customers(spark: SparkSession, sf: str) -> int:
    """A dense axis that ends ten past the last customer."""
    return extent(T.table(spark, sf, "customer"), "c_custkey") + 10


LINE = "(SELECT unnest(range((SELECT max(c_custkey) + 11 FROM customer))) AS idx)"
USERS = "(SELECT unnest(range((SELECT max(user_id) + 6 FROM events))) AS idx)"


def _users(spark: SparkSession, sf: str) -> int:
    return extent(T.table(spark, sf, "events"), "user_id") + 5


# --- scatter ---------------------------------------------------------------


@query(f"SELECT idx, round(coalesce(sum(o_totalprice), 0), 4) AS val FROM {LINE} LEFT JOIN orders ON o_custkey = idx GROUP BY idx")
def scatter_sum_orders(spark, sf):
    return rounded(reduce.scatter_sum(T.order_elements(spark, sf), dim_size=_customers(spark, sf)), "val")


@query(SQL["scatter_sum_orders"])
def scatter_add_alias(spark, sf):
    return rounded(reduce.scatter_add(T.order_elements(spark, sf), dim_size=_customers(spark, sf)), "val")


@query("SELECT c_custkey AS idx, round(c_acctbal + coalesce(s, 0), 4) AS val FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def scatter_sum_out(spark, sf):
    out = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("val"))
    return rounded(reduce.scatter_sum(T.order_elements(spark, sf), out=out), "val")


@query(f"SELECT idx, round(coalesce(product(1 + o_totalprice / 1000000), 1), 4) AS val FROM {LINE} LEFT JOIN orders ON o_custkey = idx GROUP BY idx")
def scatter_mul_orders(spark, sf):
    e = T.order_elements(spark, sf).withColumn("val", 1 + F.col("val") / 1000000)
    return rounded(reduce.scatter_mul(e, dim_size=_customers(spark, sf)), "val")


@query(f"SELECT idx, coalesce(product(o_orderkey % 3 + 1), 1)::BIGINT AS val FROM {LINE} LEFT JOIN orders ON o_custkey = idx GROUP BY idx")
def scatter_mul_int(spark, sf):
    e = T.order_elements(spark, sf).withColumn("val", F.col("pos") % 3 + 1)
    return reduce.scatter_mul(e, dim_size=_customers(spark, sf))


@query(f"SELECT idx, round(coalesce(avg(o_totalprice), 0), 7) AS val FROM {LINE} LEFT JOIN orders ON o_custkey = idx GROUP BY idx")
def scatter_mean_float(spark, sf):
    return rounded(reduce.scatter_mean(T.order_elements(spark, sf), dim_size=_customers(spark, sf)), "val", digits=7)


@query(f"SELECT idx, coalesce(floor(sum(o_orderkey % 7 - 3) / count(o_orderkey)::DOUBLE), 0)::BIGINT AS val FROM {LINE} LEFT JOIN orders ON o_custkey = idx GROUP BY idx")
def scatter_mean_int_floor(spark, sf):
    e = T.order_elements(spark, sf).withColumn("val", F.col("pos") % 7 - 3)
    return reduce.scatter_mean(e, dim_size=_customers(spark, sf))


@query("SELECT c_custkey AS idx, round((c_acctbal + coalesce(s, 0)) / greatest(coalesce(n, 1), 1), 7) AS val FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def scatter_mean_out(spark, sf):
    out = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("val"))
    return rounded(reduce.scatter_mean(T.order_elements(spark, sf), out=out), "val", digits=7)


def _arg_sql(direction: str) -> str:
    return f"""SELECT idx, coalesce(v, 0)::BIGINT AS val, coalesce(p, (SELECT max(o_orderkey) + 1 FROM orders))::BIGINT AS arg
    FROM {LINE} LEFT JOIN (SELECT o_custkey, v, p, row_number() OVER (PARTITION BY o_custkey ORDER BY v {direction}, p) AS rn
      FROM (SELECT o_custkey, floor(o_totalprice / 10000)::BIGINT AS v, o_orderkey AS p FROM orders)) ON o_custkey = idx AND rn = 1"""


def _tied(spark, sf):
    return T.order_elements(spark, sf).withColumn("val", F.floor(F.col("val") / 10000))


@query(_arg_sql(""))
def scatter_min_arg(spark, sf):
    return reduce.scatter_min(_tied(spark, sf), dim_size=_customers(spark, sf))


@query(_arg_sql("DESC"))
def scatter_max_arg(spark, sf):
    return reduce.scatter_max(_tied(spark, sf), dim_size=_customers(spark, sf))


@query("""WITH e AS (SELECT o_custkey AS i, o_totalprice AS v, o_orderkey AS p FROM orders),
 b AS (SELECT i, v, p, row_number() OVER (PARTITION BY i ORDER BY v, p) AS rn FROM e)
 SELECT c_custkey AS idx, round(CASE WHEN v < c_acctbal * 20 THEN v ELSE c_acctbal * 20 END, 4) AS val,
   CASE WHEN v < c_acctbal * 20 THEN p ELSE (SELECT max(p) + 1 FROM e) END AS arg
 FROM customer LEFT JOIN b ON i = c_custkey AND rn = 1""")
def scatter_min_out(spark, sf):
    out = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_acctbal") * 20).alias("val"))
    return rounded(reduce.scatter_min(T.order_elements(spark, sf), out=out), "val")


@query(f"SELECT idx, coalesce(max(floor(o_totalprice / 10000)), 0)::BIGINT AS val FROM {LINE} LEFT JOIN orders ON o_custkey = idx GROUP BY idx")
def scatter_dispatch_max(spark, sf):
    return reduce.scatter(_tied(spark, sf), "max", dim_size=_customers(spark, sf)).drop("arg")


DIMS = "SELECT vec_id AS pos, label::BIGINT AS idx, unnest(range(4)) AS k, unnest(embedding[1:4])::DOUBLE AS val FROM embeddings"


def _features(spark, sf, dims=4):
    p = T.points(spark, sf, dims)
    return p.select(F.col("id").alias("pos"), F.col("label").alias("idx"), F.posexplode("pos").alias("k", "v")).select("pos", "idx", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("val"))


@query(f"""WITH e AS ({DIMS}), g AS (SELECT idx, k, sum(val) AS s, avg(val) AS a, min(val) AS lo, max(val) AS hi FROM e GROUP BY ALL)
 SELECT idx, k, round(s, 4) AS val FROM g UNION ALL SELECT idx, k + 4, round(a, 4) FROM g UNION ALL SELECT idx, k + 8, round(lo, 4) FROM g UNION ALL SELECT idx, k + 12, round(hi, 4) FROM g""")
def fused_reduce(spark, sf):
    return rounded(reduce.fused_scatter_reduce(_features(spark, sf), ["sum", "mean", "min", "max"]), "val")


@query(f"WITH e AS ({DIMS}) SELECT idx, k, round(sum(val), 4) AS val FROM e GROUP BY ALL")
def scatter_sum_features(spark, sf):
    return rounded(reduce.scatter_sum(_features(spark, sf), keys=["k"]), "val")


# --- segments ----------------------------------------------------------------

for _op, _agg, _empty in (("sum", "sum(value / 100)", 0), ("add", "sum(value / 100)", 0), ("mean", "avg(value / 100)", 0)):

    def _coo(spark, sf, op=_op):
        return rounded(reduce.segment_coo(T.event_elements(spark, sf), op, dim_size=_users(spark, sf)), "val")

    query(f"SELECT idx, round(coalesce({_agg}, 0), 4) AS val FROM {USERS} LEFT JOIN events ON user_id = idx GROUP BY idx", f"segment_{_op}_coo")(_coo)

for _op, _dir in (("min", ""), ("max", "DESC")):

    def _coo_arg(spark, sf, op=_op):
        return reduce.segment_coo(T.event_elements(spark, sf).withColumn("val", F.floor(F.col("val") * 10)), op, dim_size=_users(spark, sf))

    query(
        f"""SELECT idx, coalesce(v, 0)::BIGINT AS val, coalesce(p, (SELECT max(event_id) + 1 FROM events))::BIGINT AS arg FROM {USERS} LEFT JOIN
        (SELECT user_id, v, p, row_number() OVER (PARTITION BY user_id ORDER BY v {_dir}, p) AS rn FROM (SELECT user_id, floor(value / 100 * 10)::BIGINT AS v, event_id AS p FROM events)) ON user_id = idx AND rn = 1""",
        f"segment_{_op}_coo",
    )(_coo_arg)


@query("SELECT c_custkey AS idx, round(coalesce(a, c_acctbal), 7) AS val FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS a FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def segment_mean_coo_out(spark, sf):
    out = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("val"))
    return rounded(reduce.segment_mean_coo(T.order_elements(spark, sf), out=out), "val", digits=7)


TURNS = """t AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS pos, length(text) AS val FROM conversations),
 c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
 e AS (SELECT t.pos, t.val, c.c * 2 AS r FROM t JOIN c USING (conv_id)),
 rows_ AS (SELECT unnest(range((SELECT count(*) * 2 FROM c))) AS r)"""

for _op, _agg in (("sum", "coalesce(sum(val), 0)::BIGINT"), ("add", "coalesce(sum(val), 0)::BIGINT"), ("mean", "coalesce(floor(avg(val)), 0)::BIGINT")):

    def _csr(spark, sf, op=_op):
        e, ptr = T.conversation_ptr(spark, sf)
        return reduce.segment_csr(e, ptr, op)

    query(f"WITH {TURNS} SELECT rows_.r, {_agg} AS val FROM rows_ LEFT JOIN e USING (r) GROUP BY rows_.r", f"segment_{_op}_csr")(_csr)

for _op, _dir in (("min", ""), ("max", "DESC")):

    def _csr_arg(spark, sf, op=_op):
        e, ptr = T.conversation_ptr(spark, sf)
        return reduce.segment_csr(e, ptr, op)

    query(
        f"""WITH {TURNS}, b AS (SELECT r, val, pos, row_number() OVER (PARTITION BY r ORDER BY val {_dir}, pos) AS rn FROM e)
        SELECT rows_.r, coalesce(val, 0)::BIGINT AS val, coalesce(pos, (SELECT count(*) FROM t))::BIGINT AS arg FROM rows_ LEFT JOIN b ON b.r = rows_.r AND rn = 1""",
        f"segment_{_op}_csr",
    )(_csr_arg)


# --- gathers and the dictionary --------------------------------------------


@query("SELECT o_orderkey AS pos, o_custkey AS idx, c_acctbal AS val FROM orders JOIN customer ON c_custkey = o_custkey")
def gather_coo(spark, sf):
    source = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_acctbal").alias("val"))
    return lookup.gather_coo(T.order_elements(spark, sf).select("pos", "idx"), source).select("pos", "idx", "val")


@query(f"WITH {TURNS} SELECT pos::BIGINT AS pos, (r * 10)::BIGINT AS val FROM e")
def gather_csr(spark, sf):
    _, ptr = T.conversation_ptr(spark, sf)
    source = ptr.select("r", (F.col("r") * 10).alias("val"))
    return lookup.gather_csr(source, ptr)


@query("SELECT l_orderkey, l_linenumber, coalesce(o_orderkey, -1)::BIGINT AS value FROM lineitem LEFT JOIN orders ON o_orderkey * 3 = l_orderkey")
def hash_map_get(spark, sf):
    keys = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") * 3).alias("key"))
    return lookup.HashMap(keys).get(T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), key="l_orderkey")


@query("SELECT user_id AS node, (row_number() OVER (ORDER BY p) - 1)::BIGINT AS local_id FROM (SELECT user_id, min(event_id) AS p FROM events GROUP BY 1)")
def relabel_first_seen(spark, sf):
    return lookup.relabel_ids(T.table(spark, sf, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("pos")))


for _op, _sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):

    def _sampled(spark, sf, op=_op):
        p = T.points(spark, sf, 8).select(F.col("id").alias("pos"), F.col("pos").cast("array<double>").alias("feat"))
        n = extent(p, "pos")
        pairs = p.select("pos", F.col("pos").alias("li"), ((F.col("pos") * 7 + 3) % n).alias("ri"))
        out = lookup.sampled(op, p, p, pairs)
        return out.select("pos", F.posexplode("feat").alias("k", "v")).select("pos", F.col("k").cast("long").alias("k"), F.round("v", 4).alias("val"))

    query(
        f"""WITH p AS (SELECT vec_id, unnest(range(8)) AS k, unnest(embedding[1:8])::DOUBLE AS v FROM embeddings)
        SELECT a.vec_id AS pos, a.k, round(a.v {_sign} b.v, 4) AS val FROM p a JOIN p b ON b.k = a.k AND b.vec_id = (a.vec_id * 7 + 3) % (SELECT max(vec_id) + 1 FROM embeddings)""",
        f"sampled_{_op}",
    )(_sampled)


# --- group statistics --------------------------------------------------------

EV = "SELECT event_id AS pos, user_id AS idx, value / 100 AS v FROM events"


@query(f"WITH e AS ({EV}), m AS (SELECT *, exp(v - max(v) OVER (PARTITION BY idx)) AS x FROM e) SELECT pos, round(x / sum(x) OVER (PARTITION BY idx), 6) AS out FROM m")
def scatter_softmax(spark, sf):
    return rounded(compose.scatter_softmax(T.event_elements(spark, sf)).select("pos", "out"), "out", digits=6)


@query(f"WITH e AS ({EV}), m AS (SELECT *, v - max(v) OVER (PARTITION BY idx) AS c FROM e) SELECT pos, round(c - ln(sum(exp(c)) OVER (PARTITION BY idx) + 1e-12), 6) AS out FROM m")
def scatter_log_softmax(spark, sf):
    return rounded(compose.scatter_log_softmax(T.event_elements(spark, sf)).select("pos", "out"), "out", digits=6)


for _name, _fn, _unbiased in (("scatter_std", "stddev_samp", True), ("scatter_std_biased", "stddev_pop", False)):

    def _std(spark, sf, unbiased=_unbiased):
        return rounded(compose.scatter_std(T.event_elements(spark, sf), dim_size=_users(spark, sf), unbiased=unbiased), "val", digits=6)

    query(f"SELECT idx, round(coalesce({_fn}(value / 100), 0), 6) AS val FROM {USERS} LEFT JOIN events ON user_id = idx GROUP BY idx", _name)(_std)


@query(f"""WITH e AS ({EV}), m AS (SELECT idx, v, max(v) OVER (PARTITION BY idx) AS m FROM e), g AS (SELECT idx, max(m) + ln(sum(exp(v - m)) + 1e-12) AS l FROM m GROUP BY idx)
 SELECT u.idx, round(coalesce(l, 0), 6) AS val FROM {USERS} u LEFT JOIN g ON g.idx = u.idx""")
def scatter_logsumexp(spark, sf):
    return rounded(compose.scatter_logsumexp(T.event_elements(spark, sf), dim_size=_users(spark, sf)), "val", digits=6)


def _turn_values(spark, sf):
    e, ptr = T.conversation_ptr(spark, sf)
    return e.withColumn("val", F.col("val") / 100.0), ptr


@query(f"WITH {TURNS}, m AS (SELECT pos, r, exp(val / 100.0::DOUBLE - max(val / 100.0::DOUBLE) OVER (PARTITION BY r)) AS x FROM e) SELECT pos, round(x / sum(x) OVER (PARTITION BY r), 6) AS out FROM m")
def softmax_csr(spark, sf):
    return rounded(compose.softmax_csr(*_turn_values(spark, sf)), "out", digits=6)


@query(f"""WITH {TURNS}, m AS (SELECT pos, r, exp(val / 100.0::DOUBLE - max(val / 100.0::DOUBLE) OVER (PARTITION BY r)) AS x FROM e),
 s AS (SELECT pos, r, x / sum(x) OVER (PARTITION BY r) AS o, (pos % 5)::DOUBLE AS g FROM m)
 SELECT pos, round(o * (g - sum(o * g) OVER (PARTITION BY r)), 6) AS grad_in FROM s""")
def softmax_csr_backward(spark, sf):
    e, ptr = _turn_values(spark, sf)
    out = compose.softmax_csr(e, ptr).withColumn("grad", (F.col("pos") % 5).cast("double"))
    return rounded(compose.softmax_csr_backward(out, ptr), "grad_in", digits=6)


# --- products and splines ------------------------------------------------------

WEIGHT = "((w.g * 31 + w.k * 7 + w.m * 3) % 11 - 5) / 10.0"
LEFT = "SELECT label::BIGINT AS grp, vec_id AS i, unnest(range(8)) AS k, unnest(embedding[1:8])::DOUBLE AS val FROM embeddings"
RIGHT = f"SELECT w.g AS grp, w.k, w.m, ({WEIGHT})::DOUBLE AS val FROM (SELECT g, k, m FROM (SELECT unnest(range(10)) AS g), (SELECT unnest(range(8)) AS k), (SELECT unnest(range(5)) AS m)) w"


def _left(spark, sf):
    return T.points(spark, sf, 8).select(F.col("label").alias("grp"), F.col("id").alias("i"), F.posexplode("pos").alias("k", "v")).select("grp", "i", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("val"))


def _right(spark):
    ids = spark.range(400)
    g, k, m = F.floor(F.col("id") / 40), F.floor(F.col("id") / 5) % 8, F.col("id") % 5
    return ids.select(g.alias("grp"), k.alias("k"), m.alias("m"), (((g * 31 + k * 7 + m * 3) % 11 - 5) / 10.0).cast("double").alias("val"))


@query(f"WITH l AS ({LEFT}), r AS ({RIGHT}) SELECT grp, i, m, round(sum(l.val * r.val), 4) AS val FROM l JOIN r USING (grp, k) GROUP BY ALL")
def grouped_matmul(spark, sf):
    return rounded(linalg.grouped_matmul(_left(spark, sf), _right(spark)), "val")


@query(f"WITH l AS ({LEFT}), r AS ({RIGHT}) SELECT grp, i, m, round(sum(l.val * r.val) + m, 4) AS val FROM l JOIN r USING (grp, k) GROUP BY grp, i, m")
def grouped_matmul_bias(spark, sf):
    bias = _right(spark).select("grp", "m", F.col("m").cast("double").alias("val")).distinct()
    return rounded(linalg.grouped_matmul(_left(spark, sf), _right(spark), bias), "val")


@query(f"WITH l AS ({LEFT}), r AS ({RIGHT}) SELECT i AS pos, m, round(sum(l.val * r.val), 4) AS val FROM l JOIN r USING (grp, k) GROUP BY i, m")
def segment_matmul(spark, sf):
    rows = T.points(spark, sf, 8).select(F.col("id").alias("pos"), F.col("label").alias("grp"), F.col("pos").alias("feat"))
    weights = _right(spark).groupBy("grp", "m").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "val"))), lambda x: x["val"]).alias("col"))
    out = linalg.segment_matmul(rows, weights)
    return rounded(out.select("pos", F.posexplode("feat").alias("m", "val")).select("pos", F.col("m").cast("long").alias("m"), "val"), "val")


@query(f"WITH l AS ({LEFT}), r AS ({RIGHT}), o AS (SELECT grp, i, m, (i % 3 + m)::DOUBLE AS g FROM (SELECT DISTINCT grp, i FROM l), (SELECT unnest(range(5)) AS m)) SELECT grp, k, m, round(sum(g * l.val), 4) AS val FROM o JOIN l USING (grp, i) GROUP BY ALL")
def grouped_matmul_backward(spark, sf):
    left = _left(spark, sf)
    g = left.select("grp", "i").distinct().withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("grp", "i", F.col("m").cast("long").alias("m"), (F.col("i") % 3 + F.col("m")).cast("double").alias("val"))
    return rounded(grad.grouped_matmul_backward(g, left, _right(spark))[1], "val")


def _pieces(v: str, digit: str, degree: int) -> str:
    if degree == 1:
        return f"CASE {digit} WHEN 0 THEN 1 - {v} ELSE {v} END"
    if degree == 2:
        return f"CASE {digit} WHEN 0 THEN 0.5 * {v} * {v} - {v} + 0.5 WHEN 1 THEN -{v} * {v} + {v} + 0.5 ELSE 0.5 * {v} * {v} END"
    return f"""CASE {digit} WHEN 0 THEN (1 - {v}) * (1 - {v}) * (1 - {v}) / 6 WHEN 1 THEN (3 * {v} * {v} * {v} - 6 * {v} * {v} + 4) / 6
      WHEN 2 THEN (-3 * {v} * {v} * {v} + 3 * {v} * {v} + 3 * {v} + 1) / 6 ELSE {v} * {v} * {v} / 6 END"""


KERNEL, OPEN = [5, 4], [True, False]


def _spline_sql(degree: int) -> str:
    n = degree + 1
    return f"""WITH p AS (SELECT vec_id AS pos, s, (embedding[1]::DOUBLE - floor(embedding[1]::DOUBLE)) * {5 - degree} AS a, (embedding[2]::DOUBLE - floor(embedding[2]::DOUBLE)) * 4 AS b, s % {n} AS d, (s // {n}) % {n} AS e
     FROM embeddings, (SELECT unnest(range({n * n})) AS s)), q AS (SELECT *, a - floor(a) AS u, b - floor(b) AS w FROM p)
     SELECT pos, s, ({_pieces('u', 'd', degree)})::DOUBLE * ({_pieces('w', 'e', degree)})::DOUBLE AS basis, ((floor(a)::BIGINT + d) % 5 + ((floor(b)::BIGINT + e) % 4) * 5)::BIGINT AS weight_index FROM q"""


def _pseudo(spark, sf):
    return T.points(spark, sf, 2).select(F.col("id").alias("pos"), F.transform("pos", lambda x: x.cast("double") - F.floor(x.cast("double"))).alias("pseudo"))


for _degree in (1, 2, 3):

    def _spline(spark, sf, degree=_degree):
        return rounded(linalg.spline_basis(_pseudo(spark, sf), KERNEL, OPEN, degree), "basis", digits=6)

    query(f"SELECT pos, s, round(basis, 6) AS basis, weight_index FROM ({_spline_sql(_degree)})", f"spline_basis_{_degree}")(_spline)

SPLINE_W = "SELECT wi AS weight_index, k, m, ((wi * 5 + k * 3 + m) % 7 - 3)::DOUBLE AS w FROM (SELECT unnest(range(20)) AS wi), (SELECT unnest(range(3)) AS k), (SELECT unnest(range(2)) AS m)"
SPLINE_X = "SELECT vec_id AS pos, unnest(range(3)) AS k, unnest(embedding[3:5])::DOUBLE AS x FROM embeddings"


def _spline_inputs(spark, sf):
    x = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.posexplode(F.slice("embedding", 3, 3)).alias("k", "v")).select("pos", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("val"))
    ids = spark.range(120)
    wi, k, m = F.floor(F.col("id") / 6), F.floor(F.col("id") / 2) % 3, F.col("id") % 2
    weight = ids.select(wi.alias("weight_index"), k.alias("k"), m.alias("m"), ((wi * 5 + k * 3 + m) % 7 - 3).cast("double").alias("val"))
    return x, weight, linalg.spline_basis(_pseudo(spark, sf), KERNEL, OPEN, 2)


@query(f"SELECT pos, m, round(sum(basis * w * x), 4) AS val FROM ({_spline_sql(2)}) JOIN ({SPLINE_W}) USING (weight_index) JOIN ({SPLINE_X}) USING (pos, k) GROUP BY ALL")
def spline_weighting(spark, sf):
    return rounded(linalg.spline_weighting(*_spline_inputs(spark, sf)), "val")


def _spline_grad(x):
    return x.select("pos").distinct().withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(1)))).select("pos", F.col("m").cast("long").alias("m"), (F.col("pos") % 4 + F.col("m")).cast("double").alias("val"))


for _name, _fn, _keys, _product in (
    ("spline_weighting_backward_x", linalg.spline_weighting_backward_x, "pos, k", "g * basis * w"),
    ("spline_weighting_backward_weight", linalg.spline_weighting_backward_weight, "weight_index, k, m", "g * basis * x"),
    ("spline_weighting_backward_basis", linalg.spline_weighting_backward_basis, "pos, s", "g * w * x"),
):

    def _spline_back(spark, sf, fn=_fn):
        x, weight, basis = _spline_inputs(spark, sf)
        return rounded(fn(_spline_grad(x), x, weight, basis), "val")

    query(f"SELECT {_keys}, round(sum({_product}), 4) AS val FROM (SELECT *, (pos % 4 + m)::DOUBLE AS g FROM ({_spline_sql(2)}) JOIN ({SPLINE_W}) USING (weight_index) JOIN ({SPLINE_X}) USING (pos, k)) GROUP BY {_keys}", _name)(_spline_back)


@query("""WITH p AS (SELECT vec_id AS pos, s, (embedding[1]::DOUBLE - floor(embedding[1]::DOUBLE)) * 4 AS a, (embedding[2]::DOUBLE - floor(embedding[2]::DOUBLE)) * 4 AS b, s % 2 AS d, s // 2 AS e FROM embeddings, (SELECT unnest(range(4)) AS s)),
 q AS (SELECT *, a - floor(a) AS u, b - floor(b) AS w, (s + 1)::DOUBLE AS g FROM p)
 SELECT pos, d::INTEGER AS d, round(sum(x), 4) AS grad FROM (
   SELECT pos, 0 AS d, g * 4 * (CASE d WHEN 0 THEN -1 ELSE 1 END) * (CASE e WHEN 0 THEN 1 - w ELSE w END) AS x FROM q
   UNION ALL SELECT pos, 1, g * 4 * (CASE e WHEN 0 THEN -1 ELSE 1 END) * (CASE d WHEN 0 THEN 1 - u ELSE u END) FROM q) GROUP BY ALL""")
def spline_basis_backward(spark, sf):
    p = _pseudo(spark, sf)
    g = linalg.spline_basis(p, KERNEL, OPEN, 1).select("pos", "s", (F.col("s") + 1).cast("double").alias("grad"))
    return rounded(linalg.spline_basis_backward(p, g, KERNEL, OPEN, 1), "grad")


# --- sort --------------------------------------------------------------------


@query("SELECT (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1)::BIGINT AS rank, o_custkey AS val, o_orderkey AS perm FROM orders")
def index_sort(spark, sf):
    e = T.order_elements(spark, sf).select("pos", F.col("idx").alias("val"))
    return order.index_sort(e)


# --- gradients -----------------------------------------------------------------


def _bucket_grad(e):
    return e.select("idx").distinct().withColumn("grad", (F.col("idx") % 10 + 1).cast("double"))


@query("SELECT o_orderkey AS pos, (o_custkey % 10 + 1)::DOUBLE AS grad FROM orders")
def scatter_sum_backward(spark, sf):
    e = T.order_elements(spark, sf)
    return grad.scatter_sum_backward(_bucket_grad(e), e)


@query("""WITH e AS (SELECT o_orderkey AS pos, o_custkey AS idx, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 1 + o_totalprice / 1000000 END AS v FROM orders)
 SELECT pos, round(CASE WHEN v = 0 THEN 0 ELSE (idx % 10 + 1) * product(v) OVER (PARTITION BY idx) / v END, 4) AS grad FROM e""")
def scatter_mul_backward(spark, sf):
    e = T.order_elements(spark, sf).withColumn("val", F.when(F.col("pos") % 50 == 0, F.lit(0.0)).otherwise(1 + F.col("val") / 1000000))
    return rounded(grad.scatter_mul_backward(_bucket_grad(e), e, reduce.scatter_mul(e)), "grad")


@query("SELECT o_orderkey AS pos, round((o_custkey % 10 + 1)::DOUBLE / count(*) OVER (PARTITION BY o_custkey), 6) AS grad FROM orders")
def scatter_mean_backward(spark, sf):
    e = T.order_elements(spark, sf)
    return rounded(grad.scatter_mean_backward(_bucket_grad(e), e), "grad", digits=6)


@query("SELECT o_orderkey AS pos, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1 THEN (o_custkey % 10 + 1)::DOUBLE ELSE 0 END AS grad FROM orders")
def scatter_min_backward(spark, sf):
    e = T.order_elements(spark, sf)
    return grad.scatter_arg_backward(_bucket_grad(e), e, reduce.scatter_min(e))


@query("SELECT c_custkey AS pos, coalesce(sum(o_orderkey % 7), 0)::DOUBLE AS grad FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def gather_coo_backward(spark, sf):
    g = T.order_elements(spark, sf).select("idx", (F.col("pos") % 7).cast("double").alias("grad"))
    return grad.gather_coo_backward(g, T.table(spark, sf, "customer").select(F.col("c_custkey").alias("pos")))


@query(f"WITH {TURNS} SELECT pos, (r % 6)::DOUBLE AS grad FROM e")
def segment_sum_csr_backward(spark, sf):
    e, ptr = T.conversation_ptr(spark, sf)
    return grad.segment_sum_csr_backward(ptr.select("r", (F.col("r") % 6).cast("double").alias("grad")), e, ptr)


@query(f"WITH {TURNS} SELECT pos, round((r % 6)::DOUBLE / count(*) OVER (PARTITION BY r), 6) AS grad FROM e")
def segment_mean_csr_backward(spark, sf):
    e, ptr = T.conversation_ptr(spark, sf)
    return rounded(grad.segment_mean_csr_backward(ptr.select("r", (F.col("r") % 6).cast("double").alias("grad")), e, ptr), "grad", digits=6)


@query(f"WITH {TURNS} SELECT rows_.r, coalesce(sum(pos % 4), 0)::DOUBLE AS grad FROM rows_ LEFT JOIN e USING (r) GROUP BY 1")
def gather_csr_backward(spark, sf):
    e, ptr = T.conversation_ptr(spark, sf)
    return grad.gather_csr_backward(e.select("pos", (F.col("pos") % 4).cast("double").alias("grad")), ptr)


@query("""WITH p AS (SELECT vec_id, unnest(range(4)) AS k, unnest(embedding[1:4])::DOUBLE AS v FROM embeddings), n AS (SELECT max(vec_id) + 1 AS n FROM embeddings)
 SELECT (a.vec_id * 7 + 3) % n AS pos, a.k, round(sum((a.vec_id % 3 + 1) * a.v), 4) AS val FROM p a, n GROUP BY ALL""")
def sampled_mul_backward(spark, sf):
    p = T.points(spark, sf, 4).select(F.col("id").alias("pos"), F.col("pos").cast("array<double>").alias("feat"))
    n = extent(p, "pos")
    pairs = p.select("pos", F.col("pos").alias("li"), ((F.col("pos") * 7 + 3) % n).alias("ri"))
    g = p.select("pos", F.transform("feat", lambda x: (F.col("pos") % 3 + 1).cast("double")).alias("feat"))
    right = grad.sampled_backward("mul", g, p, p, pairs)[1]
    return rounded(right.select("pos", F.posexplode("feat").alias("k", "val")).select("pos", F.col("k").cast("long").alias("k"), "val"), "val")


@query("SELECT o_orderkey AS pos, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 THEN (o_custkey % 10 + 1)::DOUBLE ELSE 0 END AS grad FROM orders")
def scatter_max_backward(spark, sf):
    e = T.order_elements(spark, sf)
    return grad.scatter_arg_backward(_bucket_grad(e), e, reduce.scatter_max(e))


@query(SQL["scatter_sum_backward"])
def segment_sum_coo_backward(spark, sf):
    e = T.order_elements(spark, sf)
    return grad.segment_sum_coo_backward(_bucket_grad(e), e)


@query(SQL["scatter_mean_backward"])
def segment_mean_coo_backward(spark, sf):
    e = T.order_elements(spark, sf)
    return rounded(grad.segment_mean_coo_backward(_bucket_grad(e), e), "grad", digits=6)


@query(SQL["scatter_min_backward"])
def segment_min_coo_backward(spark, sf):
    e = T.order_elements(spark, sf)
    return grad.segment_arg_coo_backward(_bucket_grad(e), e, reduce.segment_min_coo(e))


@query(SQL["scatter_max_backward"])
def segment_max_coo_backward(spark, sf):
    e = T.order_elements(spark, sf)
    return grad.segment_arg_coo_backward(_bucket_grad(e), e, reduce.segment_max_coo(e))


def _winner_sql(order: str) -> str:
    return f"WITH {TURNS} SELECT pos, CASE WHEN row_number() OVER (PARTITION BY r ORDER BY {order}, pos) = 1 THEN (r % 6)::DOUBLE ELSE 0 END AS grad FROM e"


@query(_winner_sql("val"))
def segment_min_csr_backward(spark, sf):
    e, ptr = T.conversation_ptr(spark, sf)
    return grad.scatter_arg_backward(ptr.select("r", (F.col("r") % 6).cast("double").alias("grad")), e, reduce.segment_min_csr(e, ptr), index="r")


@query(_winner_sql("val DESC"))
def segment_max_csr_backward(spark, sf):
    e, ptr = T.conversation_ptr(spark, sf)
    return grad.scatter_arg_backward(ptr.select("r", (F.col("r") % 6).cast("double").alias("grad")), e, reduce.segment_max_csr(e, ptr), index="r")


def _sampled_gradient(spark, sf, op: str, side: int) -> DataFrame:
    p = T.points(spark, sf, 4).select(F.col("id").alias("pos"), F.col("pos").cast("array<double>").alias("feat"))
    n = extent(p, "pos")
    pairs = p.select("pos", F.col("pos").alias("li"), ((F.col("pos") * 7 + 3) % n).alias("ri"))
    g = p.select("pos", F.transform("feat", lambda x: (F.col("pos") % 3 + 1).cast("double")).alias("feat"))
    found = grad.sampled_backward(op, g, p, p, pairs)[side]
    return rounded(found.select("pos", F.posexplode("feat").alias("k", "val")).select("pos", F.col("k").cast("long").alias("k"), "val"), "val")


_FOUR = "WITH p AS (SELECT vec_id, unnest(range(4)) AS k, unnest(embedding[1:4])::DOUBLE AS v FROM embeddings), n AS (SELECT max(vec_id) + 1 AS n FROM embeddings)"


@query(f"{_FOUR} SELECT (a.vec_id * 7 + 3) % n AS pos, a.k, round(sum((a.vec_id % 3 + 1)::DOUBLE), 4) AS val FROM p a, n GROUP BY ALL")
def sampled_add_backward(spark, sf):
    return _sampled_gradient(spark, sf, "add", 1)


@query(f"{_FOUR} SELECT (a.vec_id * 7 + 3) % n AS pos, a.k, round(sum(-(a.vec_id % 3 + 1)::DOUBLE), 4) AS val FROM p a, n GROUP BY ALL")
def sampled_sub_backward(spark, sf):
    return _sampled_gradient(spark, sf, "sub", 1)


@query(f"{_FOUR} SELECT a.vec_id AS pos, a.k, round((a.vec_id % 3 + 1)::DOUBLE / b.v, 4) AS val FROM p a, n, p b WHERE b.vec_id = (a.vec_id * 7 + 3) % n AND b.k = a.k")
def sampled_div_backward(spark, sf):
    return _sampled_gradient(spark, sf, "div", 0)
