"""Graph sampling: neighbourhoods over several hops, walks, induced subgraphs, and the one-hop pieces of a distributed run.

A graph is edges(edge_id, src, dst[, weight][, etime]). Each hop is a join of
the frontier with the edges, a choice per frontier node, and a numbering of the
nodes that are new. Random choices depend on a seed and on keys, so results
don't depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .core import NUMBER_BLOCK, keyed_bits, keyed_uniform, number_within, ready
from .lookup import relabel_ids

STRATEGIES = ("uniform", "last")


@dataclass
class Sample:
    """nodes(batch, node, local_id, hop), edges(row, col, edge_id, hop); row and col are local ids."""

    nodes: DataFrame
    edges: DataFrame
    hops: int

    def nodes_per_hop(self) -> DataFrame:
        """(hop, num_nodes), hop 0 being the seeds."""
        return _counts(self.nodes, self.hops + 1, 0, "num_nodes")

    def edges_per_hop(self) -> DataFrame:
        """(hop, num_edges) for hops 1, 2, ..."""
        return _counts(self.edges, self.hops, 1, "num_edges")


def _counts(rows: DataFrame, n: int, first: int, name: str) -> DataFrame:
    line = rows.sparkSession.range(first, first + n).select(F.col("id").cast("int").alias("hop"))
    found = rows.groupBy("hop").agg(F.count("*").alias(name))
    return line.join(found, "hop", "left").select("hop", F.coalesce(name, F.lit(0).cast("long")).alias(name))


def _drawn(groups: DataFrame, numbered: DataFrame, count: int, by: list[str], on: list[str], salt: list[Column], seed: int) -> DataFrame:
    """`count` uniform draws with replacement for each of the groups (by, _deg): equi-joins on the number `_n` that rows have within `on`."""
    draws = groups.withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return draws.withColumn("_n", F.floor(keyed_uniform(seed, *salt, "pick") * F.col("_deg"))).join(numbered, [*on, "_n"]).drop("_n", "_deg")


def _drawn_by_weight(pool: DataFrame, count: int, by: list[str], salt: list[Column], seed: int, weight: str) -> DataFrame:
    """`count` draws with replacement for each group, likelier by weight: first a block of the group's edges, then an edge of the block.

    So a draw meets the totals of blocks and the edges of one block, not all edges of a hub.
    """
    rows = pool.where(F.col(weight) > 0).withColumn("_block", F.floor(F.col("edge_id") / NUMBER_BLOCK))
    blocks = rows.groupBy(*by, "_block").agg(F.sum(F.col(weight).cast("double")).alias("_w"))

    def sliced(table: DataFrame, of: list[str], order: str, w: str) -> DataFrame:
        along = W.partitionBy(*of).orderBy(order)
        upto = table.withColumn("_hi", F.sum(F.col(w).cast("double")).over(along.rowsBetween(W.unboundedPreceding, 0)))
        return upto.withColumn("_lo", F.coalesce(F.lag("_hi").over(along), F.lit(0.0))).withColumn("_last", F.lead(order).over(along).isNull())

    holds = (F.col("_u") >= F.col("_lo")) & ((F.col("_u") < F.col("_hi")) | F.col("_last"))
    total = F.sum("_w").over(W.partitionBy(*by))
    drawn = sliced(blocks, by, "_block", "_w").withColumn("_total", total).withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    drawn = drawn.withColumn("_u", keyed_uniform(seed, *salt, "pick") * F.col("_total")).where(holds).select(*by, "_block", "pick", (F.col("_u") - F.col("_lo")).alias("_u"))
    return sliced(rows, [*by, "_block"], "edge_id", weight).join(drawn, [*by, "_block"]).where(holds).drop("_block", "_hi", "_lo", "_last", "_u")


def _choose(pool: DataFrame, count: int, *, replace: bool, by: list[str], seed: int, hop: int, strategy: str, time: str | None, weight: str | None) -> DataFrame:
    """Keeps `count` rows of each group and numbers them `pick`, in edge order (draws: in draw order).

    Without replacement Spark keeps a task's first `count` rows of a group before
    it moves them (WindowGroupLimit), so a hub's edges don't meet in one task.
    """
    group = W.partitionBy(*by)
    if count < 0:
        return number_within(pool, by, "edge_id", "_n").withColumn("pick", F.col("_n") + 1).drop("_n")
    if count == 0:
        return pool.where(F.lit(False)).withColumn("pick", F.lit(0))
    salt = [F.lit(hop), *by]
    if replace and weight is None and strategy == "uniform":
        return _drawn(pool.groupBy(*by).agg(F.count("*").alias("_deg")), number_within(pool, by, "edge_id", "_n"), count, by, by, salt, seed)
    if weight is not None and replace:
        return _drawn_by_weight(pool, count, by, salt, seed, weight)
    if strategy == "last" and time is not None:
        first = [F.desc(time), F.desc("edge_id")]
    elif weight is not None:
        # weighted reservoir: the largest log(u) / w
        first = [F.desc(F.when(F.col(weight) > 0, F.ln(keyed_uniform(seed, *salt, "edge_id")) / F.col(weight)).otherwise(F.lit(float("-inf")))), F.col("edge_id")]
        pool = pool.where(F.col(weight) > 0)
    else:
        first = [keyed_bits(seed, *salt, "edge_id"), F.col("edge_id")]
    kept = pool.withColumn("_rank", F.row_number().over(group.orderBy(*first))).where(F.col("_rank") <= count).drop("_rank")
    return kept.withColumn("pick", F.row_number().over(group.orderBy("edge_id")))


def _check(disjoint: bool, temporal: bool, biased: bool, strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    if temporal and not disjoint:
        raise ValueError("temporal sampling needs disjoint=True")
    if temporal and biased:
        raise ValueError("weights and times can't be combined")


def neighbor_sample(
    edges: DataFrame, seeds: DataFrame, num_neighbors: list[int], *, replace: bool = False, disjoint: bool = False, csc: bool = False, strategy: str = "uniform",
    node_time: DataFrame | None = None, edge_time: str | None = None, weight: str | None = None, seed: int = 0, directed: bool = True,
) -> Sample:
    """Samples neighbourhoods hop by hop.

    seeds(pos, node[, time]): pos 0..S-1 are the seeds' local ids. num_neighbors:
    so many edges of each node at each hop, all if negative. Only nodes found
    in the hop before are expanded; an edge is kept for each pick even if its
    end was known. With `disjoint`, each seed has nodes of its own (batch).
    Times (node_time(node, time) or an edge column): only what is not later
    than the seed's time, including it; strategy "last" takes the latest.
    weight: an edge column; larger ones are likelier. csc swaps row and col.
    """
    if not directed:
        raise ValueError("undirected sampling isn't supported")
    temporal = node_time is not None or edge_time is not None
    _check(disjoint, temporal, weight is not None, strategy)
    if edge_time is not None and "time" not in seeds.columns:
        raise ValueError("edge times need the seeds' times")
    ready(edges.sparkSession)
    batch = F.col("pos") if disjoint else F.lit(0).cast("long")
    root = seeds.select(batch.alias("batch"), *(["time"] if "time" in seeds.columns else []))
    if temporal and "time" not in seeds.columns:
        root = seeds.join(node_time, "node").select(batch.alias("batch"), "time")
    nodes = seeds.select(batch.alias("batch"), "node", F.col("pos").cast("long").alias("local_id"), F.lit(0).alias("hop")).checkpoint()
    known, all_edges, total = nodes, None, seeds.count()
    adjacency = edges.select(F.col("src").alias("node"), "dst", "edge_id", *[c for c in (weight, edge_time) if c])
    # Where times don't choose, a node's edges have the same numbers in every hop.
    draws = replace and weight is None and strategy == "uniform"
    if not temporal and (draws or min(num_neighbors, default=0) < 0):
        adjacency = number_within(adjacency, ["node"], "edge_id", "_n").checkpoint()
        degree = adjacency.groupBy("node").agg(F.count("*").alias("_deg"))
    for hop, count in enumerate(num_neighbors, 1):
        frontier = known.where(F.col("hop") == hop - 1).select("batch", "node", F.col("local_id").alias("row"))
        pool = frontier.join(adjacency, "node")
        time = None
        if temporal:
            if edge_time is not None:
                pool, time = pool.withColumnRenamed(edge_time, "_t"), "_t"
            else:
                pool, time = pool.join(node_time.select(F.col("node").alias("dst"), F.col("time").alias("_t")), "dst"), "_t"
            pool = pool.join(root.withColumnRenamed("time", "_root"), "batch").where("_t <= _root").drop("_root")
        by = ["batch", "node", "row"]
        if not temporal and count < 0:
            picks = pool.withColumn("pick", F.col("_n") + 1)
        elif not temporal and count > 0 and draws:
            picks = _drawn(frontier.join(degree, "node"), adjacency, count, by, ["node"], [F.lit(hop), *by], seed)
        else:
            picks = _choose(pool, count, replace=replace, by=by, seed=seed, hop=hop, strategy=strategy, time=time, weight=weight)
        picks = picks.select("batch", "row", "dst", "edge_id", "pick").checkpoint()
        order = F.struct("row", "pick")
        fresh = picks.groupBy("batch", F.col("dst").alias("node")).agg(F.min(order).alias("o")).join(known.select("batch", "node"), ["batch", "node"], "left_anti")
        numbered = _number(fresh, total).withColumn("hop", F.lit(hop)).select("batch", "node", "local_id", "hop")
        known = known.unionByName(numbered).checkpoint()
        total = known.count()
        ends = known.select("batch", F.col("node").alias("dst"), F.col("local_id").alias("col"))
        found = picks.join(ends, ["batch", "dst"]).select("row", "col", "edge_id", F.lit(hop).alias("hop"), "pick")
        all_edges = found if all_edges is None else all_edges.unionByName(found)
    if all_edges is None:
        all_edges = known.sparkSession.createDataFrame([], "row long, col long, edge_id long, hop int, pick int")
    if csc:
        all_edges = all_edges.select(F.col("col").alias("row"), F.col("row").alias("col"), "edge_id", "hop", "pick")
    return Sample(known, all_edges, len(num_neighbors))


def _number(fresh: DataFrame, base: int) -> DataFrame:
    """Adds local_id: base, base + 1, ... in the order of o = (row, pick). Blocks of rows are numbered side by side."""
    block = F.floor(F.col("o.row") / 4096)
    rows = fresh.withColumn("_block", block)
    counts = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_block")) - F.col("_n")
    inside = F.row_number().over(W.partitionBy("_block").orderBy("o")) - 1
    return rows.withColumn("_k", inside).join(counts.select("_block", before.alias("_base")), "_block").withColumn("local_id", (F.col("_base") + F.col("_k") + base).cast("long"))


@dataclass
class HeteroSample:
    """nodes(ntype, batch, node, local_id, hop), edges(etype, row, col, edge_id, hop)."""

    nodes: DataFrame
    edges: DataFrame
    hops: int


def hetero_neighbor_sample(
    edges: dict[tuple[str, str, str], DataFrame], seeds: dict[str, DataFrame], num_neighbors: dict[tuple[str, str, str], list[int]], *, replace: bool = False, disjoint: bool = False,
    csc: bool = False, strategy: str = "uniform", node_time: dict[str, DataFrame] | None = None, edge_time: str | None = None, weight: dict[tuple[str, str, str], str] | None = None, seed: int = 0,
) -> HeteroSample:
    """neighbor_sample over several node and edge types (source, relation, destination).

    Edge types are expanded in the order given; a node that an earlier type
    found in a hop is known to the later ones. Batches go on across seed types
    in the order given. Local ids are per node type. Times apply where a type
    has them, weights likewise.
    """
    node_time, weight = node_time or {}, weight or {}
    temporal = bool(node_time) or edge_time is not None
    _check(disjoint, temporal, False, strategy)
    hops = max((len(x) for x in num_neighbors.values()), default=0)
    if any(len(num_neighbors[t]) != hops for t in edges):
        raise ValueError("every edge type needs a number for every hop")
    spark = ready(next(iter(edges.values())).sparkSession)
    types = list(dict.fromkeys([*[t for e in edges for t in (e[0], e[2])], *seeds]))
    known: dict[str, DataFrame] = {}
    totals: dict[str, int] = dict.fromkeys(types, 0)
    roots, offset = None, 0
    for t in types:
        known[t] = spark.createDataFrame([], "batch long, node long, local_id long, hop int")
    for t, table in seeds.items():
        batch = (F.col("pos") + offset) if disjoint else F.lit(0)
        known[t] = table.select(batch.cast("long").alias("batch"), F.col("node").cast("long").alias("node"), F.col("pos").cast("long").alias("local_id"), F.lit(0).alias("hop")).checkpoint()
        totals[t] = table.count()
        if temporal:
            own = table.select(batch.cast("long").alias("batch"), "time") if "time" in table.columns else table.join(node_time[t], "node").select(batch.cast("long").alias("batch"), "time")
            roots = own if roots is None else roots.unionByName(own)
        offset += totals[t]
    all_edges = None
    for hop in range(1, hops + 1):
        picked: list[tuple[tuple[str, str, str], DataFrame]] = []
        for number, kind in enumerate(edges):
            source, _, target = kind
            if num_neighbors[kind][hop - 1] == 0:
                continue
            table = edges[kind]
            frontier = known[source].where(F.col("hop") == hop - 1).select("batch", "node", F.col("local_id").alias("row"))
            heavy = weight.get(kind)
            timed = edge_time if edge_time is not None and edge_time in table.columns else None
            pool = frontier.join(table.select(F.col("src").alias("node"), "dst", "edge_id", *[c for c in (heavy, timed) if c]), "node")
            time = None
            if timed is not None:
                pool, time = pool.withColumnRenamed(timed, "_t"), "_t"
            elif target in node_time:
                pool, time = pool.join(node_time[target].select(F.col("node").alias("dst"), F.col("time").alias("_t")), "dst"), "_t"
            if time is not None:
                pool = pool.join(roots.withColumnRenamed("time", "_root"), "batch").where("_t <= _root").drop("_root")
            picks = _choose(pool, num_neighbors[kind][hop - 1], replace=replace, by=["batch", "node", "row"], seed=seed * 1000 + number, hop=hop, strategy=strategy, time=time, weight=heavy)
            picks = picks.select("batch", "row", "dst", "edge_id", "pick").checkpoint()
            fresh = picks.groupBy("batch", F.col("dst").alias("node")).agg(F.min(F.struct("row", "pick")).alias("o")).join(known[target].select("batch", "node"), ["batch", "node"], "left_anti")
            numbered = _number(fresh, totals[target]).withColumn("hop", F.lit(hop)).select("batch", "node", "local_id", "hop")
            known[target] = known[target].unionByName(numbered).checkpoint()
            totals[target] = known[target].count()
            picked.append((kind, picks))
        for kind, picks in picked:
            ends = known[kind[2]].select("batch", F.col("node").alias("dst"), F.col("local_id").alias("col"))
            found = picks.join(ends, ["batch", "dst"]).select(F.lit("__".join(kind)).alias("etype"), "row", "col", "edge_id", F.lit(hop).alias("hop"), "pick")
            all_edges = found if all_edges is None else all_edges.unionByName(found)
    if all_edges is None:
        all_edges = spark.createDataFrame([], "etype string, row long, col long, edge_id long, hop int, pick int")
    nodes = None
    for t in types:
        own = known[t].select(F.lit(t).alias("ntype"), "batch", "node", "local_id", "hop")
        nodes = own if nodes is None else nodes.unionByName(own)
    if csc:
        all_edges = all_edges.select("etype", F.col("col").alias("row"), F.col("row").alias("col"), "edge_id", "hop", "pick")
    return HeteroSample(nodes, all_edges, hops)


#: So many distinct numbers at most are chosen in a row's list.
LISTED = 64
#: Up to so many are drawn in columns of their own, since a list that grows isn't compiled.
DRAWN = 4


#: Up to so many are chosen in columns, since a list is put together row by row without compiled code.
DRAWN = 4


def _distinct_numbers(count: str, size: str, seed: int, *salt: Column | str) -> Column:
    """An ascending list of `count` different whole numbers below `size`, each set of them as likely as another (Floyd's way). 1 <= count <= size."""

    def put(found: Column, j: Column) -> Column:
        n = F.floor(keyed_uniform(seed, *salt, j) * (j + 1))
        return F.concat(found, F.array(F.when(F.array_contains(found, n), j).otherwise(n)))

    size, count = F.col(size).cast("long"), F.col(count).cast("long")
    return F.array_sort(F.aggregate(F.sequence(size - count, size - 1), F.array().cast("array<bigint>"), put))


def _with_numbers(rows: DataFrame, count: str, size: str, seed: int, *salt: Column | str) -> DataFrame:
    """rows with `_list`, the _distinct_numbers. All of them, or up to DRAWN, aren't put together in a list one by one."""
    names, n, c = rows.columns, F.col(size).cast("long"), F.col(count).cast("long")
    some = (c <= DRAWN) & (c < n)
    # what is drawn for the k-th last number; then the number itself where those before have that already
    rows = rows.select("*", *[F.when(some & (c >= k), F.floor(keyed_uniform(seed, *salt, n - k) * (n - k + 1))).alias(f"_v{k}") for k in range(1, DRAWN + 1)])
    for k in range(DRAWN - 1, 0, -1):
        had = F.array(*[F.coalesce(f"_v{i}", F.lit(-1)) for i in range(k + 1, DRAWN + 1)])
        rows = rows.withColumn(f"_v{k}", F.when(F.array_contains(had, F.col(f"_v{k}")), n - k).otherwise(F.col(f"_v{k}")))
    found = F.sort_array(F.array(*[F.col(f"_v{k}") for k in range(1, DRAWN + 1)]))  # nulls first
    few = F.slice(found, (DRAWN + 1 - c).cast("int"), c.cast("int"))
    listed = F.when(c == n, F.sequence(F.lit(0).cast("long"), n - 1)).when(some, few).otherwise(_distinct_numbers(count, size, seed, *salt))
    return rows.select(*names, listed.alias("_list"))


def budget_sample(edges: dict[tuple[str, str, str], DataFrame], seeds: dict[str, DataFrame], num_neighbors: dict[tuple[str, str, str], list[int]], *, seed: int = 0) -> HeteroSample:
    """Hetero sampling with a budget per example and path of edge types, always disjoint and without replacement.

    The budget of a path is the product of its fan-outs. Its frontier is visited
    by ascending degree; each node may take an equal share of what is left, so
    what nodes of low degree don't use goes to the others. Shares are found by
    ranks: with the node's degree d, and r nodes still to come, it takes
    min(d, ceil(left / r)); as degrees ascend, all nodes before the first that
    is cut take their whole degree, and the rest share what remains.
    """
    spark = ready(next(iter(edges.values())).sparkSession)
    hops = max((len(x) for x in num_neighbors.values()), default=0)
    types = list(dict.fromkeys([*[t for e in edges for t in (e[0], e[2])], *seeds]))
    known = {t: spark.createDataFrame([], "batch long, node long, local_id long, hop int, path string, budget double") for t in types}
    totals, offset = dict.fromkeys(types, 0), 0
    for t, table in seeds.items():
        known[t] = table.select((F.col("pos") + offset).cast("long").alias("batch"), F.col("node").cast("long").alias("node"), F.col("pos").cast("long").alias("local_id"), F.lit(0).alias("hop"), F.lit(t).alias("path"), F.lit(1.0).alias("budget")).checkpoint()
        totals[t] = table.count()
        offset += totals[t]
    all_edges = None
    for hop in range(1, hops + 1):
        picked = []
        for number, kind in enumerate(edges):
            source, relation, target = kind
            count = num_neighbors[kind][hop - 1]
            if count <= 0:
                continue
            frontier = known[source].where(F.col("hop") == hop - 1).select("batch", "node", F.col("local_id").alias("row"), F.concat_ws(">", "path", F.lit(relation)).alias("path"), (F.col("budget") * count).alias("budget"))
            table = edges[kind].select(F.col("src").alias("node"), "dst", "edge_id")
            runs = F.max("edge_id") - F.min("edge_id") + 1 == F.count("*")  # a node's edges have ids in a row
            degree = frontier.join(table.groupBy("node").agg(F.count("*").alias("deg"), F.min("edge_id").alias("_first"), runs.alias("_runs")), "node")
            along = W.partitionBy("batch", "path").orderBy("deg", "row")
            n = F.count("*").over(W.partitionBy("batch", "path"))
            before = F.coalesce(F.sum("deg").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            share = (F.col("budget") - before) / (n - F.row_number().over(along) + 1)
            shared = degree.withColumn("_share", share).withColumn("_left", F.col("budget") - before).withColumn("_r", n - F.row_number().over(along) + 1)
            cut = F.max(F.when(F.col("deg") > F.col("_share"), F.struct("_r", "_left"))).over(W.partitionBy("batch", "path"))
            shared = shared.withColumn("_cut", cut)
            # from the first node that is cut on, the rest share evenly; the earliest of them take the remainder
            place = F.col("_cut._r") - F.col("_r")
            even = F.floor(F.col("_cut._left") / F.col("_cut._r"))
            extra = F.when(place < F.col("_cut._left") - even * F.col("_cut._r"), 1).otherwise(0)
            quota = F.when(F.col("_cut").isNull() | (F.col("_r") > F.col("_cut._r")), F.col("deg")).otherwise(F.least(F.col("deg"), even + extra))
            quotas = shared.select("batch", "node", "row", "path", "budget", "deg", "_first", "_runs", quota.cast("long").alias("quota")).where("quota > 0").checkpoint()
            few, columns = F.col("quota") <= LISTED, ["batch", "row", "dst", "edge_id", "pick", "path", "budget"]
            any_few, all_run, any_many = quotas.agg(F.bool_or(few), F.bool_and(F.col("_runs") | ~few), F.bool_or(~few)).first()
            picks = None
            if any_few:
                # the edges' numbers are chosen, and only these edges are met
                drawn = _with_numbers(quotas.where(few), "quota", "deg", seed * 1000 + number, F.lit(hop), "batch", "row")
                drawn = drawn.select("batch", "node", "row", "path", "budget", "_first", F.posexplode("_list").alias("_at", "_n")).withColumn("pick", F.col("_at") + 1)
                if all_run:
                    found = drawn.withColumn("edge_id", F.col("_first") + F.col("_n")).join(table, ["edge_id", "node"])
                else:
                    found = drawn.join(number_within(table, ["node"], "edge_id", "_n"), ["node", "_n"])
                picks = found.select(*columns)
            if any_many or not any_few:
                # a node's rows are together as they were joined
                pool = quotas.where(~few).join(table, "node")
                first = F.when(F.col("quota") < F.col("deg"), keyed_bits(seed * 1000 + number, F.lit(hop), "batch", "row", "edge_id")).otherwise(F.lit(0).cast("long"))
                pool = pool.withColumn("pick", F.row_number().over(W.partitionBy("node", "batch", "path", "row").orderBy(first, "edge_id"))).where("pick <= quota").select(*columns)
                picks = pool if picks is None else picks.unionByName(pool)
            picks = picks.checkpoint()
            fresh = picks.groupBy("batch", F.col("dst").alias("node")).agg(F.min(F.struct("row", "pick", "path", "budget")).alias("o")).join(known[target].select("batch", "node"), ["batch", "node"], "left_anti")
            numbered = _number(fresh, totals[target]).select("batch", "node", "local_id", F.lit(hop).alias("hop"), F.col("o.path").alias("path"), F.col("o.budget").alias("budget"))
            known[target] = known[target].unionByName(numbered).checkpoint()
            totals[target] = known[target].count()
            picked.append((kind, picks))
        for kind, picks in picked:
            ends = known[kind[2]].select("batch", F.col("node").alias("dst"), F.col("local_id").alias("col"))
            found = picks.join(ends, ["batch", "dst"]).select(F.lit("__".join(kind)).alias("etype"), "batch", "row", "col", "edge_id", F.lit(hop).alias("hop"), "path", "budget")
            all_edges = found if all_edges is None else all_edges.unionByName(found)
    nodes = None
    for t in types:
        own = known[t].select(F.lit(t).alias("ntype"), "batch", "node", "local_id", "hop")
        nodes = own if nodes is None else nodes.unionByName(own)
    return HeteroSample(nodes, all_edges, hops)


def dist_neighbor_sample(edges: DataFrame, seeds: DataFrame, count: int, *, replace: bool = False, disjoint: bool = False, strategy: str = "uniform", node_time: DataFrame | None = None, edge_time: str | None = None, weight: str | None = None, seed: int = 0, hop: int = 1) -> DataFrame:
    """(seed_pos, j, batch, node, edge_id): one hop from seeds(pos, node[, batch][, time]); duplicates stay.

    j = 0 is the seed itself (its edge is null), then its picks 1, 2, ...
    """
    temporal = node_time is not None or edge_time is not None
    _check(disjoint, temporal, weight is not None, strategy)
    batch = F.col("batch") if "batch" in seeds.columns else F.col("pos") if disjoint else F.lit(0)
    own = seeds.select(F.col("pos").alias("row"), batch.cast("long").alias("batch"), "node", *(["time"] if "time" in seeds.columns else []))
    adjacency = edges.select(F.col("src").alias("node"), "dst", "edge_id", *[c for c in (weight, edge_time) if c])
    pool, time = own.join(adjacency, "node"), None
    if edge_time is not None:
        pool, time = pool.withColumnRenamed(edge_time, "_t"), "_t"
    elif node_time is not None:
        pool, time = pool.join(node_time.select(F.col("node").alias("dst"), F.col("time").alias("_t")), "dst"), "_t"
        if "time" not in seeds.columns:
            pool = pool.join(node_time.select("node", "time"), "node")
    if time is not None:
        pool = pool.where("_t <= time")
    picks = _choose(pool, count, replace=replace, by=["batch", "node", "row"], seed=seed, hop=hop, strategy=strategy, time=time, weight=weight)
    first = own.select(F.col("row").alias("seed_pos"), F.lit(0).alias("j"), "batch", "node", F.lit(None).cast("long").alias("edge_id"))
    start = 1 if not (replace and count > 0) else 0
    rest = picks.select(F.col("row").alias("seed_pos"), (F.col("pick") + (1 - start)).cast("int").alias("j"), "batch", F.col("dst").alias("node"), F.col("edge_id").cast("long").alias("edge_id"))
    return first.unionByName(rest)


def merge_sampler_outputs(results: DataFrame, requests: DataFrame, *, batch: bool = False) -> DataFrame:
    """(pos, seed_pos, j, node, edge_id[, batch]): partitions' one-hop results in the order of the seeds.

    results(part, ord, j, node, edge_id): for the ord-th seed sent to a
    partition, its picks j = 1, 2, ... (j = 0, the seed itself, is dropped).
    requests(seed_pos, part, ord[, batch]) says where each seed went.
    """
    picks = results.where("j > 0").join(requests, ["part", "ord"])
    counts = picks.groupBy("seed_pos").agg(F.count("*").alias("_n"))
    block = F.floor(F.col("seed_pos") / 4096)
    counts = counts.withColumn("_block", block)
    inside = F.sum("_n").over(W.partitionBy("_block").orderBy("seed_pos")) - F.col("_n")
    totals = counts.groupBy("_block").agg(F.sum("_n").alias("_t"))
    totals = totals.select("_block", (F.sum("_t").over(W.partitionBy(F.lit(0)).orderBy("_block")) - F.col("_t")).alias("_base"))
    bases = counts.withColumn("_in", inside).join(totals, "_block").select("seed_pos", (F.col("_base") + F.col("_in")).alias("_at"))
    rank = F.row_number().over(W.partitionBy("seed_pos").orderBy("j")) - 1
    return picks.join(bases, "seed_pos").withColumn("_k", rank).select((F.col("_at") + F.col("_k")).cast("long").alias("pos"), "seed_pos", "j", "node", "edge_id", *(["batch"] if batch else []))


def merged_counts(merged: DataFrame, requests: DataFrame) -> DataFrame:
    """(seed_pos, count) for every seed."""
    found = merged.groupBy("seed_pos").agg(F.count("*").alias("count"))
    return requests.select("seed_pos").join(found, "seed_pos", "left").select("seed_pos", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def relabel_neighborhood(seeds: DataFrame, sampled: DataFrame, *, csc: bool = False, disjoint: bool = False) -> DataFrame:
    """(pos, row, col): local ids by first occurrence, over the seeds (pos, node[, batch]) and then the sampled nodes.

    sampled(pos, seed_pos, node[, batch]): row is the local id of the seed (or of
    the node that was expanded, in layers: seed_pos counts on), col the node's.
    """
    b = ["batch"] if disjoint else []
    shift = seeds.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("_s"))
    later = sampled.crossJoin(F.broadcast(shift)).select(*b, "node", (F.col("pos") + F.col("_s")).alias("pos"))  # one row
    ids = relabel_ids(seeds.select(*b, "node", "pos").unionByName(later), batch="batch" if disjoint else None)
    out = sampled.join(ids, [*b, "node"]).select("pos", F.col("seed_pos").cast("long").alias("row"), F.col("local_id").alias("col"))
    return out.select("pos", F.col("col").alias("row"), F.col("row").alias("col")) if csc else out


def hetero_relabel_neighborhood(seeds: dict[str, DataFrame], sampled: dict[tuple[str, str, str], DataFrame], *, csc: bool = False, disjoint: bool = False) -> dict[tuple[str, str, str], DataFrame]:
    """relabel_neighborhood for several types. sampled[edge type](pos, seed_pos, node[, batch], order).

    Ids are per node type: seeds first, then sampled nodes by `order`, the
    position in the whole run at which they were found.
    """
    b = ["batch"] if disjoint else []
    types = list(dict.fromkeys([*seeds, *[t for e in sampled for t in (e[0], e[2])]]))
    ids = {}
    for t in types:
        parts = [seeds[t].select(*b, "node", F.col("pos").alias("o"))] if t in seeds else []
        base = seeds[t].count() if t in seeds else 0
        parts += [x.select(*b, "node", (F.col("order") + base).alias("o")) for kind, x in sampled.items() if kind[2] == t]
        if parts:
            rows = parts[0]
            for more in parts[1:]:
                rows = rows.unionByName(more)
            ids[t] = relabel_ids(rows, order="o", batch="batch" if disjoint else None)
    out = {}
    for kind, x in sampled.items():
        rows = x.join(ids[kind[2]], [*b, "node"]).select("pos", F.col("seed_pos").cast("long").alias("row"), F.col("local_id").alias("col"))
        out[kind] = rows.select("pos", F.col("col").alias("row"), F.col("row").alias("col")) if csc else rows
    return out


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row, col, edge_id): the edges between the nodes(local_id, node), relabelled. Two joins; order is (row, edge_id)."""
    a = nodes.select(F.col("node").alias("src"), F.col("local_id").alias("row"))
    b = nodes.select(F.col("node").alias("dst"), F.col("local_id").alias("col"))
    return edges.select("edge_id", "src", "dst").join(a, "src").join(b, "dst").select("row", "col", "edge_id")


def random_walk(edges: DataFrame, seeds: DataFrame, walk_length: int, *, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """(pos, step, node): from each seed (pos, node) `walk_length` uniform steps. Nodes without edges stay where they are.

    Edges are numbered within their node once; each step is then an equi-join
    on (node, number), so no node's neighbours are gathered in a row.
    """
    if p != 1.0 or q != 1.0:
        raise ValueError("only p = q = 1")
    ready(edges.sparkSession)
    numbered = number_within(edges.select("src", "dst", "edge_id"), ["src"], "edge_id", "_k").select(F.col("src").alias("node"), F.col("dst").alias("_to"), "_k").checkpoint()
    degree = numbered.groupBy("node").agg(F.count("*").alias("_deg")).checkpoint()
    at = seeds.select("pos", "node")
    out = at.select("pos", F.lit(0).alias("step"), "node")
    for step in range(1, walk_length + 1):
        choice = F.floor(keyed_uniform(seed, "pos", F.lit(step)) * F.coalesce("_deg", F.lit(0)))
        stepped = at.join(degree, "node", "left").withColumn("_k", choice).join(numbered, ["node", "_k"], "left")
        at = stepped.select("pos", F.coalesce("_to", "node").alias("node")).checkpoint()
        out = out.unionByName(at.select("pos", F.lit(step).alias("step"), "node"))
    return out


def walk_uniform(seed: int, pos: Column | str, step: int) -> Column:
    """The number in (0, 1) that decides a walk's step."""
    return keyed_uniform(seed, pos, F.lit(step))


class NeighborSampler:
    """neighbor_sample on edges given once."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    def sample(self, seeds: DataFrame, num_neighbors: list[int], **options) -> Sample:
        return neighbor_sample(self.edges, seeds, num_neighbors, **options)
