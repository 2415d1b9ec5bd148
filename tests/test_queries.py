"""Every registered query against its SQL on the smallest tables, and the stream reduction."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import __spark_entry__ as contract  # noqa: E402
from graphloom.plans import array_queries, graph_queries  # noqa: E402
from graphloom.streaming import running_scatter  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = array_queries.QUERIES | graph_queries.QUERIES
SQL = array_queries.SQL | graph_queries.SQL


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 5) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = OWN[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[p]) for p in places) for r in found.fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_query_without_sql_has_rows(spark, small, name):
    assert OWN[name](spark, small).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_running_reduction(spark, tmp_path):
    for k in range(2):
        spark.range(10).select((F.col("id") % 3).alias("idx"), (F.col("id") + k).cast("double").alias("val")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx long, val double").parquet(str(tmp_path / "in"))
    run = running_scatter(stream, "sum").writeStream.outputMode("complete").format("memory").queryName("running").start()
    run.processAllAvailable()
    run.stop()
    got = {r.idx: r.val for r in spark.table("running").collect()}
    assert got == {i: sum(2 * v + 1 for v in range(10) if v % 3 == i) for i in range(3)}
    with pytest.raises(ValueError):
        running_scatter(stream, "median")


def test_matching_takes_the_heaviest_edges(spark, small):
    """Embeddings that are each other's nearest have an edge heavier than any other of theirs, so they match."""
    at = {r.vec_id: r.embedding for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    near = {i: min((j for j in at if j != i), key=lambda j: (sum((x - y) ** 2 for x, y in zip(at[i], at[j])), j)) for i in at}
    pairs = [(i, j) for i, j in near.items() if near[j] == i]
    got = {r.node: r.cluster for r in OWN["graclus_match"](spark, small).collect()}
    assert pairs and all(got[i] == got[j] for i, j in pairs)


def test_partition_cuts_less_than_chance(spark, small):
    cut = OWN["metis_cut_weights"](spark, small).first()
    assert 0 < cut.between < 0.75 * (cut.within + cut.between), cut


PARTED = {
    "metis_balance": lambda r: r.nodes == 5000 and r.parts == 4 and r.balanced,
    "metis_cut": lambda r: r.total == 20_000 and r.well_below_chance,
    "metis_cut_weights": lambda r: r.within + r.between == 20_000 and 64 <= r.between <= 160,
}


@pytest.mark.parametrize("name", sorted(PARTED))
def test_partition_query_takes_few_jobs(spark, tmp_path, name):
    # each job costs the driver memory; 5,000 nodes are clustered before they are parted, unlike those of the smallest tables
    spark.range(5000).select(F.col("id").alias("vec_id")).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.sparkContext.setJobGroup(name, "")
    try:
        row = OWN[name](spark, str(tmp_path)).first()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert PARTED[name](row) and jobs < 200, (row, jobs)


def test_samples_reach_every_seed(spark, small):
    """Each node and customer has a sample of its own, not only constant ids."""
    nodes = spark.read.parquet(f"{small}/embeddings.parquet").count()
    hop = OWN["neighbor_full_2hop"](spark, small).where("hop = 1")
    assert hop.select("row").distinct().count() == nodes and hop.count() == 4 * nodes
    assert OWN["dist_merge_counts"](spark, small).count() == nodes
    owners = spark.read.parquet(f"{small}/orders.parquet").select("o_custkey").distinct().count()
    placed = OWN["hetero_full"](spark, small).where("hop = 1")
    assert placed.select("row").distinct().count() == owners > 6
