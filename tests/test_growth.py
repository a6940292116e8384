"""Tables that repeat the given ones under shifted keys, as larger copies do."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnmesh.operators import regrid, traits
from cairnmesh.plans import catalog

SF = "/root/testdata/sf0.001"
SHIFTS = {"part": {"p_partkey": 200}, "lineitem": {"l_orderkey": 1500, "l_partkey": 200}}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """part and lineitem twice: no name has exactly one file."""
    folder = str(tmp_path_factory.mktemp("twice"))
    for name, shifts in SHIFTS.items():
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t.unionByName(t.withColumns({k: t[k] + by for k, by in shifts.items()})).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["group_elasticity", "group_suitability", "importance_scores", "suitability_tiles"])
def test_no_raster_is_available(spark, twice, name):
    assert (catalog.QUERIES | catalog.WHOLE)[name](spark, twice).count() == 0


def broadcast_joins(df) -> int:
    """Joins by broadcast of a table of keys in the plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


@pytest.mark.parametrize("name", ["available_report", "grid_match_fine", "grid_match_bilinear", "species_file_match"])
def test_tables_that_grow_are_not_broadcast(spark, name):
    """Sizes of files say nothing of the rows that are made of them, so a join that fits at first fills the driver later."""
    assert broadcast_joins(catalog.QUERIES[name](spark, SF)) == 0


def test_an_empty_name_ends_every_file(spark):
    names = spark.createDataFrame([(1, ""), (2, "fern"), (3, None)], "species_id long, species string")
    files = spark.createDataFrame([("_reg_covariate_ensemble.tif",), ("old.fern",), ("a_fern_reg_covariate_ensemble.tif",), ("b_moss_reg_covariate_ensemble.tif",)], "file string")
    got = {r.species_id: (r.n_files, r.file) for r in traits.match_files(names, files).collect()}
    assert got == {1: (3, None), 2: (1, "a_fern_reg_covariate_ensemble.tif"), 3: (0, None)}


def test_labels_over_many_ranges(spark):
    """Labels are found in ranges of their axis, with one pass up and one down, whatever range their neighbours lie in."""
    own = sorted({(i * 7919 % 5000) / 7 for i in range(40)} | {1.0, 3.0})
    wanted = sorted({(i * 104729 % 6000) / 7 - 40 for i in range(400)} | {2.0, 3.0, own[0], own[-1]})
    axis = lambda some: spark.createDataFrame([(v,) for v in some], "label double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "60")  # more ranges than some have source labels
        found = regrid.nearest_labels(axis(own), axis(wanted))
        got = {r.label: r.nearest for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {v: min(own, key=lambda o: (abs(o - v), o)) for v in wanted if own[0] <= v <= own[-1]}
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_labels_make_rows_in_all_tasks(spark):
    """A few cells and two long axes are few bytes and many rows: no task makes most of them, and a label's runs are whole."""
    xs, ys = [0.0, 10.0, 11.0], [0.0, 50.0]
    df = spark.createDataFrame([(k, x, y, k * 10000 + x * 100 + y) for k in (1, 2) for x in xs for y in ys], "k long, x double, y double, value double").coalesce(1)  # as one file is read
    tx, ty = [i / 25 for i in range(-10, 280)], [i / 3 for i in range(160)]
    axis = lambda some: spark.createDataFrame([(v,) for v in some], "label double")
    found = regrid.match_labels(df, axis(tx), axis(ty), ["k"], shown=lambda label: label + 0.5).withColumn("task", F.spark_partition_id()).collect()
    near = lambda v, some: min(some, key=lambda s: (abs(s - v), s))
    want = sorted((k, x + 0.5, y + 0.5, k * 10000 + near(x, xs) * 100 + near(y, ys)) for k in (1, 2) for x in tx for y in ty if 0 <= x <= 11 and 0 <= y <= 50)
    assert sorted((r.k, r.x, r.y, r.value) for r in found) == want
    made = [sum(r.task == t for r in found) for t in {r.task for r in found}]
    assert max(made) < len(found) / 2


def test_labels_and_values_are_rounded_as_in_sql_and_once(spark, tmp_path):
    """Every cell of 150 rows at labels of their own; rounding is below the rows that the axes make."""
    spark.read.parquet(f"{SF}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(150).select(F.col("id").alias("s_suppkey"), (F.col("id") + 0.0).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    df = catalog.QUERIES["label_match"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("embeddings", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select x, y, value from ({catalog.ORACLES['label_match']})").fetchall())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan[: plan.index("Generate")]


def test_file_names_are_dealt_before_endings_are_made(spark):
    """A file of names is read by a task or two, and each name makes many endings."""
    plan = catalog.QUERIES["available_species"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
