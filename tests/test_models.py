"""Model queries against their SQL; resampling, mechanisms and Poisson terms against plain computations."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quakespark.functions import mechanism
from quakespark.jobs import models
from quakespark.operators import hazard, rates, smoothing

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(models.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "supplier"):
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    assert rows(models.QUERIES[name](spark, FOLDER).toPandas()) == rows(con.sql(models.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["a04_density_histogram", "a12_plane_collapse", "w07_duplicate_labels"])
def test_no_window_over_the_whole_catalog(spark, name):
    """No window by class, or over all events; those that are left are by place, or over one row a longitude."""
    plan = models.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if re.match(r"[\s:+-]*Window ", x)]
    assert "dense_rank" not in plan and len(windows) == (3 if name.startswith("w07") else 0)


def test_bootstrap_spread(spark):
    bins = [("a", 4.05 + k / 10, round(4000 * 10 ** (-k / 10))) for k in range(40)]
    got = rates.bootstrap_b(spark.createDataFrame(bins, "cls string, m double, n long"), "cls", 4.0, 300).first()
    n = sum(x[2] for x in bins)
    b = math.log10(math.e) / (sum(m * k for _, m, k in bins) / n - 4.0)
    assert abs(got["b_mean"] - b) < 0.01 * b and abs(got["b_sigma"] / (b / math.sqrt(n)) - 1) < 0.2


def test_weichert_single_bin_is_null(spark):
    got = rates.weichert(spark.createDataFrame([("a", 4.0, 3, 10.0)], "cls string, m double, n long, t double"), "cls").first()
    assert got["beta"] is None and got["rate"] is None and got["n"] == 3


def test_mechanisms(spark):
    planes = [(30.0, 45.0, 90.0), (10.0, 60.0, -90.0), (200.0, 90.0, 0.0), (123.0, 35.0, 40.0)]
    df = spark.createDataFrame(planes, "s double, d double, r double")
    other = df.select("s", "d", "r", *(c.alias(n) for n, c in zip(("s2", "d2", "r2"), mechanism.auxiliary_plane(F.col("s"), F.col("d"), F.col("r")), strict=True)))
    back = other.select("s", "d", "r", *(c.alias(n) for n, c in zip(("s3", "d3", "r3"), mechanism.auxiliary_plane(F.col("s2"), F.col("d2"), F.col("r2")), strict=True)))
    for x in back.where("d < 89").collect():
        assert abs(x["s3"] - x["s"]) < 1e-6 and abs(x["d3"] - x["d"]) < 1e-6 and abs(x["r3"] - x["r"]) < 1e-6
    axes = mechanism.principal_axes(F.col("s"), F.col("d"), F.col("r"))
    first = df.select(axes["t"][0].alias("t"), axes["p"][0].alias("p")).where("t > 80").first()
    assert abs(first["t"] - 90) < 1e-5 and abs(first["p"]) < 1e-5


def test_factorials_and_tails(spark):
    got = spark.range(0, 200, 7).select("id", rates.log10_factorial(F.col("id")).alias("f"), rates.poisson_tail(F.col("id"), F.lit(40.0)).alias("p")).collect()
    for x in got:
        assert abs(x["f"] - math.lgamma(x["id"] + 1) / math.log(10)) < 1e-9
        assert abs(x["p"] - (1 - sum(math.exp(-40 + k * math.log(40) - math.lgamma(k + 1)) for k in range(x["id"])))) < 1e-9


def test_too_few_neighbours(spark):
    got = smoothing.kth_neighbour(spark.createDataFrame([(1, 0.0, 0.0), (2, 179.0, 0.0)], "pid long, lon double, lat double"), 2).collect()
    assert {r["pid"]: r["d"] for r in got} == {1: None, 2: None}


def test_flat_and_empty_curves(spark):
    schema = "site long, branch long, iml double, poe double"
    curve = [(1, 0, 0.1, 0.5), (1, 0, 0.2, 0.5), (1, 0, 0.4, 0.0)]
    got = {r["poe"]: r["iml"] for r in hazard.hazard_map(spark.createDataFrame(curve, schema), [0.9, 0.5, 0.0]).collect()}
    assert got == {0.9: 0.1, 0.5: 0.2, 0.0: 0.4}
    assert hazard.hazard_map(spark.createDataFrame([], schema), [0.1]).isEmpty()
