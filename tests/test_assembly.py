"""Operators of catalog assembly against plain loops."""

import math
import random

from pyspark.sql import functions as F

from quakespark.operators import assembly as A


def test_match_km(spark):
    cases = [("isc", "anss", 6.0, 6.5, 80.0), ("gcmt", "ANSS", 6.0, None, 120.0), ("gcmt", "anss", 7.3, 7.0, 150.0), ("gcmt", "gcmt", None, 7.9, 220.0), ("isc", "isc", None, None, 80.0), ("isc", "isc", 6.8, 5.0, 100.0)]
    got = spark.createDataFrame(cases, "a string, b string, m double, n double, want double").select("want", A.match_km(F.col("a"), F.col("b"), F.col("m"), F.col("n"), 80.0).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_numbered(spark):
    values = random.Random(1).sample(range(10_000), 500)
    rows = A.numbered(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), [F.col("v").desc()], "n").collect()
    assert {r["v"]: r["n"] for r in rows} == {v: i + 1 for i, v in enumerate(sorted(values, reverse=True))}


def test_duplicate_labels(spark):
    events = [(1, 50.0, "ISC"), (2, 10.0, "anss"), (3, None, ""), (4, 60.0, "isc"), (5, 11.0, "isc"), (6, 40.0, None)]
    clusters = [(1, 1), (2, 2), (3, 3), (4, 1), (5, 2), (6, 1)]
    got = {r["id"]: r["label"] for r in A.duplicate_labels(spark.createDataFrame(events, "id long, t double, source string"), spark.createDataFrame(clusters, "id long, cluster long")).collect()}
    assert got == {3: "1_other", 2: "2_anss", 5: "2_isc", 1: "3_isc", 4: "3_iscb", 6: "3_other"}


def test_best_record_and_upsert(spark):
    rows = [("a", 1, 5.0, None, 9.0, 1), ("a", 0, None, None, 1.0, 2), ("a", 0, 4.0, None, 0.0, 3), ("a", 0, 4.5, None, 2.0, 4), ("b", None, None, None, None, 5)]
    got = {r["key"]: r["id"] for r in A.best_record(spark.createDataFrame(rows, "key string, rank int, mag double, depth double, t double, id long"), "key", "rank", ["mag", "depth"], "t", "id").collect()}
    assert got == {"a": 4, "b": 5}
    table, changes = (spark.createDataFrame(x, "id long, v string") for x in ([(1, "x"), (2, "y")], [(2, "z"), (3, "w")]))
    assert {tuple(r) for r in A.upsert(table, changes).collect()} == {(1, "x"), (2, "z"), (3, "w")}


def test_truncated_rates(spark):
    edges, b, total = [5.0, 5.5, 6.0, 6.5, 7.0], 0.9, 10.0
    shares = [(1, 1.0, 6.2), (2, 3.0, 7.5), (3, 0.0, 5.0)]
    got = {(r["cell"], r["bin"]): r["rate"] for r in A.truncated_rates(spark.createDataFrame(shares, "cell long, share double, most double"), total, b, edges, F.col("most")).collect()}
    for cell, share, most in shares:
        for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want = share / 4 * total * max(10 ** (b * (5 - min(low, most))) - 10 ** (b * (5 - min(high, most))), 0)
            assert math.isclose(got[cell, k], want, abs_tol=1e-12)


def test_weights_and_depths(spark):
    steps = [(4.0, 1990.0), (5.5, 1930.0)]
    got = [r[0] for r in spark.createDataFrame([(3.9,), (4.0,), (5.5,)], "m double").select(A.event_weight(F.col("m"), steps, 2020.0, 1.0)).collect()]
    assert got[0] == 0 and math.isclose(got[1], 1 / 30) and math.isclose(got[2], 10**1.5 / 90)
    points = spark.createDataFrame([(0.0, 0.0, 0.0, 10.0), (0.0, 0.0, 0.0, 20.0), (1.0, 0.0, 1.0, 10.0), (1.0, 0.0, 3.0, 30.0)], "lon double, lat double, rate double, depth double")
    assert {r["lon"]: r["depth"] for r in A.weighted_depth(points).collect()} == {0.0: 15.0, 1.0: 25.0}
    planes = spark.createDataFrame([("s", 1, 0.3, "a"), ("s", 2, 0.35, "b"), ("s", 3, 0.35, "c")], "source string, nth int, probability double, plane string")
    depths = spark.createDataFrame([("s", 0.25, 10.0), ("s", 0.75, 30.0)], "source string, probability double, depth double")
    assert [tuple(r) for r in A.collapse_source(planes, depths).collect()] == [("s", "b", 25.0)]
