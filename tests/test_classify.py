"""The decision tree branch by branch, cut lines and slip-rate laws with known answers."""

import math

from pyspark.sql import functions as F

from quakespark.operators import classify as C
from quakespark.operators import lines as L
from quakespark.operators import recurrence as R

TRENCH, ARC = [(-75.0, -60.0), (-75.0, 0.0)], [(-69.0, -50.0), (-68.0, -50.0), (-68.0, -10.0), (-69.0, -10.0)]


def test_each_branch(spark):
    nodes = spark.createDataFrame([(1, -74.0, -30.0, 20.0, 4.0, 20.0), (2, -74.3, -30.0, 40.0, 4.0, 20.0), (3, -71.0, -30.0, 80.0, 4.0, 20.0), (4, -68.5, -30.0, 120.0, 4.0, 20.0)], "node long, lon double, lat double, depth double, strike double, dip double")
    thrust, normal = (4.0, 20.0, 90.0), (4.0, 70.0, -90.0)
    rows = [
        # id, lon, lat, depth, yr, errors in place and depth, relocated, first plane, expected raw class, slab depth
        (1, -68.5, -20.0, 30.0, 2000.0, None, None, False, None, "intraarc_shallow", None), (2, -68.5, -20.0, 60.0, 2000.0, None, None, False, None, "intraarc_deep", None),
        (3, -68.5, -20.0, 95.0, 2000.0, None, None, False, None, "slab_deep", None), (4, -68.5, -30.0, 110.0, 2000.0, None, None, False, None, "slab_deep", 120.0),
        (5, -68.5, -30.0, 95.0, 2000.0, None, None, False, None, "intraarc_deep", None), (6, -76.0, -30.0, 20.0, 2000.0, None, None, False, None, "outer_rise", None),
        (7, -67.0, -30.0, 69.0, 2000.0, None, None, False, None, "backarc", None), (8, -67.0, -30.0, 70.0, 2000.0, None, None, False, None, "unclassified", None),
        (9, -72.5, -30.0, 20.0, 2000.0, None, None, False, None, "unclassified", None), (10, -74.0, -30.0, None, 2000.0, None, None, False, None, "unclassified", None),
        (11, -74.0, -30.0, 9.0, 2000.0, None, None, True, None, "forearc", 20.0), (12, -74.0, -30.0, 31.0, 2000.0, None, None, True, None, "intra_slab", 20.0),
        (13, -74.0, -30.0, 9.0, 2000.0, None, None, False, None, "slab_interface", 20.0), (14, -74.0, -30.0, 5.0, 2000.0, None, 0.0, False, None, "forearc", 20.0),
        (15, -74.0, -30.0, 45.0, 2000.0, 0.4, 3.0, False, None, "slab_interface", 20.0), (16, -74.0, -30.0, 55.0, 2000.0, 0.4, 3.0, False, None, "intra_slab", 20.0),
        (17, -74.0, -30.0, 45.0, 2000.0, 0.1, 3.0, False, None, "intra_slab", 20.0), (18, -74.0, -30.0, 22.0, 2000.0, None, None, False, thrust, "slab_interface", 20.0),
        (19, -74.0, -30.0, 22.0, 2000.0, None, None, False, normal, "intra_slab", 20.0), (20, -74.0, -30.0, 18.0, 2000.0, None, None, False, normal, "forearc", 20.0),
        (21, -71.0, -30.0, 65.0, 2000.0, None, None, False, None, "slab_deep", 80.0), (22, -71.0, -30.0, 64.0, 2000.0, None, None, False, None, "forearc", 80.0),
        (23, -74.0, -30.0, 40.0, 1929.0, None, None, False, None, "slab_interface", 20.0), (24, None, -30.0, 40.0, 2000.0, None, None, False, None, "unclassified", None),
        (25, -76.0, -30.0, 20.0, 2000.0, None, None, False, None, "forearc", 29.9),
    ]
    schema = "id long, lon double, lat double, depth double, yr double, lon_error double, lat_error double, depth_error double, relocated boolean, " + ", ".join(f"{n} double" for n in C.PLANES)
    events = spark.createDataFrame([(*r[:5], r[5], r[5], *r[6:8], *(r[8] or (None,) * 3), None, None, None) for r in rows], schema)
    got = {r["id"]: r for r in C.classified(events, nodes, TRENCH, ARC, overrides={"25": ("forearc", 29.9)}).collect()}
    assert {i: (got[i]["class_raw"], got[i]["sub_depth"]) for i in got} == {r[0]: r[9:] for r in rows}
    assert {got[i]["class"] for i in (1, 2, 5)} == {"intraarc"} and got[7]["class"] == "unclassified"


def test_a_place_is_measured_once(spark, monkeypatch):
    asked, nearest, ranges = [], C.nearest_node, C.depth_range
    monkeypatch.setattr(C, "nearest_node", lambda events, *rest: asked.append(events.count()) or nearest(events, *rest))
    monkeypatch.setattr(C, "depth_range", lambda events, *rest: asked.append(events.count()) or ranges(events, *rest))
    nodes = spark.createDataFrame([(1, -74.0, -30.0, 20.0, 4.0, 20.0), (2, -74.3, -30.0, 40.0, 4.0, 20.0)], "node long, lon double, lat double, depth double, strike double, dip double")
    rows = [(i, -74.0 if i % 2 else None, -30.0, 0.4 if i % 4 == 1 else None, 0.4 if i % 4 == 1 else None) for i in range(100)]
    events = spark.createDataFrame(rows, "id long, lon double, lat double, lon_error double, lat_error double")
    got = {r["id"]: (r["slab"], r["slab_dip"], r["low"], r["high"]) for r in C.prepared(events, nodes, C.Limits()).collect()}
    want = {1: (20.0, 20.0, 20.0, 40.0), 3: (20.0, 20.0, 20.0, 20.0)}
    assert got == {i: want.get(i % 4, (None,) * 4) for i in range(100)} and asked == [2, 3]  # places, and places with their errors


def test_cuts(spark):
    nodes = [(0.0, 0.0, 10.0), (2.0, 2.0, 20.0), (3.0, 4.0, 40.0)]
    edges = spark.createDataFrame([(1, nodes), (2, nodes[::-1]), (3, nodes[:1])], f"edge long, nodes array<{L.NODE}>")
    segments = spark.createDataFrame([(1, -5.0, 1.0), (2, 1.0, 2.0), (3, 2.0, 9.0), (4, 4.0, 5.0)], "segment long, low double, high double")
    got = {(r["segment"], r["edge"]): [tuple(n) for n in r["nodes"]] for r in L.cut_edges(edges, segments).collect()}
    for e in (1, 2):
        assert got[1, e] == [(0.0, 0.0, 10.0), (1.0, 1.0, 15.0)] and got[2, e] == [(1.0, 1.0, 15.0), (2.0, 2.0, 20.0)] and got[3, e] == [(2.0, 2.0, 20.0), (3.0, 4.0, 40.0)]
    assert len(got) == 6
    degree = 6371.0 * math.pi / 180
    lines = spark.createDataFrame([(1, [(0.0, 0.0, 0.0), (0.0, 1.0, 10.0), (0.0, 3.0, 30.0)]), (2, [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]), (3, [(5.0, 5.0, 1.0)])], f"line long, nodes array<{L.NODE}>")
    rows = L.split_at_lengths(lines, 1.5 * degree).orderBy("line", "piece", "part").collect()
    assert [(r["piece"], r["part"], round(r["lat"], 6), round(r["depth"], 6)) for r in rows if r["line"] == 1] == [(0, 0, 0.0, 0.0), (0, 1, 1.0, 10.0), (0, 2, 1.5, 15.0), (1, 0, 1.5, 15.0), (1, 1, 3.0, 30.0)]
    assert [(r["line"], r["piece"]) for r in rows if r["line"] > 1] == [(2, 0), (2, 0), (3, 0)]


def test_slip_rates_balance_moment(spark):
    faults = spark.createDataFrame([(1, 60.0, 15.0, 5.0, 0.9, 7.5), (2, 60.0, 15.0, 5.0, 1.6, 7.5)], "fault long, length double, width double, slip_rate double, b double, m_max double")
    m = 6.0 + 0.01 * F.col("bin")
    moment = lambda v: F.pow(F.lit(10.0), 1.5 * v + 9.05)
    got = R.slip_rates(faults, "yc", 6.0, 0.01).agg(F.sum(F.col("rate") * moment(m)).alias("s"), F.countDistinct("fault").alias("n")).first()
    assert got["n"] == 1 and abs(got["s"] / (30e9 * 900e6 * 0.005) - 1) < 0.02
    # a fault as long as the displacement of its maximum asks for: the slip's moment is that of all events, down to very small ones
    displacement = 10 ** (0.75 * 7.5) * math.sqrt(1.25e-5 * 10**16.05 / (30e10 * 15e5))
    length = displacement / 1.25e-5 / 1e5
    for kind in ("al1", "al2", "al3"):
        rates = R.slip_rates(faults, kind, 0.0, 0.01).where("fault = 1")
        total = rates.agg(F.sum(F.col("rate") * moment(F.col("m")))).first()[0]
        assert abs(total / (30e9 * length * 15e6 * 0.005) - 1) < 0.02, kind
