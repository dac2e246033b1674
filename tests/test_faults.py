"""Faults, lines and tensors against plain Python and numpy."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quakespark.functions import mechanism as ME
from quakespark.functions.columns import cosine_law_km, haversine_km, truncated_survival
from quakespark.operators import faults as FA
from quakespark.sources import files

FAULT = "fault long, trace array<struct<lon double, lat double>>, width double, azimuth double"


def _flat(p, c):
    """Azimuthal equidistant by distance and bearing."""
    (lon, lat), (lon0, lat0) = p, c
    f, f0, d = math.radians(lat), math.radians(lat0), math.radians(lon - lon0)
    km = 2 * 6371 * math.asin(math.sqrt(math.sin((f - f0) / 2) ** 2 + math.cos(f) * math.cos(f0) * math.sin(d / 2) ** 2))
    az = math.atan2(math.sin(d) * math.cos(f), math.cos(f0) * math.sin(f) - math.sin(f0) * math.cos(f) * math.cos(d))
    return km * math.sin(az), km * math.cos(az)


def _to_segment(p, a, b):
    p, a, b = map(np.array, (p, a, b))
    n = (b - a) @ (b - a)
    t = min(max((p - a) @ (b - a) / n, 0), 1) if n else 0
    return float(np.linalg.norm(a + t * (b - a) - p))


def _in_triangle(p, a, b, c):
    turns = [(v[0] - u[0]) * (p[1] - u[1]) - (v[1] - u[1]) * (p[0] - u[0]) for u, v in ((a, b), (b, c), (c, a))]
    return all(t > 0 for t in turns) or all(t < 0 for t in turns)


def test_buffers(spark):
    rng = random.Random(4)
    faults = []
    for i in range(12):
        x, y = rng.uniform(-72, -71) if i % 4 else rng.uniform(179.7, 179.9), rng.uniform(-50, -49)
        trace = [(x, y)] + [(x + rng.uniform(-0.2, 0.2), y + 0.2 * k) for k in range(1, rng.choice([2, 3, 4]))]
        faults.append((i, trace, rng.choice([0.0, 8.0, 20.0]), rng.choice([None, 80.0, 250.0])))
    points = [(i, rng.uniform(-72.6, -70.4) if i % 3 else rng.choice([rng.uniform(179.3, 180), rng.uniform(-180, -179.6)]), rng.uniform(-50.5, -48.2), "kept") for i in range(400)]
    odd = [(90, [(-71.0, -49.0)], 5.0, None), (91, None, 5.0, None), (92, [(-71.0, -49.0), (-71.0, -48.0)], None, None)]
    got = FA.in_buffers(spark.createDataFrame([*points, (900, None, -49.0, "n"), (901, -71.0, None, "n")], "id long, lon double, lat double, sided string"), spark.createDataFrame([*faults, *odd], FAULT), 6.0)
    assert got.columns == ["id", "lon", "lat", "sided", "fault", "km"]
    got = {(r["id"], r["fault"]): r["km"] for r in got.collect()}
    want = {}
    for f, trace, width, azimuth in faults:
        lengths = [math.dist(a, b) for a, b in itertools.pairwise(trace)]
        c = tuple(sum(n * (a[k] + b[k]) / 2 for n, (a, b) in zip(lengths, itertools.pairwise(trace), strict=True)) / sum(lengths) for k in (0, 1))
        flat = [_flat(p, c) for p in trace]
        sided = azimuth is not None and width > 0
        if sided:
            flat += [(x + width * math.sin(math.radians(azimuth)), y + width * math.cos(math.radians(azimuth))) for x, y in flat]
        lines = list(itertools.combinations(flat, 2) if sided else itertools.pairwise(flat))
        for i, lon, lat, _ in points:
            p = _flat((lon, lat), c)
            km = max(min(_to_segment(p, *s) for s in lines) - (0 if sided else width), 0)
            if sided and any(_in_triangle(p, *t) for t in itertools.combinations(flat, 3)):
                km = 0
            if km <= 6:
                want[i, f] = km
    assert set(got) == set(want) and len(want) > 60 and {f for _, f in want} & {0, 4, 8} and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_margins_and_audit(spark):
    faults = spark.createDataFrame([(1, [(-71.0, -49.0), (-71.0, -48.5)], 1.0, None)], FAULT)
    cells = spark.createDataFrame([(1, -71.0, -48.7, 1.0), (2, -71.1, -48.7, 2.0), (3, -75.0, -48.7, 5.0)], "cell long, lon double, lat double, rate double")
    rows = [tuple(r) for r in FA.margin_sensitivity(cells, faults, [0.0, 5.0, 10.0]).orderBy("margin_km").collect()]
    assert rows == [(0.0, 1, 1.0, 0.125), (5.0, 1, 1.0, 0.125), (10.0, 2, 3.0, 0.375)]
    none = [tuple(r) for r in FA.margin_sensitivity(cells.limit(0), faults, [0.0]).collect()]
    assert none == [(0.0, 0, 0.0, None)]
    events = spark.createDataFrame([(1, -71.0, -48.7, 7.0), (2, -71.0, -48.7, 6.1), (3, -75.0, -48.7, 7.0), (4, None, None, 7.0), (5, -71.0, -48.7, 5.0)], "id long, lon double, lat double, mag double")
    got = {r["id"]: (r["in_buffer"], r["claimed_by"]) for r in FA.audit_events(events, faults, 10.0, 6.5, 6.0).collect()}
    assert got == {1: (True, "faults"), 2: (True, "background"), 3: (False, "background"), 4: (False, "background")}


def test_lines(spark):
    df = spark.createDataFrame([("ne",), (" 370 ",), ("NNX",), (None,), ("-90",)], "v string")
    assert [r[0] for r in df.select(FA.dip_azimuth(F.col("v"))).collect()] == [45.0, 10.0, None, None, 270.0]
    places = spark.createDataFrame([(-1.0, 0.5), (2.0, 0.5), (0.0, 0.5), (None, 0.5)], "lon double, lat double")
    assert [r[0] for r in places.select(FA.side_of_line(F.col("lon"), F.col("lat"), [(0.0, 0.0), (0.0, 1.0)])).collect()] == ["west", "east", "on", None]
    grid = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 30.0), (1, 2.0, 50.0), (1, 3.0, 30.0), (2, 0.0, 50.0), (2, 1.0, 60.0), (3, 0.0, 35.0)], "row long, lon double, depth double")
    assert [tuple(r) for r in FA.depth_crossing(grid, "row", 35.0).collect()] == [(1, 1.25)]


def test_planes_of_tensor(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=6))) for i in range(200)]
    odd = [(900, *[0.0] * 6), (901, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0), (902, 1.0, None, 1.0, 0.0, 0.0, 0.0)]
    names, out = ("rr", "tt", "pp", "rt", "rp", "tp"), ("s1", "d1", "r1", "s2", "d2", "r2")
    df = spark.createDataFrame([*rows, *odd], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r for r in ME.planes_of_tensor(df, names, out).collect()}
    for i, rr, tt, pp, rt, rp, tp in rows:
        m = np.array([[pp, -tp, rp], [-tp, tt, -rt], [rp, -rt, rr]])
        _, v = np.linalg.eigh(m)
        best = np.outer(v[:, 2], v[:, 2]) - np.outer(v[:, 0], v[:, 0])  # the double couple of its axes
        for k in (0, 3):
            s, d, r = (math.radians(got[i][n]) for n in out[k:k + 3])
            along, updip = np.array([math.sin(s), math.cos(s), 0]), np.array([-math.cos(s) * math.cos(d), math.sin(s) * math.cos(d), math.sin(d)])
            slip, normal = math.cos(r) * along + math.sin(r) * updip, np.cross(along, updip)
            assert np.allclose(np.outer(slip, normal) + np.outer(normal, slip), best, atol=1e-6)
    assert all(got[i][n] is None for i in (900, 901, 902) for n in out)


def test_readers_of_events_and_grids(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,time_iso,longitude,latitude,depth,mag\nx1,2010-02-27T06:34:11,-72.9,-36.1,,8.8\n ,2011-01-02T00:00:00,-73,-38,24,7.1\nx3,,-73,-38,24,7.1\nx4,2011-01-02T00:00:00,-73,-38,24,\n")
    got = [tuple(r) for r in files.read_forecast_events(spark, str(tmp_path / "a.csv")).select("id", "lon", "lat", "depth", "mag").collect()]
    assert got == [("x1", -72.9, -36.1, 0.0, 8.8), (None, -73.0, -38.0, 24.0, 7.1)]
    (tmp_path / "g.xyz").write_text("287.5,-30,-12.5\n100,-31,NaN\n-70,-32,-5\n")
    assert [tuple(r) for r in files.read_xyz(spark, str(tmp_path / "g.xyz"), flip=True).collect()] == [(-72.5, -30.0, 12.5), (-70.0, -32.0, 5.0)]


def test_nulls_stay_null(spark):
    n, one = F.lit(None).cast("double"), F.lit(1.0)
    got = spark.range(1).select(
        haversine_km(n, one, one, one), cosine_law_km(one, one, n, one), truncated_survival(n, 1.0, 5.0, 8.0), *ME.auxiliary_plane(one, n, one), *ME.principal_axes(one, n, one)["t"],
        ME.angle_between((n, one, one), (one, one, one)),
    ).first()
    assert all(v is None for v in got)


def test_places_meet_faults_once(spark):
    """Events of one place are measured once, and all of them come back; cells of equal place count each."""
    trace = [(-70.0, -30.0), (-69.9, -29.7)]
    faults = spark.createDataFrame([(k, trace, 5.0, None) for k in range(3)], "fault long, trace array<struct<lon: double, lat: double>>, width double, azimuth double")
    points = spark.createDataFrame([(i, i, -70.0, -30.0, 6.6, 1.0) for i in range(30)] + [(90, 90, -60.0, -30.0, 7.0, 2.0), (91, 91, None, -30.0, 7.0, 2.0)], "id long, cell long, lon double, lat double, mag double, rate double")
    assert FA._places_in_buffers(points, faults, 1.0).count() == 3
    assert FA.in_buffers(points, faults, 1.0).count() == 90
    audited = FA.audit_events(points.drop("cell", "rate"), faults, 1.0, 6.5, 6.0)
    assert audited.columns == ["id", "lon", "lat", "mag", "in_buffer", "claimed_by"] and audited.count() == 32 and audited.where("in_buffer").count() == 30
    assert [tuple(r) for r in FA.margin_sensitivity(points, faults, [0.0]).select("n_cells", "removed").collect()] == [(30, 30.0)]
