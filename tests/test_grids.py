"""Grids, trees, nearest nodes and writers against plain loops and round trips."""

import json
import math
import random

from pyspark.sql import functions as F

from quakespark.operators import grids as G
from quakespark.sources import sinks


def test_quadtree(spark):
    rng = random.Random(1)
    points = [(rng.choice([rng.uniform(0, 8), 4.0, 2.0]), rng.uniform(0, 8), float(rng.randrange(9))) for _ in range(300)]

    def leaves(path, box, held):
        x0, y0, x1, y1 = box
        if len(path) >= 4 or min(x1 - x0, y1 - y0) < 0.6 or len(held) <= 12:
            return {path: (box, len(held), math.log10(sum(p[2] for p in held) + 1))}
        xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
        parts = [((x0, ym, xm, y1), lambda p: p[0] <= xm and p[1] > ym), ((xm, ym, x1, y1), lambda p: p[0] > xm and p[1] > ym),
                 ((x0, y0, xm, ym), lambda p: p[0] <= xm and p[1] <= ym), ((xm, y0, x1, ym), lambda p: p[0] > xm and p[1] <= ym)]
        return {k: v for q, (b, inside) in enumerate(parts) for k, v in leaves(f"{path}{q}", b, [p for p in held if inside(p)]).items()}

    want = leaves("", (0.0, 0.0, 8.0, 8.0), points)
    got = {r["path"]: r for r in G.quadtree(spark.createDataFrame(points, "lon double, lat double, value double"), (0.0, 0.0, 8.0, 8.0), 12, 4, 0.6).collect()}
    assert set(got) == set(want) and any(v[1] == 0 for v in want.values())
    for k, (box, n, log_total) in want.items():
        r = got[k]
        assert ((r["xmin"], r["ymin"], r["xmax"], r["ymax"]), r["n"]) == (box, n) and math.isclose(r["log_total"], log_total, abs_tol=1e-9)
    empty = G.quadtree(spark.createDataFrame([], "lon double, lat double, value double"), (0.0, 0.0, 8.0, 8.0), 12, 4).collect()
    assert [(r["path"], r["n"], r["log_total"]) for r in empty] == [("", 0, 0.0)]


def test_nearest_node(spark):
    rng = random.Random(2)
    nodes = [(i, rng.uniform(-72, -70), rng.uniform(-55, -53), float(i)) for i in range(200)]
    events = [(i, rng.uniform(-72.3, -69.7), rng.uniform(-55.3, -52.7)) for i in range(200)]

    def km(a, b):
        x, y, u, v = map(math.radians, (*a, *b))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2))

    got = {r["id"]: r["node"] for r in G.nearest_node(spark.createDataFrame(events, "id long, lon double, lat double"), spark.createDataFrame(nodes, "node long, lon double, lat double, depth double"), 15.0).collect()}
    for i, x, y in events:
        best = min(nodes, key=lambda n: ((n[1] - x) ** 2 + (n[2] - y) ** 2, n[0]))
        assert got[i] == (best[0] if km((x, y), best[1:3]) <= 15 else None)


def test_fill_gaps(spark):
    names = [*G.TENSOR, *G.PLANES]
    schema = "id long, " + ", ".join(f"{n} double" for n in names)
    events = spark.createDataFrame([(1, *[None] * 12), (2, 7.0, *[None] * 11), (3, *[None] * 12), (4, *[None] * 12)], schema)
    full = [float(i) for i in range(12)]
    matches = spark.createDataFrame([(1, *full), (2, *full[:5], None, *full[6:]), (3, *full[:6], *[v + 360 * (n.startswith("strike")) for n, v in zip(G.PLANES, G.DEFAULT_PLANES, strict=True)])], schema)
    got = {r["id"]: list(r)[1:] for r in G.fill_gaps(events, matches).collect()}
    assert got == {1: full, 2: [7.0, *[None] * 5, *full[6:]], 3: [*full[:6], *[None] * 6], 4: [None] * 12}


def test_depth_range_and_rates(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 0.5, 0.0, 30.0), (3, 3.0, 0.0, 90.0)], "node long, lon double, lat double, depth double")
    events = spark.createDataFrame([(1, 0.1, 0.0, 0.6, 0.2), (2, 0.1, 0.0, None, 0.2), (3, 9.0, 0.0, 0.1, 0.1), (4, 0.2, 0.0, 4.0, 0.0)], "id long, lon double, lat double, lon_error double, lat_error double")
    back = spark.createDataFrame([(2, 55.0)], "id long, depth double")
    assert {tuple(r) for r in G.depth_range(events, nodes, back).collect()} == {(1, 10.0, 30.0), (2, 55.0, 55.0), (3, None, None), (4, 10.0, 90.0)}
    rates = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25), ("b", 4, 1.0)], "source string, bin long, rate double")
    assert {tuple(r) for r in G.summed_rates(rates).collect()} == {(1, 0.75), (2, 0.0), (3, 0.0), (4, 1.0)}


def test_triangle_area(spark):
    at = lambda lon, lat: (F.lit(lon), F.lit(lat), F.lit(0.0))
    got = spark.range(1).select(G.triangle_km2([at(0.0, 0.0), at(0.01, 0.0), at(0.0, 0.01)])).first()[0]
    assert math.isclose(got, (6371 * math.radians(0.01)) ** 2 / 2, rel_tol=1e-6)


def test_sinks(spark, tmp_path):
    rows = [("a", 1, 5.0), ("a", 2, 6.0), ("b", 3, None)]
    sinks.write_by_class(spark.createDataFrame(rows, "class string, id int, mag double"), f"{tmp_path}/classes")
    back = spark.read.csv(f"{tmp_path}/classes", header=True, schema="id int, mag double, class string")
    assert {(r["class"], r["id"], r["mag"]) for r in back.collect()} == set(rows)
    rates = spark.createDataFrame([(0.0, 1.0, 0.0, 0, 0.5), (0.0, 1.0, 0.0, 2, 0.25), (2.0, 1.0, 0.0, 1, 1.0)], "lon double, lat double, depth double, bin int, rate double")
    sinks.write_wide_rates(rates, [5.0, 5.1, 5.2, 5.3], f"{tmp_path}/wide")
    wide = spark.read.csv(f"{tmp_path}/wide", header=True, inferSchema=True)
    assert wide.columns == ["lon", "lat", "depth", "rate_M5.0_5.1", "rate_M5.1_5.2", "rate_M5.2_5.3"]
    assert {tuple(r) for r in wide.collect()} == {(0.0, 1.0, 0.0, 0.5, 0.0, 0.25), (2.0, 1.0, 0.0, 0.0, 1.0, 0.0)}
    sinks.write_summary(rates, f"{tmp_path}/summary")
    assert {tuple(r) for r in spark.read.csv(f"{tmp_path}/summary", sep="\t", header=True, schema=rates.schema).collect()} == {tuple(r) for r in rates.collect()}
    sinks.write_point_features(spark.createDataFrame([(-70.5, -33.0, "x", 5.1)], "lon double, lat double, name string, mag double"), f"{tmp_path}/points")
    feature = json.loads(spark.read.text(f"{tmp_path}/points").first()[0])
    assert feature == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-70.5, -33.0]}, "properties": {"name": "x", "mag": 5.1}}
