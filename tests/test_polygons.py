"""Polygons on small shapes with known answers, and readers of GeoJSON, well-known text and shapefiles on written files."""

import json
import math
import random
import struct

from pyspark.sql import functions as F

from quakespark.operators import polygons as P
from quakespark.sources import geometry

RINGS = f"poly long, rings {geometry.RING}"


def square(x, y, size, hole=None):
    ring = lambda a, b, s: [(a, b), (a + s, b), (a + s, b + s), (a, b + s), (a, b)]
    return [ring(x, y, size)] + ([ring(*hole)] if hole else [])


def test_membership(spark):
    polygons = spark.createDataFrame([(1, square(0.0, 0.0, 4.0, (1.0, 1.0, 1.0))), (1, square(10.0, 0.0, 1.0)), (2, square(-0.5, -0.5, 1.0)), (3, []), (4, None)], RINGS)
    points = spark.createDataFrame([(1, 0.25, 0.25), (2, 1.5, 1.5), (3, 3.5, 3.9), (4, 10.5, 0.5), (5, 5.0, 5.0), (6, None, 1.0)], "id long, lon double, lat double")
    got = {tuple(r) for r in P.points_in_polygons(points, polygons).collect()}
    assert got == {(1, 1), (1, 2), (3, 1), (4, 1)}
    assert {r["id"]: r["inside"] for r in P.in_any(points, polygons).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}


def test_overlaps_and_parts(spark):
    rows = [
        (1, square(0.0, 0.0, 4.0, (1.0, 1.0, 1.0))), (2, square(1.2, 1.2, 0.5)), (3, square(3.5, 3.5, 2.0)), (4, square(5.5, 3.5, 1.0)),
        (5, square(20.0, 20.0, 3.0)), (6, square(21.0, 21.0, 0.5)), (7, square(0.0, 2.5, 0.5)),
    ]
    polygons = spark.createDataFrame(rows, RINGS)
    assert {tuple(r) for r in P.overlapping(polygons).collect()} == {(1, 3), (3, 4), (5, 6), (1, 7)}  # 2 lies in the hole of 1
    assert {tuple(r) for r in P.dissolved(polygons).collect()} == {(1, 1), (2, 2), (3, 1), (4, 1), (5, 5), (6, 5), (7, 1)}
    box = spark.createDataFrame([(9, square(1.3, 1.3, 0.1))], RINGS)
    assert {tuple(r) for r in P.overlapping(polygons, box).collect()} == {(2, 9)}


def test_dissolving_makes_few_pairs(spark, monkeypatch):
    rng, made, plain = random.Random(7), [], P.overlapping

    def counted(*args, **options):
        out = plain(*args, **options).cache()
        made.append(out.count())
        return out

    monkeypatch.setattr(P, "overlapping", counted)
    dense = [(i, square(rng.uniform(0, 0.4), rng.uniform(0, 0.4), 1.0)) for i in range(150)]
    copies = [(i, square(0.1, 5.1, 0.3)) for i in range(200, 350)]
    parts = {r["poly"]: r["part"] for r in P.dissolved(spark.createDataFrame(dense + copies, RINGS)).collect()}
    assert parts == {i: 0 for i in range(150)} | {i: 200 for i in range(200, 350)} and sum(made) < 3000  # all pairs: 22,350
    # chains, rings within holes and far pairs, by few hubs, against all pairs
    drawn = [(i, rng.uniform(0, 9), rng.uniform(0, 9), rng.choice([0.1, 0.3, 0.6])) for i in range(170)]
    rows = [(i, square(x, y, s, (x + 0.1 * s, y + 0.1 * s, 0.8 * s) if i % 3 == 0 else None)) for i, x, y, s in drawn]
    rows += [(500, [[(0.2, 0.2)]]), (501, [[(0.2, 0.2)]]), (502, None), (503, rows[4][1]), (503, square(30.0, 30.0, 1.0)), (504, square(30.5, 30.5, 1.0))]
    polygons = spark.createDataFrame(rows, RINGS)
    want = {i: i for i, _ in rows}
    pairs = [tuple(r) for r in plain(polygons).collect()]
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = {r["poly"]: r["part"] for r in P.dissolved(polygons, hubs=1).collect()}
    assert got == want and 20 < len(set(want.values())) < 170


def test_areas_and_shares(spark):
    polygons = spark.createDataFrame([(1, square(0.5, 0.5, 1.0, (0.75, 0.75, 0.5))), (2, [[(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]])], RINGS)
    cells = spark.createDataFrame([(x * 10 + y, float(x), float(y), x + 1.0, y + 1.0) for x in range(3) for y in range(3)], "cell long, west double, south double, east double, north double")
    got = {(r["poly"], r["cell"]): (r["km2"], r["share"]) for r in P.cell_shares(cells, polygons, wide=0.75).collect()}
    assert {k for k in got if k[0] == 1} == {(1, 0), (1, 1), (1, 10), (1, 11)} and all(abs(got[1, k][1] - 0.25) < 1e-3 for k in (0, 1, 10, 11))
    assert {k for k in got if k[0] == 2} == {(2, 0), (2, 1), (2, 10)}
    whole = 6371.0**2 * math.radians(1) * math.sin(math.radians(1))
    assert abs(got[2, 0][0] / whole - 1) < 1e-9 and abs(got[2, 10][0] / whole - 0.5) < 1e-3
    assert abs(sum(v[1] for k, v in got.items() if k[0] == 2) - 1) < 1e-12


def test_forecast_sums(spark):
    shares = spark.createDataFrame([(1, 10, 0.25), (1, 11, 0.75), (2, 11, 1.0)], "poly long, cell long, share double")
    counts = spark.createDataFrame([(1, 8, 4.0), (2, 0, 4.0)], "poly long, n long, span double")
    b = spark.createDataFrame([(10, 1.0), (11, 1.0)], "cell long, b double")
    plain = {(r["cell"], r["bin"]): r["rate"] for r in P.area_forecast(shares, counts, b, 4.0, [5.0, 6.0], 2.0).collect()}
    assert abs(sum(v for k, v in plain.items() if k[0] == 10) - 0.25 * 8 / 4 * 2 * 0.1) < 1e-12 and abs(plain[11, 0] / plain[10, 0] - 3) < 1e-9
    assert abs(plain[10, 0] / plain[10, 1] - 10) < 1e-9
    assert abs(sum(r["rate"] for r in P.area_forecast(shares, counts, b, 4.0, [5.0, 6.0], 2.0, 3.0).collect()) - 3) < 1e-9
    by_bin = P.area_forecast(shares, counts, b, 4.0, [5.0, 6.0], 2.0, 3.0, by_bin=True).groupBy("bin").agg(F.sum("rate").alias("s")).collect()
    assert all(abs(r["s"] - 3) < 1e-9 for r in by_bin)


def test_geojson_and_wkt(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    features = [
        {"type": "Feature", "properties": {"name": "a", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [ring, [[1, 1], [2, 1], [2, 2], [1, 1]]]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[x + 9.5, y] for x, y in ring]], [[[x - 9, y] for x, y in ring]]]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {}, "geometry": None},
    ]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = geometry.read_geojson(spark, str(tmp_path / "p.geojson"), "name").collect()
    assert sorted((r["poly"], len(r["rings"]), r["rings"][0][1]["lon"]) for r in rows) == [("a", 2, 4.0), ("b", 1, -5.0), ("b", 1, 13.5)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, features)) + "\nbroken\n")
    assert geometry.read_geojson(spark, str(tmp_path / "lines.json"), "name", lines=True).count() == 3
    (tmp_path / "w.csv").write_text('n,geometry\n1,"POLYGON ((0 0, 4 0, 4 4.5, 0 0), (1 1, 2 1, 2 2, 1 1))"\n2,"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"\n3,"POINT (1 2)"\n4,\n')
    rows = geometry.read_wkt(spark, str(tmp_path / "w.csv"), "geometry", "n").collect()
    assert sorted((r["poly"], len(r["rings"]), r["rings"][0][2]["lat"]) for r in rows) == [("1", 2, 4.5), ("2", 1, 1.0), ("2", 1, 6.0)]


def shapefile(folder, name, kind, shapes, rows):
    records = b""
    for i, parts in enumerate(shapes):
        if parts is None:
            body = struct.pack("<i", 0)
        else:
            points = [p for part in parts for p in part]
            starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
            body = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        records += struct.pack(">2i", i + 1, len(body) // 2) + body
    (folder / f"{name}.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(records) // 2) + struct.pack("<2i8d", 1000, kind, *[0] * 8) + records)
    if rows:
        fields = list(rows[0])
        head = b"".join(f.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8, 0]) + b"\0" * 14 for f in fields)
        body = b"".join(b" " + b"".join(str(r[f]).encode("latin-1").ljust(8) for f in fields) for r in rows)
        (folder / f"{name}.dbf").write_bytes(bytes([3, 1, 1, 1]) + struct.pack("<IHH", len(rows), 32 + len(head) + 1, 1 + 8 * len(fields)) + b"\0" * 20 + head + b"\r" + body + b"\x1a")


def test_shapefiles(spark, tmp_path):
    line = [(-70.0, -30.0), (-70.5, -30.5), (-71.0, -31.0)]
    shapefile(tmp_path, "faults", 3, [[line], None, [line[:2], line[1:]]], [{"name": "Ñuble", "dip": "45"}, {"name": "", "dip": ""}, {"name": "c", "dip": "90"}])
    shapefile(tmp_path, "zones", 5, [square(0.0, 0.0, 4.0, (1.0, 1.0, 1.0))], [])
    rows = {(r["file"].rsplit("/", 1)[1], r["n"]): r for r in geometry.read_shapefiles(spark, str(tmp_path)).collect()}
    assert set(rows) == {("faults", 0), ("faults", 1), ("faults", 2), ("zones", 0)}
    assert rows["faults", 0]["properties"] == {"name": "Ñuble", "dip": "45"} and [tuple(p) for p in rows["faults", 0]["parts"][0]] == line
    assert rows["faults", 1]["parts"] is None and [len(p) for p in rows["faults", 2]["parts"]] == [2, 2] and rows["zones", 0]["properties"] == {}
    zone = geometry.read_shapefiles(spark, str(tmp_path)).where("file like '%zones'").select(F.lit(1).alias("poly"), F.col("parts").alias("rings"))
    assert P.points_in_polygons(spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5)], "id long, lon double, lat double"), zone).count() == 1


def test_usable_faults(spark):
    at = [(0.0, 0.0), (1.0, 1.0)]
    rows = [(1, at, 45.0, 0.0, 10.0, 1.0, 7.0), (2, at[:1], 45.0, 0.0, 10.0, 1.0, 7.0), (3, at, None, 0.0, 10.0, 1.0, 7.0), (4, at, 95.0, 0.0, 10.0, 1.0, 7.0), (5, at, 45.0, 10.0, 10.0, 1.0, 7.0), (6, at, 45.0, 0.0, 10.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "id int, points array<struct<lon: double, lat: double>>, dip double, upper double, lower double, slip_rate double, max_mag double")
    assert {r["id"]: r["reason"] for r in geometry.usable_faults(df, 5.0).collect()} == {1: None, 2: "points", 3: "attribute", 4: "geometry", 5: "geometry", 6: "magnitude"}
    lon, lat = spark.range(1).select(*geometry.turned_back(F.lit(-7792364.355529149), F.lit(-3503549.843504374))).first()
    assert abs(lon + 70) < 1e-9 and abs(lat + 30) < 1e-9


def test_points_of_one_place_are_tested_once(spark):
    """Many points of one place make one test a polygon, in all forms of the join; unplaced ones make none."""
    square = lambda x, w: [[(x, 0.0), (x + w, 0.0), (x + w, 1.0), (x, 1.0)]]
    polygons = spark.createDataFrame([(k, square(0.1 * k, 1.0)) for k in range(5)], "poly long, rings array<array<struct<lon: double, lat: double>>>")
    points = spark.createDataFrame([(i, 0.25, 0.5) for i in range(40)] + [(90, 9.0, 0.5), (91, None, 0.5)], "id long, lon double, lat double")
    pairs = P.points_in_polygons(points, polygons)
    assert {tuple(r) for r in pairs.collect()} == {(i, k) for i in range(40) for k in range(3)}
    assert {tuple(r) for r in P.counts_in_polygons(points, polygons).collect()} == {(k, 40) for k in range(3)}
    assert {r["id"] for r in P.in_any(points, polygons).where("inside").collect()} == set(range(40))
    assert P.in_any(points, polygons).count() == 42
