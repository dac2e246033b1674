"""Registered queries of grids and geometry, as DataFrame jobs; their SQL for DuckDB is written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.jobs.seismic import DUCK_CAT, KM, POLYGON, load_catalog
from quakespark.operators import catalog as C
from quakespark.operators import grids as G

BOX = (-77.0, -57.0, -65.0, -17.0)
SOUTH = [(-76.5, -56.5), (-65.5, -56.5), (-65.5, -40.0), (-76.5, -40.0)]
EMPTY = [(10.0, 10.0), (11.0, 10.0), (11.0, 11.0)]


def a16_quadtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load_catalog(spark, sf_dir).select("lon", "lat", F.col("mag").alias("value"))
    return G.quadtree(points, BOX, 400, 5).select("path", "depth", "xmin", "ymin", "xmax", "ymax", "n", F.round("log_total", 6).alias("log_total"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of nodes beside the places of every third user."""
    cat = load_catalog(spark, sf_dir).where("id % 3 = 0")
    places = cat.groupBy(F.round(F.col("lon") + 0.05, 2).alias("lon"), F.round(F.col("lat") - 0.04, 2).alias("lat")).agg(F.min("id").alias("node"), F.min("depth").alias("depth"))
    return places.select("node", "lon", "lat", "depth")


DUCK_NODES = f"""{DUCK_CAT}, node AS (SELECT round(lon + 0.05, 2) AS lon, round(lat - 0.04, 2) AS lat, min(id) AS node, min(depth) AS depth
  FROM cat WHERE id % 3 = 0 GROUP BY ALL)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a place, with errors of its place; some have none."""
    held = load_catalog(spark, sf_dir).groupBy("lon", "lat").agg(F.min("id").alias("id"))
    return held.select("id", "lon", "lat", F.when(F.col("id") % 5 != 0, F.pmod("id", F.lit(4)) / 4).alias("lon_error"), (F.pmod("id", F.lit(3)) / 2).alias("lat_error"))


DUCK_PLACES = "place AS (SELECT min(id) AS id, lon, lat, CASE WHEN min(id) % 5 <> 0 THEN min(id) % 4 / 4 END AS lon_error, min(id) % 3 / 2 AS lat_error FROM cat GROUP BY lon, lat)"


def j07_nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nearest_node(places(spark, sf_dir), nodes(spark, sf_dir), 15.0).select("id", "node", "depth", F.round("km", 6).alias("km"))


def j10_depth_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = places(spark, sf_dir)
    grid = nodes(spark, sf_dir)
    return G.depth_range(held, grid, G.nearest_node(held, grid, 15.0))


def mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with tensors and planes, with gaps and stand-ins, from their ids."""
    c = F.col("id")
    tensor = [F.when(c % (7 + k) != 0, (c % (13 + k)).cast("double")).alias(n) for k, n in enumerate(G.TENSOR)]
    planes = [F.when(c % 4 == 1, F.lit(v)).otherwise(F.when(c % (9 + k) != 0, (c % 90).cast("double"))).alias(n) for k, (n, v) in enumerate(zip(G.PLANES, G.DEFAULT_PLANES, strict=True))]
    return load_catalog(spark, sf_dir).select("id", "cls", *tensor, *planes)


DUCK_MECH = f"{DUCK_CAT}, mech AS (SELECT id, cls, " + ", ".join(
    [f"CASE WHEN id % {7 + k} <> 0 THEN (id % {13 + k})::DOUBLE END AS {n}" for k, n in enumerate(G.TENSOR)]
    + [f"CASE WHEN id % 4 = 1 THEN {v}::DOUBLE WHEN id % {9 + k} <> 0 THEN (id % 90)::DOUBLE END AS {n}" for k, (n, v) in enumerate(zip(G.PLANES, G.DEFAULT_PLANES, strict=True))]
) + " FROM cat)"
FIELDS = (*G.TENSOR, *G.PLANES)


def j05_fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each even id takes what it lacks from the id after it."""
    held = mechanisms(spark, sf_dir)
    matches = held.where("id % 2 = 1").select((F.col("id") - 1).alias("id"), *FIELDS)
    return G.fill_gaps(held.where("id % 2 = 0").drop("cls"), matches)


def a23_mechanism_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = mechanisms(spark, sf_dir)
    return held.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count(F.coalesce(*FIELDS)).alias("n_any"), F.count(F.when(G.is_default_mechanism(), 1)).alias("n_default"))


def a15_polygon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in each polygon, with zero for an empty one: counted in one pass, then one row each."""
    shapes = {"coast": POLYGON, "south": SOUTH, "empty": EMPTY}
    inside = [F.count(F.when(C.inside_polygon(F.col("lon"), F.col("lat"), p), 1)).alias(n) for n, p in shapes.items()]
    return load_catalog(spark, sf_dir).agg(*inside).unpivot([], list(shapes), "polygon", "n")


def a10_summed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = load_catalog(spark, sf_dir).groupBy(F.col("cls").alias("source"), F.floor((F.col("mag") - 4) * 4 + 1e-6).alias("bin")).agg((F.count(F.lit(1)) / 124).alias("rate"))
    return G.summed_rates(bins.where("bin <> 9")).select("bin", F.round("rate", 9).alias("rate"))


def a18_pivot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = load_catalog(spark, sf_dir).select(F.floor(F.col("lat") / 10).alias("row"), F.floor("lon").alias("col"), "depth")
    return cat.groupBy("row").pivot("col", [-75, -72, -69]).agg(F.max("depth")).toDF("row", "c1", "c2", "c3")


def g02_method_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = load_catalog(spark, sf_dir)
    columns = {f"{m}_{n}": F.round(w, 6) for m in ("uhrhammer", "gruenthal", "gk74") for n, w in zip(("km", "days"), G.method_windows(F.col("mag"), m), strict=True)}
    return cat.select("id", *(w.alias(n) for n, w in columns.items()))


def f04_triangle_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, moved = F.col, lambda x, y, z: (F.col("lon") + x, F.col("lat") + y, F.col("depth") + z)
    cat = load_catalog(spark, sf_dir)
    return cat.select("id", F.round(G.triangle_km2([(c("lon"), c("lat"), c("depth")), moved(0.5, 0.0, 3.0), moved(0.1, 0.7, 9.0)]), 4).alias("km2"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        a16_quadtree, j07_nearest_node, j10_depth_range, j05_fill_gaps, a23_mechanism_count, a15_polygon_counts, a10_summed_rates, a18_pivot_grid,
        g02_method_windows, f04_triangle_area,
    )
}


def _inside(polygon: list[tuple[float, float]]) -> str:
    sides = [(p, q) for p, q in zip(polygon, polygon[1:] + polygon[:1], strict=True) if p[1] != q[1]]
    return "(" + " + ".join(f"((({y1} > lat) <> ({y2} > lat)) AND lon < ({x2} - ({x1})) * (lat - ({y1})) / ({y2} - ({y1})) + ({x1}))::INT" for (x1, y1), (x2, y2) in sides) + ") % 2 = 1"


NEAR = f"""near AS (SELECT id, node, depth, km FROM (SELECT a.id, b.node, b.depth, {KM} AS km, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2), b.node) AS k
  FROM place a, node b) WHERE k = 1 AND km <= 15)"""
PLANE_SAME = lambda p: " AND ".join(f"abs({f'({p}{n} % 360 + 360) % 360' if n.startswith('strike') else p + n} - {v}) <= 1e-6" for n, v in zip(G.PLANES, G.DEFAULT_PLANES, strict=True))
HAS = lambda names: " AND ".join(f"m.{n} IS NOT NULL" for n in names)
XYZ = "[(6371.0 - ({z})) * cos(radians({y})) * cos(radians({x})), (6371.0 - ({z})) * cos(radians({y})) * sin(radians({x})), (6371.0 - ({z})) * sin(radians({y}))]"
ORACLES: dict[str, str] = {
    "a16_quadtree": f"""WITH RECURSIVE {DUCK_CAT}, pts AS (SELECT lon, lat, mag FROM cat), q AS (
      SELECT '' AS path, 0 AS depth, {BOX[0]}::DOUBLE AS xmin, {BOX[1]}::DOUBLE AS ymin, {BOX[2]}::DOUBLE AS xmax, {BOX[3]}::DOUBLE AS ymax, (SELECT count(*) FROM pts) AS n
      UNION ALL SELECT path || d, depth + 1, x0, y0, x1, y1, (SELECT count(*) FROM pts WHERE lon > x0 AND lon <= x1 AND lat > y0 AND lat <= y1) FROM (
        SELECT path, depth, d, CASE WHEN d % 2 = 1 THEN (xmin + xmax) / 2 ELSE xmin END AS x0, CASE WHEN d < 2 THEN (ymin + ymax) / 2 ELSE ymin END AS y0,
          CASE WHEN d % 2 = 1 THEN xmax ELSE (xmin + xmax) / 2 END AS x1, CASE WHEN d < 2 THEN ymax ELSE (ymin + ymax) / 2 END AS y1
        FROM q, range(4) r(d) WHERE n > 400 AND depth < 5))
      SELECT path, depth::BIGINT AS depth, xmin, ymin, xmax, ymax, n, round(log10(coalesce((SELECT sum(mag) FROM pts WHERE lon > xmin AND lon <= xmax AND lat > ymin AND lat <= ymax), 0) + 1), 6) AS log_total
      FROM q WHERE NOT (n > 400 AND depth < 5)""",
    "j07_nearest_node": f"WITH {DUCK_NODES}, {DUCK_PLACES}, {NEAR} SELECT id, node, depth, round(km, 6) AS km FROM place LEFT JOIN near USING (id)",
    "j10_depth_range": f"""WITH {DUCK_NODES}, {DUCK_PLACES}, {NEAR}, e AS (SELECT p.id, min(n.depth) AS low, max(n.depth) AS high FROM place p JOIN node n
      ON pow((n.lon - p.lon) / greatest(lon_error, 1e-12), 2) + pow((n.lat - p.lat) / greatest(lat_error, 1e-12), 2) <= 1 WHERE lon_error IS NOT NULL AND greatest(lon_error, lat_error) > 0 GROUP BY p.id)
      SELECT p.id, coalesce(low, depth) AS low, coalesce(high, depth) AS high FROM place p LEFT JOIN e USING (id) LEFT JOIN near USING (id)""",
    "j05_fill_gaps": f"WITH {DUCK_MECH} SELECT a.id, "
    + ", ".join([f"coalesce(a.{n}, CASE WHEN {HAS(G.TENSOR)} THEN m.{n} END) AS {n}" for n in G.TENSOR] + [f"coalesce(a.{n}, CASE WHEN {HAS(G.PLANES)} AND NOT ({PLANE_SAME('m.')}) THEN m.{n} END) AS {n}" for n in G.PLANES])
    + " FROM mech a LEFT JOIN mech m ON m.id = a.id + 1 WHERE a.id % 2 = 0",
    "a23_mechanism_count": f"WITH {DUCK_MECH} SELECT cls, count(*) AS n, count(*) FILTER (WHERE " + " OR ".join(f"{n} IS NOT NULL" for n in FIELDS) + f") AS n_any, count(*) FILTER (WHERE {PLANE_SAME('')}) AS n_default FROM mech GROUP BY cls",
    "a15_polygon_counts": f"WITH {DUCK_CAT} " + " UNION ALL ".join(f"SELECT '{n}' AS polygon, (SELECT count(*) FROM cat WHERE {_inside(p)}) AS n" for n, p in (("coast", POLYGON), ("south", SOUTH), ("empty", EMPTY))),
    "a10_summed_rates": f"""WITH {DUCK_CAT}, b AS (SELECT floor((mag - 4) * 4 + 1e-6)::BIGINT AS bin FROM cat), k AS (SELECT bin FROM b WHERE bin <> 9)
      SELECT bin, round((SELECT count(*) FROM k WHERE k.bin = s.bin) / 124, 9) AS rate FROM (SELECT unnest(range((SELECT min(bin) FROM k), (SELECT max(bin) FROM k) + 1)) AS bin) s""",
    "a18_pivot_grid": f"""WITH {DUCK_CAT} SELECT floor(lat / 10)::BIGINT AS row, max(depth) FILTER (WHERE floor(lon) = -75) AS c1, max(depth) FILTER (WHERE floor(lon) = -72) AS c2,
      max(depth) FILTER (WHERE floor(lon) = -69) AS c3 FROM cat GROUP BY ALL""",
    "g02_method_windows": f"""WITH {DUCK_CAT} SELECT id, round(exp(0.804 * mag - 1.024), 6) AS uhrhammer_km, round(exp(1.235 * mag - 2.87), 6) AS uhrhammer_days,
      round(exp(1.77 + sqrt(1.02 * mag + 0.037)), 6) AS gruenthal_km, round(CASE WHEN mag >= 6.5 THEN pow(10, 0.024 * mag + 2.8) ELSE exp(sqrt(17.32 * mag + 0.62) - 3.95) END, 6) AS gruenthal_days,
      round(pow(10, 0.1238 * mag + 0.983), 6) AS gk74_km, round(pow(10, CASE WHEN mag >= 6.5 THEN 0.032 * mag + 2.7389 ELSE 0.5409 * mag - 0.547 END), 6) AS gk74_days FROM cat""",
    "f04_triangle_area": f"""WITH {DUCK_CAT}, p AS (SELECT id, {XYZ.format(x='lon', y='lat', z='depth')} AS a, {XYZ.format(x='lon + 0.5', y='lat', z='depth + 3')} AS b, {XYZ.format(x='lon + 0.1', y='lat + 0.7', z='depth + 9')} AS c FROM cat),
      s AS (SELECT id, list_distance(a, b) AS p, list_distance(b, c) AS q, list_distance(c, a) AS r FROM p)
      SELECT id, round(sqrt((p + q + r) * (q + r - p) * (p + r - q) * (p + q - r)) / 4, 4) AS km2 FROM s""",
}
