"""Registered queries on a catalog that is derived from ``events``: DataFrame or SQL jobs, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.operators import catalog as C

#: The catalog view in both dialects: magnitudes on 0.1 bins from 4.05, places and depths from ids, years from times.
CAT = """SELECT event_id AS id, event_type AS cls,
  cast(4.05e0 + floor(value / 11.5e0) / 10e0 AS double) AS mag,
  cast(-76e0 + ((user_id * 7919) % 1000) / 100e0 AS double) AS lon,
  cast(-56e0 + ((user_id * 104729) % 3800) / 100e0 AS double) AS lat,
  cast(((event_id * 37) % 700) / 10e0 AS double) AS depth,
  {epoch} AS t,
  cast(1900 + ({epoch} - 1704067200.0) / 86400 / 30 * 124 AS double) AS yr
FROM {events}"""
STEPS = [(4.0, 1990.0), (4.5, 1965.0), (5.5, 1930.0), (6.5, 1900.0)]
WINDOWS = [(1900.0, 1930.0), (1930.0, 1965.0), (1960.0, 1990.0), (1990.0, 2100.0)]
POLYGON = [(-75.0, -50.0), (-68.0, -52.0), (-66.5, -30.0), (-71.0, -20.0), (-74.0, -35.0)]


def load_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(CAT.replace("{epoch}", "cast(unix_micros(cast(ts AS timestamp)) / 1e6 AS double)"), events=events)


DUCK_CAT = "cat AS (" + CAT.replace("{epoch}", "cast(epoch_us(ts) / 1e6 AS double)").replace("{events}", "events") + ")"
STEP_ROWS = ", ".join(f"(cast({a} AS double), cast({b} AS double))" for a, b in STEPS)
START = "CASE " + " ".join(f"WHEN mag + 1e-9 >= {a} THEN cast({b} AS double)" for a, b in reversed(STEPS)) + " END"

#: Bodies that both engines read alike; {cat} is the catalog.
SHARED: dict[str, str] = {
    "p01_filter": "SELECT id, cls, mag, lon, lat FROM {cat} WHERE lon BETWEEN -74 AND -68 AND lat BETWEEN -50 AND -20 AND mag >= 4.5 AND yr >= 1910",
    "p10_complete_or_unknown": f"SELECT id, mag, {START} AS start_year FROM {{cat}} WHERE {START} IS NULL OR yr >= {START}",
    "p14_depth_regime": "SELECT id, CASE WHEN depth < 50 THEN 7.5e0 WHEN depth < 90 THEN 10e0 ELSE 15e0 END AS half_thickness FROM {cat}",
    "a01_counts_by_class_and_decade": "SELECT cls, cast(floor(yr / 10) AS bigint) AS decade, count(*) AS n FROM {cat} GROUP BY GROUPING SETS ((), (cls), (cast(floor(yr / 10) AS bigint)), (cls, cast(floor(yr / 10) AS bigint)))",
    "a02_rollup_summary": "SELECT cls, count(*) AS n, cast(sum(CASE WHEN mag >= 5 THEN 1 ELSE 0 END) AS bigint) AS large, max(mag) AS max_mag FROM {cat} GROUP BY ROLLUP (cls)",
    "a03_histogram": "SELECT cls, cast(least(floor((mag - 4.0) / 0.2 + 1e-6), 24) AS bigint) AS bin, count(*) AS n FROM {cat} GROUP BY 1, 2",
    "a05_sum_per_place": "SELECT lon, lat, count(*) AS n, round(sum(mag), 6) AS sum_mag FROM {cat} GROUP BY lon, lat",
    "a06_weighted_depth": "SELECT lon, lat, round(sum(mag * depth) / sum(mag), 6) AS mean_depth FROM {cat} GROUP BY lon, lat",
    "a07_best_record": "SELECT cls, id, mag FROM (SELECT *, row_number() OVER (PARTITION BY cls, lon, lat ORDER BY mag DESC, t DESC, id) AS k FROM {cat}) x WHERE k = 1",
    "a19_fingerprint": "SELECT count(*) AS n, min(mag) AS min_mag, max(mag) AS max_mag, cast(sum(id) AS bigint) AS sum_id, count(DISTINCT cls) AS classes FROM {cat}",
    "a22_top_three": "SELECT cls, id, mag, cast(k AS bigint) AS k FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY mag DESC, id) AS k FROM {cat}) x WHERE k <= 3",
    "w01_reverse_cumulative": "SELECT cls, bin, cast(sum(n) OVER (PARTITION BY cls ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS n_above FROM (SELECT cls, cast(floor((mag - 4.0) * 10 + 1e-6) AS bigint) AS bin, count(*) AS n FROM {cat} GROUP BY 1, 2) x",
    "w02_clamped_completeness": "SELECT cls, decade, min(low) OVER (PARTITION BY cls ORDER BY decade ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mc FROM (SELECT cls, cast(floor(yr / 10) AS bigint) AS decade, min(mag) AS low FROM {cat} GROUP BY 1, 2) x",
    "w09_rate_rise": "SELECT cls, decade, n, n - lag(n) OVER (PARTITION BY cls ORDER BY decade) AS rise FROM (SELECT cls, cast(floor(yr / 10) AS bigint) AS decade, count(*) AS n FROM {cat} GROUP BY 1, 2) x",
    "w10_band_top": f"SELECT mc, lead(mc, 1) OVER (ORDER BY mc) AS top, n FROM (SELECT mc, count(*) AS n FROM {{cat}} JOIN (SELECT * FROM (VALUES {STEP_ROWS}) AS s(mc, y0)) s ON mag + 1e-9 >= mc AND yr >= y0 GROUP BY mc) x",
    "c01_maximum_curvature": "SELECT cls, round(4.25 + bin / 10e0, 6) AS mc FROM (SELECT cls, bin, row_number() OVER (PARTITION BY cls ORDER BY n DESC, bin) AS k, sum(n) OVER (PARTITION BY cls) AS total FROM (SELECT cls, cast(floor((mag - 4.0) * 10 + 1e-6) AS bigint) AS bin, count(*) AS n FROM {cat} GROUP BY 1, 2) y) x WHERE k = 1 AND total >= 30",
    "r01_b_value": "SELECT cls, count(*) AS n, round(0.4342944819032518e0 / (avg(mag) - 4.0e0), 6) AS b, round(0.4342944819032518e0 / (avg(mag) - 4.0e0) / sqrt(count(*)), 6) AS sigma FROM {cat} GROUP BY cls",
    "r10_least_squares": "SELECT cls, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM (SELECT cls, cast(floor((mag - 4.0) * 10 + 1e-6) AS bigint) AS bin, 4.05e0 + floor((mag - 4.0) * 10 + 1e-6) / 10e0 AS x, log10(count(*)) AS y FROM {cat} GROUP BY 1, 2, 3) z GROUP BY cls",
    "m01_event_weight": f"SELECT id, CASE WHEN yr >= {START} THEN round(1 / (2025 - {START}), 9) ELSE 0e0 END AS weight FROM {{cat}}",
    "m06_truncated_rates": "SELECT cls, k, round(n * greatest(power(10e0, -0.1e0 * k) - power(10e0, -0.1e0 * (k + 1)), 0e0), 6) AS rate FROM (SELECT cls, count(*) AS n FROM {cat} GROUP BY cls) x CROSS JOIN (SELECT DISTINCT cast(floor((mag - 4.0) * 10 + 1e-6) AS bigint) AS k FROM {cat}) b",
    "m08_superposition": "SELECT cls, lon, lat, round(n / cast(sum(n) OVER (PARTITION BY lon, lat) AS double), 6) AS share FROM (SELECT cls, lon, lat, count(*) AS n FROM {cat} GROUP BY 1, 2, 3) x",
    "j22_only_small": "SELECT DISTINCT lon, lat FROM {cat} a WHERE NOT EXISTS (SELECT 1 FROM {cat} b WHERE b.lon = a.lon AND b.lat = a.lat AND b.mag >= 6.5)",
    "u02_common_places": "SELECT lon, lat FROM {cat} WHERE cls = 'view' INTERSECT SELECT lon, lat FROM {cat} WHERE cls = 'click'",
}


def _shared(body: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(body, cat=load_catalog(spark, sf_dir))


def j02_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.band_pairs(load_catalog(spark, sf_dir), 120.0, 600.0, 0.801, ordered=True).select("a_id", "b_id", F.round("km", 6).alias("km"))


def j03_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_clusters(load_catalog(spark, sf_dir), 120.0, 600.0, 0.801)


def j04_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = load_catalog(spark, sf_dir)
    found = C.nearest_match(cat.where("cls = 'view'"), cat.where("cls <> 'view'"), 60.0, 0.8)
    return found.select("id", "match", F.round("dt", 6).alias("dt"), "km")


def j08_inside_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_catalog(spark, sf_dir).select("id", C.inside_polygon(F.col("lon"), F.col("lat"), POLYGON).alias("inside"))


def j11_last_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_catalog(spark, sf_dir).select("id", C.last_window(F.col("yr"), WINDOWS).cast("long").alias("window_index"))


def g03_decluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = load_catalog(spark, sf_dir).withColumn("t", F.col("t") / 86400 * 1500)
    return C.decluster(cat)


METHODS = {"gk74": ("gk74", 0.5), "gk74_sym": ("gk74", 1.0), "uhrhammer": ("uhrhammer", 0.5), "gruenthal": ("gruenthal", 0.5)}


def g05_decluster_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's sizes, and the large events that it removes."""
    cat = load_catalog(spark, sf_dir).withColumn("t", F.col("t") / 86400 * 1500)
    return C.decluster_variants(cat, METHODS, keep=[7, 77], large=8.0)[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _shared(v) for k, v in SHARED.items()} | {
    f.__name__: f for f in (j02_band_join, j03_duplicate_clusters, j04_nearest_match, j08_inside_polygon, j11_last_window, g03_decluster, g05_decluster_variants)
}

KM = "2 * 6371.0 * asin(sqrt(least(greatest(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 0.0), 1.0)))"
EDGES = [(p, q) for p, q in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True) if p[1] != q[1]]
CROSSED = " + ".join(
    f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < cast({x2 - x1} AS double) * (lat - ({y1})) / cast({y2 - y1} AS double) + ({x1}) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in EDGES
)
ORACLES: dict[str, str] = {k: f"WITH {DUCK_CAT} {v.replace('{cat}', 'cat')}" for k, v in SHARED.items()} | {
    "j02_band_join": f"WITH {DUCK_CAT} SELECT a.id AS a_id, b.id AS b_id, round({KM}, 6) AS km FROM cat a JOIN cat b ON b.t - a.t BETWEEN 0 AND 120 AND (b.t > a.t OR b.id > a.id) AND abs(a.mag - b.mag) <= 0.801 WHERE {KM} <= 600",
    "j04_nearest_match": f"""WITH {DUCK_CAT}, p AS (SELECT a.id, b.id AS match, abs(a.t - b.t) AS dt, round({KM}, 6) AS km,
      row_number() OVER (PARTITION BY a.id ORDER BY abs(a.t - b.t), round(abs(a.mag - b.mag), 6), round({KM}, 6), b.id) AS k
      FROM cat a JOIN cat b ON a.cls = 'view' AND b.cls <> 'view' AND abs(a.t - b.t) <= 60 AND abs(a.mag - b.mag) <= 0.8 + 1e-9)
      SELECT c.id, match, round(dt, 6) AS dt, km FROM (SELECT id FROM cat WHERE cls = 'view') c LEFT JOIN (SELECT * FROM p WHERE k = 1) p USING (id)""",
    "j08_inside_polygon": f"WITH {DUCK_CAT} SELECT id, ({CROSSED}) % 2 = 1 AS inside FROM cat",
    "j11_last_window": f"WITH {DUCK_CAT} SELECT id, cast(CASE " + " ".join(f"WHEN yr >= {a} AND yr < {b} THEN {i}" for i, (a, b) in reversed(list(enumerate(WINDOWS)))) + " ELSE -1 END AS bigint) AS window_index FROM cat",
}
