"""Registered queries: completeness, recurrence fits, smoothing, moment balance, classification, hazard curves.

They read the catalog of ``seismic`` and curves and faults that are derived from ``supplier``. {cat} is the
catalog, {supplier} the suppliers, {each:N} one row for each of 0 to N - 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark.functions import columns as K
from quakespark.functions import mechanism
from quakespark.jobs.seismic import DUCK_CAT, START, STEP_ROWS, load_catalog
from quakespark.operators import hazard, rates, smoothing

LOG10E = "0.4342944819032518e0"
STEP_TABLE = f"(SELECT * FROM (VALUES {STEP_ROWS}) AS s(mc, y0))"
#: Events at or above their magnitude's year of completeness, with that year.
COMPLETE = f"(SELECT * FROM (SELECT *, {START} AS y0 FROM {{cat}}) z WHERE yr >= y0)"
BINS = f"(SELECT cls, round(mag, 2) AS m, count(*) AS n, 2025 - max(y0) AS t FROM {COMPLETE} c GROUP BY cls, round(mag, 2))"
DECADES = "(SELECT cls, cast(floor(yr / 10) AS bigint) AS decade, count(*) AS n, min(mag) AS low FROM {cat} GROUP BY 1, 2)"
PLACES = "(SELECT lon, lat, count(*) AS n, sum(mag * depth) / sum(mag) AS depth FROM {cat} GROUP BY lon, lat)"
#: 25 branches, 25 levels from 0.0005 to 3 for each supplier as a site.
CURVES = """(SELECT site, branch, (branch + 1) / 325e0 AS weight, level, 0.0005e0 * power(6000e0, level / 24e0) AS iml,
  1 - exp(-0.001e0 * (1 + site % 7) * power(0.0005e0 * power(6000e0, level / 24e0), -(0.8e0 + 0.01e0 * branch))) AS poe
  FROM (SELECT site, branch, {each:25} AS level FROM (SELECT s_suppkey AS site, {each:25} AS branch FROM {supplier}) x) y)"""
#: Length and lower depth in km, dip, slip rate in m a year; the moment rate follows.
FAULTS = """(SELECT id, length, dip, lower, slip, m_max, 3e10 * length * 1e3 * (lower * 1e3 / sin(radians(dip))) * slip AS moment_rate
  FROM (SELECT s_suppkey AS id, 20e0 + s_suppkey % 50 AS length, 40e0 + s_suppkey % 45 AS dip, 10e0 + s_suppkey % 11 AS lower, (1 + s_suppkey % 9) / 1e3 AS slip, 6.5e0 + (s_suppkey % 12) / 10e0 AS m_max FROM {supplier}) f)"""
NEWEST = "CASE WHEN s.y1 IS NULL THEN 2025 ELSE s.y1 END"
PERIODS = "(SELECT mc, y0, lag(y0) OVER (ORDER BY mc) AS y1 FROM " + STEP_TABLE + " s0)"

SHARED: dict[str, str] = {
    "p03_segments": "SELECT id, CASE WHEN lat < -45 THEN 'south' WHEN lat < -30 THEN 'middle' ELSE 'north' END AS segment FROM {cat} WHERE depth BETWEEN 5 AND 50",
    "p07_class_collapse": "SELECT CASE WHEN cls IN ('view', 'click') THEN 'shallow' WHEN cls = 'error' THEN 'deep' ELSE 'other' END AS final, count(*) AS n FROM {cat} GROUP BY 1",
    "p08_upsert": "SELECT id, mag FROM {cat} WHERE cls <> 'click' UNION ALL SELECT id, round(mag + 0.1, 2) AS mag FROM {cat} WHERE cls = 'click'",
    "p12_cap_rates": "SELECT lon, lat, bin, CASE WHEN lon < -70 AND 4 + bin * 0.5e0 >= 6 - 1e-6 THEN 0 ELSE n END AS n, lon < -70 AS in_buffer FROM (SELECT lon, lat, cast(floor((mag - 4) * 2 + 1e-6) AS bigint) AS bin, count(*) AS n FROM {cat} GROUP BY 1, 2, 3) x",
    "p13_wide_bins": "SELECT lon, lat, " + ", ".join(f"cast(sum(CASE WHEN mag >= {4 + k} AND mag < {5 + k} THEN 1 ELSE 0 END) AS bigint) AS rate_m{4 + k}" for k in range(4)) + " FROM {cat} GROUP BY lon, lat",
    "p15_trim_bins": "SELECT cls, bin, n FROM (SELECT *, max(CASE WHEN n > 1 THEN bin END) OVER (PARTITION BY cls) AS top FROM (SELECT cls, cast(floor((mag - 4) * 5 + 1e-6) AS bigint) AS bin, count(*) AS n FROM {cat} GROUP BY 1, 2) y) x WHERE bin <= top",
    "a04_density_histogram": "SELECT cls, cast(least(floor((depth - low) / (high - low) * 20), 19) AS bigint) AS bin, round(count(*) / (max(total) * max((high - low) / 20)), 9) AS density FROM (SELECT cls, depth, min(depth) OVER (PARTITION BY cls) AS low, max(depth) OVER (PARTITION BY cls) AS high, count(*) OVER (PARTITION BY cls) AS total FROM {cat}) x GROUP BY 1, 2",
    "a08_first_complete_year": f"SELECT mc, min(y0) AS y0 FROM (SELECT mag, {START} AS y0, cast(floor(mag * 2) / 2 AS double) AS mc FROM {{cat}}) x GROUP BY mc",
    "a11_value_counts": "SELECT round(depth, 0) AS depth, count(*) AS n FROM {cat} GROUP BY 1",
    "a12_plane_collapse": "SELECT strike, dip, round(sum(p), 9) AS p FROM (SELECT cast(id % 36 * 10 AS bigint) AS strike, cast(30 + id % 4 * 15 AS bigint) AS dip, 1e0 / count(*) OVER () AS p FROM {cat}) x GROUP BY strike, dip",
    "a13_point_source": "SELECT lon, lat, depth FROM (SELECT lon, lat, depth, row_number() OVER (PARTITION BY lon, lat ORDER BY mag DESC, id) AS k FROM {cat}) x WHERE k = 1",
    "a14_cell_counts": "SELECT cast(floor(lon * 2) AS bigint) AS x, cast(floor(lat * 2) AS bigint) AS y, count(*) AS n FROM {cat} GROUP BY 1, 2",
    "a20_first_of_each": "SELECT lon, lat, id FROM (SELECT lon, lat, id, row_number() OVER (PARTITION BY lon, lat ORDER BY t, id) AS k FROM {cat}) x WHERE k = 1",
    "a21_changed_fields": "SELECT count(*) AS n, cast(sum(CASE WHEN a.mag <> b.mag THEN 1 ELSE 0 END) AS bigint) AS mags FROM {cat} a JOIN (SELECT id, round(mag * 2, 0) / 2 AS mag FROM {cat}) b ON a.id = b.id",
    "a24_moment_by_region": "SELECT cls, floor(lat / 10) AS band, count(*) AS n, round(log10(sum(power(10e0, 1.5e0 * mag + 9.1e0))), 6) AS log_moment FROM {cat} GROUP BY 1, 2",
    "j06_relocate": "SELECT a.id, coalesce(b.depth, a.depth) AS depth, CASE WHEN b.id IS NOT NULL THEN 'relocated' WHEN abs(a.depth - 33) < 1e-6 THEN 'default' END AS flag FROM {cat} a LEFT JOIN (SELECT id, round(depth, 0) AS depth FROM {cat} WHERE mag >= 5.5) b ON a.id = b.id",
    "j12_step_lookup": f"SELECT id, {START} AS y0, 2025 - {START} AS years FROM {{cat}}",
    "j21_cluster_review": "SELECT a.id, b.id AS main, round(b.mag - a.mag, 6) AS drop_mag FROM {cat} a JOIN (SELECT lon, lat, id, mag FROM (SELECT *, row_number() OVER (PARTITION BY lon, lat ORDER BY mag DESC, t, id) AS k FROM {cat}) x WHERE k = 1) b ON a.lon = b.lon AND a.lat = b.lat WHERE a.id <> b.id",
    "x01_classify": "SELECT id, CASE WHEN lon BETWEEN -70 AND -69 THEN 'intraarc' WHEN lon < -75 THEN 'outer_rise' WHEN lon > -67.5 THEN 'backarc' WHEN slab < 50 THEN CASE WHEN depth > slab + 11 THEN 'intraslab' WHEN depth < slab - 11 THEN 'forearc' ELSE 'interface' END WHEN depth < slab - 15 THEN 'crustal_deep' ELSE 'slab_deep' END AS class FROM (SELECT *, 10 + (lon + 76) * 9e0 AS slab FROM {cat}) x",
    "x02_merge_records": "SELECT lon, lat, max(CASE WHEN kb = 1 THEN id END) AS base, max(CASE WHEN kd = 1 THEN depth END) AS depth, max(CASE WHEN km = 1 THEN mag END) AS mag FROM (SELECT *, row_number() OVER (PARTITION BY lon, lat ORDER BY cls, id) AS kb, row_number() OVER (PARTITION BY lon, lat ORDER BY CASE WHEN depth = 33 THEN 1 ELSE 0 END, cls, id) AS kd, row_number() OVER (PARTITION BY lon, lat ORDER BY CASE WHEN mag >= 5 THEN 0 ELSE 1 END, cls DESC, id) AS km FROM {cat}) x GROUP BY lon, lat",
    "w03_max_from_present": f"SELECT cls, decade, max(low) OVER (PARTITION BY cls ORDER BY decade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM {DECADES} x",
    "w07_duplicate_labels": "SELECT id, concat(cast(dense_rank() OVER (ORDER BY lon, lat) AS string), '_', cls, CASE WHEN row_number() OVER (PARTITION BY lon, lat, cls ORDER BY t, id) > 1 THEN concat('-', cast(row_number() OVER (PARTITION BY lon, lat, cls ORDER BY t, id) AS string)) ELSE '' END) AS label FROM {cat}",
    "w11_grid_spacing": "SELECT round(min(step), 6) AS least, round(median(step), 6) AS middle FROM (SELECT lon - lag(lon) OVER (ORDER BY lon) AS step FROM (SELECT DISTINCT lon FROM {cat}) y) x",
    "w12_ten_year_bins": "SELECT decade, mag_bin, n, cast(sum(n) OVER (PARTITION BY mag_bin ORDER BY decade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS n_to_present FROM (SELECT cast(floor((yr - 1905) / 10) AS bigint) AS decade, floor(mag * 2) / 2 AS mag_bin, count(*) AS n FROM {cat} GROUP BY 1, 2) x",
    "w14_densest_places": f"SELECT lon, lat, n FROM (SELECT *, sum(n) OVER (ORDER BY n DESC, lon, lat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before, sum(n) OVER () AS total FROM {PLACES} x) y WHERE before < 0.5 * total",
    "w15_candidates": f"SELECT s.mc, min(x.decade) AS decade FROM {STEP_TABLE} s JOIN {DECADES} x ON x.low <= s.mc + 0.1 GROUP BY s.mc",
    "c04_floor_of_small_windows": f"SELECT cls, decade, CASE WHEN n < 50 THEN 7.5e0 ELSE low END AS mc FROM {DECADES} x",
    "c05_usable_windows": f"SELECT cls, mc, n, n >= 20 AS usable FROM (SELECT cls, mc, count(*) AS n FROM {{cat}} JOIN (SELECT greatest(mc, 4.3e0) AS mc, coalesce(lead(mc) OVER (ORDER BY mc), 99) AS top FROM {STEP_TABLE} s0) s ON mag >= s.mc AND mag < s.top WHERE s.top > 4.3 + 1e-9 GROUP BY cls, mc) x",
    "c06_complete_subset": f"SELECT id, mag, yr - y0 AS years_complete FROM {COMPLETE} x",
    "r02_disjoint_periods": f"SELECT cls, sum(n) AS n, round({LOG10E} * (sum(n) / sum(n / beta)), 6) AS b FROM (SELECT cls, s.mc, count(*) AS n, 1 / (avg(mag) - s.mc) AS beta FROM {{cat}} JOIN {PERIODS} s ON yr >= s.y0 AND yr < {NEWEST} AND mag >= s.mc GROUP BY cls, s.mc HAVING count(*) >= 5) x GROUP BY cls",
    "r03_nested_levels": f"SELECT cls, sum(n) AS n, round({LOG10E} * (sum(n) / sum(n / beta)), 6) AS b FROM (SELECT cls, s.mc, count(*) AS n, 1 / (avg(mag) - s.mc) AS beta FROM {{cat}} JOIN {STEP_TABLE} s ON yr >= s.y0 AND mag >= s.mc GROUP BY cls, s.mc HAVING count(*) >= 5) x GROUP BY cls",
    "r08_observed_rates": f"SELECT cls, m, round(sum(n / t) OVER (PARTITION BY cls ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS rate FROM {BINS} x",
    "r09_stability": f"SELECT x.cls, x.low, sum(y.n) AS n, round({LOG10E} / (sum(y.n * y.m) / sum(y.n) - (x.low - 0.05e0)), 6) AS b FROM (SELECT DISTINCT cls, m AS low FROM {BINS} a WHERE m < 5.5) x JOIN {BINS} y ON y.cls = x.cls AND y.m >= x.low - 1e-9 GROUP BY x.cls, x.low",
    "r12_pooled_b": f"SELECT donor, count(*) AS n, round({LOG10E} / (avg(mag) - 4.0e0), 6) AS b FROM (SELECT CASE WHEN cls IN ('view', 'click') THEN 'pool' ELSE cls END AS donor, mag FROM {{cat}}) x GROUP BY donor",
    "m02_stamped_weight": f"SELECT id, round(power(10e0, 0.9e0 * (4.05e0 + floor((mag - 4.05) * 2) / 2 - 4.05e0)) / (2025 - y0), 9) AS weight FROM {COMPLETE} x",
    "m11_moment_integral": "SELECT cls, round(log10(0.9e0 / 0.6e0 * power(10e0, log10(count(*)) + 9.1e0) * (power(10e0, 0.6e0 * max(mag)) - power(10e0, 0.6e0 * 4e0))), 6) AS log_rate FROM {cat} GROUP BY cls HAVING max(mag) > 4",
    "m13_m_max": "SELECT lon, lat, round(ceil(round((max(mag) + 0.2 - 4) / 0.5, 6)) * 0.5 + 4, 6) AS m_max FROM {cat} GROUP BY lon, lat",
    "m17_floor_of_models": "SELECT coalesce(a.lon, b.lon) AS lon, coalesce(a.lat, b.lat) AS lat, CASE WHEN a.n IS NULL THEN b.n WHEN b.n IS NULL THEN a.n ELSE greatest(a.n, b.n) END AS n FROM (SELECT lon, lat, count(*) AS n FROM {cat} WHERE cls = 'view' GROUP BY 1, 2) a FULL OUTER JOIN (SELECT lon, lat, count(*) AS n FROM {cat} WHERE cls = 'click' GROUP BY 1, 2) b ON a.lon = b.lon AND a.lat = b.lat",
    "m20_magnitude_pdf": "SELECT id, round(2.0e0 * exp(-2.0e0 * (mag - 4)) / (1 - exp(-2.0e0 * 5)), 9) AS pdf FROM {cat} WHERE mag BETWEEN 4 AND 9",
    "m24_ratio_of_models": "SELECT cls, " + ", ".join(f"round(sum(CASE WHEN mag >= {m} AND yr >= 1960 THEN 1e0 ELSE 0e0 END) / nullif(sum(CASE WHEN mag >= {m} THEN 1e0 ELSE 0e0 END), 0), 6) AS r{str(m).replace('.', '_')}" for m in (5.0, 5.5, 6.0)) + " FROM {cat} GROUP BY cls",
    "n16_slip_range": "SELECT id, (cast(split(span, '-')[{one}] AS double) + cast(split(span, '-')[{two}] AS double)) / 2 AS slip FROM (SELECT id, concat(cast(id % 5 AS string), '.5-', cast(5 + id % 3 AS string)) AS span FROM {cat}) x",
    "n25_cumulative_mfd": "SELECT m, n, round(sum(n) OVER (ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 125e0, 9) AS rate FROM (SELECT round(mag, 2) AS m, count(*) AS n FROM {cat} GROUP BY 1) x",
    "n15_fault_moment": f"SELECT id, round(log10(moment_rate), 9) AS log_rate, round(lower / tan(radians(dip)), 9) AS width FROM {FAULTS} f",
    "h03_envelope": f"SELECT site, level, round(min(poe), 9) AS low, round(max(poe), 9) AS high, round(sum(weight * poe) / sum(weight), 9) AS mean FROM {CURVES} c GROUP BY site, level",
    "h04_monotonic": f"SELECT site, branch, cast(sum(CASE WHEN poe > before THEN 1 ELSE 0 END) AS bigint) = 0 AS falling FROM (SELECT *, lag(poe) OVER (PARTITION BY site, branch ORDER BY level) AS before FROM {CURVES} c) x GROUP BY site, branch",
    "j20_branch_product": "SELECT b, v, round((b + 1) / 10e0 * (v + 1) / 6e0, 9) AS weight, n FROM (SELECT b, {each:3} AS v, n FROM (SELECT {each:4} AS b, n FROM (SELECT count(*) AS n FROM {cat}) a) x) y",
}


def _text(body: str, spark: bool) -> str:
    """The body in one engine's words."""
    names = {"{one}": "0" if spark else "1", "{two}": "1" if spark else "2"}
    if not spark:
        names |= {"{cat}": "cat", "{supplier}": "supplier"}
    for short, full in names.items():
        body = body.replace(short, full)
    return re.sub(r"\{each:(\d+)\}", lambda m: f"explode(sequence(0, {int(m[1]) - 1}))" if spark else f"unnest(range({m[1]}))", body)


def sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    views = {"cat": lambda: load_catalog(spark, sf_dir), "supplier": lambda: spark.read.parquet(f"{sf_dir}/supplier.parquet")}
    body = _text(body, True)
    return spark.sql(body, **{name: view() for name, view in views.items() if "{" + name + "}" in body})


def _shared(body: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql(spark, sf_dir, body)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else c for c, t in df.dtypes))


def p13_long_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = sql(spark, sf_dir, SHARED["p13_wide_bins"])
    return wide.unpivot(["lon", "lat"], None, "bin", "rate").where("rate > 0")


def w05_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT cls, decade, last(CASE WHEN n % 2 = 0 THEN n END, true) OVER (PARTITION BY cls ORDER BY decade) AS filled FROM {DECADES} x")


def a04_density_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared SQL's result; the bounds of each class are aggregated and joined, so no class is sorted in one task."""
    cat = load_catalog(spark, sf_dir).select("cls", "depth")
    bounds = cat.groupBy(F.col("cls").alias("own")).agg(F.min("depth").alias("low"), F.max("depth").alias("high"), F.count(F.lit(1)).alias("total"))
    at = F.least(F.floor((F.col("depth") - F.col("low")) / (F.col("high") - F.col("low")) * 20), F.lit(19)).cast("bigint")
    counted = cat.join(F.broadcast(bounds), F.col("cls").eqNullSafe(F.col("own"))).select("cls", at.alias("bin"), "total", ((F.col("high") - F.col("low")) / 20).alias("width"))
    return counted.groupBy("cls", "bin").agg(F.round(F.count(F.lit(1)) / (F.max("total") * F.max("width")), 9).alias("density"))


def a12_plane_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared SQL's result; events are counted by plane before their number is summed."""
    planes = load_catalog(spark, sf_dir).groupBy((F.col("id") % 36 * 10).cast("bigint").alias("strike"), (30 + F.col("id") % 4 * 15).cast("bigint").alias("dip")).agg(F.count(F.lit(1)).alias("n"))
    return planes.crossJoin(F.broadcast(planes.agg(F.sum("n").alias("total")))).select("strike", "dip", F.round(F.col("n") / F.col("total"), 9).alias("p"))


def w07_duplicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared SQL's result; a place's rank is the number of places at lesser longitudes and its rank at its own, joined back."""
    cat = load_catalog(spark, sf_dir).select("id", "cls", "lon", "lat", "t")
    places = cat.select("lon", "lat").distinct()
    lesser = Window.orderBy("lon").rowsBetween(Window.unboundedPreceding, -1)  # one row a longitude
    before = places.groupBy("lon").agg(F.count(F.lit(1)).alias("here")).select(F.col("lon").alias("lon0"), F.coalesce(F.sum("here").over(lesser), F.lit(0)).alias("before"))
    ranked = places.join(before, F.col("lon").eqNullSafe(F.col("lon0"))).select(
        F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), (F.col("before") + F.row_number().over(Window.partitionBy("lon").orderBy("lat"))).alias("rank")
    )
    k = F.row_number().over(Window.partitionBy("lon", "lat", "cls").orderBy("t", "id"))
    numbered = cat.withColumn("k", k).join(ranked, F.col("lon").eqNullSafe(F.col("lon1")) & F.col("lat").eqNullSafe(F.col("lat1")))
    suffix = F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise(F.lit(""))
    return numbered.select("id", F.concat(F.col("rank").cast("string"), F.lit("_"), "cls", suffix).alias("label"))


def w08_kth_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = load_catalog(spark, sf_dir).groupBy("lon", "lat").agg(F.min("id").alias("pid"))
    return smoothing.kth_neighbour(places, 15)


def m04_kernel_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = load_catalog(spark, sf_dir).withColumn("weight", F.lit(1.0))
    places = cat.groupBy("lon", "lat").agg(F.min("id").alias("pid"))
    radius = places.join(smoothing.kth_neighbour(places, 15), "pid").select("lon", "lat", F.greatest("d", F.lit(5.0)).alias("d"))
    x, y = F.floor("lon"), F.floor("lat")
    cells = cat.select(x.alias("x"), y.alias("y")).distinct().select((F.col("x") * 1000 + F.col("y")).alias("cell"), (F.col("x") + 0.5).alias("lon"), (F.col("y") + 0.5).alias("lat"))
    return _rounded(smoothing.kernel_field(cat.join(radius, ["lon", "lat"]), cells))


def m05_whole_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = load_catalog(spark, sf_dir).withColumn("weight", F.lit(1.0))
    places = cat.groupBy("lon", "lat").agg(F.min("id").alias("pid"))
    radius = places.join(smoothing.kth_neighbour(places, 15), "pid").select("lon", "lat", F.greatest("d", F.lit(5.0)).alias("d"))
    x, y = F.floor("lon"), F.floor("lat")
    cells = cat.select(x.alias("x"), y.alias("y")).distinct().select((F.col("x") * 1000 + F.col("y")).alias("cell"), (F.col("x") + 0.5).alias("lon"), (F.col("y") + 0.5).alias("lat"))
    return _rounded(smoothing.whole_field(cat.join(radius, ["lon", "lat"]), cells, to_one=True))


def r04_weichert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rates.weichert(sql(spark, sf_dir, f"SELECT * FROM {BINS} x"), "cls"))


def r07_bootstrap_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.bootstrap_b(sql(spark, sf_dir, "SELECT cls, round(mag, 2) AS m, count(*) AS n FROM {cat} GROUP BY 1, 2"), "cls", 4.0)


def m12_balanced_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rates.balanced_rates(sql(spark, sf_dir, f"SELECT * FROM {FAULTS} f"), "id", 0.9, 5.0, 0.1, K.MOMENT_C)
    return found.select("id", F.col("bin").cast("long").alias("bin"), F.round("rate", 9).alias("rate"))


#: Events before 1960 forecast those after it, cell by cell.
FORECAST = """(SELECT cls, x, y, n1, (n0 + 1) / cast(sum(n0 + 1) OVER (PARTITION BY cls) AS double) * sum(n1) OVER (PARTITION BY cls) AS mu
  FROM (SELECT cls, floor(lon / 2) AS x, floor(lat / 2) AS y, cast(sum(CASE WHEN yr < 1960 THEN 1 ELSE 0 END) AS bigint) AS n0, cast(sum(CASE WHEN yr >= 1960 THEN 1 ELSE 0 END) AS bigint) AS n1 FROM {cat} GROUP BY 1, 2, 3) c)"""


def m18_joint_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sql(spark, sf_dir, f"SELECT * FROM {FORECAST} f").where("mu > 0")
    term = -F.col("mu") + F.col("n1") * F.log10("mu") - rates.log10_factorial(F.col("n1"))
    return cells.groupBy("cls").agg(F.round(F.sum(F.when(F.col("n1") > 0, term).otherwise(-F.col("mu"))), 4).alias("log_likelihood"))


def m21_number_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sql(spark, sf_dir, f"SELECT * FROM {FORECAST} f")
    return cells.select("cls", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.round(rates.poisson_tail(F.col("n1"), F.col("mu")), 6).alias("p"))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = sql(spark, sf_dir, f"SELECT * FROM {CURVES} c")
    return hazard.hazard_map(curves, [0.1, 0.02, 0.002]).withColumn("weight", (F.col("branch") + 1) / 325.0)


def h01_hazard_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_maps(spark, sf_dir).select("site", F.col("branch").cast("long").alias("branch"), "poe", "iml"), 7)


def h02_branch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hazard.branch_statistics(_maps(spark, sf_dir), ["site", "poe"], [0.05, 0.16, 0.5, 0.84, 0.95]))


def h05_map_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _maps(spark, sf_dir)
    return _rounded(hazard.map_difference(maps.where("branch = 0"), maps.where("branch = 24"), ["site", "poe"]))


def h06_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean levels by probability, one row a site."""
    mean = _maps(spark, sf_dir).groupBy("site").pivot("poe", [0.002, 0.02, 0.1]).agg(F.sum(F.col("weight") * F.col("iml")))
    return _rounded(mean.toDF("site", "p0002", "p002", "p01"))


def f16_principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    strike, dip, rake = (F.col("id") * 37 % 360).cast("double"), (10 + F.col("id") * 7 % 71).cast("double"), (F.col("id") * 13 % 180 - 90).cast("double")
    axes = mechanism.principal_axes(strike, dip, rake)
    return load_catalog(spark, sf_dir).select("id", *(F.round(axes[a][0], 5).alias(f"{a}_plunge") for a in "tp"))


def _named(*found: Callable) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in found}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _shared(v) for k, v in SHARED.items()} | _named(
    a04_density_histogram, a12_plane_collapse, w07_duplicate_labels,
    p13_long_bins, w05_forward_fill, w08_kth_neighbour, m04_kernel_field, m05_whole_field, r04_weichert, r07_bootstrap_b, m12_balanced_rates, m18_joint_likelihood,
    m21_number_test, h01_hazard_map, h02_branch_statistics, h05_map_difference, h06_spectrum, f16_principal_axes,
)

DUCK_KM = "2 * 6371.0 * asin(sqrt(least(greatest(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 0.0), 1.0)))"
NEAR = f"""p AS (SELECT lon, lat, min(id) AS pid, count(*) AS n FROM cat GROUP BY 1, 2),
  near AS (SELECT pid, d FROM (SELECT a.pid, round({DUCK_KM}, 6) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY round({DUCK_KM}, 6), b.pid) AS k FROM p a JOIN p b ON a.pid <> b.pid) x WHERE k = 15),
  r AS (SELECT p.pid, d FROM p LEFT JOIN near USING (pid))"""
MAPS = f"""curves AS {CURVES}, nexts AS (SELECT *, lead(poe) OVER w AS poe1, lead(iml) OVER w AS iml1, lag(poe) OVER w AS poe0 FROM curves WINDOW w AS (PARTITION BY site, branch ORDER BY level)),
  asked AS (SELECT nexts.*, p FROM nexts, (SELECT unnest([0.1e0, 0.02e0, 0.002e0]) AS p) q),
  maps AS (SELECT site, branch, weight, p AS poe, CASE WHEN p > poe OR poe1 IS NULL THEN iml ELSE exp(ln(iml) + (ln(poe) - ln(p)) / (ln(poe) - ln(poe1)) * (ln(iml1) - ln(iml))) END AS iml
    FROM asked WHERE (poe >= p AND (poe1 < p OR poe1 IS NULL)) OR (poe0 IS NULL AND poe < p))"""
QUANTILES = ", ".join(f"coalesce(max(CASE WHEN w1 - weight < {q} AND w1 >= {q} THEN CASE WHEN v0 IS NULL THEN v ELSE v0 + ({q} - (w1 - weight)) / weight * (v - v0) END END), max(v)) AS \"q{q}\"" for q in (0.05, 0.16, 0.5, 0.84, 0.95))
AXES = "SELECT id, radians((id * 37) % 360) AS s, radians(10 + (id * 7) % 71) AS d, radians((id * 13) % 180 - 90) AS r FROM cat"


def _duck(query: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join([DUCK_CAT, *(_text(c, False) for c in ctes)]) + " " + _text(query, False)


ORACLES: dict[str, str] = {k: _duck(v) for k, v in SHARED.items()} | {
    "p13_long_bins": _duck("SELECT lon, lat, bin, rate FROM (UNPIVOT w ON rate_m4, rate_m5, rate_m6, rate_m7 INTO NAME bin VALUE rate) u WHERE rate > 0", f"w AS ({SHARED['p13_wide_bins']})"),
    "w05_forward_fill": _duck(f"SELECT cls, decade, last_value(CASE WHEN n % 2 = 0 THEN n END IGNORE NULLS) OVER (PARTITION BY cls ORDER BY decade) AS filled FROM {DECADES} x"),
    "w08_kth_neighbour": _duck("SELECT pid, d FROM r", NEAR),
    "m04_kernel_field": _duck(
        "SELECT cell, round(sum(n * k / total), 6) AS rate FROM (SELECT *, sum(k) OVER (PARTITION BY pid) AS total FROM s) x GROUP BY cell", NEAR,
        "cells AS (SELECT DISTINCT cast(floor(lon) * 1000 + floor(lat) AS bigint) AS cell, floor(lon) + 0.5e0 AS lon, floor(lat) + 0.5e0 AS lat FROM cat)",
        f"s AS (SELECT a.pid, a.n, b.cell, power(power({DUCK_KM}, 2) + power(greatest(r.d, 5), 2), -1.5) AS k FROM p a JOIN r USING (pid) JOIN cells b ON {DUCK_KM} <= 500)",
    ),
    "r04_weichert": _duck(
        "SELECT cls, cast(sum(n) AS bigint) AS n, round(any_value(beta), 6) AS beta, round(any_value(beta) / ln(10), 6) AS b, round(sum(n) * sum(exp(-beta * m)) / sum(t * exp(-beta * m)), 6) AS rate FROM bins JOIN newton USING (cls) WHERE step = 30 GROUP BY cls",
        f"bins AS {BINS}",
        """newton(cls, beta, step) AS (SELECT DISTINCT cls, 1.5e0, 0 FROM bins UNION ALL
          SELECT cls, beta - (s1 / s0 - mean) / (power(s1 / s0, 2) - s2 / s0), step + 1 FROM (SELECT newton.cls, any_value(beta) AS beta, any_value(step) AS step,
            sum(t * exp(-beta * m)) AS s0, sum(t * m * exp(-beta * m)) AS s1, sum(t * m * m * exp(-beta * m)) AS s2, sum(n * m) / sum(n) AS mean
            FROM newton JOIN bins ON bins.cls = newton.cls WHERE step < 30 GROUP BY newton.cls) x)""",
        recursive=True,
    ),
    "m12_balanced_rates": _duck(
        "SELECT id, bin, round(shape * moment_rate / sum(shape * m0) OVER (PARTITION BY id), 9) AS rate FROM (SELECT *, power(10e0, -0.9e0 * least(low, m_max)) - power(10e0, -0.9e0 * least(low + 0.1e0, m_max)) AS shape, power(10e0, 1.5e0 * low + 9.1e0) AS m0 FROM b) x",
        f"f AS {FAULTS}", "b AS (SELECT *, 5e0 + 0.1e0 * bin AS low FROM (SELECT *, unnest(range(cast(ceil(round((m_max - 5) / 0.1e0, 6)) AS bigint))) AS bin FROM f) y)",
    ),
    "m18_joint_likelihood": _duck("SELECT cls, round(sum(-mu + n1 * log10(mu) - lgamma(n1 + 1) / ln(10)), 4) AS log_likelihood FROM f WHERE mu > 0 GROUP BY cls", f"f AS {FORECAST}"),
    "m21_number_test": _duck("SELECT cls, cast(x AS bigint) AS x, cast(y AS bigint) AS y, CASE WHEN mu < 500 THEN round(CASE WHEN n1 <= 0 THEN 1 ELSE greatest(1 - list_sum(list_transform(range(n1), lambda k: exp(-mu + k * ln(mu) - lgamma(k + 1)))), 0) END, 6) END AS p FROM f", f"f AS {FORECAST}"),
    "h01_hazard_map": _duck("SELECT site, branch, round(poe, 7) AS poe, round(iml, 7) AS iml FROM maps", MAPS),
    "h02_branch_statistics": _duck(
        "SELECT site, poe, stat, round(value, 6) AS value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (site, poe)) INTO NAME stat VALUE value) u", MAPS,
        "run AS (SELECT *, iml AS v, lag(iml) OVER w AS v0, sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w1 FROM maps WINDOW w AS (PARTITION BY site, poe ORDER BY iml, branch))",
        f"w AS (SELECT site, poe, sum(weight * v) / sum(weight) AS mean, exp(sum(weight * ln(v)) / sum(weight)) AS gmean, {QUANTILES} FROM run GROUP BY site, poe)",
    ),
    "h05_map_difference": _duck("SELECT site, poe, round(b.iml - a.iml, 6) AS difference, round((b.iml - a.iml) / a.iml, 6) AS relative FROM (SELECT * FROM maps WHERE branch = 0) a JOIN (SELECT * FROM maps WHERE branch = 24) b USING (site, poe)", MAPS),
    "h06_spectrum": _duck("SELECT site, " + ", ".join(f"round(sum(CASE WHEN poe = {p} THEN weight * iml END), 6) AS {n}" for p, n in ((0.002, "p0002"), (0.02, "p002"), (0.1, "p01"))) + " FROM maps GROUP BY site", MAPS),
    "f16_principal_axes": _duck(
        "SELECT id, round(degrees(asin(least(abs(sin(r) * sin(d) + cos(d)) / sqrt(2), 1))), 5) AS t_plunge, round(degrees(asin(least(abs(sin(r) * sin(d) - cos(d)) / sqrt(2), 1))), 5) AS p_plunge FROM a", f"a AS ({AXES})"
    ),
}
