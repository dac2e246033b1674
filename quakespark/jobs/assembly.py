"""Registered queries of catalog assembly, as DataFrame jobs; their SQL for DuckDB is written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark.jobs.seismic import DUCK_CAT, KM, STEPS, load_catalog
from quakespark.operators import assembly as A
from quakespark.operators import catalog as C

SOURCES = ("isc", "anss", "gcmt", "")
END, B = 2025.0, 0.9
EDGES = [4.0 + 0.5 * i for i in range(11)]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as records of several sources, with times 300 s apart at most twice over; some lack magnitude, depth or time."""
    c = F.col
    return load_catalog(spark, sf_dir).select(
        "id", F.when(c("id") % 11 != 0, c("mag")).alias("mag"), F.when(c("id") % 7 != 0, c("depth")).alias("depth"), "lon", "lat", "cls",
        F.when(c("id") % 101 != 0, c("t")).alias("t"), F.element_at(F.array(*map(F.lit, SOURCES)), (c("id") % 4 + 1).cast("int")).alias("source"),
    )


DUCK_REC = f"""{DUCK_CAT}, rec AS (SELECT id, CASE WHEN id % 11 <> 0 THEN mag END AS mag, CASE WHEN id % 7 <> 0 THEN depth END AS depth, lon, lat, cls,
  CASE WHEN id % 101 <> 0 THEN t END AS t, ['isc', 'anss', 'gcmt', ''][id % 4 + 1] AS source FROM cat)"""


def j02_record_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.record_pairs(records(spark, sf_dir), 120.0, 80.0, 0.8).select("a_id", "b_id", F.round("km", 6).alias("km"))


def w07_cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the records of equal second and place, a stand-in for clusters that SQL can follow."""
    events = records(spark, sf_dir)
    clusters = events.groupBy("lon", "lat").agg(F.min("id").alias("cluster")).join(events, ["lon", "lat"]).select("id", "cluster")
    return A.duplicate_labels(events, clusters)


def a07_preferred_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.create_map(F.lit("gcmt"), F.lit(0), F.lit("isc"), F.lit(1), F.lit("anss"), F.lit(1))
    held = records(spark, sf_dir).withColumn("place", F.concat_ws("/", "lon", "lat")).withColumn("rank", rank[F.col("source")])
    keyed = held.select(F.floor(F.col("lon") * 4).alias("key"), "rank", "mag", "depth", "t", "id")
    return A.best_record(keyed, "key", "rank", ["mag", "depth", "t"], "t", "id").select("key", "id", "mag", "depth")


def p08_upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = records(spark, sf_dir)
    table = events.where("cls <> 'signup'").select("id", "mag")
    changes = events.where("id % 3 = 0").select("id", F.round(F.coalesce(F.col("mag"), F.lit(4.0)) + 0.1, 2).alias("mag"))
    return A.upsert(table, changes)


def p02_mainshock_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in both boxes that no larger event of their place and class precedes."""
    top = Window.partitionBy("lon", "lat", "cls")
    return (
        load_catalog(spark, sf_dir).withColumn("is_mainshock", F.col("mag") == F.max("mag").over(top))
        .where("is_mainshock and lon between -75.5 and -67 and lat between -54 and -19 and lon between -74 and -68 and lat between -50 and -25").select("id", "mag")
    )


def m01_completeness_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_catalog(spark, sf_dir).select("id", F.round(A.event_weight(F.col("mag"), STEPS, END, B), 9).alias("weight"))


def m06_truncated_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load_catalog(spark, sf_dir).groupBy(F.floor("lon").alias("x"), F.floor("lat").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("share"))
    shares = cells.select((F.col("x") * 1000 + F.col("y")).alias("cell"), "share", (6.2 + F.pmod("x", F.lit(8)) * 0.5).alias("most"))
    return A.truncated_rates(shares, 120.0, B, EDGES, F.col("most")).select("cell", "bin", F.round("rate", 9).alias("rate"))


def a06_cell_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load_catalog(spark, sf_dir).select("lon", "lat", F.greatest(F.col("mag") - 8, F.lit(0.0)).alias("rate"), "depth")
    return A.weighted_depth(points).select("lon", "lat", F.round("depth", 6).alias("depth"))


def a13_collapse_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = load_catalog(spark, sf_dir).withColumn("source", F.col("lon") * 1000 + F.col("lat"))
    planes = cat.select("source", F.col("id").alias("nth"), F.col("mag").alias("probability"), F.concat_ws("/", F.col("id") % 360, F.col("id") % 90).alias("plane"))
    depths = cat.select("source", F.col("mag").alias("probability"), "depth")
    return A.collapse_source(planes, depths).select(F.round("source", 4).alias("source"), "plane", F.round("depth", 6).alias("depth"))


def w09_band_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of complete bands per magnitude, and whether one rises by over 30 % above the band below."""
    c, bands = F.col, sorted(STEPS)
    cat = load_catalog(spark, sf_dir).withColumn("mc", C.step_value(c("mag"), [(m, m) for m, _ in bands])).withColumn("since", C.step_value(c("mag"), STEPS))
    counts = cat.where("yr >= since").groupBy("cls", "mc", "since").agg(F.count(F.lit(1)).alias("n"))
    tops = F.create_map(*(F.lit(x) for low, high in zip([m for m, _ in bands], [m for m, _ in bands][1:] + [9.5], strict=True) for x in (low, high)))
    rate = c("n") / (F.lit(END) - c("since")) / (tops[c("mc")] - c("mc"))
    before = F.lag("rate").over(Window.partitionBy("cls").orderBy("mc"))
    return counts.withColumn("rate", rate).select("cls", "mc", "n", F.round("rate", 9).alias("rate"), F.coalesce(c("rate") > 1.3 * before, F.lit(False)).alias("rises"))


def j04_match_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest records, where a magnitude may be unknown: such a record matches, after those of equal time."""
    held = records(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 10) * 10)
    found = C.nearest_match(held.where("cls = 'view'"), held.where("cls <> 'view'"), 60.0, 0.8)
    return found.select("id", "match", F.round("dt", 6).alias("dt"), "km")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        j02_record_pairs, w07_cluster_labels, a07_preferred_record, p08_upsert_records, p02_mainshock_box, m01_completeness_weight,
        m06_truncated_grid, a06_cell_depth, a13_collapse_source, w09_band_audit, j04_match_unknown,
    )
}

STEP_TABLE = "step(mc, since) AS (VALUES " + ", ".join(f"({m}::DOUBLE, {y}::DOUBLE)" for m, y in STEPS) + ")"
OWN_STEP = "cat JOIN step ON mc = (SELECT max(s.mc) FROM step s WHERE s.mc <= cat.mag + 1e-9)"
ORACLES: dict[str, str] = {
    "j02_record_pairs": f"""WITH {DUCK_REC}, p AS (SELECT a.id AS a_id, b.id AS b_id, {KM} AS km, greatest(a.mag, b.mag) AS m, a.source || b.source IN ('anssgcmt', 'gcmtanss') AS loose
      FROM rec a JOIN rec b ON b.t >= a.t AND b.t - a.t <= 120 AND a.id <> b.id AND NOT (a.t = b.t AND b.id < a.id) WHERE abs(a.mag - b.mag) <= 0.8 + 1e-9)
      SELECT a_id, b_id, round(km, 6) AS km FROM p WHERE km <= greatest(80, CASE WHEN m >= 7.8 THEN 220 WHEN m >= 7.2 THEN 150 WHEN m >= 6.8 THEN 100 ELSE 0 END, CASE WHEN loose THEN 120 ELSE 0 END)""",
    "w07_cluster_labels": f"""WITH {DUCK_REC}, g AS (SELECT lon, lat, min(id) AS cluster, CASE WHEN bool_or(t IS NULL) THEN -1e300 ELSE min(t) END AS first FROM rec GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (ORDER BY first, cluster) AS number FROM g),
      r AS (SELECT id, number, CASE source WHEN '' THEN 'other' ELSE source END AS s FROM rec JOIN n USING (lon, lat)),
      k AS (SELECT *, (SELECT count(*) FROM r q WHERE q.number = r.number AND q.s = r.s AND q.id < r.id) AS before FROM r)
      SELECT id, number || '_' || s || CASE WHEN before > 0 THEN chr((97 + before)::INT) ELSE '' END AS label FROM k""",
    "a07_preferred_record": f"""WITH {DUCK_REC}, x AS (SELECT floor(lon * 4)::BIGINT AS key, id, mag, depth, row_number() OVER (PARTITION BY floor(lon * 4)
      ORDER BY CASE source WHEN 'gcmt' THEN 0 WHEN 'isc' THEN 1 WHEN 'anss' THEN 1 ELSE 9 END, (mag IS NULL)::INT + (depth IS NULL)::INT + (t IS NULL)::INT, t DESC NULLS LAST, id) AS k FROM rec)
      SELECT key, id, mag, depth FROM x WHERE k = 1""",
    "p08_upsert_records": f"""WITH {DUCK_REC} SELECT coalesce(c.id, o.id) AS id, CASE WHEN c.id IS NULL THEN o.mag ELSE c.mag END AS mag
      FROM (SELECT id, mag FROM rec WHERE cls <> 'signup') o FULL JOIN (SELECT id, round(coalesce(mag, 4.0) + 0.1, 2) AS mag FROM rec WHERE id % 3 = 0) c ON c.id = o.id""",
    "p02_mainshock_box": f"""WITH {DUCK_CAT} SELECT id, mag FROM cat a WHERE lon >= -74 AND lon <= -68 AND lat >= -50 AND lat <= -25
      AND NOT EXISTS (SELECT 1 FROM cat b WHERE b.lon = a.lon AND b.lat = a.lat AND b.cls = a.cls AND b.mag > a.mag)""",
    "m01_completeness_weight": f"WITH {DUCK_CAT}, {STEP_TABLE} SELECT id, round(pow(10, {B} * (mc - (SELECT min(mc) FROM step))) / ({END} - since), 9) AS weight FROM {OWN_STEP}",
    "m06_truncated_grid": f"""WITH {DUCK_CAT}, c AS (SELECT floor(lon)::BIGINT AS x, floor(lat)::BIGINT AS y, count(*) AS n FROM cat GROUP BY ALL),
      s AS (SELECT x * 1000 + y AS cell, n / (SELECT sum(n) FROM c) * 120.0 AS own, 6.2 + ((x % 8 + 8) % 8) * 0.5 AS most FROM c),
      b AS (SELECT range AS bin, 4.0 + 0.5 * range AS low, 4.5 + 0.5 * range AS high FROM range({len(EDGES) - 1}))
      SELECT cell, bin, round(CASE WHEN low >= most - 1e-9 THEN 0 ELSE own * (pow(10, {B} * (4.0 - low)) - pow(10, {B} * (4.0 - least(high, most)))) END, 9) AS rate FROM s, b""",
    "a06_cell_depth": f"""WITH {DUCK_CAT}, r AS (SELECT lon, lat, depth, CASE WHEN mag > 8 THEN mag - 8 ELSE 0 END AS rate FROM cat)
      SELECT lon, lat, round(coalesce(sum(rate * depth) / nullif(sum(rate), 0), avg(depth)), 6) AS depth FROM r GROUP BY lon, lat""",
    "a13_collapse_source": f"""WITH {DUCK_CAT}, r AS (SELECT lon * 1000 + lat AS source, *, row_number() OVER (PARTITION BY lon * 1000 + lat ORDER BY mag DESC, id) AS k FROM cat)
      SELECT round(source, 4) AS source, max(CASE WHEN k = 1 THEN (id % 360) || '/' || (id % 90) END) AS plane, round(sum(mag * depth) / sum(mag), 6) AS depth FROM r GROUP BY source""",
    "w09_band_audit": f"""WITH {DUCK_CAT}, {STEP_TABLE}, n AS (SELECT cls, mc, since, count(*) AS n FROM {OWN_STEP} WHERE yr >= since GROUP BY ALL),
      r AS (SELECT cls, mc, n, n / ({END} - since) / (coalesce((SELECT min(s.mc) FROM step s WHERE s.mc > n.mc), 9.5) - mc) AS rate FROM n)
      SELECT cls, mc, n, round(rate, 9) AS rate, coalesce(rate > 1.3 * (SELECT max_by(q.rate, q.mc) FROM r q WHERE q.cls = r.cls AND q.mc < r.mc), false) AS rises FROM r""",
    "j04_match_unknown": f"""WITH {DUCK_REC}, q AS (SELECT * REPLACE (floor(t / 10) * 10 AS t) FROM rec), p AS (SELECT a.id, b.id AS match, abs(a.t - b.t) AS dt, round({KM}, 6) AS km,
      row_number() OVER (PARTITION BY a.id ORDER BY abs(a.t - b.t), coalesce(round(abs(a.mag - b.mag), 6), 1e9), round({KM}, 6), b.id) AS k
      FROM q a JOIN q b ON a.cls = 'view' AND b.cls <> 'view' AND abs(a.t - b.t) <= 60 AND coalesce(abs(a.mag - b.mag) <= 0.8 + 1e-9, true))
      SELECT c.id, match, round(dt, 6) AS dt, km FROM (SELECT id FROM q WHERE cls = 'view') c LEFT JOIN (SELECT * FROM p WHERE k = 1) p USING (id)""",
}
