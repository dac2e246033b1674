"""Registered queries of sub-catalogs, small formulas, fits, comparisons and conservation; their SQL for DuckDB is written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.functions import columns as C
from quakespark.jobs.lines import ORACLES as LINE_ORACLES
from quakespark.jobs.lines import M_MIN, STEP, slipping
from quakespark.jobs.polygons import CAP, CELL, DUCK_STAR, _inside, cells, stars
from quakespark.jobs.seismic import DUCK_CAT, KM, load_catalog
from quakespark.operators import polygons as P
from quakespark.operators import recurrence as R
from quakespark.operators import selection as S

BOX, CITY = (-75.5, -50.0, -67.0, -20.0), (-70.66, -33.45)


def f02_cosine_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of events from a city, by the law of cosines."""
    km = C.cosine_law_km(F.col("lat"), F.col("lon"), F.lit(CITY[1]), F.lit(CITY[0]))
    return load_catalog(spark, sf_dir).select("id", F.round(km, 4).alias("km"))


def f03_cell_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = C.cell_area_km2(F.col("west"), F.col("east"), F.col("south"), F.col("north"))
    return cells(spark, sf_dir).select("cell", F.round(area, 6).alias("km2"))


def f11_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years between the first and the last event of each user's place."""
    at = F.timestamp_micros((F.col("t") * 1e6).cast("long"))
    held = load_catalog(spark, sf_dir).groupBy("lon", "lat").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return held.select("lon", "lat", F.round(C.duration_years(F.col("a"), F.col("b")), 9).alias("years"))


def f20_binned_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_catalog(spark, sf_dir).groupBy(F.round(C.bin_magnitude(F.col("mag"), 0.25), 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def p04_sub_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_catalog(spark, sf_dir).withColumn("depth", F.when(F.col("id") % 9 != 0, F.col("depth")))
    return S.sub_catalog(events, (4.5, 7.0), (10.0, 50.0), True, BOX, stars(spark, sf_dir), (1930.0, 2010.0)).select("id", "depth")


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of cells in bins of half a magnitude, with empty ones between and above."""
    c = F.col
    x = (F.floor(c("lon") / CELL) * 1000 + F.floor(c("lat") / CELL)).alias("cell")
    found = load_catalog(spark, sf_dir).groupBy(x, F.floor(c("mag") * 2).alias("bin")).agg((F.count(F.lit(1)) / 124).alias("rate"))
    every = found.select("cell").distinct().withColumn("bin", F.explode(F.sequence(F.lit(8).cast("long"), F.lit(25).cast("long"))))
    return every.join(found, ["cell", "bin"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def p15_trimmed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.abs("cell")
    depths = cells(spark, sf_dir).select("cell", F.when(k % 7 != 0, (k % 11).cast("double")).alias("upper"), (k % 13).cast("double").alias("lower"))
    return S.trimmed_bins(binned(spark, sf_dir), depths).select("cell", "bin", F.round("rate", 9).alias("rate"))


def j15_slab_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of three grids that each lack some."""
    places = load_catalog(spark, sf_dir).groupBy("lon", "lat").agg(F.min("id").alias("k"))
    grid = lambda lack, v: places.where(F.col("k") % lack != 0).select("lon", "lat", v.alias("value"))
    k = F.col("k")
    return S.slab_nodes(grid(3, -(k % 100).cast("double")), grid(4, F.when(k % 10 != 0, (k % 700).cast("double"))), grid(5, (k % 60).cast("double")))


def r10_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at or above each tenth, by class."""
    c = F.col
    counts = load_catalog(spark, sf_dir).groupBy("cls", F.round("mag", 2).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    above = counts.select("cls", "m").join(counts.select("cls", c("m").alias("other"), "n"), "cls").where("other >= m").groupBy("cls", "m").agg((F.sum("n") / 124).alias("rate"))
    found = S.least_squares(above, "cls", 0.1)
    return found.select("cls", "n_bins", *(F.round(x, 6).alias(x) for x in ("a", "b", "r2", "rms")))


def m15_compared_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two laws' rates of faults at or above the least magnitude; each lacks some faults."""
    held = slipping(spark, sf_dir)
    total = lambda kind, keep: R.slip_rates(held.where(keep), kind, M_MIN, STEP, 0.9).groupBy("fault").agg(F.sum("rate").alias("rate"))
    found = S.compared(total("al2", "fault % 5 <> 0"), total("yc", "fault % 6 <> 0"), "fault")
    return found.select("fault", F.round("first", 8).alias("first"), F.round("second", 8).alias("second"), F.round("log_ratio", 6).alias("log_ratio"), "only")


def m23_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cap inside polygons takes from each bin."""
    c = F.col
    grid = cells(spark, sf_dir).select("cell", (c("west") + CELL / 2).alias("lon"), (c("south") + CELL / 2).alias("lat"))
    before = binned(spark, sf_dir)
    after = P.cap_in_polygons(before.join(grid, "cell").withColumn("low", c("bin") / 2), stars(spark, sf_dir), CAP).withColumnRenamed("in_polygon", "inside")
    found = S.conservation(before, after)
    return found.select("bin", *(F.round(x, 9).alias(x) for x in ("before", "after", "moved", "outside_change")), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        f02_cosine_law, f03_cell_areas, f11_durations, f20_binned_magnitudes, p04_sub_catalog, p15_trimmed_bins, j15_slab_nodes, r10_least_squares, m15_compared_rates, m23_conservation,
    )
}

_BINNED = f"""eb AS (SELECT floor(lon / {CELL})::BIGINT * 1000 + floor(lat / {CELL})::BIGINT AS cell, floor(mag * 2)::BIGINT AS bin, count(*) / 124 AS rate FROM cat GROUP BY ALL),
bi AS (SELECT c.cell, range AS bin, coalesce(rate, 0) AS rate FROM (SELECT DISTINCT cell FROM eb) c CROSS JOIN range(8, 26) LEFT JOIN eb ON eb.cell = c.cell AND eb.bin = range)"""
_CENTRES = _inside(f"SELECT cell AS id, west + {CELL / 2} AS lon, south + {CELL / 2} AS lat FROM gc")
ORACLES: dict[str, str] = {
    "f02_cosine_law": f"WITH {DUCK_CAT} SELECT a.id, round({KM}, 4) AS km FROM cat a, (SELECT {CITY[0]}::DOUBLE AS lon, {CITY[1]}::DOUBLE AS lat) b",
    "f03_cell_areas": f"WITH {DUCK_STAR} SELECT cell, round(6371.0 ** 2 * radians({CELL}) * 2 * cos(radians(south + {CELL / 2})) * sin(radians({CELL / 2})), 6) AS km2 FROM gc",
    "f11_durations": f"WITH {DUCK_CAT} SELECT lon, lat, round((max((t * 1000000)::BIGINT) - min((t * 1000000)::BIGINT)) / 1e6 / 31557600, 9) AS years FROM cat GROUP BY lon, lat",
    "f20_binned_magnitudes": f"WITH {DUCK_CAT} SELECT round(round_even(mag * 4, 0) / 4, 2) AS bin, count(*) AS n FROM cat GROUP BY 1",
    "p04_sub_catalog": f"""WITH {DUCK_STAR}, e AS (SELECT * REPLACE (CASE WHEN id % 9 <> 0 THEN depth END AS depth) FROM cat), h AS ({_inside('SELECT id, lon, lat FROM cat')})
      SELECT id, depth FROM e WHERE mag >= 4.5 AND mag < 7 AND (depth IS NULL OR depth >= 10 AND depth < 50) AND yr >= 1930 AND yr < 2010 AND lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]} AND id IN (SELECT id FROM h)""",
    "p15_trimmed_bins": f"""WITH {DUCK_CAT}, {_BINNED} SELECT cell, bin, round(rate, 9) AS rate FROM bi b WHERE EXISTS (SELECT 1 FROM eb WHERE eb.cell = b.cell AND eb.bin >= b.bin)
      AND abs(cell) % 7 <> 0 AND abs(cell) % 11 < abs(cell) % 13""",
    "j15_slab_nodes": f"""WITH {DUCK_CAT}, k AS (SELECT lon, lat, min(id) AS k FROM cat GROUP BY lon, lat)
      SELECT lon, lat, (k % 100)::DOUBLE AS depth, ((k % 700) % 360)::DOUBLE AS strike, (k % 60)::DOUBLE AS dip FROM k WHERE k % 3 <> 0 AND k % 4 <> 0 AND k % 10 <> 0 AND k % 5 <> 0""",
    "r10_least_squares": f"""WITH {DUCK_CAT}, n AS (SELECT cls, round(mag, 2) AS m, count(*) AS n FROM cat GROUP BY ALL), p AS (SELECT cls, m AS x, log10(sum(n) OVER (PARTITION BY cls ORDER BY m DESC) / 124) AS y FROM n),
      s AS (SELECT cls, count(*) AS k, avg(x) AS ax, avg(y) AS ay, sum(x * x) - count(*) * avg(x) ** 2 AS sxx, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(y * y) - count(*) * avg(y) ** 2 AS syy FROM p GROUP BY cls),
      f AS (SELECT *, sxy / sxx AS slope FROM s), e AS (SELECT f.cls, sum((y - ay - slope * (x - ax)) ** 2) AS rest FROM f JOIN p USING (cls) GROUP BY f.cls)
      SELECT cls, k AS n_bins, round(ay - slope * ax, 6) AS a, round(-slope, 6) AS b, round(1 - rest / syy, 6) AS r2, round(sqrt(rest / k), 6) AS rms FROM f JOIN e USING (cls)""",
    "m15_compared_rates": f"""WITH w AS (SELECT kind, fault, sum(rate) AS rate FROM ({LINE_ORACLES['m14_slip_rates'].replace(', 9) AS rate', ', 15) AS rate').replace('0), 9) FROM m', '0), 15) FROM m')}) GROUP BY ALL),
      a AS (SELECT fault, rate FROM w WHERE kind = 'al2' AND fault % 5 <> 0), b AS (SELECT fault, rate FROM w WHERE kind = 'yc' AND fault % 6 <> 0)
      SELECT coalesce(a.fault, b.fault) AS fault, round(a.rate, 8) AS first, round(b.rate, 8) AS second, round(log10(b.rate / a.rate), 6) AS log_ratio, CASE WHEN a.fault IS NULL THEN 'second' WHEN b.fault IS NULL THEN 'first' END AS only FROM a FULL JOIN b ON a.fault = b.fault""",
    "m23_conservation": f"""WITH {DUCK_STAR}, {_BINNED}, h AS (SELECT DISTINCT id AS cell FROM ({_CENTRES}))
      SELECT bin, round(sum(rate), 9) AS before, round(coalesce(sum(rate) FILTER (WHERE h.cell IS NULL OR bin / 2 < {CAP}), 0), 9) AS after, round(coalesce(sum(rate) FILTER (WHERE h.cell IS NOT NULL AND bin / 2 >= {CAP}), 0), 9) AS moved,
        0::DOUBLE AS outside_change, true AS kept FROM bi LEFT JOIN h ON h.cell = bi.cell GROUP BY bin""",
}
