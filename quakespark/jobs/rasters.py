"""Registered queries over rasters as rows, derived from ``customer``, and of completeness tests on the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.jobs.polygons import DUCK_STAR, _inside, stars
from quakespark.jobs.seismic import DUCK_CAT, WINDOWS, load_catalog
from quakespark.operators import completeness as C
from quakespark.operators import rasters as R

#: The raster has 50 columns and a row for each 50 customers; each 17th value is unknown.
WIDTH, FRAME, SIGMA = 50, (-76.0, -56.0, 0.2, 0.2), 1.5


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select((k % WIDTH).alias("i"), F.floor(k / WIDTH).alias("j"), F.when(k % 17 != 0, F.col("c_acctbal").cast("double")).alias("value"))


def s14_sampled_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load_catalog(spark, sf_dir).select("id", "lon", "lat")
    return R.sampled(points, raster(spark, sf_dir), FRAME).select("id", F.round("value", 6).alias("value"))


def s14_sampled_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load_catalog(spark, sf_dir).select("id", (F.col("lon") + 0.03).alias("lon"), (F.col("lat") + 0.03).alias("lat"))
    return R.sampled(points, raster(spark, sf_dir), FRAME, "nearest")


def n06_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = raster(spark, sf_dir)
    height = held.agg(F.max("j")).first()[0] + 1
    return R.smoothed(held, WIDTH, height, SIGMA).select("i", "j", F.round("value", 6).alias("value"))


def n09_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.masked(raster(spark, sf_dir), stars(spark, sf_dir), FRAME)


def c02_ks_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and distance of each candidate of each class, which SQL can follow; the simulated p comes with them."""
    bins = C.magnitude_bins(load_catalog(spark, sf_dir), F.col("cls"))
    return C.ks_table(bins, draws=200).select("key", "bin", "n", F.round("distance", 9).alias("distance"))


def c02_mc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mc_windows(load_catalog(spark, sf_dir), WINDOWS, ["view", "click", "purchase"], draws=1000)


def c02_stamped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with the completeness of their window."""
    events = load_catalog(spark, sf_dir)
    return C.stamped(events, c02_mc_windows(spark, sf_dir), WINDOWS).select("id", "window", "mc", "years")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (s14_sampled_linear, s14_sampled_nearest, n06_smoothed, n09_masked, c02_ks_candidates, c02_mc_windows, c02_stamped_events)
}

_RA = f"ra AS (SELECT c_custkey % {WIDTH} AS i, c_custkey // {WIDTH} AS j, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END::DOUBLE AS value FROM customer)"
_KERNEL = ", ".join(f"({k - len(R.gaussian(SIGMA)) // 2}, {w}::DOUBLE)" for k, w in enumerate(R.gaussian(SIGMA)))
_FX, _FY = f"round((lon - {FRAME[0]}) / {FRAME[2]}, 9)", f"round((lat - {FRAME[1]}) / {FRAME[3]}, 9)"
ORACLES: dict[str, str] = {
    "s14_sampled_linear": f"""WITH {DUCK_CAT}, {_RA}, p AS (SELECT id, {_FX} AS x, {_FY} AS y, floor({_FX})::BIGINT AS i, floor({_FY})::BIGINT AS j FROM cat)
      SELECT id, round(CASE WHEN (x = p.i OR b.value IS NOT NULL AND (y = p.j OR d.value IS NOT NULL)) AND a.value IS NOT NULL AND (y = p.j OR c.value IS NOT NULL) THEN
        a.value * (1 - (x - p.i)) * (1 - (y - p.j)) + coalesce(b.value * (x - p.i) * (1 - (y - p.j)), 0) + coalesce(c.value * (1 - (x - p.i)) * (y - p.j), 0) + coalesce(d.value * (x - p.i) * (y - p.j), 0) END, 6) AS value
      FROM p LEFT JOIN ra a ON a.i = p.i AND a.j = p.j LEFT JOIN ra b ON b.i = p.i + 1 AND b.j = p.j LEFT JOIN ra c ON c.i = p.i AND c.j = p.j + 1 LEFT JOIN ra d ON d.i = p.i + 1 AND d.j = p.j + 1""",
    "s14_sampled_nearest": f"""WITH {DUCK_CAT}, {_RA}, p AS (SELECT id, round_even(round((lon + 0.03 - {FRAME[0]}) / {FRAME[2]}, 9), 0)::BIGINT AS i, round_even(round((lat + 0.03 - {FRAME[1]}) / {FRAME[3]}, 9), 0)::BIGINT AS j FROM cat)
      SELECT id, value FROM p LEFT JOIN ra USING (i, j)""",
    "n06_smoothed": f"""WITH {_RA}, g(o, w) AS (VALUES {_KERNEL}), h AS (SELECT max(j) AS top FROM ra), k AS (SELECT i, j, coalesce(value, 0) AS v, (value IS NOT NULL)::INT AS k FROM ra),
      n AS (SELECT x.i, y.j FROM range({WIDTH}) x(i), range((SELECT top + 1 FROM h)) y(j)),
      a AS (SELECT n.i, n.j, sum(w * coalesce(v, 0)) AS v, sum(w * coalesce(k, 0)) AS k FROM n CROSS JOIN g CROSS JOIN h LEFT JOIN k ON k.i = n.i AND k.j = least(greatest(n.j + o, 0), top) GROUP BY ALL),
      b AS (SELECT n.i, n.j, sum(w * v) AS v, sum(w * k) AS k FROM n CROSS JOIN g JOIN a ON a.j = n.j AND a.i = least(greatest(n.i + o, 0), {WIDTH - 1}) GROUP BY ALL)
      SELECT b.i, b.j, round(CASE WHEN b.k > 1e-6 AND (ra.value IS NOT NULL OR b.k >= 0.5) THEN b.v / b.k END, 6) AS value FROM b LEFT JOIN ra USING (i, j)""",
    "n09_masked": f"""WITH {DUCK_STAR}, {_RA}, h AS (SELECT DISTINCT id FROM ({_inside(f'SELECT j * {WIDTH} + i AS id, {FRAME[0]} + i * {FRAME[2]} AS lon, {FRAME[1]} + j * {FRAME[3]} AS lat FROM ra')}))
      SELECT i, j, CASE WHEN id IS NOT NULL THEN value END AS value FROM ra LEFT JOIN h ON id = j * {WIDTH} + i""",
    "c02_ks_candidates": f"""WITH {DUCK_CAT}, b AS (SELECT cls AS key, round_even(mag / 0.1, 0)::BIGINT AS bin, count(*) AS n FROM cat GROUP BY ALL),
      r AS (SELECT key, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY key), f AS (SELECT r.key, r.bin, coalesce(n, 0) AS n FROM r LEFT JOIN b USING (key, bin)),
      t AS (SELECT x.key, x.bin, y.bin AS upto, (SELECT sum(n) FROM f z WHERE z.key = x.key AND z.bin BETWEEN x.bin AND y.bin) AS below, (SELECT sum(n) FROM f z WHERE z.key = x.key AND z.bin >= x.bin) AS n
        FROM f x JOIN f y ON y.key = x.key AND y.bin >= x.bin)
      SELECT key, bin, n::BIGINT AS n, round(max(abs(below / n - (1 - pow(10, -0.1 * (upto - bin + 1))))), 9) AS distance FROM t WHERE n >= 50 GROUP BY ALL""",
}
