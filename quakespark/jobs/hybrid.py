"""Registered queries of hybrid weights, on cells of a degree with events and faults; their SQL for DuckDB is written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.jobs.faults import _FAULTS, load_faults
from quakespark.jobs.seismic import DUCK_CAT, load_catalog
from quakespark.operators import hybrid as H

WEIGHTS, LOW, HIGH, SPLIT = [i / 10 for i in range(11)], 5.5, 7.0, 1960.0
MAGNITUDES = [5.0, 6.0, 7.0, 8.0]


def _cell(lon, lat):
    return F.floor(lon) * 1000 + F.floor(lat)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The early events of each cell as seismic field; the faults of a cell, and a hundredth, as fault field; cells in the far south are not masked."""
    first = F.col("trace")[0]
    faults = load_faults(spark, sf_dir).groupBy(_cell(first["lon"], first["lat"]).alias("cell")).agg(F.count(F.lit(1)).alias("faults"))
    early = load_catalog(spark, sf_dir).groupBy(_cell(F.col("lon"), F.col("lat")).alias("cell")).agg(F.count(F.when(F.col("yr") < SPLIT, 1)).alias("early"), F.floor(F.min("lat")).alias("south"))
    held = early.join(faults, "cell", "left")
    return held.select("cell", F.col("early").cast("double").alias("seismic"), (F.coalesce("faults", F.lit(0)) + 0.01).alias("fault"), (F.col("south") >= -50).alias("masked"))


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = load_catalog(spark, sf_dir).where(F.col("yr") >= SPLIT)
    counts = late.groupBy(_cell(F.col("lon"), F.col("lat")).alias("cell"), F.floor(F.col("mag") * 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return H.weight_likelihoods(cells(spark, sf_dir), counts, WEIGHTS)


def m19_weight_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir).where(F.col("likelihood") > float("-inf"))
    return found.select("bin", "weight", F.col("n").cast("long").alias("n"), F.round("likelihood", 4).alias("likelihood"))


def m19_weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = H.best_weights(table(spark, sf_dir)).select((F.col("bin") / 2 + 0.25).alias("m"), "weight")
    found = H.weighted_fields(cells(spark, sf_dir), H.fit_ramp(best, LOW, HIGH) or (1.0, 1.0), LOW, HIGH, MAGNITUDES)
    return found.select("cell", "m", F.round("rate", 5).alias("rate"), F.round("at_or_above", 5).alias("at_or_above"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (m19_weight_likelihoods, m19_weighted_fields)}

_DUCK = f"""{DUCK_CAT}, {_FAULTS}, ft AS (SELECT floor(x0)::BIGINT * 1000 + floor(y0)::BIGINT AS cell, count(*) AS k FROM fault GROUP BY ALL),
ev AS (SELECT floor(lon)::BIGINT * 1000 + floor(lat)::BIGINT AS cell, floor(lat) AS south, yr, floor(mag * 2)::BIGINT AS bin FROM cat),
ce AS (SELECT ev.cell, (count(*) FILTER (WHERE yr < {SPLIT}))::DOUBLE AS s, coalesce(any_value(k), 0) + 0.01::DOUBLE AS f, min(south) >= -50 AS masked FROM ev LEFT JOIN ft USING (cell) GROUP BY ev.cell),
su AS (SELECT sum(s) AS whole, sum(f) AS alls FROM ce WHERE masked), sc AS (SELECT cell, s, f * whole / alls AS f, masked, whole FROM ce, su),
nn AS (SELECT cell, bin, count(*) AS n FROM ev WHERE yr >= {SPLIT} GROUP BY ALL), mt AS (SELECT *, sum(n) OVER (PARTITION BY bin) AS total FROM nn JOIN sc USING (cell) WHERE masked),
ew AS (SELECT *, total * (w * s + (1 - w) * f) / whole AS mu FROM mt, (SELECT unnest({WEIGHTS})::DOUBLE AS w)),
ta AS (SELECT bin, w AS weight, any_value(total)::BIGINT AS n, sum(n * log10(nullif(mu, 0)) - lgamma(n + 1) / ln(10)) - any_value(total) AS likelihood FROM ew GROUP BY bin, w HAVING min(mu) > 0)"""
ORACLES: dict[str, str] = {
    "m19_weight_likelihoods": f"WITH {_DUCK} SELECT bin, weight, n, round(likelihood, 4) AS likelihood FROM ta",
    "m19_weighted_fields": f"""WITH {_DUCK}, be AS (SELECT bin, weight FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY likelihood DESC, weight) AS k FROM ta) WHERE k = 1),
      pt AS (SELECT weight AS y, least(greatest((bin / 2 + 0.25 - {LOW}) / {HIGH - LOW}, 0), 1) AS t FROM be), re AS (SELECT regr_intercept(y, t) AS p, regr_intercept(y, t) + regr_slope(y, t) AS q FROM pt),
      r AS (SELECT cell, m::DOUBLE AS m, CASE WHEN masked THEN (p + (q - p) * t) * s + (1 - p - (q - p) * t) * f ELSE s END AS rate FROM sc, re, (SELECT m, least(greatest((m - {LOW}) / {HIGH - LOW}, 0), 1) AS t FROM (SELECT unnest({MAGNITUDES}) AS m)))
      SELECT cell, m, round(rate, 5) AS rate, round((SELECT sum(q.rate) FROM r q WHERE q.cell = r.cell AND q.m >= r.m), 5) AS at_or_above FROM r""",
}
