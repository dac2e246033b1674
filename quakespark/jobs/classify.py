"""Registered query of the full classification, on the derived catalog and slab nodes; its SQL for DuckDB is written apart from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.functions.mechanism import auxiliary_plane
from quakespark.jobs.faults import _N, _S, _on_line
from quakespark.jobs.grids import DUCK_NODES, _inside, nodes
from quakespark.jobs.seismic import KM, load_catalog
from quakespark.operators import classify as C

TRENCH = [(-75.2, -56.0), (-74.6, -45.0), (-73.6, -36.0), (-72.4, -27.0), (-71.6, -18.0)]
ARC = [(-70.5, -50.0), (-69.0, -50.0), (-68.4, -25.0), (-69.6, -24.0), (-70.2, -37.0)]
OVERRIDES = {"77": ("forearc", 29.9)}


def slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a slab that dips to the east."""
    c = F.col
    return nodes(spark, sf_dir).select("node", "lon", "lat", (10 + (c("lon") + 76) * 8 + c("node") % 5).alias("depth"), F.lit(4.0).alias("strike"), (10.25 + c("node") % 30).alias("dip"))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with errors, of which some are marked as relocated, some zero and some unknown, and with planes, of which some are unknown."""
    c, k = F.col, F.col("id")
    strike, dip, rake = k * 37 % 359 + 0.5, (15 + k % 70).cast("double"), k * 53 % 340 - 169.75
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    held = load_catalog(spark, sf_dir).select("id", "lon", "lat", "depth", "yr").repartition(n, "id").select(
        "id", "lon", "lat", "depth", "yr", (k % 10 == 0).alias("relocated"), F.when((k % 10).between(1, 4), (k % 7).cast("double")).alias("depth_error"),
        F.when(k % 5 != 0, (k % 4) / 8).alias("lon_error"), F.when(k % 5 != 0, (k % 3) / 8).alias("lat_error"), strike.alias("s"), dip.alias("d"), rake.alias("r"),
    ).withColumn("depth", F.when(k % 97 != 0, c("depth")))
    other = auxiliary_plane(c("s"), c("d"), c("r"))
    has = k % 4 != 1
    angles = dict(zip(C.PLANES, (c("s"), c("d"), c("r"), *other), strict=True))
    return held.withColumns({n: F.when(has, v) for n, v in angles.items()}).drop("s", "d", "r")


def x01_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.classified(located(spark, sf_dir), slab(spark, sf_dir), TRENCH, ARC, overrides=OVERRIDES)
    return found.select("id", "class_raw", F.round("sub_depth", 6).alias("sub_depth"), "class")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"x01_classified": x01_classified}

_VECTORS = ", ".join(f"{t.format(s='strike', d='dip', r='rake')} AS {v}{a}" for v, ts in (("n", _N), ("s", _S)) for a, t in zip("enu", ts, strict=True))
ORACLES: dict[str, str] = {
    "x01_classified": f"""WITH {DUCK_NODES}, sl AS (SELECT node, lon, lat, 10 + (lon + 76) * 8e0 + node % 5 AS depth, 10.25e0 + node % 30 AS dip FROM node),
      ev AS (SELECT id, lon, lat, yr, CASE WHEN id % 97 <> 0 THEN depth END AS depth, id % 10 = 0 AS relocated, CASE WHEN id % 10 BETWEEN 1 AND 4 THEN id % 7 END::DOUBLE AS err, CASE WHEN id % 5 <> 0 THEN id % 4 / 8 END AS ex,
        CASE WHEN id % 5 <> 0 THEN id % 3 / 8 END AS ey, id * 37 % 359 + 0.5e0 AS strike, (15 + id % 70)::DOUBLE AS dip, id * 53 % 340 - 169.75e0 AS rake FROM cat),
      pt AS (SELECT DISTINCT lon, lat FROM ev),
      nr AS (SELECT lon, lat, node, slab, slab_dip FROM (SELECT a.lon, a.lat, b.node, b.depth AS slab, b.dip AS slab_dip, {KM} AS km, row_number() OVER (PARTITION BY a.lon, a.lat ORDER BY pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2), b.node) AS k FROM pt a, sl b) WHERE k = 1 AND km <= 15),
      el AS (SELECT e.id, min(s.depth) AS low, max(s.depth) AS high FROM ev e JOIN sl s ON abs(s.lon - e.lon) <= ex AND abs(s.lat - e.lat) <= greatest(ey, 1e-12) AND pow((s.lon - e.lon) / greatest(ex, 1e-12), 2) + pow((s.lat - e.lat) / greatest(ey, 1e-12), 2) <= 1
        WHERE greatest(ex, ey) > 0 GROUP BY e.id),
      j AS (SELECT ev.*, {_VECTORS}, slab, slab_dip, coalesce(low, slab) AS low, coalesce(high, slab) AS high, {_on_line(TRENCH, 'x', 'ev.lon', 'ev.lat')} > ev.lon AS west, {_on_line([*ARC, ARC[0]], 'x', 'ev.lon', 'ev.lat')} < ev.lon AS east,
        {_inside(ARC).replace('lat)', 'ev.lat)').replace('lat -', 'ev.lat -').replace('AND lon <', 'AND ev.lon <')} AS arc FROM ev LEFT JOIN nr ON nr.lon = ev.lon AND nr.lat = ev.lat LEFT JOIN el USING (id)),
      m AS (SELECT *, cos(radians(4)) * sin(radians(slab_dip)) AS pe, -sin(radians(4)) * sin(radians(slab_dip)) AS pn, cos(radians(slab_dip)) AS pu FROM j),
      q AS (SELECT *, se * sin(radians(strike)) + sn * cos(radians(strike)) AS q, (nn * se - ne * sn) / (se * se + sn * sn) AS w, CASE WHEN su < 0 THEN -1 ELSE 1 END AS k FROM m),
      z AS (SELECT *, id % 4 = 1 OR (abs(ne * pe + nn * pn + nu * pu) >= cos(radians(35)) AND (2 * q * sin(radians(strike)) - se) * sin(radians(78)) + (2 * q * cos(radians(strike)) - sn) * cos(radians(78)) >= 0)
        OR (abs(se * pe + sn * pn + su * pu) >= cos(radians(35)) AND k * ((-2 * sn * w - ne) * sin(radians(78)) + (2 * se * w - nn) * cos(radians(78))) >= 0) AS zone FROM q),
      g AS (SELECT *, CASE WHEN relocated THEN depth - slab <= -11 WHEN err > 0 THEN depth + err < low - 11 ELSE depth - slab <= -15 END AS above,
        CASE WHEN relocated THEN depth - slab >= 11 WHEN err > 0 THEN depth - err > high + 11 ELSE depth - slab >= 15 END AS below FROM z),
      c AS (SELECT *, CASE WHEN arc AND depth IS NOT NULL THEN CASE WHEN slab IS NOT NULL AND depth >= slab - 15 THEN 'slab_deep' WHEN depth <= 40 THEN 'intraarc_shallow' WHEN slab IS NULL AND depth > 90 THEN 'slab_deep' ELSE 'intraarc_deep' END
        WHEN west THEN 'outer_rise' WHEN east AND NOT arc AND depth < 70 THEN 'backarc' WHEN slab IS NULL OR depth IS NULL THEN 'unclassified'
        WHEN slab >= 50 THEN CASE WHEN depth >= slab - 15 THEN 'slab_deep' ELSE 'forearc' END WHEN above THEN 'forearc' WHEN below THEN 'intra_slab' WHEN zone THEN 'slab_interface' WHEN depth < slab THEN 'forearc' ELSE 'intra_slab' END AS raw FROM g),
      d AS (SELECT id, CASE WHEN id = 77 THEN 'forearc' WHEN raw = 'intra_slab' AND yr < 1930 THEN 'slab_interface' ELSE raw END AS raw,
        CASE WHEN id = 77 THEN 29.9 WHEN raw IN ('slab_interface', 'intra_slab', 'slab_deep', 'forearc') THEN slab END AS sub FROM c)
      SELECT id, raw AS class_raw, round(sub, 6) AS sub_depth, CASE WHEN raw LIKE 'intraarc%' THEN 'intraarc' WHEN raw IN ('backarc', 'unclassified') THEN 'unclassified' ELSE raw END AS class FROM d""",
}
