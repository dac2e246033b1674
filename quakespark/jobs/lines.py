"""Registered queries of cut polylines and of slip-rate laws, on faults derived from ``supplier``; their SQL for DuckDB is written apart from them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.jobs.faults import _FAULTS, load_faults
from quakespark.jobs.seismic import KM
from quakespark.operators import grids as G
from quakespark.operators import lines as L
from quakespark.operators import recurrence as R

PIECE, BANDS = 10.0, [-56.0 + 2.15 * k for k in range(20)]
M_MIN, STEP = 6.0, 0.1


KINDS = ("Reverse", " sinistral ", "dextral-Normal", "oblique", "normal", "SINISTRAL-REVERSE")


def f28_rakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rakes of faults whose written rupture type comes from their key; each seventh has none."""
    k = F.col("fault")
    kind = F.when(k % 7 != 0, F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int")))
    return load_faults(spark, sf_dir).select("fault", G.rake_of(kind).alias("rake"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda p, i: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), (10.0 * i + F.col("fault") % 5).alias("depth"))
    return load_faults(spark, sf_dir).select(F.col("fault").alias("edge"), F.transform("trace", node).alias("nodes"))


def f26_cut_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(BANDS, BANDS[1:], strict=False))], "segment long, low double, high double")
    found = L.cut_edges(edges(spark, sf_dir), segments)
    ends = {f"{n}_{w}": F.round(F.element_at("nodes", i)[n], 6) for w, i in (("a", 1), ("b", -1)) for n in ("lon", "lat", "depth")}
    return found.select("segment", "edge", F.size("nodes").cast("long").alias("n"), *(v.alias(k) for k, v in ends.items()))


def s16_split_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = L.split_at_lengths(edges(spark, sf_dir).select(F.col("edge").alias("line"), "nodes"), PIECE)
    end = lambda f, n: F.round(f(n, "part"), 6)
    return parts.groupBy("line", "piece").agg(F.count(F.lit(1)).alias("n"), *(end(f, n).alias(f"{n}_{w}") for w, f in (("a", F.min_by), ("b", F.max_by)) for n in ("lon", "lat")))


def slipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("fault")
    return load_faults(spark, sf_dir).select(
        "fault", "width", (20.0 + k % 30).alias("length"), ((k % 7 + 1) * 0.5).alias("slip_rate"), (0.8 + (k % 8) * 0.1).alias("b"), (6.5 + (k % 10) * 0.1).alias("m_max")
    )


def m14_slip_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = slipping(spark, sf_dir)
    found = [R.slip_rates(held, kind, M_MIN, STEP, 0.9).withColumn("kind", F.lit(kind)) for kind in ("al1", "al2", "al3", "yc")]
    rows = found[0].union(found[1]).union(found[2]).union(found[3])
    return rows.select("kind", "fault", F.col("bin").cast("long").alias("bin"), F.round("rate", 9).alias("rate"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (f26_cut_edges, s16_split_traces, m14_slip_rates, f28_rakes)}

#: st: steps of the traces, from one node to the next.
_STEPS = f"""{_FAULTS}, nd AS (SELECT fault, 0 AS i, x0 AS lon, y0 AS lat FROM fault UNION ALL SELECT fault, 1, x1, y1 FROM fault UNION ALL SELECT fault, 2, x2, y2 FROM fault),
st AS (SELECT a.fault, a.i, a.lon, a.lat, b.lon AS lon2, b.lat AS lat2, 10.0 * a.i + a.fault % 5 AS depth, {KM} AS km FROM nd a JOIN nd b ON a.fault = b.fault AND b.i = a.i + 1)"""
_BANDS = "(VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(zip(BANDS, BANDS[1:], strict=False))) + ") sg(segment, low, high)"


def _at(v: str, low: str) -> str:
    return f"max(CASE WHEN {low} >= lat AND {low} <= lat2 THEN {v} + ({low} - lat) / (lat2 - lat) * ({v}2 - {v}) END)"


_LN = math.log(10)
_S = f"slip / 10 / sqrt({R.DISPLACEMENT} * pow(10, {R.MOMENT_C}) / ({R.SHEAR_GPA} * 1e10 * width * 1e5)) * exp(-{0.75 * _LN} * m_max)"
_ABOVE = {
    "al1": lambda x: f"CASE WHEN {x} > 1e-9 THEN level * (1 - b / 1.5) * pow(10, b * ({x})) ELSE 0 END",
    "al2": lambda x: f"CASE WHEN {x} > 1e-9 THEN level * (1.5 / b - 1) * (pow(10, b * ({x})) - 1) ELSE 0 END",
    "al3": lambda x: f"CASE WHEN {x} > 1e-9 THEN level * 1.5 * (1.5 - b) / (b * b) * (pow(10, b * ({x})) - 1 - b * {_LN} * ({x})) ELSE 0 END",
}
_M0 = lambda m: f"pow(10, 1.5 * ({m}) + {R.MOMENT_C - 7})"
_LOW = M_MIN - STEP / 2
#: The characteristic law per unit of its density at the start: exponential to m_max - 0.5, then flat.
_TAIL = lambda m: f"(CASE WHEN {m} < m_max - 0.5 THEN (pow(10, -b * ({m} - {_LOW})) - pow(10, -b * (m_max - 0.5 - {_LOW}))) / (b * {_LN}) + flat * 0.5 ELSE flat * greatest(m_max - ({m}), 0) END)"
ORACLES: dict[str, str] = {
    "f28_rakes": f"WITH {_FAULTS} SELECT fault, CASE WHEN fault % 7 = 0 THEN 90 ELSE [90, 0, -135, 90, -90, 45][fault % 6 + 1] END::DOUBLE AS rake FROM fault",
    "f26_cut_edges": f"""WITH {_STEPS}, w AS (SELECT fault, min(lat) AS s, max(lat2) AS n FROM st GROUP BY fault),
      d AS (SELECT fault, lon, lat, depth, lon2, lat2, depth + 10 AS depth2 FROM st), c AS (SELECT segment, w.fault, greatest(low, s) AS low, least(high, n) AS high FROM w JOIN {_BANDS} ON s < high AND n > low)
      SELECT segment, c.fault AS edge, 2 + (SELECT count(*) FROM nd WHERE nd.fault = c.fault AND nd.lat > c.low + 1e-9 AND nd.lat < c.high - 1e-9) AS n,
        {', '.join(f'round({_at(v, e)}, 6) AS {v}_{w}' for w, e in (('a', 'c.low'), ('b', 'c.high')) for v in ('lon', 'lat', 'depth'))} FROM c JOIN d ON d.fault = c.fault GROUP BY c.segment, c.fault, c.low, c.high""",
    "s16_split_traces": f"""WITH {_STEPS}, r AS (SELECT *, sum(km) OVER (PARTITION BY fault ORDER BY i) - km AS start, sum(km) OVER (PARTITION BY fault) AS whole FROM st),
      p AS (SELECT fault, piece, piece * {PIECE} AS a, least((piece + 1) * {PIECE}, whole) AS b FROM (SELECT DISTINCT fault, whole FROM r), LATERAL (SELECT unnest(range(ceil(whole / {PIECE})::BIGINT)) AS piece)),
      q AS (SELECT p.fault, piece, a, b, r.*, start + km AS stop FROM p JOIN r USING (fault))
      SELECT fault AS line, piece, 2 + count(*) FILTER (WHERE i > 0 AND start > a AND start < b) AS n, {', '.join(f'round(max(CASE WHEN {e} >= start - 1e-9 AND {e} <= stop + 1e-9 THEN {v} + ({e} - start) / km * ({v}2 - {v}) END), 6) AS {v}_{e}' for e in ('a', 'b') for v in ('lon', 'lat'))} FROM q GROUP BY fault, piece""",
    "m14_slip_rates": f"""WITH {_FAULTS}, h AS (SELECT fault, width, 20.0 + fault % 30 AS length, (fault % 7 + 1) * 0.5 * 0.9 AS slip, (0.8e0 + (fault % 8) * 0.1e0) AS b, 6.5e0 + (fault % 10) * 0.1e0 AS m_max FROM fault WHERE width > 0 AND fault % 8 <> 7),
      l AS (SELECT *, {_S} AS level, pow(10, -b * (m_max - 1.5 - {_LOW})) AS flat FROM h),
      y AS (SELECT *, {R.SHEAR_GPA} * 1e9 * length * width * 1e6 * slip / 1000 / (({_M0('m_max - 0.5')} * pow(10, -b * (m_max - 0.5 - {_LOW})) - {_M0(_LOW)}) / ((1.5 - b) * {_LN}) + flat * ({_M0('m_max')} - {_M0('m_max - 0.5')}) / (1.5 * {_LN})) AS scale FROM l),
      r AS (SELECT *, unnest(range(6 + (fault % 10))) AS bin FROM y), m AS (SELECT *, {M_MIN} + bin * {STEP} - {STEP / 2} AS lo, {M_MIN} + bin * {STEP} + {STEP / 2} AS hi FROM r)
      {' UNION ALL '.join(f"SELECT '{k}' AS kind, fault, bin, round(greatest({f('m_max - lo')} - {f('m_max - hi')}, 0), 9) AS rate FROM m" for k, f in _ABOVE.items())}
      UNION ALL SELECT 'yc', fault, bin, round(greatest(scale * ({_TAIL('lo')} - {_TAIL('hi')}), 0), 9) FROM m""",
}
