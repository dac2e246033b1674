"""Registered queries over polygons as rows, derived from ``supplier``, and events; their SQL for DuckDB is written apart from them.

Each supplier gives a star-shaped polygon of 5 to 8 corners about a place that its key gives, every third with a square
hole; the cells are half a degree wide, where the catalog has events.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.jobs.seismic import DUCK_CAT, load_catalog
from quakespark.operators import polygons as P

CELL, CAP, BOX = 0.5, 6.5, (-73.0, -40.0, -69.5, -30.0)
MAGNITUDES = [5.0 + 0.5 * i for i in range(7)]


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    place = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").repartition(n, "s_suppkey").select(
        k.cast("long").alias("poly"), (-76 + ((k * 7919) % 1000) / 100.0).alias("x"), (-56 + ((k * 104729) % 3800) / 100.0).alias("y"), (5 + k % 4).alias("n")
    )
    angle = lambda j: 2 * math.pi * j / c("n")
    reach = lambda j: 0.5 + ((c("poly") * 31 + j * 17) % 10) / 10.0
    outline = F.transform(F.sequence(F.lit(0).cast("long"), c("n") - 1), lambda j: P.corner(F.round(c("x") + reach(j) * F.cos(angle(j)), 6), F.round(c("y") + reach(j) * F.sin(angle(j)), 6)))
    hole = F.array(*(P.corner(F.round(c("x") + dx, 6), F.round(c("y") + dy, 6)) for dx, dy in ((-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2))))
    return place.select("poly", F.when(c("poly") % 3 == 0, F.array(outline, hole)).otherwise(F.array(outline)).alias("rings"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.floor(F.col("lon") / CELL), F.floor(F.col("lat") / CELL)
    found = load_catalog(spark, sf_dir).groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    west, south = F.col("x") * CELL, F.col("y") * CELL
    return found.select((F.col("x") * 1000 + F.col("y")).alias("cell"), "n", west.alias("west"), south.alias("south"), (west + CELL).alias("east"), (south + CELL).alias("north"))


def j08_points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.points_in_polygons(load_catalog(spark, sf_dir).select("id", "lon", "lat"), stars(spark, sf_dir))


def u03_dissolved_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dissolved(stars(spark, sf_dir))


def s15_polygons_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    west, south, east, north = BOX
    ring = F.array(*(P.corner(F.lit(x), F.lit(y)) for x, y in ((west, south), (east, south), (east, north), (west, north))))
    return P.overlapping(stars(spark, sf_dir), spark.range(1).select(F.lit("box").alias("poly"), F.array(ring).alias("rings"))).select(F.col("a").alias("poly"))


def p12_capped_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.explode(F.array(*map(F.lit, MAGNITUDES)))
    rates = cells(spark, sf_dir).select("cell", (F.col("west") + CELL / 2).alias("lon"), (F.col("south") + CELL / 2).alias("lat"), "n", low.alias("low"))
    rates = rates.withColumn("rate", F.col("n") * F.pow(F.lit(10.0), -(F.col("low") - MAGNITUDES[0])))
    return P.cap_in_polygons(rates, stars(spark, sf_dir), CAP).select("cell", "low", F.round("rate", 9).alias("rate"), "in_polygon")


def m16_cell_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.cell_shares(cells(spark, sf_dir).drop("n"), stars(spark, sf_dir))
    return found.where("km2 > 0.001").select("poly", "cell", F.round("km2", 4).alias("km2"))


def m16_area_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast of 50 years from polygons' counts, whose rates of all cells add up to 1 in each bin."""
    grid, held = cells(spark, sf_dir), stars(spark, sf_dir)
    counts = P.counts_in_polygons(load_catalog(spark, sf_dir), held).withColumn("span", F.lit(124.0))
    b = grid.select("cell", F.when(F.col("south") >= -40, 1.0).otherwise(0.9).alias("b"))
    rates = P.area_forecast(P.cell_shares(grid.drop("n"), held), counts, b, 4.05, MAGNITUDES, 50.0, 1.0, by_bin=True)
    return rates.select("cell", F.col("bin").cast("long").alias("bin"), F.round("rate", 9).alias("rate"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (j08_points_in_polygons, u03_dissolved_polygons, s15_polygons_in_box, p12_capped_rates, m16_cell_shares, m16_area_forecast)
}

#: st: the stars' places; cn: corners (poly, ring, k, x, y); ed: their edges; gc: the cells.
DUCK_STAR = f"""{DUCK_CAT}, st AS (SELECT s_suppkey::BIGINT AS poly, -76 + ((s_suppkey * 7919) % 1000) / 100.0 AS x, -56 + ((s_suppkey * 104729) % 3800) / 100.0 AS y, 5 + s_suppkey % 4 AS n FROM supplier),
cn AS (SELECT poly, 0 AS ring, j AS k, round(x + (0.5 + ((poly * 31 + j * 17) % 10) / 10.0) * cos(2 * pi() * j / n), 6)::DOUBLE AS x, round(y + (0.5 + ((poly * 31 + j * 17) % 10) / 10.0) * sin(2 * pi() * j / n), 6)::DOUBLE AS y
  FROM st, LATERAL (SELECT unnest(range(n)) AS j)
  UNION ALL SELECT poly, 1, k, round(x + dx, 6)::DOUBLE, round(y + dy, 6)::DOUBLE FROM st, (VALUES (0, -0.2, -0.2), (1, 0.2, -0.2), (2, 0.2, 0.2), (3, -0.2, 0.2)) h(k, dx, dy) WHERE poly % 3 = 0),
ed AS (SELECT poly, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM cn WINDOW w AS (PARTITION BY poly, ring ORDER BY k)),
gc AS (SELECT floor(lon / {CELL})::BIGINT * 1000 + floor(lat / {CELL})::BIGINT AS cell, floor(lon / {CELL}) * {CELL} AS west, floor(lat / {CELL}) * {CELL} AS south, count(*) AS n FROM cat GROUP BY ALL)"""


def _inside(points: str) -> str:
    """(id, poly) of points (id, lon, lat): an odd number of edges crossed, over all pairs of points and edges."""
    return f"SELECT id, poly FROM ({points}) p, ed WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, poly HAVING count(*) % 2 = 1"


_TURN = "sign(({b}.x2 - {b}.x1) * ({p}{v} - {b}.y1) - ({b}.y2 - {b}.y1) * ({p}{u} - {b}.x1))"
_SIDE = lambda b, p, i: _TURN.format(b=b, p=f"{p}.", u=f"x{i}", v=f"y{i}")
_MEET = f"""greatest(least(a.x1, a.x2), least(b.x1, b.x2)) <= least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) AND greatest(least(a.y1, a.y2), least(b.y1, b.y2)) <= least(greatest(a.y1, a.y2), greatest(b.y1, b.y2))
  AND {_SIDE('a', 'b', 1)} * {_SIDE('a', 'b', 2)} <= 0 AND {_SIDE('b', 'a', 1)} * {_SIDE('b', 'a', 2)} <= 0"""
#: ov: pairs of overlapping polygons in both directions.
DUCK_OVER = f"""{DUCK_STAR}, io AS ({_inside('SELECT poly AS id, x AS lon, y AS lat FROM cn WHERE ring = 0 AND k = 0'.replace('poly AS id', 'poly AS id'))}),
ov AS (SELECT DISTINCT a.poly AS a, b.poly AS b FROM ed a JOIN ed b ON a.poly <> b.poly AND {_MEET} UNION SELECT id, poly FROM io WHERE id <> poly UNION SELECT poly, id FROM io WHERE id <> poly)"""


def _clip(source: str, name: str, axis: str, limit: str, sign: int) -> str:
    """One side of a box: rows (poly, cell, ring, k, x, y) of ``source`` cut where sign * axis <= sign * limit, by the next corner of each."""
    other = "y" if axis == "x" else "x"
    out = f"({sign} * ({axis} - {limit}) > 0)"
    out_next = f"({sign} * (n{axis} - {limit}) > 0)"
    at = f"({other} + (n{other} - {other}) * ({limit} - {axis}) / nullif(n{axis} - {axis}, 0))"
    cut = f"SELECT poly, cell, ring, k * 2 AS k, {limit if axis == 'x' else at} AS x, {at if axis == 'x' else limit} AS y, west, south FROM {name}n WHERE {out} <> {out_next}"
    return f"""{name}n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM {source} WINDOW w AS (PARTITION BY poly, cell, ring ORDER BY k)),
{name}u AS ({cut} UNION ALL SELECT poly, cell, ring, k * 2 + 1, nx, ny, west, south FROM {name}n WHERE NOT {out_next}),
{name} AS (SELECT poly, cell, ring, row_number() OVER (PARTITION BY poly, cell, ring ORDER BY k) AS k, x, y, west, south FROM {name}u)"""


#: ar: km2 of a cell that a polygon covers.
DUCK_AREA = f"""{DUCK_STAR}, bx AS (SELECT poly, min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM cn GROUP BY poly),
c0 AS (SELECT poly, cell, ring, k, x, y, west, south FROM cn JOIN bx USING (poly) JOIN gc ON w < west + {CELL} AND west < e AND s < south + {CELL} AND south < bx.n),
{_clip('c0', 'c1', 'x', 'west', -1)}, {_clip('c1', 'c2', 'x', f'(west + {CELL})', 1)}, {_clip('c2', 'c3', 'y', 'south', -1)}, {_clip('c3', 'c4', 'y', f'(south + {CELL})', 1)},
c5 AS (SELECT *, radians(coalesce(lead(x) OVER w, first_value(x) OVER w) - x) AS turn, radians(y) AS p, radians(coalesce(lead(y) OVER w, first_value(y) OVER w)) AS q FROM c4 WINDOW w AS (PARTITION BY poly, cell, ring ORDER BY k)),
c6 AS (SELECT poly, cell, ring, 6371.0 ** 2 * abs(sum(turn * CASE WHEN abs(p - q) < 1e-9 THEN sin((p + q) / 2) ELSE (cos(p) - cos(q)) / (q - p) END)) AS km2 FROM c5 GROUP BY ALL),
ar AS (SELECT poly, cell, sum(CASE ring WHEN 0 THEN km2 ELSE -km2 END) AS km2 FROM c6 GROUP BY ALL)"""
_POINTS = _inside("SELECT id, lon, lat FROM cat")
_CENTRES = _inside(f"SELECT cell AS id, west + {CELL / 2} AS lon, south + {CELL / 2} AS lat FROM gc")
_BINS = f"(SELECT range AS bin, {MAGNITUDES[0]} + 0.5 * range AS m FROM range({len(MAGNITUDES)}))"
ORACLES: dict[str, str] = {
    "j08_points_in_polygons": f"WITH {DUCK_STAR} {_POINTS}",
    "u03_dissolved_polygons": f"""WITH RECURSIVE {DUCK_OVER}, r AS (SELECT poly, poly AS low FROM st UNION SELECT b, low FROM r JOIN ov ON a = r.poly WHERE low < b)
      SELECT poly, min(low) AS part FROM r GROUP BY poly""",
    "s15_polygons_in_box": f"""WITH {DUCK_STAR}, bo AS (SELECT {BOX[0]}::DOUBLE AS w, {BOX[1]}::DOUBLE AS s, {BOX[2]}::DOUBLE AS e, {BOX[3]}::DOUBLE AS n),
      be AS (SELECT w AS x1, s AS y1, e AS x2, s AS y2 FROM bo UNION ALL SELECT e, s, e, n FROM bo UNION ALL SELECT e, n, w, n FROM bo UNION ALL SELECT w, n, w, s FROM bo)
      SELECT poly FROM (SELECT a.poly FROM ed a, be b WHERE {_MEET} UNION SELECT poly FROM cn, bo WHERE ring = 0 AND x BETWEEN w AND e AND y BETWEEN s AND n UNION SELECT poly FROM ({_inside('SELECT 0 AS id, w AS lon, s AS lat FROM bo')}))""",
    "p12_capped_rates": f"""WITH {DUCK_STAR}, h AS (SELECT DISTINCT id AS cell FROM ({_CENTRES}))
      SELECT gc.cell, m::DOUBLE AS low, round(CASE WHEN h.cell IS NOT NULL AND m >= {CAP} THEN 0 ELSE n * pow(10, {MAGNITUDES[0]} - m) END, 9) AS rate, h.cell IS NOT NULL AS in_polygon FROM gc LEFT JOIN h USING (cell), {_BINS}""",
    "m16_cell_shares": f"WITH {DUCK_AREA} SELECT poly, cell, round(km2, 4) AS km2 FROM ar WHERE km2 > 0.001",
    "m16_area_forecast": f"""WITH {DUCK_AREA}, np AS (SELECT poly, count(*) AS n FROM ({_POINTS}) GROUP BY poly), sh AS (SELECT *, km2 / sum(km2) OVER (PARTITION BY poly) AS share FROM ar WHERE km2 > 1e-9),
      l AS (SELECT cell, sum(n * share) / 124 * 50 AS learnt FROM sh JOIN np USING (poly) GROUP BY cell), t AS (SELECT l.cell, learnt, CASE WHEN south >= -40 THEN 1.0 ELSE 0.9 END::DOUBLE AS b FROM l JOIN gc USING (cell)),
      r AS (SELECT cell, bin, learnt * pow(10, -b * ({MAGNITUDES[0]} - 4.05)) * (pow(10, -b * (m - 0.25)) - pow(10, -b * (m + 0.25))) / (pow(10, -b * {MAGNITUDES[0] - 0.25}) - pow(10, -b * {MAGNITUDES[-1] + 0.25})) AS rate FROM t, {_BINS})
      SELECT cell, bin, round(rate / sum(rate) OVER (PARTITION BY bin), 9) AS rate FROM r""",
}
