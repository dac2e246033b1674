"""Registered queries of faults, lines and mechanisms; faults are derived from ``supplier``. Their SQL for DuckDB is written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.functions import mechanism as ME
from quakespark.functions.columns import magnitude
from quakespark.jobs.seismic import DUCK_CAT, KM, load_catalog
from quakespark.operators import catalog as C
from quakespark.operators import faults as FA

TRENCH = [(-73.0, -57.0), (-74.5, -48.0), (-74.0, -36.0), (-71.0, -25.0), (-71.5, -17.0)]
REGIONS = {"north": [(-72.0, -30.0), (-68.0, -30.0), (-68.0, -20.0), (-72.0, -20.0)], "south": [(-75.0, -55.0), (-70.0, -55.0), (-71.0, -42.0), (-75.0, -42.0)]}
MARGINS = [0.0, 5.0, 10.0, 15.0, 20.0]
#: Weights of geometries, rate models, coupling branches and laws.
W_RATE = {"seismic": 0.4, "geodetic": 0.6}
W_CHI = {"lo": (-0.1, 0.25), "mid": (0.0, 0.5), "hi": (0.1, 0.25)}
W_FORM = {"tgr": 0.7, "tapered": 0.3}
M_MIN, RIGIDITY = 6.0, 3e10


def load_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace of three points, dip, depths and a written dip direction for each supplier."""
    k, d = F.col("s_suppkey").cast("long"), F.lit
    lon, lat = -75.5 + (k * 7919 % 900) / 100.0, -55.5 + (k * 104729 % 3700) / 100.0
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    trace = F.array(point(lon, lat), point(lon + 0.1, lat + 0.3), point(lon + (k % 4) * 0.1 - 0.05, lat + 0.6))
    written = F.when(k % 5 == 1, "NE").when(k % 5 == 2, "255").when(k % 5 == 3, " sse ").when(k % 5 == 4, "unclear")
    dip, lower = (30 + k * 13 % 61).cast("double"), (10 + k % 11).cast("double")
    faults = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("fault"), trace.alias("trace"), dip.alias("dip"), lower.alias("lower"), written.alias("written"))
    return faults.select("fault", "trace", FA.down_dip_km(F.col("dip"), d(0.0), F.col("lower")).alias("width"), FA.dip_azimuth(F.col("written")).alias("azimuth"))


def f05_trace_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.trace_lengths(load_faults(spark, sf_dir)).select("fault", "place", F.round("km", 6).alias("km"))


def f07_dip_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_faults(spark, sf_dir).select("fault", F.round("width", 6).alias("width"), "azimuth")


def f06_buffer_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_catalog(spark, sf_dir).select("id", "lon", "lat")
    return FA.in_buffers(events, load_faults(spark, sf_dir), 10.0).select("id", "fault", F.round("km", 4).alias("km"))


def m22_event_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load_catalog(spark, sf_dir).select("id", "lon", "lat", "mag")
    return FA.audit_events(events, load_faults(spark, sf_dir), 10.0, 6.5, 6.0).select("id", "mag", "in_buffer", "claimed_by")


def m25_margin_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a tenth of a degree with their events of magnitude 6 or more a year."""
    large = load_catalog(spark, sf_dir).where("mag >= 6")
    row, col = F.floor(F.col("lat") * 10 + 0.5), F.floor(F.col("lon") * 10 + 0.5)
    cells = large.groupBy(row.alias("row"), col.alias("col")).agg((F.count(F.lit(1)) / 124).alias("rate"))
    cells = cells.select((F.col("row") * 10000 + F.col("col")).alias("cell"), (F.col("col") / 10).alias("lon"), (F.col("row") / 10).alias("lat"), "rate")
    found = FA.margin_sensitivity(cells, load_faults(spark, sf_dir), MARGINS)
    return found.select("margin_km", "n_cells", F.round("removed", 6).alias("removed"), F.round("fraction", 6).alias("fraction"))


def j09_side_of_trench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_catalog(spark, sf_dir).select("id", FA.side_of_line(F.col("lon"), F.col("lat"), TRENCH).alias("side"))


def j19_fault_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = F.col("trace")[1]
    return load_faults(spark, sf_dir).select("fault", FA.region_of(middle["lon"], middle["lat"], REGIONS, C.inside_polygon).alias("region"))


def a17_depth_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = load_catalog(spark, sf_dir).groupBy(F.floor("lat").alias("row"), F.floor(F.col("lon") * 4).alias("col")).agg(F.avg("depth").alias("depth"))
    return FA.depth_crossing(grid.withColumn("lon", F.col("col") / 4), "row", 35.0).select("row", F.round("lon", 6).alias("lon"))


def m10_branch_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and weights of the branches of each fault as a segment: one seismic and three geodetic rates, two laws each."""
    k = F.col("fault")
    faults = load_faults(spark, sf_dir).select("fault", "width").where("width > 0")
    held = faults.withColumns({"b": 0.8 + (k % 5) * 0.1, "m_max": 7.0 + (k % 10) * 0.1, "chi": 0.3 + (k % 8) * 0.1, "seismic": 0.01 + (k % 7) * 0.005, "full": RIGIDITY * F.col("width") * 1e3 * 6e4 * 0.05})
    forms = F.array(*(F.struct(F.lit(f).alias("form"), F.lit(w).alias("w"), FA.moment_per_unit_rate(f, F.col("b"), M_MIN, F.col("m_max")).alias("unit")) for f, w in W_FORM.items()))
    held = held.select("*", F.explode(forms).alias("f")).select("*", "f.form", "f.w", "f.unit")
    moved = lambda by: F.least(F.greatest(F.col("chi") + by, F.lit(0.0)), F.lit(1.0)) * F.col("full")
    row = lambda model, branch, rate, w: F.struct(F.lit(model).alias("model"), F.lit(branch).alias("branch"), rate.alias("rate"), (F.col("w") * w).alias("weight"))
    rows = [row("seismic", "-", F.col("seismic"), W_RATE["seismic"])] + [row("geodetic", n, moved(by) / F.col("unit"), W_RATE["geodetic"] * w) for n, (by, w) in W_CHI.items()]
    out = held.select("fault", "form", "unit", F.explode(F.array(*rows)).alias("r"))
    return out.select("fault", "form", "r.model", "r.branch", F.round("r.rate", 8).alias("rate"), F.round(magnitude(F.col("r.rate") * F.col("unit"), 9.05), 6).alias("moment_magnitude"), F.round("r.weight", 6).alias("weight"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return load_catalog(spark, sf_dir).select("id", (k * 37 % 359 + 0.5).alias("strike"), (15 + k % 70).cast("double").alias("dip"), (k * 53 % 340 - 169.75).alias("rake"))


DUCK_PLANES = f"{DUCK_CAT}, pl AS (SELECT id, id * 37 % 359 + 0.5e0 AS strike, (15 + id % 70)::DOUBLE AS dip, id * 53 % 340 - 169.75e0 AS rake FROM cat)"
PARTS = ("rr", "tt", "pp", "rt", "rp", "tp")
SIX = ("s1", "d1", "r1", "s2", "d2", "r2")


def f15_planes_of_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of events as tensors and back; the plane of the lesser strike comes first."""
    held = planes(spark, sf_dir)
    parts = ME.tensor_of_plane(F.col("strike"), F.col("dip"), F.col("rake"))
    tensors = held.select("id", *((v * (1 + F.col("id") % 9)).alias(n) for n, v in zip(PARTS, parts, strict=True)))
    both = [F.struct(*(F.round(n, 2).alias(m) for n, m in zip(SIX[i:i + 3], SIX[:3], strict=True))) for i in (0, 3)]
    ordered = ME.planes_of_tensor(tensors, PARTS, SIX).select("id", F.sort_array(F.array(*both)).alias("p"))
    return ordered.select("id", *(F.col("p")[i][n].alias(SIX[3 * i + j]) for i in (0, 1) for j, n in enumerate(SIX[:3])))


def f18_interface_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Either plane like a slab's, which strikes north and dips by 10 to 39 degrees."""
    c = F.col
    first = (c("strike"), c("dip"), c("rake"))
    held = planes(spark, sf_dir).withColumns(dict(zip(SIX[3:], ME.auxiliary_plane(*first), strict=True)))
    like = ME.interface_like([first, (c("s2"), c("d2"), c("r2"))], F.lit(4.0), 10.25 + c("id") % 30, 78.0)
    return held.select("id", like.alias("like"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        f05_trace_lengths, f07_dip_directions, f06_buffer_members, m22_event_audit, m25_margin_sensitivity, j09_side_of_trench, j19_fault_region,
        a17_depth_crossing, m10_branch_parameters, f15_planes_of_tensor, f18_interface_mechanism,
    )
}

_FAULTS = """raw AS (SELECT s_suppkey::BIGINT AS fault, -75.5e0 + (s_suppkey::BIGINT * 7919 % 900) / 100e0 AS x0, -55.5e0 + (s_suppkey::BIGINT * 104729 % 3700) / 100e0 AS y0 FROM supplier),
fault AS (SELECT fault, x0, y0, x0 + 0.1e0 AS x1, y0 + 0.3e0 AS y1, x0 + (fault % 4) * 0.1e0 - 0.05e0 AS x2, y0 + 0.6e0 AS y2,
  CASE WHEN 30 + fault * 13 % 61 >= 90 THEN 0e0 ELSE (10 + fault % 11)::DOUBLE / tan(radians((30 + fault * 13 % 61)::DOUBLE)) END AS width,
  CASE fault % 5 WHEN 1 THEN 45e0 WHEN 2 THEN 255e0 WHEN 3 THEN 157.5e0 END AS azimuth FROM raw)"""
_POINTS = "pt AS (" + " UNION ALL ".join(f"SELECT fault, {i} AS place, x{i} AS lon, y{i} AS lat FROM fault" for i in range(3)) + ")"


def _plane(axis: str, lon: str, lat: str) -> str:
    cos_c = f"(sin(radians(clat)) * sin(radians({lat})) + cos(radians(clat)) * cos(radians({lat})) * cos(radians({lon} - clon)))"
    east = f"(cos(radians({lat})) * sin(radians({lon} - clon)))"
    north = f"(cos(radians(clat)) * sin(radians({lat})) - sin(radians(clat)) * cos(radians({lat})) * cos(radians({lon} - clon)))"
    rho = f"sqrt(pow({east}, 2) + pow({north}, 2))"
    return f"CASE WHEN {rho} > 0 THEN 6371e0 * atan2({rho}, {cos_c}) / {rho} ELSE 6371e0 END * {east if axis == 'x' else north}"


def _near(points: str, margin: float) -> str:
    """CTEs up to ``hit`` (id, fault, km) of the points (id, lon, lat); bounds of 1.5 and 3 degrees lie beyond any buffer."""
    return f"""{_FAULTS}, long AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS la, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS lb FROM fault),
mid AS (SELECT *, (la * (x0 + x1) + lb * (x1 + x2)) / 2 / (la + lb) AS clon, (la * (y0 + y1) + lb * (y1 + y2)) / 2 / (la + lb) AS clat, azimuth IS NOT NULL AND width > 0 AS sided FROM long),
corner AS ({" UNION ALL ".join(f"SELECT fault, {i} AS i, {_plane('x', f'x{i}', f'y{i}')} AS x, {_plane('y', f'x{i}', f'y{i}')} AS y FROM mid" for i in range(3))}),
spread AS (SELECT fault, i, x, y FROM corner UNION ALL
  SELECT c.fault, i + 3, x + width * sin(radians(azimuth)), y + width * cos(radians(azimuth)) FROM corner c JOIN mid m ON c.fault = m.fault WHERE sided),
near AS (SELECT p.id, m.fault, sided, CASE WHEN sided THEN 0 ELSE width END AS slack, {_plane('x', 'p.lon', 'p.lat')} AS px, {_plane('y', 'p.lon', 'p.lat')} AS py
  FROM {points} p JOIN mid m ON abs(p.lat - clat) < 1.5 AND abs(p.lon - clon) < 3),
seg AS (SELECT n.id, n.fault, slack, px, py, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM near n JOIN spread a ON n.fault = a.fault
  JOIN spread b ON b.fault = a.fault AND (CASE WHEN sided THEN b.i > a.i ELSE b.i = a.i + 1 END)),
part AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM seg),
lined AS (SELECT id, fault, greatest(min(sqrt(pow(ax + t * dx - px, 2) + pow(ay + t * dy - py, 2))) - any_value(slack), 0) AS km FROM part GROUP BY id, fault),
tri AS (SELECT a.fault, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy FROM spread a JOIN spread b ON a.fault = b.fault AND a.i < b.i JOIN spread c ON c.fault = a.fault AND b.i < c.i),
side AS (SELECT id, n.fault, sign((bx - ax) * (py - ay) - (by_ - ay) * (px - ax)) AS u, sign((cx - bx) * (py - by_) - (cy - by_) * (px - bx)) AS v,
  sign((ax - cx) * (py - cy) - (ay - cy) * (px - cx)) AS w FROM near n JOIN tri t ON n.fault = t.fault WHERE sided),
within AS (SELECT DISTINCT id, fault FROM side WHERE u = v AND v = w AND u <> 0),
hit AS (SELECT l.id, l.fault, CASE WHEN w.id IS NULL THEN km ELSE 0 END AS km FROM lined l LEFT JOIN within w ON l.id = w.id AND l.fault = w.fault WHERE w.id IS NOT NULL OR km <= {margin})"""


def _on_line(line: list[tuple[float, float]], want: str, lon: str, lat: str) -> str:
    """Of the nearest point of a line in degrees: its longitude (x) or its squared distance (d)."""
    options = []
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        t = f"greatest(0, least(1, (({lon} - ({ax}e0)) * ({bx - ax}e0) + ({lat} - ({ay}e0)) * ({by - ay}e0)) / {(bx - ax) ** 2 + (by - ay) ** 2}e0))"
        x, y = f"({ax}e0 + {t} * ({bx - ax}e0))", f"({ay}e0 + {t} * ({by - ay}e0))"
        options.append(f"{{'d': pow({lon} - {x}, 2) + pow({lat} - {y}, 2), 'x': {x}}}")
    return f"list_min([{', '.join(options)}]).{want}"


def _box(polygon: list[tuple[float, float]]) -> str:
    sides = [(p, q) for p, q in zip(polygon, polygon[1:] + polygon[:1], strict=True) if p[1] != q[1]]
    return "(" + " + ".join(f"((({y1}e0 > y1) <> ({y2}e0 > y1)) AND x1 < ({x2 - x1}e0) * (y1 - ({y1}e0)) / ({y2 - y1}e0) + ({x1}e0))::INT" for (x1, y1), (x2, y2) in sides) + ") % 2 = 1"


_N = ("-sin(radians({s})) * 0 + cos(radians({s})) * sin(radians({d}))", "-sin(radians({s})) * sin(radians({d}))", "cos(radians({d}))")
_S = (
    "cos(radians({r})) * sin(radians({s})) - sin(radians({r})) * cos(radians({s})) * cos(radians({d}))",
    "cos(radians({r})) * cos(radians({s})) + sin(radians({r})) * sin(radians({s})) * cos(radians({d}))",
    "sin(radians({r})) * sin(radians({d}))",
)
_VECTORS = ", ".join([f"{t.format(s='strike', d='dip', r='rake')} AS n{a}" for a, t in zip("enu", _N, strict=True)] + [f"{t.format(s='strike', d='dip', r='rake')} AS s{a}" for a, t in zip("enu", _S, strict=True)])
# the other plane: the slip is its normal, turned upwards
_OTHER = f"""v AS (SELECT *, {_VECTORS} FROM pl), up AS (SELECT *, CASE WHEN su < 0 THEN -1 ELSE 1 END AS k FROM v),
aux AS (SELECT *, (degrees(atan2(-k * sn, k * se)) + 360) % 360 AS strike2, degrees(acos(least(k * su, 1))) AS dip2 FROM up),
oth AS (SELECT *, degrees(atan2(k * nu / sin(radians(dip2)), k * (ne * sin(radians(strike2)) + nn * cos(radians(strike2))))) AS rake2 FROM aux)"""
_M0 = lambda m: f"pow(10, 1.5e0 * ({m}) + 9.05e0)"
_TAP = lambda m: f"(pow({_M0('6e0')} / {_M0(m)}, 2 * b / 3) * exp(({_M0('6e0')} - {_M0(m)}) / {_M0('m_max')}))"

ORACLES: dict[str, str] = {
    "f05_trace_lengths": f"""WITH {_FAULTS}, {_POINTS}, ab AS (SELECT a.fault, b.place, {KM} AS km FROM pt a JOIN pt b ON a.fault = b.fault AND b.place = a.place + 1)
SELECT pt.fault, pt.place, round(coalesce(sum(ab.km), 0), 6) AS km FROM pt LEFT JOIN ab ON pt.fault = ab.fault AND ab.place <= pt.place GROUP BY pt.fault, pt.place""",
    "f07_dip_directions": f"WITH {_FAULTS} SELECT fault, round(width, 6) AS width, azimuth FROM fault",
    "f06_buffer_members": f"WITH {DUCK_CAT}, {_near('cat', 10.0)} SELECT id, fault, round(km, 4) AS km FROM hit",
    "m22_event_audit": f"""WITH {DUCK_CAT}, {_near('cat', 10.0)}
SELECT id, mag, id IN (SELECT id FROM hit) AS in_buffer, CASE WHEN mag >= 6.5 AND id IN (SELECT id FROM hit) THEN 'faults' ELSE 'background' END AS claimed_by FROM cat WHERE mag >= 6""",
    "m25_margin_sensitivity": f"""WITH {DUCK_CAT}, rc AS (SELECT floor(lat * 10 + 0.5) AS r, floor(lon * 10 + 0.5) AS c, count(*) / 124 AS rate FROM cat WHERE mag >= 6 GROUP BY ALL),
cell AS (SELECT r * 10000 + c AS id, c / 10 AS lon, r / 10 AS lat, rate FROM rc), {_near('cell', 20.0)}, best AS (SELECT id, min(km) AS km FROM hit GROUP BY id)
SELECT margin_km, count(b.id) AS n_cells, round(coalesce(sum(c.rate) FILTER (b.id IS NOT NULL), 0), 6) AS removed, round(coalesce(sum(c.rate) FILTER (b.id IS NOT NULL), 0) / sum(c.rate), 6) AS fraction
FROM (SELECT unnest({MARGINS})::DOUBLE AS margin_km) m CROSS JOIN cell c LEFT JOIN best b ON b.id = c.id AND b.km <= margin_km GROUP BY margin_km""",
    "j09_side_of_trench": f"""WITH {DUCK_CAT}, s AS (SELECT id, lon, {_on_line(TRENCH, 'x', 'lon', 'lat')} AS x FROM cat)
SELECT id, CASE WHEN lon < x THEN 'west' WHEN lon > x THEN 'east' ELSE 'on' END AS side FROM s""",
    "j19_fault_region": f"""WITH {_FAULTS} SELECT fault, CASE WHEN {_box(REGIONS['north'])} THEN 'north' WHEN {_box(REGIONS['south'])} THEN 'south'
WHEN {_on_line([*REGIONS['north'], REGIONS['north'][0]], 'd', 'x1', 'y1')} <= {_on_line([*REGIONS['south'], REGIONS['south'][0]], 'd', 'x1', 'y1')} THEN 'north' ELSE 'south' END AS region FROM fault""",
    "a17_depth_crossing": f"""WITH {DUCK_CAT}, g AS (SELECT floor(lat)::BIGINT AS r, floor(lon * 4) / 4 AS lon, avg(depth) AS z FROM cat GROUP BY ALL),
nx AS (SELECT a.r, a.lon, a.z, arg_min(b.z, b.lon) AS z2, min(b.lon) AS lon2 FROM g a JOIN g b ON a.r = b.r AND b.lon > a.lon GROUP BY ALL)
SELECT r AS row, round(min(CASE WHEN z = z2 THEN lon ELSE lon + (35 - z) / (z2 - z) * (lon2 - lon) END), 6) AS lon FROM nx WHERE least(z, z2) <= 35 AND greatest(z, z2) >= 35 GROUP BY r""",
    "m10_branch_parameters": f"""WITH {_FAULTS}, h AS (SELECT fault, 0.8e0 + (fault % 5) * 0.1e0 AS b, 7e0 + (fault % 10) * 0.1e0 AS m_max, 0.3e0 + (fault % 8) * 0.1e0 AS chi, 0.01e0 + (fault % 7) * 0.005e0 AS seismic,
  3e10 * width * 1e3 * 6e4 * 0.05e0 AS full_, 100 + (fault % 10) * 10 AS n FROM fault WHERE width > 0),
st AS (SELECT h.*, 6e0 + k * 0.01e0 AS lo, 6e0 + (k + 1) * 0.01e0 AS hi, 6e0 + (k + 0.5e0) * 0.01e0 AS m FROM h, range(0, 190) t(k) WHERE k < n),
u AS (SELECT fault, sum((pow(10, -b * lo) - pow(10, -b * hi)) / (pow(10, -b * 6) - pow(10, -b * m_max)) * {_M0('m')}) AS tgr,
  sum(({_TAP('lo')} - {_TAP('hi')}) / (1 - {_TAP('m_max')}) * {_M0('m')}) AS tapered FROM st GROUP BY fault),
f AS (SELECT h.*, 'tgr' AS form, 0.7e0 AS w, tgr AS unit FROM h JOIN u USING (fault) UNION ALL SELECT h.*, 'tapered', 0.3e0, tapered FROM h JOIN u USING (fault)),
r AS (SELECT fault, form, unit, 'seismic' AS model, '-' AS branch, seismic AS rate, w * 0.4e0 AS weight FROM f UNION ALL
  SELECT fault, form, unit, 'geodetic', br, greatest(least(chi + by_, 1), 0) * full_ / unit, w * 0.6e0 * share FROM f, (VALUES ('lo', -0.1e0, 0.25e0), ('mid', 0e0, 0.5e0), ('hi', 0.1e0, 0.25e0)) c(br, by_, share))
SELECT fault, form, model, branch, round(rate, 8) AS rate, round((log10(rate * unit) - 9.05e0) / 1.5e0, 6) AS moment_magnitude, round(weight, 6) AS weight FROM r""",
    "f15_planes_of_tensor": f"""WITH {DUCK_PLANES}, {_OTHER}, two AS (SELECT id, round(strike, 2) AS a, round(dip, 2) AS b, round(rake, 2) AS c, round(strike2, 2) AS d, round(dip2, 2) AS e, round(rake2, 2) AS f FROM oth)
SELECT id, CASE WHEN a <= d THEN a ELSE d END AS s1, CASE WHEN a <= d THEN b ELSE e END AS d1, CASE WHEN a <= d THEN c ELSE f END AS r1,
  CASE WHEN a <= d THEN d ELSE a END AS s2, CASE WHEN a <= d THEN e ELSE b END AS d2, CASE WHEN a <= d THEN f ELSE c END AS r2 FROM two""",
    "f18_interface_mechanism": f"""WITH {DUCK_PLANES}, v AS (SELECT *, {_VECTORS}, 10.25e0 + id % 30 AS slab FROM pl),
w AS (SELECT *, cos(radians(4)) * sin(radians(slab)) AS e, -sin(radians(4)) * sin(radians(slab)) AS n, cos(radians(slab)) AS u FROM v), q AS (SELECT *, se * sin(radians(strike)) + sn * cos(radians(strike)) AS q, (nn * se - ne * sn) / (se * se + sn * sn) AS w, CASE WHEN su < 0 THEN -1 ELSE 1 END AS k FROM w)
SELECT id, (abs(ne * e + nn * n + nu * u) >= cos(radians(35)) AND (2 * q * sin(radians(strike)) - se) * sin(radians(78)) + (2 * q * cos(radians(strike)) - sn) * cos(radians(78)) >= 0)
  OR (abs(se * e + sn * n + su * u) >= cos(radians(35)) AND k * ((-2 * sn * w - ne) * sin(radians(78)) + (2 * se * w - nn) * cos(radians(78))) >= 0) AS "like" FROM q""",
}
