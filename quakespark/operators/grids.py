"""Grids, trees and geometry: quadtree aggregation, nearest nodes, ellipses around places, gap filling, areas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakespark.functions.columns import haversine_km

#: A mechanism that stands for an unknown one, and its fields.
PLANES = ("strike1", "dip1", "rake1", "strike2", "dip2", "rake2")
DEFAULT_PLANES = (0.0, 45.0, 90.0, 180.0, 45.0, 90.0)
TENSOR = ("Mrr", "Mtt", "Mpp", "Mrt", "Mrp", "Mtp")
#: Rakes of rupture types.
RAKES = {
    "reverse": 90.0, "normal": -90.0, "dextral": 180.0, "sinistral": 0.0, "dextral-reverse": 135.0, "sinistral-reverse": 45.0,
    "dextral-normal": -135.0, "sinistral-normal": -45.0,
}
EARTH_KM = 6371.0


def _boxes(digits: Column, box: tuple[float, float, float, float]) -> Column:
    """The box (xmin, ymin, xmax, ymax) of a path of quadrants: 0 NW, 1 NE, 2 SW, 3 SE."""
    start = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), box, strict=True)))

    def halved(b: Column, q: Column) -> Column:
        x, y, east, south = 0.5 * (b["xmin"] + b["xmax"]), 0.5 * (b["ymin"] + b["ymax"]), q % 2 == 1, q >= 2
        return F.struct(
            F.when(east, x).otherwise(b["xmin"]).alias("xmin"), F.when(south, b["ymin"]).otherwise(y).alias("ymin"),
            F.when(east, b["xmax"]).otherwise(x).alias("xmax"), F.when(south, y).otherwise(b["ymax"]).alias("ymax"),
        )

    return F.aggregate(digits, start, halved)


def _path(lon: Column, lat: Column, box: tuple[float, float, float, float], depth: int) -> Column:
    """The quadrants, one character a level, that lead to a point; west and south edges belong to the halves before them."""
    start = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), box, strict=True)), F.lit("").alias("path"))

    def stepped(b: Column, _: Column) -> Column:
        x, y = 0.5 * (b["xmin"] + b["xmax"]), 0.5 * (b["ymin"] + b["ymax"])
        east, north = lon > x, lat > y
        return F.struct(
            F.when(east, x).otherwise(b["xmin"]).alias("xmin"), F.when(north, y).otherwise(b["ymin"]).alias("ymin"),
            F.when(east, b["xmax"]).otherwise(x).alias("xmax"), F.when(north, b["ymax"]).otherwise(y).alias("ymax"),
            F.concat(b["path"], (east.cast("int") + 2 * (~north).cast("int")).cast("string")).alias("path"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, stepped, lambda b: b["path"])


def quadtree(points: DataFrame, box: tuple[float, float, float, float], most_points: int, most_depth: int = 10, least_size: float = 0.0) -> DataFrame:
    """Leaves of an adaptive quadtree: path, depth, xmin, ymin, xmax, ymax, n, total, log_total (log10 of total + 1).

    points: lon, lat, value, inside the box. A node is split into four, empty ones too, while it holds more than
    ``most_points`` points, lies above ``most_depth`` and is not narrower than ``least_size``. Points are summed by their
    deepest quadrant first; the nodes above are sums of those rows, so no point is copied and no node is gathered.
    """
    cells = points.groupBy(_path(F.col("lon"), F.col("lat"), box, most_depth).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    level = F.explode(F.sequence(F.lit(0), F.lit(most_depth)))
    nodes = cells.withColumn("depth", level).groupBy(F.substring("path", F.lit(1), F.col("depth")).alias("path")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    size, depth = min(box[2] - box[0], box[3] - box[1]), F.length("path")
    split = (F.col("n") > most_points) & (depth < most_depth) & (F.lit(size) / F.pow(F.lit(2.0), depth) >= least_size)
    inner = nodes.where(split).select("path")
    children = inner.select(F.explode(F.array(*(F.concat("path", F.lit(str(q))) for q in range(4)))).alias("path"))
    root = points.sparkSession.createDataFrame([("",)], "path string")
    leaves = root.union(children).join(inner, "path", "left_anti").join(nodes, "path", "left")
    b = _boxes(F.transform(F.regexp_extract_all("path", F.lit("."), F.lit(0)), lambda q: q.cast("int")), box)
    held = leaves.select("path", depth.cast("long").alias("depth"), b.alias("b"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))
    return held.select("path", "depth", "b.*", "n", "total", F.log10(F.col("total") + 1).alias("log_total"))


def nearest_node(events: DataFrame, nodes: DataFrame, most_km: float, most_latitude: float = 60.0) -> DataFrame:
    """(id, node, depth, km): of each event the node nearest in degrees, or nulls if it is farther than ``most_km``.

    events: id, lon, lat; nodes: node, lon, lat, depth. Nodes go to the nine tiles around theirs. A tile is so wide that
    a node outside of these lies beyond ``most_km`` at latitudes up to ``most_latitude``.
    """
    wide = 1.05 * most_km / 111.0 / math.cos(math.radians(most_latitude))
    tile = lambda c: F.floor(F.col(c) / wide)
    around = lambda c: F.explode(F.sequence(tile(c) - 1, tile(c) + 1))
    near = nodes.withColumn("tx", around("lon")).withColumn("ty", around("lat")).select("tx", "ty", "node", F.col("lon").alias("nx"), F.col("lat").alias("ny"), "depth")
    c = F.col
    order = F.struct((F.pow(c("lon") - c("nx"), 2) + F.pow(c("lat") - c("ny"), 2)).alias("d"), c("node"))
    best = (
        events.withColumns({"tx": tile("lon"), "ty": tile("lat")}).join(near, ["tx", "ty"]).groupBy("id")
        .agg(F.min_by(F.struct("node", "depth", haversine_km(c("lat"), c("lon"), c("ny"), c("nx")).alias("km")), order).alias("best")).where(c("best.km") <= most_km)
    )
    return events.select("id").join(best, "id", "left").select("id", "best.node", "best.depth", "best.km")


def depth_range(events: DataFrame, nodes: DataFrame, fallback: DataFrame, wide: float = 1.0) -> DataFrame:
    """(id, low, high): least and greatest depth of the nodes in each event's error ellipse, else the depth of ``fallback``.

    events: id, lon, lat, lon_error, lat_error (degrees); fallback: id, depth. Events go to all tiles of ``wide`` degrees
    that their ellipse touches; errors that aren't positive in either direction make no ellipse.
    """
    c = F.col
    sx, sy = F.greatest(c("lon_error"), F.lit(1e-12)), F.greatest(c("lat_error"), F.lit(1e-12))
    tiles = lambda at, s: F.explode(F.sequence(F.floor((c(at) - s) / wide), F.floor((c(at) + s) / wide)))
    asked = events.where("lon_error is not null and lat_error is not null and (lon_error > 0 or lat_error > 0)").withColumn("tx", tiles("lon", sx)).withColumn("ty", tiles("lat", sy))
    held = nodes.select(F.floor(c("lon") / wide).alias("tx"), F.floor(c("lat") / wide).alias("ty"), c("lon").alias("nx"), c("lat").alias("ny"), "depth")
    met = (
        asked.join(held, ["tx", "ty"]).where(F.pow((c("nx") - c("lon")) / sx, 2) + F.pow((c("ny") - c("lat")) / sy, 2) <= 1)
        .groupBy("id").agg(F.min("depth").alias("low"), F.max("depth").alias("high"))
    )
    return events.select("id").join(met, "id", "left").join(fallback.select("id", "depth"), "id", "left").select("id", F.coalesce("low", "depth").alias("low"), F.coalesce("high", "depth").alias("high"))


def rake_of(kind: Column, default: float = 90.0) -> Column:
    """The rake of a rupture type, in any case of letters and with spaces around; types that aren't known, and nulls, have the default."""
    return F.coalesce(F.create_map(*(F.lit(v) for pair in RAKES.items() for v in pair))[F.lower(F.trim(kind))], F.lit(default))


def is_default_mechanism(values: dict[str, Column] | None = None, slack: float = 1e-6) -> Column:
    """Whether six plane angles are the stand-in for an unknown mechanism; false if one is missing."""
    held = values or {n: F.col(n) for n in PLANES}
    turn = lambda n: F.pmod(held[n], F.lit(360.0)) if n.startswith("strike") else held[n]
    same = [F.abs(turn(n) - v) <= slack for n, v in zip(PLANES, DEFAULT_PLANES, strict=True)]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return F.coalesce(out, F.lit(False))


def fill_gaps(events: DataFrame, matches: DataFrame) -> DataFrame:
    """``events`` with missing tensor components and plane angles taken from their match, never overwriting one.

    A match gives its tensor only if it is complete, and its planes only if they are complete and not the stand-in.
    matches: id and the twelve fields, at most one row for each event.
    """
    named = {n: F.col(f"m_{n}") for n in (*TENSOR, *PLANES)}
    full = lambda names: F.forall(F.array(*(named[n] for n in names)), lambda v: v.isNotNull())
    gives = {n: full(TENSOR) for n in TENSOR} | {n: full(PLANES) & ~is_default_mechanism({p: named[p] for p in PLANES}) for n in PLANES}
    both = events.join(matches.select("id", *(F.col(n).alias(f"m_{n}") for n in named)), "id", "left")
    filled = both.withColumns({n: F.coalesce(F.col(n), F.when(gives[n], named[n])) for n in named})
    return filled.select(*events.columns)


def triangle_km2(corners: list[tuple[Column, Column, Column]]) -> Column:
    """The area of a triangle of points (lon, lat, depth in km) below a sphere."""
    def xyz(lon: Column, lat: Column, depth: Column) -> list[Column]:
        r, x, y = F.lit(EARTH_KM) - depth, F.radians(lon), F.radians(lat)
        return [r * F.cos(y) * F.cos(x), r * F.cos(y) * F.sin(x), r * F.sin(y)]

    a, b, c = (xyz(*p) for p in corners)
    u, v = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return 0.5 * F.sqrt(sum((x * x for x in cross[1:]), cross[0] * cross[0]))


def summed_rates(sources: DataFrame) -> DataFrame:
    """(bin, rate): the rates of all sources added bin by bin, with zero for bins between the first and the last that no source has.

    sources: source, bin (integer), rate.
    """
    ends = sources.agg(F.min("bin").alias("low"), F.max("bin").alias("high")).where("low is not null")
    spine = ends.select(F.explode(F.sequence("low", "high")).alias("bin"))
    return spine.join(sources.groupBy("bin").agg(F.sum("rate").alias("rate")), "bin", "left").select("bin", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def method_windows(m: Column, method: str) -> tuple[Column, Column]:
    """Space (km) and time (days) windows of a declustering method: gk74, uhrhammer or gruenthal."""
    ten = lambda x: F.pow(F.lit(10.0), x)
    if method == "gk74":
        return ten(0.1238 * m + 0.983), F.when(m >= 6.5, ten(0.032 * m + 2.7389)).otherwise(ten(0.5409 * m - 0.547))
    if method == "uhrhammer":
        return F.exp(-1.024 + 0.804 * m), F.exp(-2.87 + 1.235 * m)
    if method == "gruenthal":
        root = lambda a, b: F.sqrt(F.greatest(a + b * m, F.lit(0.0)))
        return F.exp(1.77 + root(0.037, 1.02)), F.when(m >= 6.5, ten(2.8 + 0.024 * m)).otherwise(F.exp(-3.95 + root(0.62, 17.32)))
    raise ValueError(f"unknown method {method}")
