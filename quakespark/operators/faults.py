"""Faults and lines: widths, buffers, audits, sides, crossings and lengths, as joins and column expressions.

A fault is a row with ``fault``, ``trace`` (array of struct<lon, lat>, in order), ``width`` (km of the surface
projection down the dip) and ``azimuth`` (of the dip; null: both sides). Traces are rows of bounded size.
Null places match no fault, faults without a trace of two points or without a width match no place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.functions.columns import EARTH_KM, haversine_km

#: Sixteen compass points, 22.5 degrees apart from north.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
TILE = 0.5


def down_dip_km(dip: Column, upper: Column, lower: Column) -> Column:
    """Horizontal width of a dipping plane between two depths; 0 for vertical planes and for depths in reverse."""
    return F.when(dip >= 90, 0.0).otherwise(F.greatest(lower - upper, F.lit(0.0)) / F.tan(F.radians(dip)))


def dip_azimuth(text: Column) -> Column:
    """Azimuth in 0..360 of a compass point or a number; null for any other text."""
    held = F.upper(F.trim(text))
    points = F.create_map(*(F.lit(v) for i, n in enumerate(COMPASS) for v in (n, i * 22.5)))
    return F.coalesce(F.try_element_at(points, held), F.pmod(held.try_cast("double"), F.lit(360.0)))


def _project(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Azimuthal equidistant places in km about a centre."""
    f, f0, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    east, north = F.cos(f) * F.sin(d), F.cos(f0) * F.sin(f) - F.sin(f0) * F.cos(f) * F.cos(d)
    rho = F.sqrt(east * east + north * north)
    scale = F.when(rho > 0, EARTH_KM * F.atan2(rho, F.sin(f0) * F.sin(f) + F.cos(f0) * F.cos(f) * F.cos(d)) / rho).otherwise(EARTH_KM)
    return scale * east, scale * north


def _steps(points: Column) -> Column:
    """Pairs of neighbours of an array."""
    n = F.size(points) - 1
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + of(v))


def _segment_km(s: Column, x: Column, y: Column) -> Column:
    ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
    squared = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    t = F.when(squared > 0, F.least(F.greatest(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / squared, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.sqrt(F.pow(ax + t * (bx - ax) - x, 2) + F.pow(ay + t * (by - ay) - y, 2))


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns out of an array of one row, through which no later filter writes out their expressions anew."""
    packed = F.explode(F.array(F.struct(*(v.alias(n) for n, v in columns.items())))).alias("__new")
    return df.select("*", packed).select(*df.columns, "__new.*")


def _outlines(faults: DataFrame, margin: float) -> DataFrame:
    """Each fault's centre, its corners and lines in km about it, and the radius that holds its buffer."""
    c = F.col
    held = faults.where((F.size("trace") >= 2) & c("width").isNotNull()).select("fault", "trace", "width", c("azimuth").isNotNull() & (c("width") > 0), "azimuth").toDF("fault", "trace", "width", "sided", "azimuth")
    steps = _steps(c("trace"))
    length = lambda s: F.hypot(s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"])
    total = _sum(steps, length)
    middle = lambda n: F.when(total > 0, _sum(steps, lambda s: length(s) * (s["a"][n] + s["b"][n]) / 2) / total).otherwise(c("trace")[0][n])
    held = _fixed(held, lon0=middle("lon"), lat0=middle("lat"))
    flat = F.transform("trace", lambda p: F.struct(*(v.alias(n) for n, v in zip("xy", _project(p["lon"], p["lat"], c("lon0"), c("lat0")), strict=True))))
    held = _fixed(held, flat=flat)
    az = F.radians("azimuth")
    shifted = F.transform("flat", lambda p: F.struct((p["x"] + c("width") * F.sin(az)).alias("x"), (p["y"] + c("width") * F.cos(az)).alias("y")))
    held = _fixed(held, corners=F.when(c("sided"), F.concat("flat", shifted)).otherwise(c("flat")))
    pairs = F.flatten(F.transform("corners", lambda p, i: F.transform(F.slice(c("corners"), i + 2, F.size("corners")), lambda q: F.struct(p.alias("a"), q.alias("b")))))
    slack = F.when(c("sided"), 0.0).otherwise(c("width"))
    held = _fixed(held, lines=F.when(c("sided"), pairs).otherwise(_steps(c("flat"))), slack=slack)
    radius = F.array_max(F.transform("corners", lambda p: F.hypot(p["x"], p["y"]))) + c("slack") + margin + 1e-6
    return _fixed(held, radius=radius).select("fault", "lon0", "lat0", "sided", "corners", "lines", "slack", "radius")


def _places_in_buffers(points: DataFrame, faults: DataFrame, margin: float) -> DataFrame:
    """(__lon, __lat, fault, km): the different places of ``points`` with each ``fault`` whose area lies within ``margin`` km.

    A fault's area is its trace widened by its width on both sides or, where its azimuth is known, the convex hull
    of its trace and the trace moved down the dip. Distances are taken in an azimuthal equidistant plane about the
    trace's centre. Points of one place are measured once; places meet faults in tiles of half a degree that the buffer
    may reach, a place is in one tile, so a pair meets once. The hull's nearest line is among the lines between its corners, and a point is inside
    where its directions to the corners leave no gap of half a turn.
    """
    c = F.col
    reach = F.degrees(c("radius") / EARTH_KM)
    ratio = F.sin(F.least(c("radius") / EARTH_KM, F.lit(math.pi / 2))) / F.cos(F.radians("lat0"))
    wide = F.when(ratio < 1, F.degrees(F.asin(F.least(ratio, F.lit(1.0))))).otherwise(180.0)
    span = lambda at, by: F.sequence(F.floor((at - by) / TILE), F.floor((at + by) / TILE))
    turn = F.lit(int(360 / TILE))
    tiled = _outlines(faults, margin).withColumn("__row", F.explode(span(c("lat0"), reach)))
    tiled = tiled.withColumn("__col", F.explode(F.array_distinct(F.transform(span(c("lon0"), wide), lambda i: F.pmod(i, turn)))))
    places = points.select(c("lon").alias("__lon"), c("lat").alias("__lat")).where("__lon is not null and __lat is not null").distinct()
    keyed = places.withColumns({"__row": F.floor(c("__lat") / TILE), "__col": F.pmod(F.floor(c("__lon") / TILE), turn)})
    # few bytes, much work: a set number of parts, which are not put together again
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed, tiled = (df.repartition(n, "__row", "__col") for df in (keyed, tiled))
    # no place outside the radius about the centre is within the buffer
    met = keyed.join(tiled, ["__row", "__col"]).where(haversine_km(c("__lat"), c("__lon"), c("lat0"), c("lon0")) <= c("radius"))
    x, y = _project(c("__lon"), c("__lat"), c("lon0"), c("lat0"))
    met = _fixed(met, __x=x, __y=y)
    turns = F.sort_array(F.transform("corners", lambda p: F.atan2(p["y"] - c("__y"), p["x"] - c("__x"))))
    met = _fixed(met, __turns=F.when(c("sided"), turns))
    gaps = F.transform(_steps(c("__turns")), lambda s: s["b"] - s["a"])
    gap = F.greatest(F.array_max(gaps), 2 * math.pi - (F.element_at("__turns", -1) - c("__turns")[0]))
    nearest = F.array_min(F.transform("lines", lambda s: _segment_km(s, c("__x"), c("__y"))))
    km = F.when(c("sided") & (gap < math.pi), 0.0).otherwise(F.greatest(nearest - c("slack"), F.lit(0.0)))
    return _fixed(met, __km=km).where(c("__km") <= margin).select("__lon", "__lat", "fault", c("__km").alias("km"))


def _placed(points: DataFrame) -> DataFrame:
    return points.select(F.struct(*(f"`{n}`" for n in points.columns)).alias("__point"), F.col("lon").alias("__lon"), F.col("lat").alias("__lat"))


def in_buffers(points: DataFrame, faults: DataFrame, margin: float) -> DataFrame:
    """``points`` (lon, lat) with each ``fault`` whose area lies within ``margin`` km, and the ``km`` to it (0 inside)."""
    return _placed(points).join(_places_in_buffers(points, faults, margin), ["__lon", "__lat"]).select("__point.*", "fault", "km")


def audit_events(events: DataFrame, faults: DataFrame, margin: float, cap: float, least: float) -> DataFrame:
    """Events (id, lon, lat, mag) of ``least`` or more: inside a buffer or not, and the part of the model that holds their magnitude."""
    large = events.where(F.col("mag") >= least)
    inside = _places_in_buffers(large, faults, margin).select("__lon", "__lat").distinct().withColumn("__in", F.lit(True))
    audited = _placed(large).join(inside, ["__lon", "__lat"], "left").select("__point.*", F.coalesce("__in", F.lit(False)).alias("in_buffer"))
    return audited.withColumn("claimed_by", F.when((F.col("mag") >= cap) & F.col("in_buffer"), "faults").otherwise("background"))


def margin_sensitivity(cells: DataFrame, faults: DataFrame, margins: list[float]) -> DataFrame:
    """For each margin the number of cells (cell, lon, lat, rate) inside the buffers, their rate and its share of all.

    Cells meet faults once, at the widest margin; each margin then keeps the cells that are near enough.
    """
    nearest = _places_in_buffers(cells, faults, max(margins)).groupBy("__lon", "__lat").agg(F.min("km").alias("__km"))
    near = _placed(cells).join(nearest, ["__lon", "__lat"]).select("__point.*", F.col("__km").alias("km"))
    total = cells.agg(F.sum("rate").alias("total"))
    within = lambda m, v: F.when(F.col("km") <= m, v)
    wide = near.agg(*(e.alias(f"{n}{i}") for i, m in enumerate(margins) for n, e in (("n", F.count(within(m, F.lit(1)))), ("r", F.coalesce(F.sum(within(m, F.col("rate"))), F.lit(0.0))))))
    rows = F.array(*(F.struct(F.lit(float(m)).alias("margin_km"), F.col(f"n{i}").alias("n_cells"), F.col(f"r{i}").alias("removed")) for i, m in enumerate(margins)))
    # both sides are one row
    return wide.join(F.broadcast(total)).select(F.explode(rows).alias("row"), "total").select("row.*", (F.col("row.removed") / F.when(F.col("total") > 0, F.col("total"))).alias("fraction"))


def nearest_on_line(lon: Column, lat: Column, line: list[tuple[float, float]]) -> Column:
    """Squared degrees (d) to a line of literal points, and the place of its nearest point (x, y); ties: the westernmost."""
    found = []
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        squared = (bx - ax) ** 2 + (by - ay) ** 2
        t = F.least(F.greatest(((lon - ax) * (bx - ax) + (lat - ay) * (by - ay)) / (squared or 1.0), F.lit(0.0)), F.lit(1.0))
        x, y = ax + t * (bx - ax), ay + t * (by - ay)
        found.append(F.struct((F.pow(lon - x, 2) + F.pow(lat - y, 2)).alias("d"), x.alias("x"), y.alias("y")))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.array_min(F.array(*found)))


def side_of_line(lon: Column, lat: Column, line: list[tuple[float, float]]) -> Column:
    """"west" or "east" of the line's nearest point, "on" at its longitude; null for null places."""
    x = nearest_on_line(lon, lat, line)["x"]
    return F.when(lon < x, "west").when(lon > x, "east").when(lon == x, "on")


def region_of(lon: Column, lat: Column, regions: dict[str, list[tuple[float, float]]], inside) -> Column:
    """The first region that holds a place, else the nearest one (ties: the first); ``inside(lon, lat, polygon)`` tests."""
    held = F.coalesce(*(F.when(inside(lon, lat, p), n) for n, p in regions.items()))
    ranked = F.array(*(F.struct(nearest_on_line(lon, lat, [*p, p[0]])["d"].alias("d"), F.lit(i), F.lit(n).alias("n")) for i, (n, p) in enumerate(regions.items())))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.coalesce(held, F.array_min(ranked)["n"]))


def depth_crossing(grid: DataFrame, row: str, depth: float) -> DataFrame:
    """For each row of a grid (``row``, lon, depth) the westernmost longitude at which the depth is crossed, interpolated."""
    ahead = Window.partitionBy(row).orderBy("lon")
    pairs = grid.select(row, "lon", "depth", F.lead("lon").over(ahead).alias("lon2"), F.lead("depth").over(ahead).alias("depth2"))
    c = F.col
    share = F.when(c("depth2") != c("depth"), (depth - c("depth")) / (c("depth2") - c("depth"))).otherwise(0.0)
    hit = pairs.where((c("depth") - depth) * (c("depth2") - depth) <= 0)
    return hit.groupBy(row).agg(F.min(c("lon") + share * (c("lon2") - c("lon"))).alias("lon"))


def trace_lengths(faults: DataFrame) -> DataFrame:
    """Each point of each trace (fault, place from 0) with the km along the trace to it; the last is the trace's length."""
    points = faults.select("fault", F.posexplode("trace").alias("place", "p")).select("fault", "place", "p.*")
    order = Window.partitionBy("fault").orderBy("place")
    step = F.coalesce(haversine_km(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon")), F.lit(0.0))
    return points.withColumn("step", step).withColumn("km", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def moment_per_unit_rate(form: str, b: Column, m_min: float, m_max: Column, c: float = 9.05, width: float = 0.01) -> Column:
    """N m a year of a law with one event a year at or above ``m_min``: steps of ``width``, moments at their middles.

    ``form``: "tgr", doubly truncated, or "tapered", its corner at ``m_max`` and renormalised there.
    """
    moment = lambda m: F.pow(F.lit(10.0), 1.5 * m + c)
    power = lambda m: F.pow(F.lit(10.0), -b * m)
    low = F.lit(m_min)
    if form == "tgr":
        above = lambda m: F.greatest((power(m) - power(m_max)) / (power(low) - power(m_max)), F.lit(0.0))
    else:
        taper = lambda m: F.pow(moment(low) / moment(m), 2 * b / 3) * F.exp((moment(low) - moment(m)) / moment(m_max))
        above = lambda m: F.when(m > m_max, 0.0).otherwise(F.greatest((taper(m) - taper(m_max)) / (1 - taper(m_max)), F.lit(0.0)))
    steps = F.sequence(F.lit(0), F.ceil((m_max - m_min) / width - 1e-9).cast("int") - 1)
    return _sum(steps, lambda k: F.greatest(above(m_min + k * width) - above(m_min + (k + 1) * width), F.lit(0.0)) * moment(m_min + (k + 0.5) * width))
