"""Polygons as rows: membership of points, overlaps, dissolved groups, cells cut by polygons, and rates that are capped or dealt out by them.

A polygon is one row or more of poly and rings (``array<array<struct<lon, lat>>>``): of each row the first ring is
the outline and the others are holes; rings are closed whether or not the first corner is repeated. Edges are straight in
longitude and latitude. A point is inside if an odd number of edges lies east of it, so that rows of one ``poly``
must not overlap each other. Null polygons and rings of fewer than three corners hold nothing.

Polygons meet points and each other by tiles of ``wide`` degrees, and each tile's row holds only the edges of its
band of latitude, so that the work for a point grows with these and not with the whole outline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.functions.columns import EARTH_KM, let
from quakespark.operators.graph import connected_components
from quakespark.session import discard, materialise

CORNER = "struct<lon: double, lat: double>"


def corner(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def ring_edges(ring: Column) -> Column:
    """The edges (x1, y1, x2, y2) of a ring, the closing one included, without those of no length."""
    pairs = F.zip_with(
        ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)),
        lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")),
    )
    return F.filter(pairs, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def edges(polygons: DataFrame) -> DataFrame:
    """(poly, x1, y1, x2, y2), one row for each edge."""
    rings = polygons.select("poly", F.explode("rings").alias("ring")).where(F.size("ring") >= 3)
    return rings.select("poly", F.explode(ring_edges(F.col("ring"))).alias("e")).select("poly", "e.*")


def _steps(low: Column, high: Column, wide: float) -> Column:
    return F.explode(F.sequence(F.floor(low / wide), F.floor(high / wide)))


def _places_in_polygons(places: DataFrame, polygons: DataFrame, wide: float, how: str = "inner") -> DataFrame:
    """(lon, lat, poly) of all polygons that hold a place, or (lon, lat) of held places by ``left_semi``; places: lon, lat, each one once."""
    c = F.col
    n = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    all_edges = edges(polygons)
    reach = all_edges.groupBy("poly").agg(F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"))
    bands = (
        all_edges.where("y1 <> y2").withColumn("ty", _steps(F.least("y1", "y2"), F.greatest("y1", "y2"), wide))
        .groupBy("poly", "ty").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    )
    tiles = bands.join(reach, "poly").withColumn("tx", _steps(c("west"), c("east"), wide)).select("tx", "ty", "poly", "edges")
    placed = places.where("lon is not null and lat is not null").select("lon", "lat", F.floor(c("lon") / wide).alias("tx"), F.floor(c("lat") / wide).alias("ty"))
    crossed = F.filter("edges", lambda e: ((e["y1"] > c("lat")) != (e["y2"] > c("lat"))) & (c("lon") < (e["x2"] - e["x1"]) * (c("lat") - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    # few bytes, much work: a set number of parts, which are not put together again
    placed, tiles = placed.repartition(n, "tx", "ty"), tiles.toDF("px", "py", "poly", "edges").repartition(n, "px", "py")
    met = placed.join(tiles, (c("tx") == c("px")) & (c("ty") == c("py")) & (F.size(crossed) % 2 == 1), how)
    return met.select("lon", "lat", *(["poly"] if how == "inner" else []))


def points_in_polygons(points: DataFrame, polygons: DataFrame, wide: float = 1.0) -> DataFrame:
    """(id, poly) of all polygons that hold a point; points: id, lon, lat. Points of one place are tested once."""
    held = _places_in_polygons(points.select("lon", "lat").distinct(), polygons, wide)
    return points.select("id", "lon", "lat").join(held, ["lon", "lat"]).select("id", "poly")


def counts_in_polygons(points: DataFrame, polygons: DataFrame, wide: float = 1.0) -> DataFrame:
    """(poly, n): the number of points (lon, lat) in each polygon that holds any; points are counted by place first, so no pairs of them are made."""
    places = points.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    held = _places_in_polygons(places.select("lon", "lat"), polygons, wide)
    return places.join(held, ["lon", "lat"]).groupBy("poly").agg(F.sum("n").alias("n"))


def in_any(points: DataFrame, polygons: DataFrame, name: str = "inside", wide: float = 1.0) -> DataFrame:
    """``points`` with a column that says whether any polygon holds them. A place leaves the search at the first polygon that does."""
    found = _places_in_polygons(points.select("lon", "lat").distinct(), polygons, wide, "left_semi").withColumn(name, F.lit(True))
    return points.join(found, ["lon", "lat"], "left").select(*points.columns, F.coalesce(found[name], F.lit(False)).alias(name))


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def overlapping(polygons: DataFrame, others: DataFrame | None = None, wide: float = 1.0) -> DataFrame:
    """(a, b) of polygons that share a point, boundaries included: their edges meet, or one holds a corner of the other.

    Of one table a < b; with ``others``, b is one of these.
    """
    c = F.col
    second = polygons if others is None else others
    wanted = (c("a") < c("b")) if others is None else F.lit(True)

    def tiled(frame: DataFrame, p: str, name: str) -> DataFrame:
        named = edges(frame).select(c("poly").alias(name), *(c(x).alias(f"{p}{x}") for x in ("x1", "y1", "x2", "y2")))
        low, high = (lambda k: F.least(f"{p}{k}1", f"{p}{k}2")), (lambda k: F.greatest(f"{p}{k}1", f"{p}{k}2"))
        return named.withColumn("tx", _steps(low("x"), high("x"), wide)).withColumn("ty", _steps(low("y"), high("y"), wide))

    p, q = [c(f"p{x}") for x in ("x1", "y1", "x2", "y2")], [c(f"q{x}") for x in ("x1", "y1", "x2", "y2")]
    boxes = [F.greatest(F.least(p[k], p[k + 2]), F.least(q[k], q[k + 2])) <= F.least(F.greatest(p[k], p[k + 2]), F.greatest(q[k], q[k + 2])) for k in (0, 1)]
    parted = (_side(*p, q[0], q[1]) * _side(*p, q[2], q[3]) <= 0) & (_side(*q, p[0], p[1]) * _side(*q, p[2], p[3]) <= 0)
    n = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    left, right = (tiled(*of).repartition(n, "tx", "ty") for of in ((polygons, "p", "a"), (second, "q", "b")))
    crossing = left.join(right, ["tx", "ty"]).where(wanted & boxes[0] & boxes[1] & parted).select("a", "b")

    def held(inner: DataFrame, outer: DataFrame, names: tuple[str, str]) -> DataFrame:
        first = inner.select(c("poly").alias("id"), F.get(F.get("rings", F.lit(0)), F.lit(0)).alias("at")).select("id", "at.lon", "at.lat")
        return points_in_polygons(first, outer, wide).select(c("id").alias(names[0]), c("poly").alias(names[1])).where("a <> b" if others is None else "true")

    inside = held(polygons, second, ("a", "b")).select("a", "b").unionByName(held(second, polygons, ("b", "a")).select("a", "b"))
    if others is None:
        inside = inside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return crossing.unionByName(inside).distinct()


#: Of each tile so many polygons meet all others first.
HUBS = 4


def _first_of_alike(polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with equal rings the one of the least ``poly`` (poly, rings), and a link (a, b) to it for each other one.

    Equal rows overlap if they have an edge; rows without one stay as they are.
    """
    c = F.col
    whole = lambda e: F.abs(e["x1"]) + F.abs(e["y1"]) + F.abs(e["x2"]) + F.abs(e["y2"]) < float("inf")
    solid = F.coalesce(F.exists("rings", lambda r: (F.size(r) >= 3) & F.exists(ring_edges(r), whole)), F.lit(False))
    rows = materialise(polygons.select("poly", "rings"), "rows")
    first = rows.where(solid).groupBy("rings").agg(F.min("poly").alias("first"))
    same = rows.where(solid).join(first, "rings").where(c("poly") != c("first")).select(c("first").alias("a"), c("poly").alias("b"))
    out = materialise(first.select(c("first").alias("poly"), "rings").unionByName(rows.where(~solid)), "polygons"), materialise(same, "alike")
    discard(rows)
    return out


def _astray(rows: DataFrame, labels: DataFrame, wide: float) -> DataFrame:
    """(poly) of polygons that in any tile of their boxes don't have the most frequent label: of two that touch and differ in label, one at least."""
    c = F.col
    corners = F.flatten("rings")
    ends = [f(F.transform(corners, lambda p: p[k])) for k in ("lon", "lat") for f in (F.array_min, F.array_max)]  # noqa: B023
    boxed = rows.select("poly", *(e.alias(n) for e, n in zip(ends, ("west", "east", "south", "north"), strict=True))).where("west is not null and south is not null")
    tiles = boxed.withColumn("tx", _steps(c("west"), c("east"), wide)).withColumn("ty", _steps(c("south"), c("north"), wide)).select("poly", "tx", "ty").join(labels, "poly")
    counts = tiles.groupBy("tx", "ty", "label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("tx", "ty").agg(F.max(F.struct("n", "label")).alias("top")).select("tx", "ty", c("top.label").alias("top"))
    return tiles.join(top, ["tx", "ty"]).where("label <> top").select("poly").distinct()


def dissolved(polygons: DataFrame, wide: float = 1.0, hubs: int = HUBS) -> DataFrame:
    """(poly, part): polygons that overlap, directly or over others, share the least ``poly`` as their part.

    Not all overlapping pairs are made, since these grow with the square of the polygons in one place. Equal rows count once. Then
    ``hubs`` polygons of each tile meet all others, which puts most of a dense place into one part. At last every polygon that in
    some tile is not of the tile's largest part meets all that are left; of two polygons that touch and whose parts
    differ, one at least is such, so no link is lost. Work stays quadratic where many parts share one tile.
    """
    c = F.col
    rows, alike = _first_of_alike(polygons)
    first = F.get(F.get("rings", F.lit(0)), F.lit(0))
    placed = rows.groupBy("poly").agg(F.min(F.struct(F.floor(first["lon"] / wide).alias("x"), F.floor(first["lat"] / wide).alias("y"))).alias("tile"))
    order = Window.partitionBy("tile").orderBy(F.xxhash64("poly"), "poly")
    chosen = materialise(placed.withColumn("k", F.row_number().over(order)).where(c("k") <= hubs).select("poly"), "hubs")
    met = overlapping(rows.join(chosen, "poly", "left_semi"), rows, wide).where("a <> b")
    found = connected_components(met.unionByName(alike), "a", "b")
    spent = labels = materialise(polygons.select("poly").distinct().join(found.withColumnRenamed("node", "poly"), "poly", "left").select("poly", F.coalesce("component", "poly").alias("label")), "parts")
    rest = materialise(rows.join(chosen, "poly", "left_anti"), "rest")
    astray = materialise(_astray(rest, labels, wide), "astray")
    if not astray.isEmpty():
        side = lambda p: labels.select(c("poly").alias(p), c("label").alias(f"{p}_label"))
        more = overlapping(rest.join(astray, "poly", "left_semi"), rest, wide).join(side("a"), "a").join(side("b"), "b").where("a_label <> b_label")
        merged = connected_components(more.select("a_label", "b_label").distinct(), "a_label", "b_label")
        labels = materialise(labels.join(merged.withColumnRenamed("node", "label"), "label", "left").select("poly", F.coalesce("component", "label").alias("label")), "parts")
        discard(spent)
    discard(rows, alike, chosen, rest, astray)
    return labels.select("poly", c("label").alias("part"))


def cap_in_polygons(rates: DataFrame, polygons: DataFrame, cap: float, **options) -> DataFrame:
    """rates (cell, lon, lat, low, rate, ...) with rate 0 from the lower edge ``cap`` on in cells that lie in a polygon, and ``in_polygon``."""
    cells = rates.select(F.col("cell").alias("id"), "lon", "lat").distinct()
    flags = points_in_polygons(cells, polygons, **options).select(F.col("id").alias("cell")).distinct().withColumn("in_polygon", F.lit(True))
    held = rates.join(flags, "cell", "left").withColumn("in_polygon", F.coalesce("in_polygon", F.lit(False)))
    return held.withColumn("rate", F.when(F.col("in_polygon") & (F.col("low") >= cap - 1e-6), 0.0).otherwise(F.col("rate")))


def _half(ring: Column, inside: Callable[[Column], Column], cut: Callable[[Column, Column], Column]) -> Column:
    """The part of a ring on one side of a line: of each edge its end, where that is inside, after the point where it comes in or goes out."""

    def kept(r: Column) -> Column:
        def step(p: Column, i: Column) -> Column:
            q = F.get(r, (i + 1) % F.size(r))
            return let(q, lambda q: F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(cut(p, q))).when(inside(q), F.array(cut(p, q), q)).otherwise(F.array().cast(f"array<{CORNER}>")))

        return F.flatten(F.transform(r, step))

    return let(ring, kept)


def clipped(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """The ring cut to a box, side by side. A ring that enters the box more than once keeps edges of no width along its sides, which have no area."""
    at = lambda x: lambda p, q: corner(x, p["lat"] + (q["lat"] - p["lat"]) * (x - p["lon"]) / (q["lon"] - p["lon"]))
    on = lambda y: lambda p, q: corner(p["lon"] + (q["lon"] - p["lon"]) * (y - p["lat"]) / (q["lat"] - p["lat"]), y)
    ring = _half(ring, lambda p: p["lon"] >= west, at(west))
    ring = _half(ring, lambda p: p["lon"] <= east, at(east))
    ring = _half(ring, lambda p: p["lat"] >= south, on(south))
    return _half(ring, lambda p: p["lat"] <= north, on(north))


def ring_km2(ring: Column) -> Column:
    """Area on the sphere of a ring whose edges are straight in longitude and latitude: the integral of the sine of latitude over longitude."""
    def under(e: Column) -> Column:
        a, b = F.radians(e["y1"]), F.radians(e["y2"])
        mean = F.when(F.abs(a - b) < 1e-9, F.sin((a + b) / 2)).otherwise((F.cos(a) - F.cos(b)) / F.when(a != b, b - a))
        return F.radians(e["x2"] - e["x1"]) * mean

    return EARTH_KM**2 * F.abs(F.aggregate(F.transform(ring_edges(ring), under), F.lit(0.0), lambda x, y: x + y))


def polygon_km2(rings: Column) -> Column:
    """The outline's area less that of the holes."""
    areas = F.transform(rings, ring_km2)
    return let(areas, lambda x: F.coalesce(F.get(x, F.lit(0)), F.lit(0.0)) - F.aggregate(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.lit(0.0), lambda s, v: s + v))


def cell_shares(cells: DataFrame, polygons: DataFrame, wide: float = 1.0) -> DataFrame:
    """(poly, cell, km2, share): the part of each cell that a polygon covers, and its share of all that the polygon covers of the cells.

    cells: cell, west, south, east, north. A cell and a polygon meet in the tile of the south-west corner of what their boxes share.
    """
    c = F.col
    corners = F.flatten("rings")
    boxed = polygons.where(F.size("rings") > 0).select(
        "poly", "rings", *(f(F.transform(corners, lambda p: p[k])).alias(n) for n, f, k in (("w", F.array_min, "lon"), ("e", F.array_max, "lon"), ("s", F.array_min, "lat"), ("n", F.array_max, "lat")))  # noqa: B023
    )
    left = boxed.withColumn("tx", _steps(c("w"), c("e"), wide)).withColumn("ty", _steps(c("s"), c("n"), wide))
    right = cells.withColumn("tx", _steps(c("west"), c("east"), wide)).withColumn("ty", _steps(c("south"), c("north"), wide))
    first = (F.floor(F.greatest("w", "west") / wide) == c("tx")) & (F.floor(F.greatest("s", "south") / wide) == c("ty"))
    met = left.join(right, ["tx", "ty"]).where(first & (c("w") < c("east")) & (c("west") < c("e")) & (c("s") < c("north")) & (c("south") < c("n")))
    cut = F.transform("rings", lambda r: clipped(r, c("west"), c("south"), c("east"), c("north")))
    parts = met.select("poly", "cell", polygon_km2(cut).alias("km2")).groupBy("poly", "cell").agg(F.sum("km2").alias("km2")).where("km2 > 1e-9")
    whole = parts.groupBy("poly").agg(F.sum("km2").alias("whole"))
    return parts.join(whole, "poly").select("poly", "cell", "km2", (c("km2") / c("whole")).alias("share"))


def bin_weights(b: Column, edges_low: list[float], width: float) -> Column:
    """The parts of a truncated Gutenberg-Richter law in bins of ``width`` around the given magnitudes; they add up to 1."""
    survival = lambda m: F.pow(F.lit(10.0), -b * m)
    whole = survival(edges_low[0] - width / 2) - survival(edges_low[-1] + width / 2)
    return F.array(*((survival(m - width / 2) - survival(m + width / 2)) / whole for m in edges_low))


def area_forecast(shares: DataFrame, counts: DataFrame, b: DataFrame, learnt_from: float, magnitudes: list[float], years: float, scale: float | None = None, by_bin: bool = False) -> DataFrame:
    """(cell, bin, rate) of a forecast: each polygon's events dealt over its cells by area, scaled from the magnitude that they were
    learnt from to the first of ``magnitudes``, and spread over the bins around these.

    shares: poly, cell, share; counts: poly, n, span (years); b: cell, b. Cells without events have 1e-10 in every bin.
    With ``scale``, all rates together add up to it, or those of each bin do.
    """
    c = F.col
    width = magnitudes[1] - magnitudes[0]
    dealt = shares.join(counts, "poly").groupBy("cell").agg(F.sum(c("n") * c("share") / c("span") * years).alias("learnt"))
    target = c("learnt") * F.pow(F.lit(10.0), -c("b") * (magnitudes[0] - learnt_from))
    weights = F.when(target > 0, F.transform(bin_weights(c("b"), magnitudes, width), lambda w: target * w)).otherwise(F.array_repeat(F.lit(1e-10), len(magnitudes)))
    rates = dealt.join(b, "cell").select("cell", F.posexplode(weights).alias("bin", "rate"))
    if scale is None:
        return rates
    keys = ["bin"] if by_bin else []
    sums = rates.groupBy(*keys).agg(F.sum("rate").alias("all"))  # one row, or one for each bin
    joined = rates.join(F.broadcast(sums), keys) if by_bin else rates.crossJoin(F.broadcast(sums))
    return joined.select("cell", "bin", (c("rate") * scale / c("all")).alias("rate"))
