"""Rasters as rows (i, j, value): column and row numbers from 0, and a value or null; samples at points, smoothing, masks.

A raster's nodes lie at x0 + i * dx and y0 + j * dy.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakespark.operators.polygons import in_any

Frame = tuple[float, float, float, float]


def sampled(points: DataFrame, raster: DataFrame, frame: Frame, method: str = "linear") -> DataFrame:
    """(id, value) of points (id, lon, lat): bilinear between the four nodes around, or that of the nearest node.

    Each point asks for the nodes whose weight isn't 0, by a join on their numbers; where one lies outside or is null, so
    is the result. Halves go to the node with the even number.
    """
    x0, y0, dx, dy = frame
    c = F.col
    fx, fy = (c("lon") - x0) / dx, (c("lat") - y0) / dy
    at = points.where("lon is not null and lat is not null").select("id", F.round(fx, 9).alias("fx"), F.round(fy, 9).alias("fy"))
    if method == "nearest":
        asked = at.select("id", F.bround("fx", 0).cast("long").alias("i"), F.bround("fy", 0).cast("long").alias("j"), F.lit(1.0).alias("w"))
    else:
        i, j = F.floor("fx").cast("long"), F.floor("fy").cast("long")
        u, v = c("fx") - i, c("fy") - j
        four = F.array(*(F.struct((i + a).alias("i"), (j + b).alias("j"), ((u if a else 1 - u) * (v if b else 1 - v)).alias("w")) for a in (0, 1) for b in (0, 1)))
        asked = at.select("id", F.explode(F.filter(four, lambda n: n["w"] > 0)).alias("n")).select("id", "n.*")
    met = asked.join(raster.where("value is not null"), ["i", "j"], "left").groupBy("id")
    found = met.agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum(c("value") * c("w"))).alias("value"))
    return points.select("id").join(found, "id", "left")


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of a normalised kernel cut at ``truncate`` sigmas."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


#: A line is smoothed in blocks of so many nodes.
BLOCK = 64


def _blocks(raster: DataFrame, along: str, across: str, size: int, radius: int) -> DataFrame:
    """One row a block of a line: ``across``, low and high (its first and last node), start, and the array ``line`` of v (0 where
    unknown) and k (1 where known) of its nodes and of ``radius`` more on either side, from the node ``start`` on, within the line."""
    c = F.col
    spine = raster.select(across).distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((size - 1) // BLOCK).cast("long"))))
    asked = F.sequence(F.floor((c(along) - radius) / BLOCK), F.floor((c(along) + radius) / BLOCK))
    held = raster.withColumn("block", F.explode(asked)).groupBy(across, "block").agg(F.map_from_entries(F.collect_list(F.struct(F.col(along), F.struct("v", "k")))).alias("of"))
    none = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("k"))
    low, high = c("block") * BLOCK, F.least(c("block") * BLOCK + (BLOCK - 1), F.lit(size - 1))
    ends = {"low": low, "high": high, "start": F.greatest(low - radius, F.lit(0)), "end": F.least(high + radius, F.lit(size - 1))}
    each = spine.join(held, [across, "block"], "left").withColumns({n: v.cast("long") for n, v in ends.items()})
    return each.select(across, "low", "high", "start", F.transform(F.sequence("start", "end"), lambda i: F.coalesce(F.try_element_at("of", i), none)).alias("line"))


def _passed(raster: DataFrame, along: str, across: str, size: int, weights: list[float]) -> DataFrame:
    """Rows (i, j, v, k) smoothed along one axis; beyond the ends a line goes on with its end nodes."""
    radius = len(weights) // 2
    kernel = F.array(*map(F.lit, weights))
    place = lambda n: (F.greatest(F.lit(0), F.least(F.lit(size - 1), n)) - F.col("start")).cast("int")
    reach = lambda i: F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda o: place(i + o))
    total = lambda i, part: F.aggregate(F.zip_with(kernel, reach(i), lambda w, n: w * F.get("line", n)[part]), F.lit(0.0), lambda a, b: a + b)
    blocks = _blocks(raster, along, across, size, radius)
    out = F.transform(F.sequence("low", "high"), lambda i: F.struct(i.alias(along), total(i, "v").alias("v"), total(i, "k").alias("k")))
    return blocks.select(across, F.explode(out).alias("o")).select(across, "o.*")


def smoothed(raster: DataFrame, width: int, height: int, sigma: float, least: float = 1e-6, filled: float = 0.5) -> DataFrame:
    """(i, j, value): the mean of the known values under a Gaussian kernel of ``sigma`` nodes, by one pass along each axis.

    Both the values (0 where unknown) and the knowns are smoothed, and divided. A node stays null if less than ``least``
    of the kernel is known, or, where it was null itself, less than ``filled``. Each pass holds a block of a line, with what the
    kernel reaches around it, in a row, so that work grows with the nodes and a row's memory is that of a block, however long a line is.
    """
    weights = gaussian(sigma)
    known = raster.select("i", "j", F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.lit(0.0)).alias("v"), F.when(F.col("value").isNotNull() & ~F.isnan("value"), 1.0).otherwise(0.0).alias("k"))
    down = _passed(known, "j", "i", height, weights)
    over = _passed(down, "i", "j", width, weights)
    was = known.where("k = 1").select("i", "j", F.lit(True).alias("was"))
    mean = F.when(F.col("k") > least, F.col("v") / F.when(F.col("k") > 0, F.col("k")))
    return over.join(was, ["i", "j"], "left").select("i", "j", F.when(F.coalesce("was", F.lit(False)) | (F.col("k") >= filled), mean).alias("value"))


def pixel_km(frame: Frame, rows: int) -> float:
    """The mean side of a node's box in km, in the middle of ``rows`` rows."""
    _, y0, dx, dy = frame
    return 0.5 * 111.32 * (abs(dx) * math.cos(math.radians(y0 + dy * (rows - 1) / 2)) + abs(dy))


def placed(raster: DataFrame, frame: Frame) -> DataFrame:
    """The raster with lon and lat of its nodes."""
    x0, y0, dx, dy = frame
    return raster.withColumns({"lon": x0 + F.col("i") * dx, "lat": y0 + F.col("j") * dy})


def masked(raster: DataFrame, polygons: DataFrame, frame: Frame, crop: bool = False, **options) -> DataFrame:
    """The raster with null outside of the polygons, by its nodes' places; with ``crop`` without these rows."""
    key = F.struct("i", "j")
    held = in_any(placed(raster, frame).withColumn("id", key), polygons, "in_polygon", **options)
    if crop:
        return held.where("in_polygon").select("i", "j", "value")
    return held.select("i", "j", F.when(F.col("in_polygon"), F.col("value")).alias("value"))


def boxed(raster: DataFrame, frame: Frame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The nodes of a box; the bounds become numbers, so that the scan can skip by them."""
    x0, y0, dx, dy = frame
    low = lambda a, o, d: math.ceil(round((a - o) / d, 9))
    high = lambda a, o, d: math.floor(round((a - o) / d, 9))
    (i0, i1), (j0, j1) = ((low(a, o, d), high(b, o, d)) if d > 0 else (low(b, o, d), high(a, o, d)) for a, b, o, d in ((west, east, x0, dx), (south, north, y0, dy)))
    return raster.where(F.col("i").between(i0, i1) & F.col("j").between(j0, j1))
