"""Smoothed fields: nearest-neighbour radii and power-law kernels on a grid, without all-pairs joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.functions.columns import EARTH_KM, haversine_km
from quakespark.operators.catalog import radius_pairs
from quakespark.session import materialise


def kth_neighbour(points: DataFrame, k: int, key: str = "pid", tile_km: float = 100.0) -> DataFrame:
    """(key, d): the great-circle distance in km, to 6 places, from each point to its k-th nearest other one.

    points: key, lon, lat, one row a place. Places lie in cubic tiles of earth-centred space and meet only those of
    the 27 tiles around them. A point is settled once its k-th distance is at most the tile's edge, as then no
    nearer place can lie outside; the others go on with tiles four times as wide. Fewer than k others: null.
    """
    c = F.col
    base = points.where("lon is not null and lat is not null").select(
        key, "lon", "lat",
        (EARTH_KM * F.cos(F.radians("lat")) * F.cos(F.radians("lon"))).alias("x"),
        (EARTH_KM * F.cos(F.radians("lat")) * F.sin(F.radians("lon"))).alias("y"), (EARTH_KM * F.sin(F.radians("lat"))).alias("z"),
    )
    open_points, settled, size = base, None, tile_km
    while True:
        last = size > 2 * EARTH_KM
        tile = [F.floor(c(a) / size).alias(f"t{a}") for a in "xyz"]
        near = base.select(c(key).alias("other"), c("lon").alias("olon"), c("lat").alias("olat"), *tile)
        for a in "xyz":
            near = near.withColumn(f"t{a}", F.explode(F.array(c(f"t{a}") - 1, c(f"t{a}"), c(f"t{a}") + 1)))
        km = F.round(haversine_km(c("lat"), c("lon"), c("olat"), c("olon")), 6)
        ranked = (
            open_points.select("*", *tile).join(near, ["tx", "ty", "tz"]).where(c(key) != c("other")).select(key, km.alias("d"), "other")
            .withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("d", "other"))).where(c("n") == k).select(key, "d")
        )
        found = materialise(open_points.select(key).join(ranked if last else ranked.where(c("d") <= size), key, "left"), "neighbours")
        done = found if last else found.where("d is not null")
        settled = done if settled is None else settled.union(done)
        rest = found.where("d is null")
        if last or rest.isEmpty():
            return settled
        open_points, size = base.join(rest.select(key), key, "left_semi"), size * 4


def kernel_field(events: DataFrame, cells: DataFrame, km: float = 500.0, power: float = 1.5) -> DataFrame:
    """(cell, rate): each event's weight, spread over the cells within ``km`` in proportion to (r r + d d)^-power.

    events: lon, lat, weight, d (km); cells: cell, lon, lat. Events of one place and radius are summed first.
    An event that reaches no cell gives nothing; a cell that none reaches has no row.
    """
    c = F.col
    places = events.where("weight > 0").groupBy("lon", "lat", "d").agg(F.sum("weight").alias("weight"))
    spread = radius_pairs(places, cells, km).withColumn("k", F.pow(c("km") * c("km") + c("d") * c("d"), F.lit(-power)))
    whole = spread.withColumn("total", F.sum("k").over(Window.partitionBy("lon", "lat", "d")))
    return whole.groupBy("cell").agg(F.sum(c("weight") * c("k") / c("total")).alias("rate"))


def _tiles(rows: DataFrame, wide: float, total: Column) -> DataFrame:
    """(tx, ty, lon, lat, rho, total): of each tile of ``wide`` degrees the mean place of its rows, the greatest distance of a row from it, and a sum."""
    c = F.col
    at = [F.floor(c("lon") / wide).alias("tx"), F.floor(c("lat") / wide).alias("ty")]
    mean = rows.groupBy(*at).agg(F.avg("lon").alias("mlon"), F.avg("lat").alias("mlat"), F.sum(total).alias("total"))
    far = rows.select("lon", "lat", *at).join(mean, ["tx", "ty"]).groupBy("tx", "ty").agg(F.max(haversine_km(c("lat"), c("lon"), c("mlat"), c("mlon"))).alias("rho"))
    return mean.join(far, ["tx", "ty"]).select("tx", "ty", "mlon", "mlat", "rho", "total")


def field_error(theta: float, power: float, step: float) -> float:
    """The greatest relative error of a term of ``whole_field``: that of a place within ``theta`` times the distance, twice, and of a radius off by half a step."""
    place = (1 - theta) ** (-2 * power) - 1
    return (1 + place) ** 2 * (1 + step) ** power - 1


def whole_field(events: DataFrame, cells: DataFrame, power: float = 1.5, wide: float = 2.0, theta: float = 0.1, step: float = 0.02, by_area: bool = False, to_one: bool = False) -> DataFrame:
    """(cell, rate): as ``kernel_field`` without a cut-off, for cells of the whole Earth.

    Cells, and then events with their shares, are summed up by tiles of ``wide`` degrees, and events by radii in steps of ``step``
    besides. A tile whose places lie within ``theta`` times its distance counts as one place; nearer tiles are taken
    apart exactly. So a term is off by at most ``field_error`` of itself, and far less on average, since a tile stands at its mean
    place. There are at most (360 / wide) (180 / wide) tiles, 16,200 by default, which are broadcast; the work is events, or
    cells, times tiles instead of events times cells. cells: cell, lon, lat and, for ``by_area``, area: rates are divided by it;
    ``to_one``: they add up to 1.
    """
    c = F.col
    places = events.where("weight > 0 and d > 0").groupBy("lon", "lat", "d").agg(F.sum("weight").alias("weight"))
    kernel = lambda km, d: F.pow(km * km + d * d, F.lit(-power))
    at = [F.floor(c("lon") / wide).alias("tx"), F.floor(c("lat") / wide).alias("ty")]
    away = haversine_km(c("lat"), c("lon"), c("mlat"), c("mlon"))
    tiles = materialise(_tiles(cells, wide, F.lit(1.0)), "tiles")
    met = places.crossJoin(F.broadcast(tiles)).withColumn("km", away)
    near = met.where(c("rho") > theta * c("km")).drop("km")
    inner = near.join(cells.select(*at, c("lon").alias("clon"), c("lat").alias("clat")), ["tx", "ty"]).select("lon", "lat", "d", kernel(haversine_km(c("lat"), c("lon"), c("clat"), c("clon")), c("d")).alias("k"))
    outer = met.where(c("rho") <= theta * c("km")).select("lon", "lat", "d", (c("total") * kernel(c("km"), c("d"))).alias("k"))
    sums = outer.union(inner).groupBy("lon", "lat", "d").agg(F.sum("k").alias("all"))
    held = materialise(places.join(sums, ["lon", "lat", "d"]).select("lon", "lat", "d", (c("weight") / c("all")).alias("share")), "shares")
    # radii of one step share their geometric middle
    level = F.round(F.log("d") / F.log(F.lit(1 + step))).cast("long")
    stepped = held.withColumn("level", level)
    sources = materialise(
        _tiles(held, wide, c("share")).drop("total").join(stepped.groupBy(*at, "level").agg(F.sum("share").alias("total")), ["tx", "ty"]).withColumn("d", F.pow(F.lit(1 + step), c("level"))), "tiles"
    )
    by_tile = sources.groupBy("tx", "ty").agg(F.first("mlon").alias("mlon"), F.first("mlat").alias("mlat"), F.first("rho").alias("rho"), F.collect_list(F.struct("d", "total")).alias("parts"))
    seen = cells.select("cell", "lon", "lat").crossJoin(F.broadcast(by_tile)).withColumn("km", away)
    far = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["total"] * kernel(c("km"), p["d"]))
    outer = seen.where(c("rho") <= theta * c("km")).select("cell", far.alias("rate"))
    close = seen.where(c("rho") > theta * c("km")).select("cell", c("lon").alias("clon"), c("lat").alias("clat"), "tx", "ty")
    inner = close.join(held.select("*", *at), ["tx", "ty"]).select("cell", (c("share") * kernel(haversine_km(c("lat"), c("lon"), c("clat"), c("clon")), c("d"))).alias("rate"))
    rates = outer.union(inner).groupBy("cell").agg(F.sum("rate").alias("rate"))
    if by_area:
        rates = rates.join(cells.select("cell", "area"), "cell").select("cell", (c("rate") / c("area")).alias("rate"))
    if to_one:
        rates = rates.crossJoin(F.broadcast(rates.agg(F.sum("rate").alias("all")))).select("cell", (c("rate") / c("all")).alias("rate"))  # one row
    return rates
