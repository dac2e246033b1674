"""Parts of catalogs and models: sub-catalogs, trimmed bins, slab nodes, fits by least squares, comparisons and conservation of rates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakespark.operators.polygons import in_any


def sub_catalog(
    events: DataFrame, mag: tuple[float, float] | None = None, depth: tuple[float, float] | None = None, unknown_depths: bool = False,
    box: tuple[float, float, float, float] | None = None, polygons: DataFrame | None = None, years: tuple[float, float] | None = None,
) -> DataFrame:
    """Events with low <= value < high of magnitude, depth and decimal year, in a closed box (west, south, east, north) and in any polygon.

    Unknown values don't pass, but for depths if ``unknown_depths``. All that isn't a polygon is one filter that reaches the scan.
    """
    c, keep = F.col, F.lit(True)
    half_open = lambda n, r: (c(n) >= r[0]) & (c(n) < r[1])
    if mag:
        keep = keep & half_open("mag", mag)
    if years:
        keep = keep & half_open("yr", years)
    if depth:
        keep = keep & (F.coalesce(half_open("depth", depth), F.lit(True)) if unknown_depths else half_open("depth", depth))
    if box:
        keep = keep & c("lon").between(box[0], box[2]) & c("lat").between(box[1], box[3])
    held = events.where(keep)
    return held if polygons is None else in_any(held, polygons, "__in").where("__in").drop("__in")


def trimmed_bins(rates: DataFrame, depths: DataFrame) -> DataFrame:
    """rates (cell, bin, rate, ...) up to each cell's last bin with a positive rate; cells without one, or without an ordered depth range
    in ``depths`` (cell, upper, lower), are left out."""
    last = rates.where("rate > 0").groupBy("cell").agg(F.max("bin").alias("__last"))
    good = depths.where("upper is not null and lower is not null and upper < lower").select("cell")
    return rates.join(last, "cell").where("bin <= __last").drop("__last").join(good, "cell", "left_semi")


def slab_nodes(depth: DataFrame, strike: DataFrame, dip: DataFrame, flip: bool = True) -> DataFrame:
    """(lon, lat, depth, strike, dip) of nodes that all three grids (lon, lat, value) hold with a value; strikes within 0 and 360, ``flip`` turns depths."""
    named = lambda df, n: df.where("value is not null").select("lon", "lat", F.col("value").alias(n))
    whole = named(depth, "depth").join(named(strike, "strike"), ["lon", "lat"]).join(named(dip, "dip"), ["lon", "lat"])
    return whole.select("lon", "lat", (-F.col("depth") if flip else F.col("depth")).alias("depth"), F.pmod("strike", F.lit(360.0)).alias("strike"), "dip")


def least_squares(bins: DataFrame, key: str, width: float) -> DataFrame:
    """(key, n_bins, a, b, r2, rms) of log10 of rates at or above m, fitted by a line over bins (key, m, rate) with a positive rate.

    a is that of all magnitudes from 0 on; one bin has no fit. Sums of squares are those of one aggregate.
    """
    c = F.col
    y = F.log10("rate")
    held = bins.where("rate > 0").select(key, c("m").alias("x"), y.alias("y"))
    s = held.groupBy(key).agg(F.count(F.lit(1)).alias("n_bins"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("y", "x").alias("r2"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    rest = F.greatest(c("syy") - c("slope") * c("sxy"), F.lit(0.0))
    many = c("n_bins") > 1
    return s.select(key, "n_bins", F.when(many, c("a")).alias("a"), F.when(many, -c("slope")).alias("b"), F.when(many, c("r2")).alias("r2"), F.when(many, F.sqrt(rest / c("n_bins"))).alias("rms"))


def compared(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, first, second, log_ratio, only): rates (key, rate) of two models side by side; ``only`` names the one that alone has the key."""
    c = F.col
    a, b = first.select(key, c("rate").alias("first")), second.select(key, c("rate").alias("second"))
    both = a.join(b, key, "full")
    only = F.when(c("first").isNull(), "second").when(c("second").isNull(), "first")
    return both.select(key, "first", "second", F.when((c("first") > 0) & (c("second") > 0), F.log10("second") - F.log10("first")).alias("log_ratio"), only.alias("only"))


def conservation(before: DataFrame, after: DataFrame, slack: float = 1e-12) -> DataFrame:
    """(bin, before, after, moved, outside_change, kept) of two tables of rates (cell, bin, rate), the second with ``inside``.

    moved: what cells inside lost; outside_change: the greatest change of a cell outside; kept: whether that is at most
    ``slack`` and the bin's sum is what it was less what was moved. Cells that only one table has count as 0 in the other.
    """
    c = F.col
    both = before.select("cell", "bin", c("rate").alias("a")).join(after.select("cell", "bin", c("rate").alias("b"), "inside"), ["cell", "bin"], "full").na.fill(0.0, ["a", "b"])
    inside = F.coalesce("inside", F.lit(False))
    change = F.abs(c("b") - c("a"))
    sums = both.groupBy("bin").agg(
        F.sum("a").alias("before"), F.sum("b").alias("after"), F.sum(F.when(inside, c("a") - c("b")).otherwise(0.0)).alias("moved"), F.max(F.when(~inside, change).otherwise(0.0)).alias("outside_change")
    )
    near = F.abs(c("before") - c("moved") - c("after")) <= 1e-9 * F.greatest(F.abs("before"), F.lit(math.ulp(1.0)))
    return sums.withColumn("kept", (c("outside_change") <= slack) & near)
