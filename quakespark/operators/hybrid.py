"""Hybrids of a seismic and a fault field: likelihoods of their weights by magnitude, a ramp fitted to the best ones, and the weighted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.operators.rates import log10_factorial


def matched(cells: DataFrame) -> DataFrame:
    """cells (cell, seismic, fault, masked) with ``fault`` scaled so that both fields have one sum over the masked cells, and that sum as ``whole``."""
    c = F.col
    sums = cells.where("masked").agg(F.sum("seismic").alias("whole"), F.sum("fault").alias("all"))  # one row
    return cells.crossJoin(F.broadcast(sums)).select("cell", "seismic", (c("fault") * F.try_divide(c("whole"), c("all"))).alias("fault"), "masked", "whole")


def weight_likelihoods(cells: DataFrame, counts: DataFrame, weights: list[float]) -> DataFrame:
    """(bin, weight, n, likelihood): how likely the events (cell, bin, n) of the masked cells are if the seismic field has that weight.

    Expected numbers add up to those that happened, so cells without events need no row: one join with the cells that have
    some, and one aggregate. Logarithms are decimal but for the expected numbers. Bins without events are left out; a
    field of 0 where events are makes the likelihood minus infinity.
    """
    c = F.col
    met = counts.where("n > 0").join(matched(cells).where("masked"), "cell")
    totals = met.groupBy("bin").agg(F.sum("n").alias("total"))
    each = met.join(totals, "bin").withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    mu = c("total") * (c("weight") * c("seismic") + (1 - c("weight")) * c("fault")) / c("whole")
    term = F.when(mu > 0, c("n") * F.log10(mu) - log10_factorial(c("n"))).otherwise(F.lit(float("-inf")))
    return each.groupBy("bin", "weight").agg(F.max("total").alias("n"), (F.sum(term) - F.max("total")).alias("likelihood"))


def best_weights(table: DataFrame) -> DataFrame:
    """(bin, weight) of the highest likelihood, of equal ones the least weight; bins that no weight makes possible are left out."""
    possible = table.where(F.col("likelihood") > float("-inf"))
    return possible.groupBy("bin").agg(F.max_by("weight", F.struct("likelihood", -F.col("weight"))).alias("weight"))


def ramp(m: Column, low: float, high: float) -> Column:
    """0 below ``low``, 1 above ``high``, straight between."""
    return F.least(F.greatest((m - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def fit_ramp(points: DataFrame, low: float, high: float) -> tuple[float, float] | None:
    """The plateaus below ``low`` and above ``high`` of the least squares through points (m, weight); None unless there are points on both sides.

    The sums of the normal equations are one aggregate.
    """
    t = ramp(F.col("m"), low, high)
    w = F.col("weight")
    a, b, d, x, y = points.agg(F.sum((1 - t) * (1 - t)), F.sum((1 - t) * t), F.sum(t * t), F.sum((1 - t) * w), F.sum(t * w)).first()
    det = None if a is None else a * d - b * b
    return ((x * d - y * b) / det, (y * a - x * b) / det) if det and abs(det) > 1e-12 else None


def weighted_fields(cells: DataFrame, plateaus: tuple[float, float], low: float, high: float, magnitudes: list[float]) -> DataFrame:
    """(cell, m, rate, at_or_above): the hybrid field at each magnitude, and summed over all from it on; cells outside the mask keep the seismic field."""
    c = F.col
    each = matched(cells).withColumn("m", F.explode(F.array(*map(F.lit, magnitudes))))
    t = ramp(c("m"), low, high)
    w = plateaus[0] * (1 - t) + plateaus[1] * t
    rates = each.withColumn("rate", F.when(c("masked"), w * c("seismic") + (1 - w) * c("fault")).otherwise(c("seismic")))
    onwards = Window.partitionBy("cell").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rates.select("cell", "m", "rate", F.sum("rate").over(onwards).alias("at_or_above"))
