"""Analytics of hazard curves: maps by interpolation, statistics over branches, spectra, differences.

Curves are long: site, branch, level, iml, poe; poe falls as iml rises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hazard_map(curves: DataFrame, poes: list[float], keys: tuple[str, ...] = ("site", "branch")) -> DataFrame:
    """(keys, poe, iml): the level at each probability, linear in logarithms, held at the ends of the curve."""
    points = curves.where("iml > 0").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("iml", "poe"))).alias("points"))
    c = F.col
    asked = points.withColumn("p", F.explode(F.array(*(F.lit(p) for p in poes))))
    above = F.filter("points", lambda x: x["poe"] >= c("p"))
    below = F.filter("points", lambda x: x["poe"] < c("p"))
    both = asked.select(*keys, "p", F.try_element_at(above, F.lit(-1)).alias("a"), F.try_element_at(below, F.lit(1)).alias("b"))
    log_p = lambda v: F.log(F.greatest(v, F.lit(1e-30)))
    share = (log_p(c("a.poe")) - log_p(c("p"))) / (log_p(c("a.poe")) - log_p(c("b.poe")))
    iml = F.when(c("a").isNull(), c("b.iml")).when(c("b").isNull(), c("a.iml")).otherwise(F.exp(F.log("a.iml") + share * (F.log("b.iml") - F.log("a.iml"))))
    return both.select(*keys, c("p").alias("poe"), iml.alias("iml"))


def branch_statistics(values: DataFrame, keys: list[str], quantiles: list[float], value: str = "iml") -> DataFrame:
    """(keys, stat, value): weighted mean, geometric mean and quantiles over branches (columns branch, weight).

    A quantile interpolates between values in ascending order (ties by branch) at their cumulative weights,
    and is held at the ends. One shuffle on ``keys`` serves the window and the aggregate.
    """
    c = F.col
    ordered = Window.partitionBy(*keys).orderBy(value, "branch")
    run = values.select(
        *keys, "weight", c(value).alias("v"), F.lag(value).over(ordered).alias("v0"),
        F.sum("weight").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("w1"),
    ).withColumn("w0", c("w1") - c("weight"))

    def at(q: float) -> Column:
        inside = F.when(c("v0").isNull(), c("v")).otherwise(c("v0") + (q - c("w0")) / c("weight") * (c("v") - c("v0")))
        return F.coalesce(F.max(F.when((c("w0") < q) & (c("w1") >= q), inside)), F.max("v"))

    stats = {"mean": F.sum(c("weight") * c("v")) / F.sum("weight"), "gmean": F.exp(F.sum(c("weight") * F.log("v")) / F.sum("weight"))}
    stats |= {f"q{q:g}": at(q) for q in quantiles}
    wide = run.groupBy(*keys).agg(*(x.alias(n) for n, x in stats.items()))
    return wide.unpivot(keys, [f"`{n}`" for n in stats], "stat", "value")


def map_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str = "iml") -> DataFrame:
    """(keys, difference, relative) of two maps on the same keys; relative to the left, null where that is 0."""
    both = left.select(*keys, F.col(value).alias("l")).join(right.select(*keys, F.col(value).alias("r")), keys)
    return both.select(*keys, (F.col("r") - F.col("l")).alias("difference"), F.try_divide(F.col("r") - F.col("l"), "l").alias("relative"))
