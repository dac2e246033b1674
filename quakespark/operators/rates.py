"""Recurrence rates: maximum-likelihood fits per group, resampling, Poisson tests, moment balance.

Events are reduced to magnitude bins before any fit, so a group holds as many rows as it has bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weichert(bins: DataFrame, key: str, start: float = 1.5, steps: int = 30) -> DataFrame:
    """(key, n, beta, b, rate) by Newton's method for unequal observation periods.

    bins: key, m (centre), n (count), t (years observed), one row a bin. ``rate`` is that of all magnitudes from
    the lowest bin on. Bins without a period are left out; groups with one bin have no finite fit and give null.
    """
    c = F.col
    held = (
        bins.where("t > 0").groupBy(key)
        .agg(F.collect_list(F.struct("m", "n", "t")).alias("bins"), F.sum("n").alias("n"), (F.sum(c("n") * c("m")) / F.sum("n")).alias("mean"))
        .where("n > 0")
    )

    def sums(beta: Column) -> Column:
        """Sums of t, t m, t m m, and of 1, each times exp(-beta m)."""
        zero = F.struct(*(F.lit(0.0).alias(f"s{k}") for k in range(4)))

        def added(acc: Column, x: Column) -> Column:
            e = F.exp(-beta * x["m"])
            return F.struct(
                (acc["s0"] + x["t"] * e).alias("s0"), (acc["s1"] + x["t"] * x["m"] * e).alias("s1"),
                (acc["s2"] + x["t"] * x["m"] * x["m"] * e).alias("s2"), (acc["s3"] + e).alias("s3"),
            )

        return F.aggregate("bins", zero, added)

    def newton(beta: Column, _: Column) -> Column:
        def step(s: Column) -> Column:
            first = F.try_divide(s["s1"], s["s0"])
            return beta - F.try_divide(first - c("mean"), first * first - F.try_divide(s["s2"], s["s0"]))

        one = F.transform(F.array(sums(beta)), step)
        return F.element_at(one, 1)

    fitted = held.withColumn("beta", F.when(F.size("bins") > 1, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(start), newton)))
    s = sums(c("beta"))
    return fitted.withColumn("s", s).select(
        key, "n", "beta", (c("beta") / math.log(10)).alias("b"), F.try_divide(c("n") * c("s.s3"), c("s.s0")).alias("rate")
    )


def bootstrap_b(bins: DataFrame, key: str, m_min: float, replicates: int = 200, seed: int = 11) -> DataFrame:
    """(key, b_mean, b_sigma) of the Aki-Utsu b-value over Poisson resamples of the bins (key, m, n).

    Each bin of each replicate draws its count once: below 30 events by inversion of the distribution, above by
    the rounded normal law. Draws depend only on seed, replicate, key and bin, so a rerun gives the same table.
    """
    c = F.col
    drawn = bins.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "rep", key, "m"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    zero = F.struct(F.exp(-c("n").cast("double")).alias("p"), F.exp(-c("n").cast("double")).alias("sum"), F.lit(0).alias("k"))
    small = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), zero,
        lambda acc, k: F.when(acc["sum"] < c("u"), F.struct((acc["p"] * c("n") / k).alias("p"), (acc["sum"] + acc["p"] * c("n") / k).alias("sum"), k.alias("k"))).otherwise(acc),
    )["k"]
    counted = drawn.withColumn("u", u(3)).withColumn("x", F.when(c("n") < 30, small).otherwise(F.greatest(F.round(c("n") + F.sqrt(c("n")) * normal), F.lit(0.0))))
    each = counted.groupBy(key, "rep").agg((math.log10(math.e) / (F.sum(c("x") * c("m")) / F.sum("x") - m_min)).alias("b"))
    return each.groupBy(key).agg(F.avg("b").alias("b_mean"), F.stddev("b").alias("b_sigma"))


def log10_factorial(n: Column) -> Column:
    """log10 n!: summed up to 50, by Stirling's series (error below 1e-12) above."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    summed = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n.cast("int"), F.lit(1)), F.lit(50))), F.lit(0.0), lambda acc, k: acc + F.log10(k))
    return F.when(n > 50, series / math.log(10)).otherwise(summed)


def poisson_tail(n: Column, rate: Column, top: float = 500.0) -> Column:
    """P(N >= n) of a Poisson count of mean ``rate``; null from ``top`` on. Terms past 2000 vanish for rates below that."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.least(n.cast("int"), F.lit(2000))),
        F.struct(F.exp(-rate).alias("p"), F.lit(0.0).alias("sum")),
        lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), (acc["sum"] + acc["p"]).alias("sum")),
    )["sum"]
    return F.when(rate < top, F.when(n <= 0, 1.0).otherwise(F.greatest(1 - terms, F.lit(0.0))))


def balanced_rates(faults: DataFrame, key: str, b: float, m_min: float, width: float, moment_c: float) -> DataFrame:
    """(key, bin, rate): each fault's truncated rates, scaled so that their moment sums to ``moment_rate``.

    faults: key, m_max, moment_rate (N m a year). Bins run from m_min up to m_max; moments are taken at lower edges.
    """
    c = F.col
    n_bins = F.greatest(F.ceil(F.round((c("m_max") - m_min) / width, 6)), F.lit(1)).cast("int")
    tail = lambda m: F.pow(F.lit(10.0), -b * F.least(m, c("m_max")))
    low = m_min + width * c("bin")
    shaped = faults.withColumn("bin", F.explode(F.sequence(F.lit(0), n_bins - 1))).withColumns(
        {"shape": tail(low) - tail(low + width), "m0": F.pow(F.lit(10.0), 1.5 * low + moment_c)}
    )
    total = shaped.groupBy(key).agg(F.sum(c("shape") * c("m0")).alias("per_unit"))
    return shaped.join(total, key).select(key, "bin", (c("shape") * c("moment_rate") / c("per_unit")).alias("rate"))
