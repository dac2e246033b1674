"""Rates of faults by slip-rate laws with a bounded maximum, whose moment is that of the slip."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log10 M0 = 1.5 m + 16.05 (dyn cm), shear modulus in GPa, ratio of displacement to length.
MOMENT_C, SHEAR_GPA, DISPLACEMENT = 16.05, 30.0, 1.25e-5
#: Width of the characteristic box, and how far below it the exponential part has its density.
BOX, BELOW = 0.5, 1.0
LN10 = math.log(10)
D = 1.5 * LN10


def unit_displacement(width_km: Column, shear_gpa: float = SHEAR_GPA, ratio: float = DISPLACEMENT) -> Column:
    """Mean displacement (cm) of an event of magnitude 0 on a fault of that width, if displacement grows with length."""
    return F.sqrt(ratio * 10**MOMENT_C / (shear_gpa * 1e10 * width_km * 1e5))


def cumulative(kind: str, m: Column, m_max: Column, b: Column, slip_mm: Column, width_km: Column) -> Column:
    """Events a year at or above ``m``, by the law whose rate falls to its maximum like e^(b x) (al1: with all of the rest at
    the maximum), e^(b x) - 1 (al2) or e^(b x) - 1 - b x (al3), x below it. Each is scaled so that its moment is the slip's."""
    beta, x = b * LN10, m_max - m
    level = slip_mm / 10 / unit_displacement(width_km) * F.exp(-D / 2 * m_max)
    share, shape = {
        "al1": ((D - beta) / D, F.exp(beta * x)),
        "al2": ((D - beta) / beta, F.exp(beta * x) - 1),
        "al3": (D * (D - beta) / (beta * beta), F.exp(beta * x) - 1 - beta * x),
    }[kind]
    return F.when(x > 1e-9, level * share * shape).otherwise(0.0)


def characteristic(m: Column, m_min: float, m_max: Column, b: Column, moment_rate: Column) -> Column:
    """Events a year at or above ``m``: exponential up to a box below ``m_max`` in which all magnitudes are as frequent as BELOW under it.

    moment_rate in N m a year; moments grow by 10^1.5 a magnitude throughout.
    """
    beta, box = b * LN10, m_max - BOX
    moment = lambda v: F.pow(F.lit(10.0), 1.5 * v + (MOMENT_C - 7))
    flat = F.exp(-beta * (box - BELOW - m_min))
    inner = (moment(box) * F.exp(-beta * (box - m_min)) - moment(F.lit(m_min))) / (D - beta)
    outer = flat * (moment(m_max) - moment(box)) / D
    scale = moment_rate / (inner + outer)
    tail = lambda v: (F.exp(-beta * (F.least(v, box) - m_min)) - F.exp(-beta * (box - m_min))) / beta + flat * (m_max - F.least(F.greatest(v, box), m_max))
    return scale * tail(m)


def slip_rates(faults: DataFrame, kind: str, m_min: float, step: float, phi: float = 1.0) -> DataFrame:
    """(fault, bin, m, rate): incremental rates of bins of ``step`` around magnitudes from ``m_min`` to each fault's maximum.

    faults: fault, length, width (km), slip_rate (mm a year), b (below 1.5, or the fault is left out), m_max. ``kind`` is al1, al2, al3 or yc.
    """
    c = F.col
    slip = c("slip_rate") * phi
    held = faults.where((c("b") < 1.5) & (c("m_max") >= m_min) & (c("width") > 0))
    bins = F.sequence(F.lit(0), F.floor((c("m_max") - m_min) / step + 1e-9).cast("int"))
    rows = held.withColumn("bin", F.explode(bins)).withColumn("m", m_min + c("bin") * step)
    if kind == "yc":
        moment_rate = SHEAR_GPA * 1e9 * c("length") * c("width") * 1e6 * slip / 1000
        above = lambda m: characteristic(m, m_min - step / 2, c("m_max"), c("b"), moment_rate)
    else:
        above = lambda m: cumulative(kind, m, c("m_max"), c("b"), slip, c("width"))
    return rows.select("fault", "bin", "m", F.greatest(above(c("m") - step / 2) - above(c("m") + step / 2), F.lit(0.0)).alias("rate"))
