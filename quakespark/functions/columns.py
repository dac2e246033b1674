"""Column functions: geodesy, moments, magnitudes, binning, identifiers. All are built-in expressions.

Null inputs give null results throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in km, and the constant of log10(M0) = 1.5 Mw + c in N m.
EARTH_KM = 6371.0
MOMENT_C = 9.1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; the argument of the root is held within 0 and 1."""
    a = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    )
    # least and greatest skip nulls
    return F.when((lat1 + lon1 + lat2 + lon2).isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))))


def cosine_law_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the spherical law of cosines."""
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.when((lat1 + lon1 + lat2 + lon2).isNotNull(), EARTH_KM * F.acos(F.least(F.greatest(F.round(c, 12), F.lit(-1.0)), F.lit(1.0))))


def cell_area_km2(lon1: Column, lon2: Column, lat1: Column, lat2: Column) -> Column:
    return EARTH_KM**2 * F.abs(F.radians(lon2 - lon1)) * F.abs(F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)))


def wrap_longitude(lon: Column) -> Column:
    """0..360 to -180..180."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def moment(mw: Column, c: float = MOMENT_C) -> Column:
    return F.pow(F.lit(10.0), 1.5 * mw + c)


def magnitude(m0: Column, c: float = MOMENT_C) -> Column:
    """Moment magnitude; null where the moment isn't positive."""
    return F.when(m0 > 0, (F.log10(m0) - c) / 1.5)


def bin_magnitude(m: Column, width: float = 0.1) -> Column:
    """The nearest multiple of ``width``, halves to even."""
    return F.bround(m / width, 0) * width


def safe_log10(v: Column) -> Column:
    return F.when(v > 0, F.log10(v))


def canonical_id(value: Column) -> Column:
    """Lower-cased, cut at "<", trimmed, without one letter before its digits."""
    return F.regexp_replace(F.lower(F.trim(F.split_part(value, F.lit("<"), F.lit(1)))), "^[a-z](?=[0-9])", "")


def duration_years(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6 / (365.25 * 86400)


def window_km(m: Column) -> Column:
    """Radius of the space window of a mainshock of 1974."""
    return F.pow(F.lit(10.0), 0.1238 * m + 0.983)


def window_days(m: Column) -> Column:
    """Length of its time window."""
    return F.when(m >= 6.5, F.pow(F.lit(10.0), 0.032 * m + 2.7389)).otherwise(F.pow(F.lit(10.0), 0.5409 * m - 0.547))


def truncated_survival(m: Column, b: float, m_min: float, m_max: float) -> Column:
    """Share of events of a truncated Gutenberg-Richter law at or above m, within 0 and 1."""
    top = 10 ** (-b * m_max)
    share = (F.pow(F.lit(10.0), -b * F.least(F.greatest(m, F.lit(m_min)), F.lit(m_max))) - top) / (10 ** (-b * m_min) - top)
    return F.when(m.isNotNull(), F.greatest(share, F.lit(0.0)))
