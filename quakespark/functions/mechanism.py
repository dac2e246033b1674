"""Focal mechanisms as column expressions, in east-north-up axes. Angles in degrees; a null input gives null for all that depends on it."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def slip_and_normal(strike: Column, dip: Column, rake: Column) -> tuple[Vector, Vector]:
    """Unit slip of the hanging wall and unit normal (upwards) of a plane that dips to the right of its strike."""
    s, d, r = F.radians(strike), F.radians(dip), F.radians(rake)
    along = (F.sin(s), F.cos(s), F.lit(0.0))
    updip = (-F.cos(s) * F.cos(d), F.sin(s) * F.cos(d), F.sin(d))
    slip = tuple(F.cos(r) * a + F.sin(r) * u for a, u in zip(along, updip, strict=True))
    return slip, _cross(along, updip)


def principal_axes(strike: Column, dip: Column, rake: Column) -> dict[str, tuple[Column, Column]]:
    """Plunge and azimuth of the T, P and N axes: T and P halve the angles of slip and normal, N is their product."""
    slip, normal = slip_and_normal(strike, dip, rake)
    axes = {
        "t": tuple((a + b) / math.sqrt(2) for a, b in zip(slip, normal, strict=True)),
        "p": tuple((a - b) / math.sqrt(2) for a, b in zip(slip, normal, strict=True)),
        "n": _cross(slip, normal),
    }
    return {name: plunge_azimuth(v) for name, v in axes.items()}


def plunge_azimuth(v: Vector) -> tuple[Column, Column]:
    """Of an unoriented unit vector: its angle below the horizon, and the azimuth of its lower end in 0..360."""
    down = F.when(v[2] > 0, -1.0).otherwise(1.0)
    plunge = F.degrees(F.asin(F.when(F.abs(v[2]) > 1, 1.0).otherwise(F.abs(v[2]))))
    return plunge, F.pmod(F.degrees(F.atan2(down * v[0], down * v[1])), F.lit(360.0))


def auxiliary_plane(strike: Column, dip: Column, rake: Column) -> tuple[Column, Column, Column]:
    """Strike, dip and rake of the other nodal plane: slip and normal change places."""
    n, s = slip_and_normal(strike, dip, rake)
    up = F.when(n[2] < 0, -1.0).otherwise(1.0)
    n, s = tuple(up * x for x in n), tuple(up * x for x in s)
    strike2 = F.pmod(F.degrees(F.atan2(-n[1], n[0])), F.lit(360.0))
    along = (F.sin(F.radians(strike2)), F.cos(F.radians(strike2)), F.lit(0.0))
    return strike2, F.degrees(F.acos(F.when(n[2] > 1, 1.0).otherwise(n[2]))), F.degrees(F.atan2(_dot(s, _cross(n, along)), _dot(s, along)))


def angle_between(a: Vector, b: Vector, oriented: bool = True) -> Column:
    """The angle of two vectors in degrees; within 0..90 if they aren't oriented."""
    cosine = _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.least(F.greatest(cosine if oriented else F.abs(cosine), F.lit(-1.0)), F.lit(1.0)))))


def tensor_of_plane(strike: Column, dip: Column, rake: Column) -> tuple[Column, ...]:
    """The six parts of a unit double couple in up-south-east axes: rr, tt, pp, rt, rp, tp."""
    s, n = slip_and_normal(strike, dip, rake)
    (e, no, u), (ne, nn, nu) = s, n
    return 2 * u * nu, 2 * no * nn, 2 * e * ne, -(u * nn + no * nu), u * ne + e * nu, -(no * ne + e * nn)


def _plane_of(normal: Vector, slip: Vector) -> tuple[Column, Column, Column]:
    """Strike, dip and rake of a unit normal and slip of any sign of both."""
    up = F.when(normal[2] < 0, -1.0).otherwise(1.0)
    n, s = tuple(up * x for x in normal), tuple(up * x for x in slip)
    strike = F.pmod(F.degrees(F.atan2(-n[1], n[0])), F.lit(360.0))
    along = (F.sin(F.radians(strike)), F.cos(F.radians(strike)), F.lit(0.0))
    return strike, F.degrees(F.acos(F.when(n[2] > 1, 1.0).otherwise(n[2]))), F.degrees(F.atan2(_dot(s, _cross(n, along)), _dot(s, along)))


def planes_of_tensor(df: DataFrame, names: tuple[str, ...], out: tuple[str, ...]) -> DataFrame:
    """Adds strike, dip and rake of both planes (six columns ``out``) of tensors with parts ``names`` (rr, tt, pp, rt, rp, tp).

    The largest and least eigenvalues of the tensor come in closed form; each axis is the longest product of two
    rows of the tensor less its eigenvalue. Slip and normal are the sum and difference of the two axes. Null for
    tensors with a null part and for tensors whose largest or least eigenvalue is not single, as of zero or isotropic ones.
    Steps are columns of their own, so that no expression is written out again in the next.
    """
    rr, tt, pp, rt, rp, tp = (F.col(f"`{n}`").cast("double") for n in names)
    held = df.withColumn("__size", F.greatest(*(F.abs(v) for v in (rr, tt, pp, rt, rp, tp))))
    whole = [F.col(f"`{n}`").isNotNull() for n in names]
    scale = F.when(functools.reduce(lambda a, b: a & b, whole) & (F.col("__size") > 0), F.col("__size"))
    # east, north, up
    parts = {"__a": pp / scale, "__b": tt / scale, "__c": rr / scale, "__d": -tp / scale, "__e": rp / scale, "__f": -rt / scale}
    held = held.withColumns(parts)
    a, b, c, d, e, f = (F.col(n) for n in parts)
    held = held.withColumn("__q", (a + b + c) / 3)
    q = F.col("__q")
    spread = F.sqrt((F.pow(a - q, 2) + F.pow(b - q, 2) + F.pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6)
    held = held.withColumn("__p", F.when(spread > 1e-12, spread))
    p = F.col("__p")
    x, y, z = (a - q) / p, (b - q) / p, (c - q) / p
    half = (x * (y * z - (f / p) * (f / p)) - (d / p) * ((d / p) * z - (f / p) * (e / p)) + (e / p) * ((d / p) * (f / p) - y * (e / p))) / 2
    held = held.withColumn("__turn", F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3)
    for axis, turn in (("t", 0.0), ("p", 2 * math.pi / 3)):
        w = q + 2 * p * F.cos(F.col("__turn") + turn)
        held = held.withColumn("__w", w)
        w = F.col("__w")
        rows = ((a - w, d, e), (d, b - w, f), (e, f, c - w))
        products = [_cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
        held = held.withColumn("__v", F.array_max(F.array(*(F.struct(F.sqrt(_dot(v, v)).alias("l"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z")) for v in products))))
        v = F.col("__v")
        held = held.withColumn(f"__{axis}", F.when(v["l"] > 1e-9, F.struct(*((v[n] / v["l"]).alias(n) for n in "xyz"))))
    t, pr = (tuple(F.col(f"__{n}")[k] for k in "xyz") for n in "tp")
    one, two = (tuple((i + j) / math.sqrt(2) for i, j in zip(t, pr, strict=True)), tuple((i - j) / math.sqrt(2) for i, j in zip(t, pr, strict=True)))
    for normal, slip, these in ((one, two, out[:3]), (two, one, out[3:])):
        held = held.withColumns(dict(zip(these, _plane_of(normal, slip), strict=True)))
    return held.select(*df.columns, *out)


def interface_like(planes: list[tuple[Column, Column, Column]], slab_strike: Column, slab_dip: Column, convergence: float, normal_cone: float = 35.0, slip_cone: float = 90.0) -> Column:
    """True if the normal of either plane lies within a cone about the slab's, of any sign, and its slip within one about
    the convergence as projected on the plane; a plane with a null part, or square to the convergence, doesn't pass.

    The rake is turned from the strike towards the dip here, so that the slip of a thrust is that of the plate below,
    which moves with the convergence.
    """
    az = math.radians(convergence)
    moved = (F.lit(math.sin(az)), F.lit(math.cos(az)), F.lit(0.0))
    _, slab = slip_and_normal(slab_strike, slab_dip, F.lit(0.0))
    passed = []
    for plane in planes:
        strike, dip, rake = plane
        slip, normal = slip_and_normal(strike, dip, -rake)
        across = _dot(moved, normal)
        on_plane = tuple(m - across * n for m, n in zip(moved, normal, strict=True))
        like = (angle_between(normal, slab, oriented=False) <= normal_cone) & (_dot(on_plane, on_plane) > 1e-12) & (angle_between(slip, on_plane) <= slip_cone)
        passed.append(F.coalesce(like, F.lit(False)))
    return functools.reduce(lambda a, b: a | b, passed)
