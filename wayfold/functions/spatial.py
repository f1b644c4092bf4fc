"""Spatial column expressions: projection to a segment, great-circle distance,
endpoint choice.  All are native Catalyst expressions (codegen, no Python UDF),
meant to be used inside table jobs (``operators.spatial_jobs``).

Division uses ``try_divide`` so that ANSI mode does not raise on a zero
denominator; the reference's NaN outcomes are reproduced with explicit rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results:
# degrees-to-radians factor and earth radius (metres) of its distance formula.
DEG_TO_RAD = 0.01745329252
EARTH_RADIUS_M = 6370693.5


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def great_circle_m(lon1, lat1, lon2, lat2) -> Column:
    """Metres on the sphere by the law of cosines; rounding can't take the cosine out of [-1, 1]."""
    la, lb = (_c(v) * F.lit(DEG_TO_RAD) for v in (lat1, lat2))
    turn = _c(lon1) * F.lit(DEG_TO_RAD) - _c(lon2) * F.lit(DEG_TO_RAD)
    cosine = F.sin(la) * F.sin(lb) + F.cos(la) * F.cos(lb) * F.cos(turn)
    return F.lit(EARTH_RADIUS_M) * F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


# Semi-major axis (metres) and flattening of the WGS 84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
#: Rounds of the longitude iteration; each shrinks the error by about the flattening (points near each other's antipode aside).
GEODESIC_ROUNDS = 12


def geodesic_m(lon1, lat1, lon2, lat2) -> Column:
    """Metres along the WGS 84 ellipsoid by Vincenty's inverse formula, as one column.

    The difference of longitudes on the auxiliary sphere is iterated in an aggregate over a short sequence.  Between points
    almost opposite each other the iteration does not settle; such pairs are no use of a radius search."""
    rad = lambda v: F.radians(_c(v))
    f, a, b = WGS84_F, WGS84_A, WGS84_A * (1 - WGS84_F)
    u1, u2 = (F.atan(F.lit(1 - f) * F.tan(rad(v))) for v in (lat1, lat2))
    away = rad(lon2) - rad(lon1)
    fixed = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"))

    def arc(k: Column, lam: Column) -> dict[str, Column]:
        """Quantities of the great circle on the auxiliary sphere for one difference of longitudes."""
        p = k["c2"] * F.sin(lam)
        q = k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam)
        sin_s, cos_s = F.sqrt(p * p + q * q), k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam)
        sin_a = F.coalesce(F.try_divide(k["c1"] * k["c2"] * F.sin(lam), sin_s), F.lit(0.0))
        cos2a = F.lit(1.0) - sin_a * sin_a
        mid = cos_s - F.coalesce(F.try_divide(F.lit(2.0) * k["s1"] * k["s2"], cos2a), F.lit(0.0))  # 0 along the equator
        return {"sin_s": sin_s, "cos_s": cos_s, "s": F.atan2(sin_s, cos_s), "sin_a": sin_a, "cos2a": cos2a, "mid": mid}

    def turned(state: Column, _i: Column) -> Column:
        g = arc(state["k"], state["lam"])
        c = F.lit(f / 16) * g["cos2a"] * (F.lit(4.0) + F.lit(f) * (F.lit(4.0) - F.lit(3.0) * g["cos2a"]))
        inner = g["mid"] + c * g["cos_s"] * (F.lit(-1.0) + F.lit(2.0) * g["mid"] * g["mid"])
        lam = state["l"] + (F.lit(1.0) - c) * F.lit(f) * g["sin_a"] * (g["s"] + c * g["sin_s"] * inner)
        return F.struct(state["k"].alias("k"), state["l"].alias("l"), lam.alias("lam"))

    def metres(state: Column) -> Column:
        g = arc(state["k"], state["lam"])
        u = g["cos2a"] * F.lit((a * a - b * b) / (b * b))
        big = F.lit(1.0) + u / 16384 * (F.lit(4096.0) + u * (F.lit(-768.0) + u * (F.lit(320.0) - F.lit(175.0) * u)))
        small = u / 1024 * (F.lit(256.0) + u * (F.lit(-128.0) + u * (F.lit(74.0) - F.lit(47.0) * u)))
        m2 = g["mid"] * g["mid"]
        tail = small / 6 * g["mid"] * (F.lit(-3.0) + F.lit(4.0) * g["sin_s"] * g["sin_s"]) * (F.lit(-3.0) + F.lit(4.0) * m2)
        shift = small * g["sin_s"] * (g["mid"] + small / 4 * (g["cos_s"] * (F.lit(-1.0) + F.lit(2.0) * m2) - tail))
        return F.lit(b) * big * (g["s"] - shift)

    start = F.struct(fixed.alias("k"), away.alias("l"), away.alias("lam"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(GEODESIC_ROUNDS)), start, turned, metres)


#: Vectors shorter than this (degrees, a tenth of a millimetre) have no direction, and cosines closer than it are equal.
NOISE = 1e-9
#: Distances that differ by less (metres) are equal: the law of cosines is no finer over a road's length.
TIE_M = 1e-3


def project_to_segment(x, y, x1, y1, x2, y2) -> Column:
    """The point of segment (x1, y1)-(x2, y2) nearest to (x, y) in the lon/lat plane.

    The share of the way from the first to the second end at which the perpendicular meets the line is
    held within 0 and 1.  Returns ``struct<x: double, y: double>``; a segment without length gives its
    end (the reference yields NaN there)."""
    x, y, x1, y1, x2, y2 = map(_c, (x, y, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    share = F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy)
    share = F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0))
    return F.struct(
        F.when(share >= 1.0, x2).otherwise(x1 + share * dx).alias("x"),
        F.when(share >= 1.0, y2).otherwise(y1 + share * dy).alias("y"),
    )


def _cosine(vx, vy, ux, uy) -> Column:
    """Cosine of the angle between two plane vectors; null where one of them has no direction."""
    v, u = F.sqrt(vx * vx + vy * vy), F.sqrt(ux * ux + uy * uy)
    return F.when((v > NOISE) & (u > NOISE), F.try_divide(vx * ux + vy * uy, v * u))


def facing_end_is_first_from(tx, ty, x1, y1, x2, y2, ox, oy) -> Column:
    """As ``facing_end_is_first`` with the projection (tx, ty) given (e.g. a
    column computed in an earlier projection, to keep generated code small)."""
    tx, ty = _c(tx), _c(ty)
    vx, vy = _c(ox) - tx, _c(oy) - ty
    c1 = _cosine(vx, vy, _c(x1) - tx, _c(y1) - ty)
    c2 = _cosine(vx, vy, _c(x2) - tx, _c(y2) - ty)
    return F.coalesce(c1 > c2 + NOISE, F.lit(False))  # the smaller angle has the larger cosine


def facing_end_is_first(gx, gy, x1, y1, x2, y2, ox, oy) -> Column:
    """For a GPS point (gx, gy) on segment 1-2 and the other GPS point (ox, oy):
    True when end 1 makes the smaller angle, seen from the projection, with the
    direction to the other point.  Ties or undefined angles pick end 2."""
    p = project_to_segment(gx, gy, x1, y1, x2, y2)
    return facing_end_is_first_from(p["x"], p["y"], x1, y1, x2, y2, ox, oy)
