"""7-character geohash as a native column expression.

The cell is found by bisection: 18 longitude bits and 17 latitude bits,
interleaved longitude first, five bits per base-32 character.  Like the
reference, the input is rounded to 7 decimals and every bisection midpoint is
rounded to 7 decimals (HALF_UP), which moves cell borders by < 1e-6 degrees
against the textbook closed form; the fold is kept so cells agree exactly.

One ``aggregate`` over the 18 steps carries both intervals and the
interleaved 35-bit code; its finish step cuts the code into 7 characters.
The whole cell is therefore a single expression evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: the geohash base-32 alphabet,
# the coordinate ranges, bit counts and the decimals kept in the bisection.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
LON_MIN, LON_MAX = -180.0, 180.0
LAT_MIN, LAT_MAX = -90.0, 90.0
LON_BITS, LAT_BITS = 18, 17
DECIMALS = 7
CHARS = 7


def _fold(lon: Column, lat: Column) -> Column:
    """Exact cell by the rounded bisection (slow path: interpreted higher-order function)."""
    lon = lon if isinstance(lon, Column) else F.col(lon)
    lat = lat if isinstance(lat, Column) else F.col(lat)
    init = F.struct(
        F.round(lon, DECIMALS).alias("x"),
        F.round(lat, DECIMALS).alias("y"),
        F.lit(LON_MIN).alias("lo1"),
        F.lit(LON_MAX).alias("hi1"),
        F.lit(LAT_MIN).alias("lo2"),
        F.lit(LAT_MAX).alias("hi2"),
        F.lit(0).cast("long").alias("code"),
    )

    def step(acc, i):
        m1 = F.round((acc["hi1"] + acc["lo1"]) / 2.0, DECIMALS)
        m2 = F.round((acc["hi2"] + acc["lo2"]) / 2.0, DECIMALS)
        up1 = acc["x"] >= m1
        up2 = acc["y"] >= m2
        code1 = acc["code"] * 2 + F.when(up1, 1).otherwise(0)
        return F.struct(
            acc["x"].alias("x"),
            acc["y"].alias("y"),
            F.when(up1, m1).otherwise(acc["lo1"]).alias("lo1"),
            F.when(up1, acc["hi1"]).otherwise(m1).alias("hi1"),
            F.when(up2, m2).otherwise(acc["lo2"]).alias("lo2"),
            F.when(up2, acc["hi2"]).otherwise(m2).alias("hi2"),
            # latitude contributes a bit on steps 1..17 only (35 bits in all)
            F.when(i <= LAT_BITS, code1 * 2 + F.when(up2, 1).otherwise(0)).otherwise(code1).alias("code"),
        )

    alphabet = F.array(*[F.lit(ch) for ch in BASE32])
    total = LON_BITS + LAT_BITS

    def finish(acc):
        return F.concat(
            *[
                F.element_at(alphabet, F.shiftright(acc["code"], total - 5 * (c + 1)).bitwiseAND(31).cast("int") + 1)
                for c in range(CHARS)
            ]
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(LON_BITS)), init, step, finish)


# A fold midpoint differs from the exact dyadic one by at most 18 roundings of
# 5e-8 (< 1e-6 degrees), and rounding the input moves it by <= 5e-8.  A point
# farther than this margin from every cell border of the finest level therefore
# gets the same bits from the closed form floor((x - min) / width * 2^bits).
BORDER_MARGIN_DEG = 2e-6


def _cell_index(v: Column, lo: float, hi: float, bits: int):
    scale = float(1 << bits)
    # What lies beyond a range is in its first or last cell by every bit, and the ends of a range are no border of a bisection.
    u = F.least(F.greatest((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(scale), F.lit(0.5)), F.lit(scale - 0.5))
    idx = F.floor(u)
    width = (hi - lo) / scale
    gap = F.least(u - idx, idx + 1 - u) * F.lit(width)
    unsafe = (gap < BORDER_MARGIN_DEG) | v.isNull() | F.isnan(v)
    return idx, unsafe


def geohash7(lon, lat) -> Column:
    """Geohash cell (7 chars) of a lon/lat pair of DOUBLE columns.

    Fast path: integer cell indexes, bit interleave and base-32 by plain
    codegen'd arithmetic; the exact rounded fold is evaluated only for the
    rare points within ``BORDER_MARGIN_DEG`` of a cell border (CASE evaluates
    only the branch taken)."""
    lon = lon if isinstance(lon, Column) else F.col(lon)
    lat = lat if isinstance(lat, Column) else F.col(lat)
    i1, unsafe1 = _cell_index(lon, LON_MIN, LON_MAX, LON_BITS)
    i2, unsafe2 = _cell_index(lat, LAT_MIN, LAT_MAX, LAT_BITS)
    total = LON_BITS + LAT_BITS
    terms = []
    for i in range(1, LON_BITS + 1):
        terms.append(F.shiftleft(F.shiftright(i1, LON_BITS - i).bitwiseAND(1), total - (2 * i - 1)))
        if i <= LAT_BITS:
            terms.append(F.shiftleft(F.shiftright(i2, LAT_BITS - i).bitwiseAND(1), total - 2 * i))
    code = terms[0]
    for t in terms[1:]:
        code = code.bitwiseOR(t)
    alphabet = F.array(*[F.lit(ch) for ch in BASE32])
    fast = F.concat(
        *[
            F.element_at(alphabet, F.shiftright(code, total - 5 * (c + 1)).bitwiseAND(31).cast("int") + 1)
            for c in range(CHARS)
        ]
    )
    return F.when(unsafe1 | unsafe2, _fold(lon, lat)).otherwise(fast)
