"""Column expressions: colour, geometry and hashing. All but ``dot`` and ``norm``, which fold arrays, stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def int_div(a, b) -> Column:
    return F.call_function("div", F.lit(a) if not isinstance(a, Column) else a,
                           F.lit(b) if not isinstance(b, Column) else b)


# --- packed pixels: one INT holds 0xYYRRGGBB, with Y the gray value --------------------------

def red(px: Column) -> Column:
    return F.shiftright(px, 16).bitwiseAND(255)


def green(px: Column) -> Column:
    return F.shiftright(px, 8).bitwiseAND(255)


def blue(px: Column) -> Column:
    return px.bitwiseAND(255)


def packed_luma(px: Column) -> Column:
    """Gray value: 0.299R + 0.587G + 0.114B, rounded half up when the raster was made."""
    return F.shiftrightunsigned(px, 24)


def packed_rgb(px: Column) -> Column:
    """0xRRGGBB; its order is (r, g, b) order."""
    return px.bitwiseAND(0xFFFFFF)


def packed_sum(px: Column) -> Column:
    return red(px) + green(px) + blue(px)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit HSV: hue 0..179 (half degrees), saturation and value 0..255, rounded half up."""
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    s = F.when(v == 0, 0).otherwise(int_div(510 * d + v, 2 * v)).cast("int")
    turn = (F.when(v == r, 60 * (g - b))
            .when(v == g, 60 * (b - r) + 120 * d)
            .otherwise(60 * (r - g) + 240 * d))
    h = F.when(d == 0, 0).otherwise(int_div(turn + d + 360 * d, 2 * d) % 180).cast("int")
    return h, s, v


def color_distance(a: tuple[Column, Column, Column], b: tuple) -> Column:
    """Euclidean RGB distance."""
    return F.sqrt(sum(((x - F.lit(y)) * (x - F.lit(y)) for x, y in zip(a, b)), F.lit(0)).cast("double"))


# --- moments from exact integer sums --------------------------------------------------------

def var_pop_of(n: Column, s1: Column, s2: Column) -> Column:
    """Population variance from count, sum and sum of squares of integers (exact numerator)."""
    n, s1, s2 = (c.cast("long") for c in (n, s1, s2))
    return (n * s2 - s1 * s1).cast("double") / (n * n).cast("double")


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / b.cast("double")


# --- hashing --------------------------------------------------------------------------------

def h32(col: Column) -> Column:
    """Stable 32-bit hash of a string: the first eight hex digits of its md5."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# --- boxes ----------------------------------------------------------------------------------

def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes, given as column prefixes; 0 when the union is empty."""
    iw = f"greatest(0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x))"
    ih = f"greatest(0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))"
    union = f"({a}w * {a}h + {b}w * {b}h - {iw} * {ih})"
    return F.expr(f"CASE WHEN {union} > 0 THEN CAST({iw} * {ih} AS DOUBLE) / CAST({union} AS DOUBLE) ELSE 0.0D END")


def box_score(w: Column, h: Column) -> Column:
    """Large and square boxes first: min(1, area / 300^2) * (1 - |w/h - 1|); 0 for a flat box."""
    return F.when((w > 0) & (h > 0),
                  F.least(F.lit(1.0), ratio(w * h, F.lit(90000))) * (1.0 - F.abs(ratio(w, h) - 1.0))
                  ).otherwise(F.lit(0.0))


# --- vectors --------------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, z: acc + z)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"),
                              lambda acc, z: acc + z.cast("double") * z.cast("double")))
