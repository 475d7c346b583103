"""Colour expressions; channel conventions follow the usual 8-bit images (hue 0-179)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rgb = tuple[Column, Column, Column]


def parse_hex(text: Column) -> Column:
    """array<int> of the three channels; an invalid text raises an error."""
    digits = F.regexp_replace(text, "^#", "")
    channel = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("int")
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.array(channel(1), channel(3), channel(5))).otherwise(
        F.raise_error(F.concat(F.lit("not a colour: "), F.coalesce(text, F.lit("null")))).cast("array<int>")
    )


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 180 - d)


def hsv(rgb: Rgb) -> tuple[Column, Column, Column]:
    """8-bit hue (0-179), saturation and value of 8-bit channels."""
    r, g, b = rgb
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    degrees = (
        F.when(span == 0, F.lit(0.0))
        .when(top == r, 60.0 * (g - b) / span)
        .when(top == g, 120.0 + 60.0 * (b - r) / span)
        .otherwise(240.0 + 60.0 * (r - g) / span)
    )
    hue = F.round(F.when(degrees < 0, degrees + 360).otherwise(degrees) / 2).cast("int") % 180
    saturation = F.when(top == 0, F.lit(0.0)).otherwise(255.0 * span / top)
    return hue, F.round(saturation).cast("int"), top.cast("int")


def lab(rgb: Rgb) -> tuple[Column, Column, Column]:
    """8-bit L, a, b of 8-bit sRGB channels (D65 white)."""

    def linear(c: Column) -> Column:
        v = c / 255.0
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = (linear(c) for c in rgb)
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    root = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)
    light = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    return F.round(light * 255 / 100), F.round(500.0 * (root(x) - root(y)) + 128), F.round(200.0 * (root(y) - root(z)) + 128)


def kit_distance(a: Rgb, b: Rgb) -> Column:
    """Distance in LAB with lightness damped to 0.4, over 255."""
    la, lb = lab(a), lab(b)
    parts = [(0.4 * (la[0] - lb[0])), la[1] - lb[1], la[2] - lb[2]]
    return F.sqrt(sum(p * p for p in parts)) / 255.0


def palette_color(track_id: Column, palette: list[str]) -> Column:
    """The palette entry of a track: its number modulo the size; other ids by a hash."""
    nr = F.coalesce(track_id.try_cast("bigint"), F.xxhash64(track_id))
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod(nr, F.lit(len(palette))) + 1).cast("int"))
