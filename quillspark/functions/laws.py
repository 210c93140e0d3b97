"""Width, pressure and colour laws as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def freedraw_factor(pressure: Column) -> Column:
    """Stroke thickness per unit of width at a pressure."""
    return 8.5 * F.sin(F.pi() / 2 * (0.5 + 0.6 * (pressure - 0.5)))


def freedraw_pressure(factor: Column) -> Column:
    """Inverse of `freedraw_factor`, clamped to 0..1."""
    return clamp((F.asin(clamp(factor / 8.5, 0.0, 1.0)) / (F.pi() / 2) - 0.5) / 0.6 + 0.5, 0.0, 1.0)


def calligraphy_width(scale: Column, theta: Column, pressure: Column) -> Column:
    return scale * F.greatest(2.855 - 2.176 * F.abs(F.sin(theta - F.radians(F.lit(92.0)))) + 1.004 * pressure, F.lit(0.5))


def force_width(base: Column, sensitivity: Column, force: Column) -> Column:
    return F.greatest(base * (1 + F.coalesce(sensitivity, F.lit(0.0)) * 2.43 * (force - 0.29)), 0.2 * base)


def force_of_width(base: Column, sensitivity: Column, width: Column) -> Column:
    return F.when((sensitivity > 0) & (base > 0), (width / base - 1) / (sensitivity * 2.43) + 0.29).otherwise(0.29)


def power_width(thickness: Column, k: Column, exponent: Column, pressure: Column) -> Column:
    return F.greatest(thickness * k * F.pow(pressure, exponent), F.lit(0.5))


def draw_width(size: Column, z: Column) -> Column:
    return (1.374 * size + 2.52) * (1 + 1.006 * (z - 0.5))


def channel_of(packed: Column, shift: int) -> Column:
    """One 0..1 channel of a packed colour."""
    return F.shiftright(packed, shift).bitwiseAND(255) / 255.0


def pack_argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.bround(c * 255).cast("long")
    return part(a) * 16777216 + part(r) * 65536 + part(g) * 256 + part(b)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b
