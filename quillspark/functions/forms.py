"""Parsing, formatting and unit laws as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .laws import clamp, luminance

#: Points per CSS unit; no unit means pixels.
POINTS_PER_UNIT = {"pt": 1.0, "px": 0.75, "": 0.75, "in": 72.0, "mm": 72.0 / 25.4, "cm": 72.0 / 2.54, "pc": 12.0}
#: A few CSS colour names.
NAMED_COLORS = {"black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "gray": "808080"}


def length_in_points(text: Column) -> Column:
    """``12mm`` in points; null if it has no number or an unknown unit."""
    parts = r"^\s*([-+]?[0-9.]+)\s*([a-z%]*)"
    number, unit = F.regexp_extract(text, parts, 1), F.regexp_extract(text, parts, 2)
    known = F.create_map(*[F.lit(x) for pair in POINTS_PER_UNIT.items() for x in pair])
    return F.try_element_at(known, unit) * number.try_cast("double")


def parse_color(text: Column) -> Column:
    """Struct r, g, b, a (0 to 1) of #rgb, #rrggbb, #rrggbbaa, rgb(), or a name; null for ``none`` and the rest."""
    low = F.lower(F.trim(text))
    names = F.create_map(*[F.lit(x) for pair in NAMED_COLORS.items() for x in pair])
    rgb = r"^rgb\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*\)$"
    digits = F.when(low.rlike("^#[0-9a-f]{6}([0-9a-f]{2})?$"), F.substring(low, 2, 8))
    digits = digits.when(low.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(F.substring(low, 2, 3), "(.)", "$1$1")).otherwise(F.try_element_at(names, low))
    pair = lambda k: F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("double") / 255
    part = lambda k: F.least(F.regexp_extract(low, rgb, k + 1).try_cast("double"), F.lit(255.0)) / 255
    channels = [F.when(low.rlike(rgb), part(k)).otherwise(pair(k)).alias("rgb"[k]) for k in range(3)]
    alpha = F.when(F.length(digits) == 8, pair(3)).otherwise(F.lit(1.0)).alias("a")
    return F.when(digits.isNotNull() | low.rlike(rgb), F.struct(*channels, alpha))


def number_text(value: Column, places: int) -> Column:
    """Fixed decimals without trailing zeros; ``-0`` is ``0``."""
    text = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", value), "0+$", ""), r"\.$", "")
    return F.when(text.isin("-0", ""), "0").otherwise(text)


def time_ago(now: Column, then: Column) -> Column:
    """Age of an epoch in seconds, or in milliseconds if above 1e12; null and 0 are ``never``."""
    seconds = F.greatest(F.lit(0.0), now - F.when(then > 1e12, then / 1000).otherwise(then))
    whole = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit + " ago"))
    text = F.when(seconds < 60, "just now").when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))
    return F.when(F.coalesce(then, F.lit(0)) == 0, "never").otherwise(text)


def next_hex_id(ident: Column) -> Column:
    """The id whose last hexadecimal group is one larger, in as many digits; null where it overflows or is no such id."""
    last = F.substring_index(ident, "-", -1)
    head = F.substring(ident, F.lit(1), F.length(ident) - F.length(last) - 1)
    up = F.conv(F.lpad((F.conv(last, 16, 10).cast("long") + 1).cast("string"), 20, "0"), 10, 16)
    return F.when(ident.rlike("-[0-9A-Fa-f]{1,15}$") & (head != "") & (F.length(up) <= F.length(last)), F.concat_ws("-", head, F.lpad(up, F.length(last), "0")))


def fixed_delta(bits: Column, fraction: int) -> Column:
    """Value of a 16-bit delta: a sign bit, then whole bits, then ``fraction`` bits."""
    size = bits.bitwiseAND(0x7FFF) / float(1 << fraction)
    return F.when(bits.bitwiseAND(0x8000) != 0, -size).otherwise(size)


def over_white(channel: Column, opacity: Column) -> Column:
    return 1 - opacity * (1 - channel)


def gray_level(r: Column, g: Column, b: Column, opacity: Column) -> Column:
    """Luminance over white, 0 to 255, and below it one of four gray levels by fixed bounds."""
    lum = F.bround(over_white(luminance(r, g, b), opacity) * 255).cast("int")
    return F.struct(lum.alias("lum"), F.when(lum < 64, 0).when(lum < 140, 1).when(lum < 217, 2).otherwise(3).alias("level"))


def clamped_width(size: Column, highlight: Column, pressure: Column) -> Column:
    """Size by pressure between 0.4 and 0.7; highlighters are 2.5 times as wide and constant."""
    return F.when(highlight, size * 2.5 * 0.45).otherwise(size * clamp(pressure, 0.4, 0.7))


def sequence_key(n: Column) -> Column:
    """Keys whose order as text is the order of ``n``: ``ba``, ``bb`` and so on, 25 letters a prefix."""
    return F.concat(F.lit("b"), F.repeat(F.lit("z"), F.floor(n / 25).cast("int")), F.chr((F.pmod(n, F.lit(25)) + 97).cast("long")))


def min_max(values: Column) -> Column:
    """Values scaled to 0..1 by the least and the largest; zeros if these are equal."""
    low, span = F.array_min(values), F.array_max(values) - F.array_min(values)
    return F.transform(values, lambda v: F.when(span > 0, clamp((v - low) / span, 0.0, 1.0)).otherwise(F.lit(0.0)))


def varint_hex(n: Column) -> Column:
    """Base-128 varint of a number from 0 to 2^63 - 1, as hexadecimal digits."""
    parts = [F.when((F.lit(k) == 0) | (F.shiftrightunsigned(n, 7 * k) != 0), F.lpad(F.hex(F.shiftrightunsigned(n, 7 * k).bitwiseAND(127) + F.when(F.shiftrightunsigned(n, 7 * k + 7) != 0, 128).otherwise(0)), 2, "0")) for k in range(9)]
    return F.concat_ws("", *parts)
