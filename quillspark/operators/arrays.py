"""Operators on strokes whose channels are arrays: folds and slices inside one row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_modes(values: Column, modes: Column) -> Column:
    """Positions of a trace whose values are explicit (0), first (1) or second (2) differences.

    A null mode keeps the one before; an explicit value also sets the velocity.
    """
    zero = F.struct(F.lit(0).alias("m"), F.lit(0.0).alias("p"), F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("out"))

    def step(a, x):
        m = F.coalesce(x["mode"], a["m"]).cast("int")
        v = F.when(m == 0, x["value"] - a["p"]).when(m == 1, x["value"]).otherwise(a["v"] + x["value"])
        p = a["p"] + v
        return F.struct(m.alias("m"), p.alias("p"), v.alias("v"), F.array_append(a["out"], p).alias("out"))

    pairs = F.zip_with(values, modes, lambda v, m: F.struct(v.cast("double").alias("value"), m.alias("mode")))
    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def middle(values: Column) -> Column:
    """Median of an array: the mean of the middle two if there are two."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def sensor_values(values: Column, n: Column, offset: Column, mapping: Column) -> Column:
    """The sensor sample of each of ``n`` points, by a mapping if there is one, else by an offset; the last sample serves for the rest."""
    last = F.size(values) - 1

    def sample(i):
        k = F.when((offset == 0) & (i > 0), i - 1).otherwise(i)
        at = F.when(mapping.isNotNull(), F.get(mapping, F.least(k, F.size(mapping) - 1))).otherwise(F.least(offset + k, last))
        return F.get(values, at)

    return F.transform(F.sequence(F.lit(0), n - 1), sample)


def trim_phantoms(xs: Column) -> Column:
    """Without a first point that repeats the second, and a last that repeats the one before."""
    n = F.size(xs)
    head = F.when((n > 1) & (F.get(xs, F.lit(0)) == F.get(xs, F.lit(1))), 1).otherwise(0)
    tail = F.when((n - head > 1) & (F.get(xs, n - 1) == F.get(xs, n - 2)), 1).otherwise(0)
    return F.slice(xs, head + 1, n - head - tail)


def parity_interval(crossings: Column) -> Column:
    """First interval around 0 among sorted crossings paired even-odd; null if none holds 0."""
    s = F.array_sort(crossings)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / 2).cast("int") - 1), lambda k: F.struct(F.get(s, 2 * k).alias("a"), F.get(s, 2 * k + 1).alias("b")))
    return F.when(F.size(s) > 1, F.get(F.filter(pairs, lambda p: (p["a"] <= 0) & (p["b"] >= 0)), F.lit(0)))


def append_missing(order: Column, every: Column) -> Column:
    """``order`` and then what else is in ``every``, in its order."""
    return F.concat(order, F.array_except(every, order))


def bezier(controls: list[Column], steps: int) -> Column:
    """Points 1 to ``steps`` of a curve with three or four controls (numbers)."""
    weight = {3: (1, 2, 1), 4: (1, 3, 3, 1)}[len(controls)]
    degree = len(controls) - 1

    def at(k):
        t = k / float(steps)
        return sum((w * F.pow(1 - t, F.lit(degree - j)) * F.pow(t, F.lit(j)) * c for j, (w, c) in enumerate(zip(weight, controls))), F.lit(0.0))

    return F.transform(F.sequence(F.lit(1), F.lit(steps)), at)


def rotate(x: Column, y: Column, cx: Column, cy: Column, angle: Column) -> Column:
    """Struct x, y: a point turned about a centre."""
    dx, dy = x - cx, y - cy
    return F.struct((cx + dx * F.cos(angle) - dy * F.sin(angle)).alias("x"), (cy + dx * F.sin(angle) + dy * F.cos(angle)).alias("y"))


def center_line(outline: Column, n: Column) -> Column:
    """Points (x, y, width) midway between the two sides of an outline of a stroke of ``n`` points; null unless it has 2n or 2n + 14 points."""
    size = F.size(outline)
    start = F.when(size == 2 * n, n + 1).when(size == 2 * n + 14, n + 8)
    mid = lambda f, b: F.struct(((f["x"] + b["x"]) / 2).alias("x"), ((f["y"] + b["y"]) / 2).alias("y"), F.hypot(f["x"] - b["x"], f["y"] - b["y"]).alias("width"))
    return F.when(start.isNotNull(), F.zip_with(F.slice(outline, F.lit(1), n), F.reverse(F.slice(outline, F.coalesce(start, F.lit(1)), n)), mid))
