"""Outlines of strokes with a width at each point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 7


def outlines(points: DataFrame) -> DataFrame:
    """(stroke, seq, x, y): closed outlines of strokes, from (stroke, i, x, y, half).

    Forward along one side, round the end, back along the other, round the
    start: twice the points and two caps of `CAP` points.  A stroke whose
    points all coincide has none.
    """
    w = Window.partitionBy("stroke").orderBy("i")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    size = F.hypot(dx, dy)
    unit = F.when(size > 1e-9, F.struct((dx / size).alias("x"), (dy / size).alias("y")))
    p = points.withColumn("u", unit).withColumn("n", F.count(F.lit(1)).over(all_))
    # Segments without length take the last direction before them, leading ones the first after.
    p = p.withColumn("d", F.coalesce(F.last("u", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("u", ignorenulls=True).over(all_)))
    p = p.where("d is not null").withColumn("b", F.lag("d").over(w))
    sx, sy = F.col("b.x") + F.col("d.x"), F.col("b.y") + F.col("d.y")
    length = F.hypot(sx, sy)
    inner = (F.col("i") > 0) & (F.col("i") < F.col("n") - 1) & (length > 1e-9)
    p = p.withColumn("tx", F.when(inner, sx / length).otherwise(F.col("d.x"))).withColumn("ty", F.when(inner, sy / length).otherwise(F.col("d.y")))
    at = lambda seq, nx, ny: F.struct(seq.cast("long").alias("seq"), (F.col("x") + F.col("half") * nx).alias("x"), (F.col("y") + F.col("half") * ny).alias("y"))
    i, n, tx, ty = F.col("i"), F.col("n"), F.col("tx"), F.col("ty")
    sides = F.array(at(i, -ty, tx), at(n + CAP + (n - 1 - i), ty, -tx))
    angles = [F.pi() * k / (CAP + 1) for k in range(1, CAP + 1)]
    end = F.array(*[at(n + k, -ty * F.cos(a) + tx * F.sin(a), tx * F.cos(a) + ty * F.sin(a)) for k, a in enumerate(angles)])
    start = F.array(*[at(2 * n + CAP + k, ty * F.cos(a) - tx * F.sin(a), -tx * F.cos(a) - ty * F.sin(a)) for k, a in enumerate(angles)])
    none = F.slice(sides, 1, 0)
    every = F.concat(sides, F.when(i == n - 1, end).otherwise(none), F.when(i == 0, start).otherwise(none))
    return p.select("stroke", F.explode(every).alias("o")).select("stroke", "o.seq", "o.x", "o.y")
