"""Operators on ordered points: a table (stroke, i, ...) with one row per point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(key: str = "stroke", at: str = "i"):
    return Window.partitionBy(key).orderBy(at)


def delta_encode(points: DataFrame, value: Column, step: float, out: str = "d") -> DataFrame:
    """Differences of the values rounded half to even in units of ``step``; rounding never accumulates."""
    q = F.bround(value / step).cast("long")
    return points.withColumn("__q", q).withColumn(out, F.col("__q") - F.lag("__q", 1, 0).over(in_order())).drop("__q")


def delta_decode(points: DataFrame, d: str, step: float, out: str = "v") -> DataFrame:
    return points.withColumn(out, F.sum(d).over(in_order().rowsBetween(Window.unboundedPreceding, 0)) * step)


def second_difference(points: DataFrame, value: str, out: str = "dd") -> DataFrame:
    w = in_order()
    return points.withColumn(out, F.col(value) + F.lag(value, 2, 0).over(w) - 2 * F.lag(value, 1, 0).over(w))


def undo_second_difference(points: DataFrame, dd: str, out: str = "v") -> DataFrame:
    up = in_order().rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("__s", F.sum(dd).over(up)).withColumn(out, F.sum("__s").over(up)).drop("__s")


def rebase(points: DataFrame, time: str, out: str = "t") -> DataFrame:
    return points.withColumn(out, F.col(time) - F.first(time).over(in_order()))


def drop_repeats(points: DataFrame, *values: str) -> DataFrame:
    """Points equal to the one before go."""
    w = in_order()
    same = F.col("i") > 0
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    return points.withColumn("__same", same).where("not __same").drop("__same")


def run_lengths(points: DataFrame, value: str, most: int) -> DataFrame:
    """(stroke, run, value, length): runs of equal values, long ones in chunks of ``most``."""
    w = in_order()
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.col("i") == 0)).cast("int")
    runs = points.withColumn("__c", change).withColumn("__r", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("stroke", "__r").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))
    chunks = runs.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {most})")))
    return chunks.select("stroke", F.col("__r").alias("run"), "chunk", value, F.least(F.lit(most), F.col("n") - F.col("chunk") * most).alias("length"))


def split_at(points: DataFrame, is_break: Column) -> DataFrame:
    """Add ``part``: sub-paths between break points, which go."""
    up = in_order().rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("__b", is_break.cast("int")).withColumn("part", F.sum("__b").over(up)).where("__b = 0").drop("__b")


def directions(points: DataFrame, x: str, y: str) -> DataFrame:
    """Add ``dir``: angle to the next point; where the two coincide, the last one before, else the first one after."""
    w = in_order()
    dx, dy = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    p = points.withColumn("__d", F.when(F.hypot(dx, dy) > 1e-9, F.atan2(dy, dx)))
    carried = F.last("__d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__d", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return p.withColumn("dir", F.coalesce(carried, ahead)).drop("__d")


def width_runs(strokes: DataFrame, widths: str, tolerance: float = 0.35) -> DataFrame:
    """Add ``starts``: first points (from 0) of the runs of nearly constant width.

    A point opens a run if its width differs by more than ``tolerance`` from
    that of the run's first point and the run has more than one point.
    """
    fold = F.aggregate(
        F.slice(F.col(widths), 2, F.greatest(F.size(widths) - 1, F.lit(0))),
        F.struct(F.element_at(widths, 1).alias("w"), F.lit(1).alias("n"), F.lit(1).alias("i"), F.array(F.lit(0)).alias("s")),
        lambda a, w: F.when(
            (F.abs(w - a["w"]) > tolerance) & (a["n"] > 1),
            F.struct(w.alias("w"), F.lit(2).alias("n"), (a["i"] + 1).alias("i"), F.array_append(a["s"], a["i"]).alias("s")),
        ).otherwise(F.struct(a["w"].alias("w"), (a["n"] + 1).alias("n"), (a["i"] + 1).alias("i"), a["s"].alias("s"))),
        lambda a: a["s"],
    )
    return strokes.withColumn("starts", fold)
