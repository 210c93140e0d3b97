"""Aggregations over strokes, documents and pixels; nearest matches; trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Values between which the values of a group are split into buckets, to rank them in many tasks.
BOUNDS = 64


def with_buckets(rows: DataFrame, key: str, value: str, n: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, value, n) with a ``bucket`` by value, and (key, bucket, before, total) of each bucket.

    The bounds are about equal shares of a group's rows; where they lie decides
    how large buckets are, never a rank.
    """
    shares = F.array(*[F.lit((k + 1) / (BOUNDS + 1)) for k in range(BOUNDS)])
    bounds = rows.groupBy(key).agg(F.percentile_approx(value, shares, F.lit(1000)).alias("bounds"))
    bounds = bounds.select(F.col(key).alias("__key"), F.array_distinct("bounds").alias("bounds"))
    placed = rows.join(bounds, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    placed = placed.withColumn("bucket", F.size(F.filter("bounds", lambda x: x < F.col(value)))).drop("bounds")
    sizes = placed.groupBy(key, "bucket").agg(F.sum(n).alias("size"))
    w = Window.partitionBy(key)  # a row for each bucket
    before = F.sum("size").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return placed, sizes.select(key, "bucket", before.alias("before"), "size", F.sum("size").over(w).alias("total"))


def values_at(rows: DataFrame, key: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(key, n, and a value for each of ``ranks``): elements of a group's sorted values, by functions of their number n, from 0.

    Nulls are left out.  Equal values are counted before they are sorted, and
    only the buckets that hold a rank are sorted, each in a task of its own.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    placed, sizes = with_buckets(counted, key, value, "__n")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("total")).cast("long").alias("at")) for name, at in ranks.items()])
    needed = sizes.withColumn("want", F.filter(wanted, lambda x: (x["at"] >= F.col("before")) & (x["at"] < F.col("before") + F.col("size")))).where(F.size("want") > 0)
    needed = needed.select(F.col(key).alias("__key"), F.col("bucket").alias("__bucket"), "before", "want", "total")
    inside = placed.join(needed, F.col(key).eqNullSafe(F.col("__key")) & (F.col("bucket") == F.col("__bucket"))).drop("__key", "__bucket")
    upto = F.col("before") + F.sum("__n").over(Window.partitionBy(key, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("upto", upto).withColumn("__w", F.explode("want")).where((F.col("__w.at") < F.col("upto")) & (F.col("__w.at") >= F.col("upto") - F.col("__n")))
    return found.groupBy(key).agg(F.max("total").alias("n"), *[F.max(F.when(F.col("__w.name") == name, F.col(value))).alias(name) for name in ranks])


#: The two middle elements, whose mean is the median.
MIDDLE = {"__low": lambda n: F.floor((n - 1) / 2), "__high": lambda n: F.floor(n / 2)}


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median), exact."""
    return values_at(rows, key, value, MIDDLE).select(key, "n", ((F.col("__low") + F.col("__high")) / 2).alias("median"))


def quartiles_by_index(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median, q1, q3): quartiles are the elements n//4 and 3n//4 of the sorted values, from 0."""
    found = values_at(rows, key, value, MIDDLE | {"q1": lambda n: F.floor(n / 4), "q3": lambda n: F.floor(3 * n / 4)})
    return found.select(key, "n", ((F.col("__low") + F.col("__high")) / 2).alias("median"), "q1", "q3")


def numbered(rows: DataFrame, first: str, *then: Column, name: str = "nth") -> DataFrame:
    """Rows numbered from 1 by ``first``, a number, descending, nulls last, and then by other columns; no task sees all rows."""
    keyed = rows.withColumn("__all", F.lit(0)).withColumn("__value", -F.coalesce(F.col(first).cast("double"), F.lit(float("-inf")))).withColumn("__one", F.lit(1))
    placed, sizes = with_buckets(keyed, "__all", "__value", "__one")
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("__value", *then))
    ranked = placed.join(sizes.select("bucket", "before"), "bucket").withColumn(name, (F.col("before") + within).cast("long"))
    return ranked.select(*rows.columns, name)


def nearest(points: DataFrame, targets: list[tuple], dims: list[str]) -> DataFrame:
    """Each point with the ``target`` of least squared distance (the first on ties) and that distance ``d2``.

    ``targets`` lists (target, one value for each of ``dims``): a palette or
    the like, which goes into the expression, so rows stay where they are and
    repeated rows stay apart.
    """
    kind = ", ".join(["d2 double", "nth int", "target " + ("int" if isinstance(targets[0][0], int) else "string")])
    each = [F.struct(sum(((F.col(d) - F.lit(v)) * (F.col(d) - F.lit(v)) for d, v in zip(dims, at)), F.lit(0.0)).alias("d2"), F.lit(k).alias("nth"), F.lit(target).alias("target")) for k, (target, *at) in enumerate(targets)]
    best = F.array_min(F.array(*each).cast(f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>"))
    return points.withColumn("__m", best).select(*points.columns, F.col("__m.target").alias("target"), F.col("__m.d2").alias("d2"))


def spans_covering(records: DataFrame, spans: DataFrame) -> DataFrame:
    """Records (key, at) with the spans (key, first, last, tag) that cover them: an equi-join on exploded positions."""
    return records.join(spans.select("key", "tag", F.explode(F.sequence("first", "last")).alias("at")), ["key", "at"])


def text_entropy(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy, in bits, of the bytes of each key's texts; null and empty texts have no bytes and no row."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256) for x in batch.column(1).to_pylist()]
            at = [np.flatnonzero(c) for c in counts]
            row = np.repeat(np.arange(len(at)), [len(x) for x in at])
            values = [np.concatenate(x) if at else np.empty(0, np.int64) for x in (at, [c[x] for c, x in zip(counts, at)])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(values[0], pa.int32()), pa.array(values[1], pa.int64())], names=[key, "byte", "n"])

    each = rows.select(key, F.encode(F.col(text), "utf-8")).mapInArrow(run, f"{key} {kind}, byte int, n long")
    counts = each.groupBy(key, "byte").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(key))  # 256 rows at most
    return counts.withColumn("h", -p * F.log2(p)).groupBy(key).agg(F.sum("h").alias("entropy"), F.sum("n").alias("size"))


def magic(head: Column) -> Column:
    """Kind of a container by its first characters; the first that fits."""
    case = F.when(head.startswith("PK"), "zip")
    for prefix, kind in (("%PDF", "pdf"), ("bplist", "plist"), ("SQLite", "sqlite"), ("<!DOCTYPE", "html"), ("<html", "html"), ("<?xml", "xml"), ("<", "markup"), ("{", "json"), ("[", "json")):
        case = case.when(head.startswith(prefix), kind)
    return case.otherwise("unknown")


def pixel_match(pixels: DataFrame, tolerance: int) -> DataFrame:
    """(page, pixels, differing, match, ink_match) from (page, a, b, ink)."""
    differs = F.abs(F.col("a") - F.col("b")) > tolerance
    n, d, ink, both = F.count(F.lit(1)), F.count_if(differs), F.count_if("ink"), F.count_if(differs & F.col("ink"))
    return pixels.groupBy("page").agg(n.alias("pixels"), d.alias("differing"), (1 - d / n).alias("match"), F.when(ink == 0, 1.0).otherwise(1 - both / ink).alias("ink_match"))


def folder_paths(nodes: DataFrame, doublings: int = 6) -> DataFrame:
    """(id, path, trashed) from (id, parent, name): names from the root.

    The climb ends at a missing parent, at ``trash`` or after 2**doublings
    names, so cycles end.  Only nodes that are parents climb, each round twice
    as far; the others take the path of their parent.
    """
    parents = nodes.select(F.col("parent").alias("id")).where("id is not null").distinct()
    in_trash = F.coalesce(F.col("parent") == "trash", F.lit(False))
    up = nodes.join(parents, "id", "left_semi").select("id", F.when(~in_trash, F.col("parent")).alias("top"), F.col("name").alias("path"), in_trash.alias("trashed"))
    for _ in range(doublings):
        above = up.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("path").alias("over"), F.col("trashed").alias("gone"))
        up = up.join(above, "top", "left").select("id", F.col("next").alias("top"), F.concat_ws("/", "over", "path").alias("path"), (F.col("trashed") | F.coalesce("gone", F.lit(False))).alias("trashed"))
    above = up.select(F.col("id").alias("parent"), F.col("path").alias("over"), F.col("trashed").alias("gone"))
    return nodes.join(above, "parent", "left").select("id", F.when(in_trash, F.col("name")).otherwise(F.concat_ws("/", "over", "name")).alias("path"), (in_trash | F.coalesce("gone", F.lit(False))).alias("trashed"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")
