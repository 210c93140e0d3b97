"""Intermediate tables that outlive the executors which wrote them.

Lineage is cut by writing Parquet below the folder that the session names in
``spark.checkpoint.dir``.  A folder of our own is used only where that
setting is absent and driver and executors are one process (tests, a laptop);
a cluster without the setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

_OWN: dict[str, str] = {}


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_prefix(columns: list[str], prefix: str) -> str:
    """``prefix``, made longer until no column begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix = "_" + prefix
    return prefix


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a private one where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="quill-")
    return "file://" + _OWN[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the copy.

    The table is removed when the driver's JVM ends, or by `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_at = path
    return written


def discard(*tables: DataFrame) -> None:
    """Remove tables of `materialize` that nothing reads any more: what was made of them has been written itself."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(t._written_at)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def commonest(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the largest counts ``n``: at most ``most``, all or none of those with equal counts.

    The cut is found from how many rows have each count, so that tasks send
    no more than the rows which stay.
    """
    cut, total = None, 0
    for row in counts.groupBy(n).count().orderBy(F.col(n).desc()).limit(most).collect():
        total += row["count"]
        if total > most:
            break
        cut = row[n]
    return counts.where(F.col(n) >= F.lit(cut)) if cut is not None else counts.limit(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
