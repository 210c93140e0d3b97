"""Exact duplicates by skew-safe combining.

Equal texts are merged three times: inside each map task (Spark's partial
aggregation), then per digest and salt, then over the salts of a digest.
The whole folded text is a grouping key each time, so a digest alone never
decides.  A group that holds a third of all rows is spread over ``salts``
tasks and reaches the last step as at most ``salts`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .store import free_prefix, materialize, named

SALTS = 64
_P = "__dd_"


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _folded(df: DataFrame, text: str, digest, keep: list[str], with_text: bool, p: str) -> DataFrame:
    """The columns ``keep`` of ``df``, the digest of the folded text and, if ``with_text``, the folded text."""
    # Positions stand for names meanwhile, which may have dots.
    slim = df.select(*[named(c).alias(f"c{k}") for k, c in enumerate(keep)], named(text).alias("t"))
    added = ["digest"] + (["text"] if with_text else [])
    schema = StructType([*slim.schema.fields[:-1], *(StructField(c, StringType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = pc.ascii_lower(pc.fill_null(batch.column("t"), ""))
            columns = [*batch.columns[:-1], pa.array([digest(x) for x in folded.cast(pa.binary()).to_pylist()], pa.string())]
            if with_text:
                columns.append(folded)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return slim.mapInArrow(run, schema).toDF(*keep, *(p + c for c in added))


def _winners(docs: DataFrame, text: str, id_col: str, salts: int, digest, p: str) -> tuple[DataFrame, bool]:
    """A row for each digest, text and salt: keep, size, and the text if its digest has others too; whether any has."""
    d, s, t = f"{p}digest", f"{p}salt", f"{p}text"
    slim = _folded(docs.select(named(id_col).alias(f"{p}id"), named(text).alias(f"{p}in")), f"{p}in", digest, [f"{p}id"], True, p)
    by_salt = slim.groupBy(d, F.pmod(F.xxhash64(f"{p}id"), F.lit(salts)).cast("int").alias(s), t).agg(F.max(f"{p}id").alias(f"{p}keep"), F.count(F.lit(1)).alias(f"{p}size"))
    # Salt winners meet by digest; partitioning by the digest alone serves both groupings below.
    merged = by_salt.repartition(F.col(d)).groupBy(d, t).agg(F.max(f"{p}keep").alias(f"{p}keep"), F.sum(f"{p}size").alias(f"{p}size"), F.collect_set(s).alias(f"{p}salts"))
    alone = F.count(F.lit(1)).over(Window.partitionBy(d)) == 1
    found = materialize(merged.withColumn(t, F.when(~alone, F.col(t))).select(d, t, f"{p}keep", f"{p}size", F.explode(f"{p}salts").alias(s)), "dedup-winners")
    return found, not found.where(F.col(t).isNotNull()).isEmpty()


def tag_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", salts: int = SALTS, digest=_digest, carry: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Every row of ``docs`` (its columns ``carry``, all by default) with four helper columns.

    Their names begin with ``prefix``, by default ``__dd_``, or that after as
    many underscores as no column of ``docs`` begins with.  ``__dd_digest`` (sha256, lower-case hex, of the text with A-Z lowered),
    ``__dd_keep`` (largest id among equal texts), ``__dd_size`` (rows with
    that text) and ``__dd_kept``.

    Null text counts as empty.  A null id is smaller than any other.  Of rows
    that repeat the winning id, exactly one stays.  No input row gives no
    output row.  Other columns pass through untouched, whatever their names.
    ``digest`` may collide: texts are compared whole, and only if some digest
    has several texts do texts go along to the last join.
    """
    p = prefix or free_prefix(docs.columns, _P)
    d, s, t = f"{p}digest", f"{p}salt", f"{p}text"
    winners, collide = _winners(docs, text, id_col, salts, digest, p)
    carry = docs.columns if carry is None else carry
    rows = _folded(docs, text, digest, carry, collide, p).withColumn(s, F.pmod(F.xxhash64(named(id_col)), F.lit(salts)).cast("int"))
    w = winners.select(*[F.col(c).alias(f"{c}_w") for c in (d, s, t)], f"{p}keep", f"{p}size")
    on = (F.col(d) == F.col(f"{d}_w")) & (F.col(s) == F.col(f"{s}_w"))
    if collide:
        on = on & (F.col(f"{t}_w").isNull() | (F.col(t) == F.col(f"{t}_w")))
    texts = [t] if collide else []
    joined = rows.join(w, on).drop(f"{d}_w", f"{s}_w", f"{t}_w")
    nth = F.row_number().over(Window.partitionBy(d, s, *texts, named(id_col)).orderBy(named(id_col)))
    return joined.withColumn(f"{p}kept", named(id_col).eqNullSafe(F.col(f"{p}keep")) & (nth == 1)).drop(s, *texts)


def exact_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", salts: int = SALTS, digest=_digest) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``; see `tag_duplicates`."""
    slim = docs.select(named(id_col).alias("id"), named(text).alias("text"))
    return tag_duplicates(slim, "text", "id", salts, digest, carry=["id"], prefix=_P).select(
        F.col("id").alias(id_col),
        F.col(f"{_P}keep").alias("keep_id"),
        F.col(f"{_P}size").alias("group_size"),
        F.col(f"{_P}kept").alias("kept"),
        F.col(f"{_P}digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    p = free_prefix(docs.columns, _P)
    return tag_duplicates(docs, text, id_col, prefix=p).where(F.col(f"{p}kept")).select(*[named(c) for c in docs.columns])


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
