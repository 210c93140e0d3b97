"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize

#: So many links at most are followed in one task, without rounds (2 MB).
TOGETHER = 1 << 17


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the links (u, v), and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while (up[x] != up[y]).any():
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def _in_one_task(links: DataFrame) -> DataFrame:
    """(node, component) from few links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(k).to_numpy() for k in (0, 1)] for batch in batches]
        if held:
            found = smallest_reachable(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Up to `TOGETHER` links are followed in one task; ``links`` is read twice
    and should be written.  With more, each round links every larger neighbour of a node to the node's smallest
    neighbour, then every smaller one, until nothing changes; the rounds grow
    with the logarithm of the number of nodes.  Each round is written, so a
    lost executor costs one round at most.  Self-links and repeated links are
    harmless; links with a null end are ignored.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    if edges.count() <= TOGETHER:
        return materialize(_in_one_task(edges), "cc")
    edges = materialize(edges.distinct(), "cc-0")
    before = None
    while True:
        sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        edges, old = materialize(small, "cc"), edges
        discard(old)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
