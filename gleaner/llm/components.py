"""Connected components of an edge list by alternating star operations.

In every round each partition first contracts its own edges to stars.  Then
the larger neighbours of each vertex are hung on its smallest one (large star)
and the smaller ones too (small star); the edges end as one star for each
component around its smallest vertex.  A vertex with very many edges is
aggregated before the shuffle; both sides of a join are written tables, so
Spark's skew handling can split its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import drop
from ._common import package_on_workers, pinned, scope


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around smallest vertices."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    found = [(a, find(a)) for a in list(root)]
    found = [x for x in found if x[0] != x[1]]
    for k in range(0, len(found), 100_000):
        a, b = zip(*found[k : k + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex hangs on one other at most, or has others on it."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of edges (a, b; longs) but the roots
    themselves; root is the smallest vertex of the component."""
    package_on_workers(edges.sparkSession)
    spark = edges.sparkSession
    edges = pinned(edges.where("a <> b").select("a", "b").mapInArrow(contracted, "a long, b long").distinct())
    while not _stars(edges):
        before = edges
        # A round's tables go when the next edges are written.
        with scope(spark) as kept:
            both = edges.mapInArrow(contracted, "a long, b long")
            both = pinned(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
            least = pinned(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
            large = pinned(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
            least = pinned(large.groupBy("a").agg(F.min("b").alias("m")))
            small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            edges = pinned(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
            kept.append(edges)
        drop(before)
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
