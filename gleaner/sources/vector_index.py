"""A persisted index of vectors in coarse cells.

Vectors lie in folders by cell (see operators.cells).  A query reads the cells
that are nearest to it (``probes``), or, exactly, as many as can hold one of its
nearest vectors: the k-th best score of the first cells rules out all cells
whose angle and radius allow no better one.  An update places new vectors in the
cells that are there, and names the ids that don't count any more; when vectors
have doubled since cells were trained, ``stale`` says so.

Up to ``cells`` centres go to the driver and to the workers.  A cell that many
vectors share is split by id, and a task compares a bounded number of vectors
with a bounded number of queries.  All vectors have one size; those without a
direction have a cell of their own and score 0.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import cosine
from ..operators import cells as C
from .staging import package_on_workers, pinned
from .store import Folder

#: Vectors or queries that one task compares at once.
BLOCK = 4096


class VectorIndex(Folder):
    """rows have id and embedding, and may carry more columns to filter by."""

    def __init__(self, spark: SparkSession, path: str, cells: int = 4096, cell_rows: int = 1000, split_rows: int = 1_000_000, keep: int = 2, grace: float = 3600.0):
        super().__init__(spark, path, keep, grace)
        self._cells, self._cell_rows, self._split_rows = cells, cell_rows, split_rows

    # Writing

    def _generation(self, rows: DataFrame, dead: DataFrame | None, middle: np.ndarray, version: int) -> tuple[dict, int]:
        made = {"vectors": self.new("vectors"), "cells": self.new("cells"), "dead": None}
        n = rows.count()
        splits = max(1, -(-n // self._split_rows))
        at = C.placed(rows, middle).withColumn("since", F.lit(version).cast("long"))
        dealt = at.withColumn("split", F.pmod(F.xxhash64("id"), F.lit(splits))).repartition("cell", "split").drop("split")
        dealt.write.partitionBy("cell").parquet(f"{self.path}/{made['vectors']}")
        written = self.spark.read.schema(at.schema).parquet(f"{self.path}/{made['vectors']}")
        written.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{self.path}/{made['cells']}")
        if dead is not None:
            made["dead"] = self.new("dead")
            dead.select("id").withColumn("dead_since", F.lit(version).cast("long")).write.parquet(f"{self.path}/{made['dead']}")
        return made, n

    def _named(self, generations: list[dict], middle: str, **content) -> dict:
        return {**content, "generations": generations, "centres": middle, "folders": [middle, *(f for g in generations for f in (g["vectors"], g["cells"], g["dead"]) if f)]}

    def build(self, rows: DataFrame, of: int = 0) -> None:
        """Trains cells and indexes all vectors anew.  of: a number that the
        index is known by, for instance the version of a table."""
        v = self.version() + 1
        rows = rows.where("embedding is not null")
        n = rows.count()
        middle = C.centres(rows, max(1, min(self._cells, n // self._cell_rows)), n)
        folder = self.new("centres")
        self.spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(middle)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/{folder}")
        made, n = self._generation(rows, None, middle, v)
        self.commit(v, self._named([made], folder, n=n, trained=n, of=of, schema=C.placed(rows.withColumn("since", F.lit(0).cast("long")), middle).schema.jsonValue()), [folder, *(f for f in made.values() if f)])

    def update(self, added: DataFrame, removed: DataFrame, of: int = 0) -> None:
        """Takes away the vectors with the ids of removed and adds those of
        added; an id whose vector changes is in both."""
        last, found = self.latest()
        made, n = self._generation(added.where("embedding is not null"), removed, self._centres(found), last + 1)
        now = self._named([*found["generations"], made], found["centres"], n=found["n"] + n, trained=found["trained"], of=of, schema=found["schema"])
        self.commit(last + 1, now, [f for f in made.values() if f])

    def renamed(self, of: int) -> None:
        """The same index, known by another number."""
        last, found = self.latest()
        self.commit(last + 1, found | {"of": of}, [])

    # Reading

    def of(self) -> int | None:
        found = self.latest()[1]
        return found and found["of"]

    def stale(self) -> bool:
        """Whether the vectors have doubled since the cells were trained, or
        lie in many generations."""
        found = self.latest()[1]
        return found["n"] > 2 * found["trained"] or len(found["generations"]) > 16

    def _centres(self, found: dict) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/{found['centres']}").orderBy("cell").collect()
        return np.array([r.centre for r in rows]) if rows else np.zeros((0, 1))

    def _radii(self, found: dict) -> dict[int, float]:
        """Of the cells that hold something."""
        parts = [self.spark.read.parquet(f"{self.path}/{g['cells']}") for g in found["generations"]]
        return {r.cell: r.radius for r in functools.reduce(DataFrame.unionByName, parts).groupBy("cell").agg(F.max("radius").alias("radius")).collect()}

    def _vectors(self, found: dict) -> DataFrame:
        schema = T.StructType.fromJson(found["schema"])
        rows = functools.reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{g['vectors']}") for g in found["generations"]])
        dead = [g["dead"] for g in found["generations"] if g["dead"]]
        if not dead:
            return rows
        last = functools.reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{f}") for f in dead]).groupBy(F.col("id").alias("dead_id")).agg(F.max("dead_since").alias("dead_since"))
        return rows.join(last, (F.col("id") == F.col("dead_id")) & (F.col("since") < F.col("dead_since")), "left_anti")

    def search(self, query: list[float], k: int = 10, probes: int | None = None, keep: Column | None = None) -> DataFrame:
        """The k nearest vectors and their score, as search.vector_top_k gives
        them; keep is applied before.  probes: cells that are read; None reads
        what the exact result needs."""
        found = self.latest()[1]
        middle, radii = self._centres(found), self._radii(found)
        q = np.asarray(query, np.float64)
        cells = np.array(sorted(c for c in radii if c != C.NOWHERE), np.int64)
        best = C.highest(q, middle[cells], np.array([radii[c] for c in cells])) if len(cells) else np.zeros(0)
        # Probed by the angle to the centre, as the vectors were placed.
        order = cells[np.argsort(-(middle[cells] @ q), kind="stable")] if len(cells) else cells
        rows = self._vectors(found)
        rows = rows if keep is None else rows.where(keep)
        score = F.round(cosine(F.col("embedding"), F.array(*map(F.lit, query))), 6)
        top = lambda at: rows.where(F.col("cell").isin([int(c) for c in at])).withColumn("score", score).orderBy(F.desc("score"), "id").limit(k).drop("cell", "angle", "since")
        if probes is not None:
            return top(order[:probes])
        first = sorted((r[0] for r in top(order[:8]).select("score").collect()), reverse=True)
        worst = first[k - 1] if len(first) >= k else -2.0
        need = [*cells[best >= worst - C.SLACK], *[c for c in (C.NOWHERE,) if c in radii and worst <= 0]]
        return top(need)

    def search_many(self, queries: DataFrame, k: int = 10, probes: int | None = None, same: bool = False) -> DataFrame:
        """query, id, score, place of the k nearest vectors of each of many
        queries (id, embedding).  same: whether a query's own id counts."""
        found = self.latest()[1]
        middle, radii = self._centres(found), self._radii(found)
        cells = np.array(sorted(c for c in radii if c != C.NOWHERE), np.int64)
        radius = np.array([radii[c] for c in cells])
        more = [C.NOWHERE] if C.NOWHERE in radii else []
        asked = queries.where("embedding is not null").select(F.col("id").alias("query"), F.col("embedding").alias("q"))

        def chosen(rows: DataFrame, kind: str) -> DataFrame:
            """The cells of each query: the nearest ones, or those that can
            still hold a better vector than its k-th (worst)."""
            sent = self.spark.sparkContext.broadcast((middle[cells], radius, cells))

            @F.pandas_udf("array<int>")
            def near(q: pd.Series, worst: pd.Series) -> pd.Series:
                m, r, c = sent.value
                out = []
                for x, w in zip(q, worst):
                    order = np.argsort(-(m @ x), kind="stable")[: 8 if probes is None else probes]
                    if kind == "nearest":
                        out.append([*c[order], *([] if len(order) else more)])
                        continue
                    can = C.highest(np.asarray(x, np.float64), m, r) >= w - C.SLACK
                    can[order] = False
                    out.append([*c[can], *[x for x in more if w <= 0 and len(order)]])
                return pd.Series([np.array(o, np.int32) for o in out])

            return rows.select("query", "q", F.explode(near("q", "worst")).alias("cell"))

        first = self._best(found, chosen(asked.withColumn("worst", F.lit(-2.0)), "nearest"), k, same)
        if probes is not None:
            return self._placed(first, k)
        first = pinned(self._placed(first, k))
        worst = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst"))
        rest = chosen(asked.join(worst, "query", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0))), "rest")
        return self._placed(first.select("query", "id", "score").unionByName(self._best(found, rest, k, same)), k)

    def _placed(self, rows: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)

    def _best(self, found: dict, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """query, id, score of the k best of each cell's part for each query
        that asks for the cell (query, q, cell)."""
        package_on_workers(self.spark)
        sizes: dict[int, int] = {}
        for g in found["generations"]:
            for r in self.spark.read.parquet(f"{self.path}/{g['cells']}").collect():
                sizes[r.cell] = sizes.get(r.cell, 0) + r.n
        parts = self.spark.createDataFrame([(c, -(-n // BLOCK)) for c, n in sizes.items()], "cell int, parts int")
        asks = pinned(asked)
        blocks = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        shape = parts.join(blocks, "cell")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = asks.join(shape, "cell").select("query", "q", "cell", each("parts").alias("part"), one("query", "blocks").alias("block"))
        right = self._vectors(found).select("id", "embedding", "cell").join(shape, "cell").select("id", "embedding", "cell", one("id", "parts").alias("part"), each("blocks").alias("block"))
        empty = pd.DataFrame({"query": pd.Series(dtype=object), "id": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})

        def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return empty
            ids, names = v["id"].to_numpy(), q["query"].to_numpy()
            by_id = np.argsort(ids, kind="stable")
            sims = np.round(C.units(np.stack(q["q"]).astype(np.float64)) @ C.units(np.stack(v["embedding"].to_numpy()[by_id]).astype(np.float64)).T, 6)
            ids = ids[by_id]
            if not same:
                sims[names[:, None] == ids[None, :]] = -3.0
            at = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            got = np.take_along_axis(sims, at, 1)
            here = got > -3.0
            return pd.DataFrame({"query": np.repeat(names, here.sum(1)), "id": ids[at][here], "score": got[here]})

        kinds = f"query {asks.schema['query'].dataType.simpleString()}, id {right.schema['id'].dataType.simpleString()}, score double"
        return left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInPandas(compare, kinds)
