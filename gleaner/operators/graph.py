"""Walks over the graph tables: mentions, relations, provenance, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import pinned


def _first(rows: DataFrame, group: list[str], n: int, *order) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows by key in so many tasks.  Without a number Spark chooses: by bytes as
    they are moved, which are few for rows that take much room once sorted."""
    return rows.repartition(parts, *keys) if parts else rows


def undirected(relations: DataFrame) -> DataFrame:
    """seed, other, type, confidence, from_id, to_id: each relation (source,
    target, type, confidence) from both ends, a loop once."""
    ends = [F.col("source").alias("from_id"), F.col("target").alias("to_id")]
    there = relations.select(F.col("source").alias("seed"), F.col("target").alias("other"), "type", "confidence", *ends)
    back = relations.where("source <> target").select(F.col("target").alias("seed"), F.col("source").alias("other"), "type", "confidence", *ends)
    return there.unionByName(back)


def neighbors(relations: DataFrame, seeds: DataFrame, n: int = 20, parts: int | None = None) -> DataFrame:
    """The n surest relations of each seed (id), either way."""
    rows = dealt(undirected(relations), parts, "seed").join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi")
    return _first(rows, ["seed"], n, F.desc("confidence"), "other", "type", "from_id")


def chunks_of(mentions: DataFrame, entities: DataFrame, parts: int | None = None) -> DataFrame:
    """entity, chunk, doc of the chunks that mention the entities (id)."""
    return dealt(mentions.select("entity", "chunk", "doc"), parts, "entity").join(entities.select(F.col("id").alias("entity")), "entity", "left_semi").select("entity", "chunk", "doc").distinct()


def entities_of(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk, entity of the entities that the chunks (id) mention."""
    return mentions.join(chunks.select(F.col("id").alias("chunk")), "chunk", "left_semi").select("chunk", "entity").distinct()


def hops(mentions: DataFrame, relations: DataFrame, seeds: DataFrame, per_chunk: int = 2, per_entity: int = 3, per_neighbor: int = 2) -> DataFrame:
    """From chunks (id) over their entities and these entities' neighbours to
    the neighbours' chunks, the first few at each step; no seed comes back."""
    own = _first(entities_of(mentions, seeds), ["chunk"], per_chunk, "entity")
    near = neighbors(relations, own.select(F.col("entity").alias("id")).distinct(), per_entity).select(F.col("seed").alias("entity"), "other", "type")
    reached = own.join(near, "entity")
    there = _first(chunks_of(mentions, reached.select(F.col("other").alias("id")).distinct()), ["entity"], per_neighbor, "doc", "chunk")
    rows = reached.join(there.select(F.col("entity").alias("other"), F.col("chunk").alias("found")), "other")
    rows = rows.join(seeds.select(F.col("id").alias("found")), "found", "left_anti")
    return rows.select(F.col("chunk").alias("seed"), "entity", "type", "other", "found").distinct()


def walk(mentions: DataFrame, relations: DataFrame, entities: DataFrame, own_chunks: int = 2, n: int = 5, per_neighbor: int = 1, parts: int | None = None) -> DataFrame:
    """Evidence around entities (id): their own chunks (step 0) and one chunk
    of each neighbour (step 1)."""
    own = _first(chunks_of(mentions, entities, parts), ["entity"], own_chunks, "doc", "chunk").select("entity", F.lit(0).alias("step"), "chunk")
    near = neighbors(relations, entities, n, parts)
    there = _first(chunks_of(mentions, near.select(F.col("other").alias("id")).distinct(), parts), ["entity"], per_neighbor, "doc", "chunk")
    far = dealt(near, parts, "other").join(there.select(F.col("entity").alias("other"), "chunk"), "other").select(F.col("seed").alias("entity"), F.lit(1).alias("step"), "chunk")
    return dealt(own.unionByName(far), parts, "entity").distinct()


def unprocessed(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """doc, pending: documents whose chunks (id, doc) aren't all in done (id)."""
    return chunks.join(done.select("id"), "id", "left_anti").groupBy("doc").agg(F.count(F.lit(1)).alias("pending"))


def dirty(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities (id, synthesized_at; "" is never) with a mention (entity, at)
    that is newer than their synthesis; both are ISO strings."""
    last = mentions.groupBy("entity").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("mentions"))
    rows = entities.join(last, entities["id"] == last["entity"])
    return rows.where(F.col("last") > F.coalesce("synthesized_at", F.lit(""))).select("id", "last", "mentions")


def sources_of(insights: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Insights (id, score) with the sorted paths of their sources (insight, chunk)."""
    paths = sources.join(chunks.select(F.col("id").alias("chunk"), "path"), "chunk").groupBy("insight").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    rows = insights.join(paths, insights["id"] == paths["insight"], "left")
    return rows.select("id", "score", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def _jumps(nodes: DataFrame):
    """hops, and of, up, n of the ways that many hops up a forest (id, parent),
    for 1, 2, 4 ... hops until there are none; n counts rows that repeat.  Each
    is no longer than the nodes, and is written out.  A cycle raises ValueError."""
    count, hops = nodes.count(), 1
    ways = pinned(nodes.where("parent is not null").groupBy(F.col("id").alias("of"), F.col("parent").alias("up")).agg(F.count(F.lit(1)).alias("n")))
    while not ways.isEmpty():
        if hops > count:
            raise ValueError("a tree has a cycle")
        yield hops, ways
        on = ways.select(F.col("of").alias("up"), F.col("up").alias("top"), F.col("n").alias("m"))
        ways = pinned(ways.join(on, "up").groupBy("of", F.col("top").alias("up")).agg(F.sum(F.col("n") * F.col("m")).alias("n")))
        hops *= 2


def ancestors(nodes: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """node, ancestor, hops of a forest (id, parent), each node its own at 0;
    of the nodes in among (id) only, if it is given."""
    start = nodes if among is None else nodes.join(F.broadcast(among.select("id")), "id", "left_semi")
    out = start.select(F.col("id").alias("node"), F.col("id").alias("ancestor"), F.lit(0).alias("hops"), F.lit(1).cast("long").alias("n"))
    for k, ways in _jumps(nodes):
        far = out.join(ways.withColumnRenamed("n", "m"), F.col("ancestor") == F.col("of"))
        out = pinned(out.unionByName(far.select("node", F.col("up").alias("ancestor"), (F.col("hops") + k).alias("hops"), (F.col("n") * F.col("m")).alias("n"))))
    return out.select("node", "ancestor", "hops", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def rollup(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """id, visits, total: the scores (id, score) of each node and all below it.

    Sums are carried up, not pairs of nodes: twice the hops each round.
    """
    out = nodes.join(scores, "id").groupBy("id").agg(F.count(F.lit(1)).alias("visits"), F.sum("score").alias("total"))
    for _, ways in _jumps(nodes):
        up = out.join(ways, F.col("id") == F.col("of")).select(F.col("up").alias("id"), (F.col("visits") * F.col("n")).alias("visits"), (F.col("total") * F.col("n")).alias("total"))
        out = pinned(out.unionByName(up).groupBy("id").agg(F.sum("visits").alias("visits"), F.sum("total").alias("total")))
    return out.select("id", "visits", F.round("total", 6).alias("total"))


def best_path(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """The path from the root to the node of the highest score: step, id."""
    best = scores.orderBy(F.desc("score"), "id").limit(1)  # one row
    path = ancestors(nodes, best)
    return path.select((F.max("hops").over(Window.partitionBy("node")) - F.col("hops")).alias("step"), F.col("ancestor").alias("id"))
