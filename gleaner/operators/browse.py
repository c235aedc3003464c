"""Listings and look-ups over the tables, each in a stable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import hash_order, hop, shortened
from .graph import _first, dealt, entities_of, neighbors


def nodes(**tables: DataFrame) -> DataFrame:
    """id, label, text of the rows (id, text) of all tables, by their label."""
    out = None
    for label, rows in tables.items():
        part = rows.select("id", F.lit(label).alias("label"), "text")
        out = part if out is None else out.unionByName(part)
    return out


def by_ids(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows (id and more) for each id that is asked for (id and more), as often
    as it is asked for."""
    return asked.join(rows, "id")


def in_corpus(rows: DataFrame, corpus: str, or_none: bool = False) -> DataFrame:
    """The rows of a corpus (corpus_id), and those without one if asked for."""
    return rows.where(F.coalesce("corpus_id", F.lit("")).isin(corpus, "") if or_none else F.col("corpus_id") == corpus)


def chosen(rows: DataFrame, **equal: str) -> DataFrame:
    """The rows whose columns have the given values; an empty one chooses all."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value) if value else rows
    return rows


def best_of_each(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows with the highest score of each value of a column, with their
    place; ties go to the smaller id."""
    best = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def sizes(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def mentioned(mentions: DataFrame) -> DataFrame:
    """entity, mentions, docs of mentions (entity, doc)."""
    return mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc").alias("docs"))


def entity_counts(entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """entity, mentions, docs, incoming of each of the entities (entity), 0 for
    those that have none."""
    incoming = relations.groupBy(F.col("target").alias("entity")).agg(F.count(F.lit(1)).alias("incoming"))
    return entities.select("entity").join(mentioned(mentions), "entity", "left").join(incoming, "entity", "left").fillna(0)


def to_embed(rows: DataFrame, missing_only: bool = True, limit: int | None = None) -> DataFrame:
    """The rows (id, embedding and more) without a vector, or all, by id."""
    rows = rows.where("embedding is null") if missing_only else rows
    return rows.orderBy("id") if limit is None else rows.orderBy("id").limit(limit)


def sampled_insights(insights: DataFrame, sources: DataFrame, n: int = 50, layer: int = 1, seed: int = 0) -> DataFrame:
    """A reproducible sample of a layer's insights, each with the sorted list
    of its sources (insight, source)."""
    drawn = insights.where(F.col("layer") == layer).withColumn("o", hash_order(seed, F.col("id"))).orderBy("o").limit(n).drop("o")
    of = sources.join(drawn.select(F.col("id").alias("insight")), "insight", "left_semi").groupBy("insight").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    out = drawn.join(of.withColumnRenamed("insight", "id"), "id", "left")
    return out.withColumn("sources", F.coalesce("sources", F.array().cast(of.schema["sources"].dataType)))


def evidence_texts(held: DataFrame, rows: DataFrame, n: int, chars: int) -> DataFrame:
    """node, place, id, text of the last n ids that each node (node, ids)
    holds, in their order; ids that no row (id, text) has are left out."""
    last = held.select("node", F.posexplode("ids").alias("place", "id"), F.size("ids").alias("size")).where(F.col("place") >= F.col("size") - n)
    return last.join(rows.select("id", "text"), "id").select("node", "place", "id", shortened(F.col("text"), chars).alias("text"))


def follow(seeds: DataFrame, links: DataFrame, sources: DataFrame, most_next: int = 2, most_sources: int = 3) -> DataFrame:
    """seed, how, found: the chunks after a seed (id) and what an insight is
    derived from, the first few of each.  links: id, next_id; sources: insight,
    source."""
    after = links.join(seeds.select("id"), "id", "left_semi").select(F.col("id").alias("seed"), F.lit("next").alias("how"), F.col("next_id").alias("found"))
    from_ = sources.join(seeds.select(F.col("id").alias("insight")), "insight", "left_semi").select(F.col("insight").alias("seed"), F.lit("source").alias("how"), F.col("source").alias("found"))
    return _first(after.distinct(), ["seed"], most_next, "found").unionByName(_first(from_.distinct(), ["seed"], most_sources, "found"))


def quota(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """channel, id, score: at most k // 2 of the first channel (id, score), and
    of the second what is missing to k; best scores first, then ids."""
    best = lambda rows, c: rows.select(F.lit(c).alias("channel"), "id", "score").orderBy(F.desc("score"), "id").limit(k // 2 if c == 1 else k)
    both = best(first, 1).unionByName(best(second, 2))  # 1.5 k rows at most
    place = F.row_number().over(Window.orderBy("channel", F.desc("score"), "id"))
    return both.withColumn("place", place).where(F.col("place") <= k).drop("place")


def budgeted(rows: DataFrame, budget: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first rows that a budget covers, and one row with the number of the
    others (remaining)."""
    remaining = rows.agg(F.greatest(F.count(F.lit(1)) - budget, F.lit(0)).alias("remaining"))
    return rows.orderBy(*order).limit(budget), remaining


def _ordered(value: Column, *order: str, most: int) -> Column:
    """The first values of a group in order."""
    return F.slice(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]), 1, most)


def contexts(findings: DataFrame, chunks: DataFrame, mentions: DataFrame, relations: DataFrame, entities: DataFrame, *, most_sources: int = 5, chars: int = 500, per_chunk: int = 5, per_entity: int = 3, most: int = 10, parts: int | None = None) -> DataFrame:
    """What a finding (id, sources) is judged on, from the graph around it: id,
    texts of its first sources, their entities (per_chunk of each, a name once
    whatever its case) and these entities' surest relations as paths.

    chunks: id, text; entities: id, name, entity_type.
    """
    src = findings.select(F.col("id").alias("finding"), F.posexplode(F.slice("sources", 1, most_sources)).alias("place", "chunk"))
    src = dealt(src, parts, "chunk")
    held = src.join(chunks.select(F.col("id").alias("chunk"), "text"), "chunk")
    texts = dealt(held, parts, "finding").groupBy("finding").agg(_ordered(shortened(F.col("text"), chars), "place", most=most_sources).alias("texts"))
    own = _first(entities_of(mentions, src.select(F.col("chunk").alias("id"))), ["chunk"], per_chunk, "entity")
    named = dealt(src.join(own, "chunk"), parts, "entity").join(entities.select(F.col("id").alias("entity"), "name", "entity_type"), "entity")
    # Of a name the first entity counts.
    named = _first(dealt(named, parts, "finding").withColumn("low", F.lower("name")), ["finding", "low"], 1, "place", "entity")
    kinds = named.groupBy("finding").agg(_ordered(F.concat("name", F.lit(" ("), F.coalesce("entity_type", F.lit("UNKNOWN")), F.lit(")")), "place", "entity", most=most).alias("entities"))
    near = neighbors(relations, named.select(F.col("entity").alias("id")).distinct(), per_entity, parts)
    ends = entities.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    near = near.join(ends, "other").select(F.col("seed").alias("entity"), (-F.col("confidence")).alias("unsure"), "other", "type", "other_name")
    paths = dealt(dealt(named, parts, "entity").join(near, "entity"), parts, "finding").groupBy("finding").agg(_ordered(hop(F.col("name"), F.col("type"), F.col("other_name")), "place", "entity", "unsure", "other", "type", most=most).alias("paths"))
    none = F.array().cast("array<string>")
    out = findings.select(F.col("id").alias("finding")).join(texts, "finding", "left").join(kinds, "finding", "left").join(paths, "finding", "left")
    return out.select(F.col("finding").alias("id"), *[F.coalesce(c, none).alias(c) for c in ("texts", "entities", "paths")])
