"""Search: vectors, words, and the fusion of several channels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cosine, tokens

K1, B = 1.2, 0.75


def vector_top_k(chunks: DataFrame, query: list[float], k: int = 10, keep: Column | None = None, mode: str = "post", transform: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """The k nearest chunks (id, embedding and more) with their score.

    keep: a filter; mode "post" applies it to the k nearest, "pre" before.
    """
    if mode not in ("post", "pre"):
        raise ValueError("mode is post or pre")
    rows = chunks.where("embedding is not null")
    if keep is not None and mode == "pre":
        rows = rows.where(keep)
    score = F.round(transform(cosine(F.col("embedding"), F.array(*map(F.lit, query)))), 6)
    top = rows.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)
    return top if keep is None or mode == "pre" else top.where(keep)


def insight_top_k(insights: DataFrame, query: list[float], k: int = 5, corpus: str = "") -> DataFrame:
    """id, text, strategy, score (the stored one), layer, similarity of the k
    nearest insights; those of other corpora are left out of these."""
    keep = F.col("corpus_id") == corpus if corpus else None
    rows = insights.withColumnRenamed("score", "stored")
    top = vector_top_k(rows, query, k, keep)
    return top.select("id", "text", "strategy", F.col("stored").alias("score"), "layer", F.col("score").alias("similarity"))


def bm25(docs: DataFrame, query: str, k: int | None = 10) -> DataFrame:
    """id, score of the documents (id, text) that hold a word of the query.

    BM25 with k1 = 1.2 and b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5));
    a word that the query repeats counts once.
    """
    words = docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("words"))
    sizes = words.select("id", F.size("words").alias("size"), "words")
    # One row: its size is fixed.
    corpus = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    asked = F.array_distinct(tokens(F.lit(query)))
    # Only the words that are asked for leave a document's row.
    hits = sizes.select("id", "size", F.explode(F.filter("words", lambda w: F.array_contains(asked, w))).alias("word"))
    tf = hits.groupBy("id", "size", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = tf.join(df, "word").crossJoin(F.broadcast(corpus)).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def fuse(channels: dict[int, DataFrame], seen: list | None = None, k: int = 15, boost: float = 1.1, constant: float = 0.8) -> DataFrame:
    """id, score, channel of the best candidates of up to five channels (id, score).

    Channels 1, 2 and 5 count with the highest score, channel 3 replaces it by
    its own times ``boost`` unless 5 is higher, channel 4 counts with
    ``constant`` where no channel before it has the candidate.
    """
    parts = [df.select("id", F.lit(c).alias("channel"), F.col("score").cast("double").alias("score")) for c, df in channels.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = lambda c: F.max(F.when(F.col("channel") == c, F.col("score"))).alias(f"c{c}")
    merged = rows.groupBy("id").agg(*[best(c) for c in range(1, 6)])
    first = F.coalesce(F.col("c3") * boost, F.greatest("c1", "c2"), F.when(F.col("c4").isNotNull(), F.lit(constant)))
    score = F.greatest(first, "c5")
    channel = F.when(F.col("c5").isNotNull() & (first.isNull() | (F.col("c5") > first)), 5).when(F.col("c3").isNotNull(), 3)
    channel = channel.when(F.col("c1").isNotNull() & (F.col("c2").isNull() | (F.col("c1") >= F.col("c2"))), 1).when(F.col("c2").isNotNull(), 2).otherwise(4)
    out = merged.select("id", F.round(score, 6).alias("score"), channel.alias("channel"))
    if seen:
        out = out.where(~F.col("id").isin(seen))
    return out.orderBy(F.desc("score"), "id").limit(k)
