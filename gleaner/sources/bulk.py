"""Bulk embedding: a file of requests out, a file of vectors in.

A request is a line of JSON with a typed key ("chunk:<id>") and the text; a
result is a line with the key and response.embeddings[0].values.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import embedding_text
from ..models import BulkEmbedder, Embedder, embedding, tried

RESULT = "key string, response struct<embeddings: array<struct<values: array<float>>>>"
#: States in which a job ends.
DONE, ENDED = "succeeded", ("succeeded", "failed", "cancelled")


def requests(tables: dict[str, DataFrame], size: int = 768) -> DataFrame:
    """value: a line for each row (id, text) of the tables, by their kind."""
    lines = [
        rows.select(
            F.to_json(F.struct(F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("key"), F.struct(F.lit(size).alias("output_dimensionality"), F.struct(F.array(F.struct(embedding_text(F.col("text")).alias("text"))).alias("parts")).alias("content")).alias("request"))).alias("value")
        )
        for kind, rows in tables.items()
    ]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


def typed(key: Column) -> tuple[Column, Column]:
    """The kind and the id in a key kind:id; what follows the first colon is the
    id."""
    parts = F.split(key, ":", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def results(lines: DataFrame) -> DataFrame:
    """kind, id, embedding of the result lines (value); lines that can't be
    read, or have no key or no vector, are left out."""
    r = lines.select(F.from_json("value", RESULT).alias("r")).select("r.key", F.get("r.response.embeddings", F.lit(0)).getField("values").alias("embedding"))
    kind, id_ = typed(F.col("key"))
    out = r.select(kind.alias("kind"), id_.alias("id"), "embedding")
    return out.where((F.coalesce(F.col("id"), F.lit("")) != "") & (F.coalesce(F.size("embedding"), F.lit(0)) > 0))


def run(spark: SparkSession, job_dir: str, tables: dict[str, DataFrame], service: BulkEmbedder, size: int = 768, poll: float = 30.0, attempts: int = 5) -> DataFrame:
    """kind, id, embedding of the tables' texts, from a job of the service."""
    path = f"{job_dir}/requests"
    requests(tables, size).write.text(path)
    job = tried(lambda: service.submit(path), attempts, poll)
    while (state := service.state(job)) not in ENDED:
        time.sleep(poll)
    if state != DONE:
        raise RuntimeError(f"the bulk job {state}")
    return results(spark.read.text(service.results(job)))


class LocalBulk:
    """A stand-in for such a service: works through the file with an embedder."""

    def __init__(self, spark: SparkSession, embedder: Embedder):
        self.spark, self.embedder = spark, embedder

    def submit(self, requests: str) -> str:
        asked = self.spark.read.text(requests).select(F.from_json("value", "key string, request struct<content: struct<parts: array<struct<text: string>>>>").alias("r"))
        text = F.get("r.request.content.parts", F.lit(0)).getField("text")
        values = embedding(text, self.embedder)
        out = f"{requests.rstrip('/')}-results"
        asked.select(F.to_json(F.struct(F.col("r.key").alias("key"), F.struct(F.array(F.struct(values.alias("values"))).alias("embeddings")).alias("response"))).alias("value")).write.text(out)
        return out

    def state(self, job: str) -> str:
        return DONE

    def results(self, job: str) -> str:
        return job
