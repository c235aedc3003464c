"""Posteriors of arms as a stream over a growing folder of reward logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import arm_name, clamped
from ..sources.store import Table

KEY = ("corpus", "arm")
SCHEMA = "corpus string, mode string, strategy string, action string, score double, weight double, insight_id string, timestamp string"


def log(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't JSON are left out."""
    return spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def sums(rewards: DataFrame) -> DataFrame:
    """corpus, arm, won, lost; a line without score counts as 0.5."""
    s, w = clamped(F.coalesce("score", F.lit(0.5))), F.coalesce("weight", F.lit(1.0))
    rows = rewards.where("strategy is not null").withColumn("arm", arm_name(F.col("strategy"))).withColumn("corpus", F.coalesce("corpus", F.lit("")))
    return rows.groupBy("corpus", "arm").agg(F.sum(s * w).alias("won"), F.sum((1 - s) * w).alias("lost"))


def merge(state: str, batch: DataFrame, number: int) -> None:
    """Adds a batch's sums to those of the table in the folder state; a batch
    that is in it already, since its writer died before it said so, changes
    nothing."""
    table = Table(batch.sparkSession, state, KEY)
    held = table.read()
    if held is not None and table.latest()[1].get("batch", -1) >= number:
        return
    new = sums(batch)
    if held is not None:
        both = new.unionByName(held.join(new.select("corpus", "arm"), ["corpus", "arm"], "left_semi"))
        new = both.groupBy("corpus", "arm").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    table.change(new, note={"batch": number})


def refresh(rewards: DataFrame, checkpoint: str, name: str) -> DataFrame:
    """Takes in what is new, batch by batch, and gives corpus ("" for none),
    arm, alpha, beta, as a view too.  The sums are a table beside the
    checkpoint; nothing is held in the driver."""
    spark, state = rewards.sparkSession, f"{checkpoint.rstrip('/')}.sums"
    query = rewards.writeStream.foreachBatch(lambda batch, number: merge(state, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    held = Table(spark, state, KEY).read()
    if held is None:
        held = spark.createDataFrame([], "corpus string, arm string, won double, lost double")
    out = held.select("corpus", "arm", (1 + F.col("won")).alias("alpha"), (1 + F.col("lost")).alias("beta"))
    out.createOrReplaceTempView(name)
    return out
