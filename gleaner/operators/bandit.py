"""Bandit statistics as aggregates over a log of rewards."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clamped, hash_order, uct
from ..sources.staging import pinned


def posteriors(log: DataFrame, arms: DataFrame, mode: str = "pseudo_count") -> DataFrame:
    """Beta posterior of every arm (arm) from a log (arm, score, weight); with
    the mode "bernoulli" from whole wins and losses (see there)."""
    if mode not in ("pseudo_count", "bernoulli"):
        raise ValueError("mode is pseudo_count or bernoulli")
    s = clamped(F.col("score"))
    sums = bernoulli(log) if mode == "bernoulli" else log.groupBy("arm").agg(F.sum(s * F.col("weight")).alias("won"), F.sum((1 - s) * F.col("weight")).alias("lost"))
    rows = arms.join(sums, "arm", "left").fillna(0.0, ["won", "lost"])
    rows = rows.select("arm", (1 + F.col("won")).alias("a"), (1 + F.col("lost")).alias("b"))
    return rows.select("arm", F.round("a", 6).alias("alpha"), F.round("b", 6).alias("beta"), F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("mean"), F.round(F.col("a") + F.col("b") - 2, 6).alias("observations"))


def bernoulli(log: DataFrame, seed: int = 0) -> DataFrame:
    """arm, won, lost: each score as the probability of a win, drawn from a
    hash of seed and event (id), so that a replay draws the same.  weight (1
    where it is absent): what an event counts."""
    u = F.conv(F.left(hash_order(seed, F.col("id")), F.lit(13)), 16, 10).cast("double") / float(1 << 52)
    won = (u < clamped(F.col("score"))).cast("int")
    weight = F.col("weight") if "weight" in log.columns else F.lit(1)
    return log.groupBy("arm").agg(F.sum(won * weight).alias("won"), F.sum((1 - won) * weight).alias("lost"))


def running(log: DataFrame) -> DataFrame:
    """The posterior after each event (id, arm, at, score) of an arm.

    Events are dealt by ranges of arm and time, so that an arm with most of them
    lies in many parts: a part's sums begin where the totals of the arm's parts
    before it end.  The totals are a row for each part and arm.
    """
    s = clamped(F.col("score"))
    dealt = log.select("id", "arm", "at", s.alias("won"), (1 - s).alias("lost")).repartitionByRange("arm", "at", "id")
    # Written, so that a part is the same for its total and for its sums.
    parts = pinned(dealt.withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("arm").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("arm", "part").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    starts = totals.select("arm", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_before") for c in ("won", "lost")])
    own = Window.partitionBy("arm", "part").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.select("id", "arm", "part", *[F.sum(c).over(own).alias(c) for c in ("won", "lost")])
    rows = sums.withColumnRenamed("arm", "of").withColumnRenamed("part", "of_part").join(starts, F.col("of").eqNullSafe(F.col("arm")) & (F.col("of_part") == F.col("part")))
    return rows.select("id", F.col("of").alias("arm"), F.round(1 + F.col("won_before") + F.col("won"), 6).alias("alpha"), F.round(1 + F.col("lost_before") + F.col("lost"), 6).alias("beta"))


def discounted(score: Column, evaluated: Column, supported: Column) -> Column:
    """Half the reward without an evaluator, half again without support."""
    return score * F.when(evaluated, 1.0).otherwise(0.5) * F.when(supported, 1.0).otherwise(0.5)


def answer_feedback(evidence: DataFrame, insights: DataFrame, score: float) -> DataFrame:
    """Rewards (arm, score, weight) for the arms of known insights (id, arm)
    in an answer's evidence (id); none below a score of 0.5."""
    rows = evidence.join(insights, "id").select("arm", F.lit(0.3 * score).alias("score"), F.lit(1.0).alias("weight"))
    return rows if score >= 0.5 else rows.limit(0)


def human_feedback(ratings: DataFrame, insights: DataFrame) -> DataFrame:
    """Ratings (id, score) count three times for the insight's arm."""
    return ratings.join(insights, "id").select("arm", clamped(F.col("score")).alias("score"), F.lit(3.0).alias("weight"))


def ucb1(log: DataFrame, arms: DataFrame, c: float = 1.41) -> DataFrame:
    """visits, mean and UCB1 score of every arm; unvisited ones are infinite."""
    sums = log.groupBy("arm").agg(F.count(F.lit(1)).alias("visits"), F.sum("score").alias("total"))
    rows = arms.join(sums, "arm", "left").fillna(0, ["visits", "total"])
    every = rows.agg(F.greatest(F.sum("visits"), F.lit(1)).alias("n"))  # one row
    rows = rows.crossJoin(F.broadcast(every))
    mean = F.when(F.col("visits") > 0, F.col("total") / F.greatest("visits", F.lit(1))).otherwise(0.0)
    return rows.select("arm", "visits", F.round(mean, 6).alias("mean"), F.round(uct(F.col("total"), F.col("visits"), F.col("n"), c), 6).alias("score"))


def thompson(rows: list[dict], disabled: set[str] = frozenset(), seed: int | None = None) -> str:
    """The arm of the highest draw from posteriors (arm, alpha, beta); all
    arms are eligible if every one is disabled."""
    rng = random.Random(seed)
    eligible = [r for r in rows if r["arm"] not in disabled] or rows
    return max(eligible, key=lambda r: rng.betavariate(r["alpha"], r["beta"]))["arm"]
