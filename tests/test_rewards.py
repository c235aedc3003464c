"""Posteriors: running sums over many parts, and a stream that is restarted."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import bandit
from gleaner.streaming import rewards


def events(seed, n):
    """One arm has most events; times repeat, scores go beyond 0 and 1."""
    rng = random.Random(seed)
    return [(k, rng.choice(["hub"] * 8 + ["gap", None]), f"2024-01-{rng.randrange(1, 28):02d}", rng.choice([0.25, 0.5, 1.5, -1.0, 0.125])) for k in range(n)]


def expected(rows):
    sums, out = {}, {}
    for i, arm, _, score in sorted(rows, key=lambda r: (r[2], r[0])):
        s = max(0.0, min(1.0, score))
        a, b = sums.get(arm, (1.0, 1.0))
        sums[arm] = out[i] = (a + s, b + 1 - s)
    return out


@pytest.mark.parametrize("parts", [1, 13])
def test_running_sums(spark, parts):
    rows = events(3, 500)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = spark.createDataFrame(rows, "id long, arm string, at string, score double")
        out = bandit.running(log)
        assert {r.id: (r.alpha, r.beta) for r in out.collect()} == expected(rows) and out.count() == 500
        dealt = log.repartitionByRange("arm", "at", "id").withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
        assert max(r["count"] for r in dealt) < 500 / max(1, parts - 1) * 3 + 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert bandit.running(log.limit(0)).collect() == []


def lines(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def held(spark, folder, checkpoint):
    return {(r.corpus, r.arm): (r.alpha, r.beta) for r in rewards.refresh(rewards.log(spark, str(folder)), str(checkpoint), "held").collect()}


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    log, checkpoint = tmp_path / "log", tmp_path / "cp"
    lines(log, "1.json", {"corpus": "c", "strategy": "hub", "score": 1.0}, {"strategy": "gap_discovery"}, {"corpus": "c", "score": 1.0})
    assert held(spark, log, checkpoint) == {("c", "hub"): (2.0, 1.0), ("", "gap"): (1.5, 1.5)}
    lines(log, "2.json", {"corpus": "c", "strategy": "hub", "score": 0.0, "weight": 3.0})
    need = {("c", "hub"): (2.0, 4.0), ("", "gap"): (1.5, 1.5)}
    assert held(spark, log, checkpoint) == need
    # The driver died after the sums were written and before the batch was done.
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    os.remove(last)
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    assert held(spark, log, checkpoint) == need
    lines(log, "3.json", {"corpus": "d", "strategy": "hub"})
    assert held(spark, log, checkpoint) == need | {("d", "hub"): (1.5, 1.5)} and spark.table("held").count() == 3


def test_an_empty_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    assert held(spark, tmp_path / "log", tmp_path / "cp") == {}
