"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly into buckets of about ``bucket_bytes``
with a seeded hash of each record's place in the input, so that records that
are alike don't meet.  Pass two puts each bucket in an order of its own with a
seeded Fisher-Yates shuffle (Spark's ``shuffle``) and deals the records out to
the shards in turn, the buckets one after the other: counts of shards differ by
one at most (the law ``rows``).  ``write`` puts the shards into folders.

The same input, in the same files, with the same parameters gives the same
shards.

Edge cases.  Null text has size 1 and no text to check; null ids are dealt like
others; rows that repeat are rows of their own.  More shards than rows leave
some shards empty.  A text larger than a bucket makes its bucket larger.  Other
columns are not read, so none can clash.  No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import input_columns, pinned, setting


#: Buckets whose counts are summed up in one task.
GROUP = 4096
#: Buckets whose first places are sent to all executors: up to 128 MB, at 16 MiB
#: a bucket for 128 TB of text.
SENT = 8_000_000


def shard(docs: DataFrame, *, shards: int = 8, bucket_bytes: int = 16 << 20, max_tasks: int = 20_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, size, shard, slot (gapless in its shard) of every row.

    max_tasks: neighbouring buckets share a task where there are more, since
    what the driver holds for a shuffle grows with its tasks.  The shuffles of
    buckets that share a task draw from one generator in turn, so the order is
    one of its own for each choice of bucket_bytes and max_tasks.
    """
    rows = docs.select(*input_columns(docs, id=id_col, text=text_col))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    total = rows.select(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    scattered = rows.select(F.pmod(place, F.lit(buckets)).cast("int").alias("bucket"), F.struct(place.alias("place"), "id", "text", size.alias("size")).alias("record"))
    # The shuffle's generator starts from the seed and the partition, and the
    # buckets and their records come to it in order.  The sort that brings
    # them there spills, so a task holds one bucket at a time.
    per_task = -(-buckets // max_tasks)
    tasks = -(-buckets // per_task)
    gathered = scattered.withColumn("task", F.floor(F.col("bucket") / per_task).cast("int")).repartitionById(tasks, "task")
    gathered = gathered.groupBy("task", "bucket").agg(F.array_sort(F.collect_list("record")).alias("records"))
    shuffled = gathered.select("bucket", F.shuffle("records", seed).alias("records"))
    dealt = shuffled.select("bucket", F.posexplode("records").alias("at", "r")).select("bucket", "at", F.col("r.id").alias("id"), F.col("r.text").alias("text"), F.col("r.size").alias("size"))
    with setting(docs.sparkSession, "spark.sql.execution.useObjectHashAggregateExec", "false"):
        dealt = pinned(dealt)
    # Records before each bucket: first over groups of buckets, then within one,
    # so no task sees a row for every bucket.
    counts = dealt.groupBy(F.floor(F.col("bucket") / GROUP).alias("group"), "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = pinned(counts)
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n")).select("group", earlier(Window.orderBy("group")).alias("first"))
    starts = counts.withColumn("inner", earlier(Window.partitionBy("group").orderBy("bucket"))).join(groups, "group")
    starts = pinned(starts.select(F.col("bucket").alias("of"), (F.col("first") + F.col("inner")).alias("start")))
    number = F.col("start") + F.col("at")
    # Two numbers a bucket; beside them the texts stay where they are.
    out = dealt.join(F.broadcast(starts) if buckets <= SENT else starts, F.col("bucket") == F.col("of"))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "size", F.pmod(number, F.lit(shards)).cast("int").alias("shard"), F.floor(number / shards).alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; slot tells the order of its records."""
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
