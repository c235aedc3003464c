"""A ledger of model calls: what has been answered is never asked again.

Calls are worked on in batches, each a job of its own whose answers are
committed before the next begins; a task of a batch makes a few calls only.  So
a driver that is lost loses the batch at hand at most, and a task that is tried
again repeats its own few calls.  An answer is known by its call, a digest of
all that the model is told, and not by the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import transient
from ..models import failure, tried
from .staging import forget_at_end, package_on_workers, shared_dir
from .store import Table

KIND = "call string, answer string, code int, kind string, error string, attempts int"


class Ledger:
    """batch: calls of a job; task: calls of a task.  attempts and wait: of a
    call that fails for now (see models.tried)."""

    def __init__(self, spark: SparkSession, path: str, batch: int = 2000, task: int = 20, attempts: int = 3, wait: float = 1.0, grace: float = 3600.0):
        self._spark, self._batch, self._task, self._attempts, self._wait = spark, batch, task, attempts, wait
        self._table = Table(spark, path, ("call",), grace=grace)

    def read(self) -> DataFrame:
        """call, answer, code, kind, error, attempts; answer is null where the
        last attempt failed."""
        found = self._table.read()
        return self._spark.createDataFrame([], KIND) if found is None else found

    def answered(self, asked: DataFrame, ask: Callable[[dict], str], again: bool = False) -> DataFrame:
        """The ledger's lines for the calls of asked (call, and what ask is
        given), after those that it lacks have been made.  Calls that failed for
        now are made again; with ``again`` those too whose failure stays."""
        held = self.read()
        settled = held.where("error is null") if again else held.where(F.col("error").isNull() | ~transient(F.col("code"), F.col("kind")))
        todo = asked.dropDuplicates(["call"]).join(settled.select("call"), "call", "left_anti")
        todo = todo.join(held.select("call", F.col("attempts").alias("before")), "call", "left")
        path = f"{shared_dir(self._spark)}/{self._table.new('calls')}"
        forget_at_end(self._spark, path)
        n = asked.count()
        batches = max(1, -(-n // self._batch))
        todo.withColumn("batch", F.pmod(F.xxhash64("call"), F.lit(batches)).cast("int")).repartition("batch").write.partitionBy("batch").parquet(path)
        schema = T.StructType([*todo.schema.fields, T.StructField("batch", T.IntegerType())])
        dealt = self._spark.read.schema(schema).parquet(path)
        for r in dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy("batch").collect():
            rows = dealt.where(F.col("batch") == r.batch).drop("batch").repartition(max(1, -(-r.n // self._task)))
            self._table.read()
            self._table.change(self._made(rows, ask))
        return self.read().join(asked.select("call").distinct(), "call", "left_semi")

    def _made(self, rows: DataFrame, ask: Callable[[dict], str]) -> DataFrame:
        package_on_workers(self._spark)
        attempts, wait = self._attempts, self._wait

        def one(row: dict) -> tuple:
            try:
                return tried(lambda: ask(row), attempts, wait), None, None, None
            except Exception as e:  # told apart by those who read it
                return None, *failure(e), f"{type(e).__name__}: {e}"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = pd.DataFrame([one(r) for r in frame.to_dict("records")], columns=["answer", "code", "kind", "error"])
                made = made.astype({"code": "Int32"})
                made.insert(0, "call", frame["call"].to_numpy())
                made["attempts"] = frame["before"].fillna(0).to_numpy().astype("int32") + 1
                yield made

        return rows.mapInPandas(run, KIND)

    def forget(self, calls: DataFrame) -> None:
        """Takes away lines whose answers are in the tables."""
        if self._table.read() is not None:
            self._table.change(gone=calls.select("call").distinct())
