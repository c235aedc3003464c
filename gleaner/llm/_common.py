"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import package_on_workers, pinned, scope, shared_dir  # noqa: F401  (some for the operators)

#: White space of all contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
#: Words of some contracts: runs of letters, digits and whatever isn't ASCII, of
#: a text whose A-Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def input_columns(df: DataFrame, **names: str) -> list[Column]:
    """The named columns under the operator's own names; all others stay out,
    so none of them can clash."""
    return [df[column].alias(own) for own, column in names.items()]


def lowered(c: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def read_file(path: str) -> str:
    """A file of the driver's machine; its content goes out as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and then the worker gives its free memory back to the system: it
    stays alive for later tasks, beside other workers."""

    @functools.wraps(run)
    def and_release(batches: Iterator) -> Iterator:
        yield from run(batches)
        import pyarrow

        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return and_release


#: Values that are asked for at the moment, by setting, the last one in force;
#: the first is what was there before.
_asked: dict[str, list[tuple[object, str]]] = {}
_asking = threading.Lock()


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """While this lasts, a setting of the session has another value.  Where
    threads overlap, what was there before comes back with the last of them."""
    mine = (object(), str(value))
    with _asking:
        values = _asked.setdefault(name, [(None, spark.conf.get(name))])
        values.append(mine)
        spark.conf.set(name, mine[1])
    try:
        yield
    finally:
        with _asking:
            values.remove(mine)
            spark.conf.set(name, values[-1][1])
            if len(values) == 1:
                del _asked[name]


def small_batches(spark: SparkSession, rows: int = 1000):
    """While this lasts, Python workers get so many rows at once.  For whole
    texts the usual 10,000 take much memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    return setting(spark, name, min(rows, before) if before > 0 else rows)
