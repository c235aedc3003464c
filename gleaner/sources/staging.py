"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables of each scope that is open in this thread, the innermost
#: last: what one thread pins is never part of another thread's scope.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent and the master is local (tests) a temporary
    folder is made once and set as the checkpoint directory; on a cluster that
    is an error, since no executor sees another's folders.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def package_on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package: by its place under a local
    master, else from an archive in the shared folder."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if is_local(spark):
        parts = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in parts:
            sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, parts)])
        return
    package = __package__.split(".")[0]
    if any(os.path.basename(x).startswith(f"{package}-") for x in sc._python_includes):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    path = f"{shared_dir(spark)}/{package}-{uuid.uuid4().hex}.zip"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(sc._jsc.hadoopConfiguration())
    out = files.create(where)
    out.write(bytearray(packed.getvalue()))
    out.close()
    files.deleteOnExit(where)
    sc.addPyFile(path)


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the driver's JVM ends."""
    where, files = _at(spark, path)
    files.deleteOnExit(where)


def fingerprint(spark: SparkSession, path: str) -> str:
    """What changes whenever a file at the path, or below it, does."""
    where, files = _at(spark, path)
    found, todo = [], [files.getFileStatus(where)]
    while todo:
        at = todo.pop()
        found.append(f"{at.getPath()} {at.getLen()} {at.getModificationTime()}")
        if at.isDirectory():
            todo += list(files.listStatus(at.getPath()))
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def pinned(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there.

    The files go with the scope, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_end(spark, path)
    for own in _scopes.get()[-1:]:
        own.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pinned_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that pinned() gave; others stay as they are."""
    path = getattr(df, "_pinned_at", None)
    if path:
        where, files = _at(df.sparkSession, path)
        files.delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables that were pinned within it, but those put into the
    list; these belong to the scope around it then.  What is handed out must be
    one of the tables kept, not a plan that still reads another."""
    kept: list[DataFrame] = []
    around, made = _scopes.get(), []
    token = _scopes.set((*around, made))
    try:
        yield kept
    finally:
        _scopes.reset(token)
        stay = {getattr(df, "_pinned_at", None) for df in kept}
        for path in made:
            if path in stay:
                for outer in around[-1:]:
                    outer.append(path)
                continue
            where, files = _at(spark, path)
            files.delete(where, True)
