"""Intermediate tables: where they are, and when they go."""

import os
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest

from gleaner.sources import staging


def files(spark):
    return {n for n in os.listdir(staging.shared_dir(spark).removeprefix("file://")) if n.startswith("pinned-")}


def test_a_scope_deletes_what_it_does_not_keep(spark):
    before = files(spark)
    with staging.scope(spark) as kept:
        staging.pinned(spark.range(3))
        with staging.scope(spark) as inner:
            staging.pinned(spark.range(4))
            out = staging.pinned(spark.range(5))
            inner.append(out)
        assert len(files(spark) - before) == 2
        kept.append(out)
    assert out.count() == 5 and len(files(spark) - before) == 1
    staging.drop(out)
    staging.drop(spark.range(2))
    assert files(spark) == before


def test_a_scope_is_its_threads_own(spark):
    """A table that another thread pins while a scope is open outlives it."""
    opened, pinned, closed = Barrier(2), Barrier(2), Barrier(2)

    def holder():
        with staging.scope(spark):
            own = staging.pinned(spark.range(2))
            opened.wait(60)
            pinned.wait(60)
        closed.wait(60)
        return own._pinned_at

    def other():
        opened.wait(60)
        out = staging.pinned(spark.range(7))
        pinned.wait(60)
        closed.wait(60)
        return out.count(), out

    with ThreadPoolExecutor(2) as pool:
        first, second = pool.submit(holder), pool.submit(other)
        gone, (n, out) = first.result(120), second.result(120)
    assert n == 7 and not os.path.exists(gone.removeprefix("file://"))
    staging.drop(out)


def test_a_failure_deletes_too(spark):
    before = files(spark)
    with pytest.raises(RuntimeError), staging.scope(spark):
        staging.pinned(spark.range(3))
        raise RuntimeError
    assert files(spark) == before


def test_a_cluster_has_to_name_a_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        staging.shared_dir(Session())
