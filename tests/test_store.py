"""Tables of a base and changes: what is read, what is written, what goes."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.engine import Engine
from gleaner.sources.store import Table

KIND = "id long, name string, v array<float>"


def rows(spark, pairs):
    return spark.createDataFrame([(i, n, [float(i)]) for i, n in pairs], KIND)


def held(table):
    return {r.id: r.name for r in table.read().collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.startswith("part-"))


def test_changes_are_merged_when_read(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), most=100, share=100.0)
    assert table.change(gone=spark.createDataFrame([(1,)], "id long")) == 0 and table.read() is None
    table.change(rows(spark, [(1, "a"), (2, "b"), (3, None)]))
    assert table.change(rows(spark, [(2, "B"), (4, "d")])) == 2
    assert held(table) == {1: "a", 2: "B", 3: None, 4: "d"}
    table.change(gone=spark.createDataFrame([(1,), (4,), (9,)], "id long"))
    assert held(table) == {2: "B", 3: None}
    table.change(rows(spark, [(4, "again"), (3, "c")]), spark.createDataFrame([(3,), (2,)], "id long"))
    assert held(table) == {3: "c", 4: "again"}
    assert table.change(rows(spark, [])) == 0 and table.version() == 4
    before = sorted(map(str, table.read().collect()))
    table.compact()
    assert sorted(map(str, table.read().collect())) == before and table.content(5)["changes"] == []


def test_random_changes_are_like_a_dictionary(spark, tmp_path):
    rng, table, need = random.Random(4), Table(spark, str(tmp_path / "t"), grace=0.0, most=3, bucket_bytes=2000), {}
    for step in range(14):
        new = {rng.randrange(60): f"{step}" for _ in range(rng.randrange(1, 25))}
        gone = [rng.randrange(60) for _ in range(rng.randrange(4))]
        table.read()
        table.change(rows(spark, new.items()), spark.createDataFrame([(i,) for i in gone], "id long"))
        need = {i: n for i, n in need.items() if i not in gone} | new
        assert held(table) == need
    assert table.latest()[1]["buckets"] > 1
    for i in range(60):
        got = [r.name for r in table.read([(i,)]).where(F.col("id") == i).collect()]
        assert got == ([need[i]] if i in need else [])


def test_a_look_up_reads_one_bucket(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), bucket_bytes=1000)
    for _ in range(2):
        table.write(spark.range(4000).select("id", F.col("id").cast("string").alias("name")))
    assert table.latest()[1]["buckets"] >= 8
    whole, one = table.read(), table.read([(77,)])
    assert one.where("id = 77").first().name == "77" and whole.count() == 4000 and 0 < one.count() < 4000 / 4
    assert re.search(r"PartitionFilters: \[[^\]]*at_bucket", one._jdf.queryExecution().toString())


def test_a_small_change_writes_little(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.change(spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name")))
    whole = size(tmp_path)
    table.read()
    table.change(spark.createDataFrame([(7, "new")], "id long, name string"))
    assert size(tmp_path) - whole < 5_000 < whole / 100 and table.read().where("id = 7").first().name == "new" and table.read().count() == 50_000


def test_old_versions_go_and_a_reader_is_safe(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), keep=2, grace=0.0)
    table.write(rows(spark, [(k, "0") for k in range(50)]))
    for n in range(1, 6):
        before = table.read()
        table.write(rows(spark, [(k, str(n)) for k in range(50)]))
        assert {r.name for r in before.collect()} == {str(n - 1)}  # one version behind
    left = os.listdir(tmp_path / "t")
    assert len([x for x in left if x.startswith("base-")]) == 2 and sorted(x for x in left if x.startswith("CURRENT")) == ["CURRENT.5", "CURRENT.6"]
    slow = Table(spark, str(tmp_path / "t"), keep=1, grace=3600.0)
    slow.write(rows(spark, [(1, "x")]))
    assert len([x for x in os.listdir(tmp_path / "t") if x.startswith("base-")]) == 3


def test_what_was_read_must_be_the_last(spark, tmp_path):
    first, second = (Table(spark, str(tmp_path / "t"), share=100.0) for _ in range(2))
    first.change(rows(spark, [(1, "a")]))
    assert held(second) == {1: "a"}
    first.change(rows(spark, [(1, "b")]))
    with pytest.raises(RuntimeError):
        second.change(rows(spark, [(1, "from a")]))
    second.read()
    second.change(rows(spark, [(2, "c")]))
    assert held(first) == {1: "b", 2: "c"}


def test_writers_that_died(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), share=100.0)
    table.change(rows(spark, [(1, "a")]))
    (tmp_path / "t" / "CURRENT.2").write_text('{"schema": ')
    assert held(table) == {1: "a"}
    table.change(rows(spark, [(2, "b")]))
    assert held(table) == {1: "a", 2: "b"} and table.version() == 3
    old = tmp_path / "old"
    old.mkdir()
    (old / "CURRENT.1").write_text("v1-abc")
    with pytest.raises(ValueError):
        Table(spark, str(old)).read()


def test_keys_of_two_columns(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), ("a", "b"), share=100.0)
    kind = "a string, b string"
    table.change(spark.createDataFrame([("x", "1"), ("x", "2")], kind))
    table.change(spark.createDataFrame([("x", "2"), ("y", "1")], kind))
    assert sorted(map(tuple, table.read().collect())) == [("x", "1"), ("x", "2"), ("y", "1")]


def test_a_rating_writes_one_row(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine._put("insight", [{"id": f"i{k}", "corpus_id": "", "strategy": "hub", "text": f"{k} " * 30, "score": 0.5} for k in range(3000)])
    before = size(tmp_path / "insight")
    assert engine.rate("i77", 0.25) == "hub" and engine.rate("nobody", 1.0) is None
    assert size(tmp_path / "insight") - before < 8_000 < before
    assert [r.human_score for r in engine.read("insight").where("id = 'i77'").collect()] == [0.25] and engine.read("insight").count() == 3000
    assert engine.read("insight").where("human_score is not null").count() == 1
    found = json.loads((tmp_path / "insight" / "CURRENT.2").read_text())
    assert len(found["changes"]) == 1
