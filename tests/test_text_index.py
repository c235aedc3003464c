"""The inverted index against scoring of all texts."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.engine import Engine
from gleaner.operators import search
from gleaner.sources import text_index
from gleaner.sources.text_index import TextIndex

QUERY = "tea Acme, tea and the café 42"


def texts(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def made(seed, n, start=0):
    rng = random.Random(seed)
    words = ["tea", "acme", "Acme's", "the", "café", "x42", "42", "river", "and", "Ünder"]
    return [(f"d{k}", None if k % 17 == 3 else " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(start, start + n)]


def same(index, rows, spark, query=QUERY):
    need = sorted(map(tuple, search.bm25(texts(spark, rows), query, None).collect()))
    assert sorted(map(tuple, index.search(query, None).collect())) == need
    assert list(map(tuple, index.search(query, 3).collect())) == sorted(need, key=lambda r: (-r[1], r[0]))[:3]
    return need


def test_like_scoring_all_texts(spark, tmp_path):
    rows = made(1, 200)
    index = TextIndex(spark, str(tmp_path / "i"), split_rows=50)
    index.build(texts(spark, rows), of=3)
    assert len(same(index, rows, spark)) > 50 and index.of() == 3
    assert index.search("", None).collect() == [] and index.search("nowhere", None).collect() == []
    assert index.search("?!", 5).schema.simpleString() == "struct<id:string,score:double>"


def test_updates(spark, tmp_path):
    rows = dict(made(2, 120))
    index = TextIndex(spark, str(tmp_path / "i"), most=3, grace=0.0)
    index.build(texts(spark, list(rows.items())))
    rng = random.Random(7)
    for step in range(5):
        changed = {i: f"{rng.choice(['tea', 'acme 42', 'the river'])} {step}" for i in rng.sample(sorted(rows), 10)}
        new = dict(made(step + 50, 7, start=1000 + step * 10))
        gone = rng.sample(sorted(set(rows) - set(changed)), 5)
        removed = [(i, rows[i]) for i in [*changed, *gone]]
        index.update(texts(spark, [*changed.items(), *new.items()]), texts(spark, removed), of=step)
        rows = {i: t for i, t in rows.items() if i not in gone} | changed | new
        same(index, list(rows.items()), spark)
        assert index.of() == step
    assert len(index.latest()[1]["generations"]) <= 3
    # An id that went comes back.
    index.update(texts(spark, [(gone[0], "tea tea")]), texts(spark, []), of=9)
    same(index, [*rows.items(), (gone[0], "tea tea")], spark)


def test_no_texts(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    assert index.of() is None
    index.build(texts(spark, []))
    assert index.search("tea", None).collect() == []
    index.update(texts(spark, [("a", "tea")]), texts(spark, []))
    same(index, [("a", "tea")], spark)


def test_a_query_reads_the_postings_of_its_words(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.build(spark.range(3000).select(F.col("id").cast("string").alias("id"), F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id")), F.concat(F.lit("v"), F.col("id") % 100)).alias("text")))
    plan = index.search("w77", None)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*at_bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    files = index.search("w77", None).inputFiles()
    index.search("w77", None).collect()
    read = spark.read.parquet(f"{index.path}/{index.latest()[1]['generations'][0]['postings']}")
    assert read.where(F.col("at_bucket").isin([r.at_bucket for r in read.where("term = 'w77'").select("at_bucket").collect()])).count() < read.count() / 10 and files


def test_the_engine_keeps_its_index(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    chunk = lambda k, text: {"id": k, "document_id": "d", "corpus_id": "c", "doc_path": "a.md", "position": 0, "text": text, "embedding": [1.0]}
    engine._put("chunk", [chunk("a", "green tea"), chunk("b", "black tea tea"), chunk("c", "coffee")])
    index = TextIndex(spark, f"{tmp_path}/index/chunk")
    assert index.of() is None
    assert [r["id"] for r in engine.fulltext("tea", 5)] == ["b", "a"] and index.of() == 1
    engine._put("chunk", [chunk("c", "tea tea tea"), chunk("d", "milk")])
    assert len(index.latest()[1]["generations"]) == 2
    assert [r["id"] for r in engine.fulltext("tea", 5)] == ["c", "b", "a"] and engine.fulltext("coffee") == []
    engine._table("chunk").change(gone=spark.createDataFrame([("b",)], "id string"))  # past the index
    assert [r["id"] for r in engine.fulltext("tea", 5)] == ["c", "a"]
    assert engine.reembed("chunk", missing_only=False) == 3 and len(index.latest()[1]["generations"]) == 1
    engine._put("entity", [{"id": "e", "name": "Acme", "description": "sells tea"}, {"id": "f", "name": "Bolt"}])
    assert [r["name"] for r in engine.entity_search("tea")] == ["Acme"]
    engine._set("entity", spark.createDataFrame([("f", "tea tea")], "id string, description string"))
    assert [r["name"] for r in engine.entity_search("tea")] == ["Bolt", "Acme"]


@pytest.mark.parametrize("corpus", ["", "c"])
def test_ingest_updates_the_index(spark, tmp_path, corpus):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# A\n" + "green tea from the hills " * 5)
    engine = Engine(spark, str(tmp_path / "data"))
    engine.ingest(str(docs), "demo")
    assert len(engine.fulltext("hills")) == 1
    (docs / "a.md").write_text("# A\n" + "coffee from the coast " * 5)
    engine.ingest(str(docs), "demo")
    assert engine.fulltext("hills") == [] and len(engine.fulltext("coast")) == 1


def test_words_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(text_index, "AT_ONCE", 7)
    words = [["a", "b", "a"], [], ["c"] * 3, ["d", "e"] * 10, None, ["a"], ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(words, pa.list_(pa.string())), pa.array([len(w or []) for w in words])], names=["id", "words", "size"])
    out = list(text_index._counted(iter([batch])))
    assert len(out) == 3
    got = sorted((r["id"], r["term"], r["size"], r["tf"]) for b in out for r in b.to_pylist())
    assert got == sorted((k, t, len(w), w.count(t)) for k, w in enumerate(words) if w for t in set(w))
