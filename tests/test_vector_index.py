"""The vector index: exact results, recall, updates, and what isn't compared."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.engine import Engine
from gleaner.operators import cells, search
from gleaner.settings import Settings
from gleaner.sources.vector_index import VectorIndex


def clustered(seed, n, clusters=12, size=24, spread=0.15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, size))
    return middle[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, size))


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + k, x.tolist(), f"p{k % 3}") for k, x in enumerate(m)], "id long, embedding array<float>, path string")


@pytest.fixture(scope="module")
def vectors(spark):
    m = clustered(1, 3000)
    m[5] = m[6] = 0.0
    m[100:140] = m[99]
    return frame(spark, m).repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    made = VectorIndex(spark, str(tmp_path_factory.mktemp("i") / "i"), cell_rows=100)
    made.build(vectors, of=4)
    return made


def same(got, need):
    assert [(r.id, r.score) for r in got.collect()] == [(r.id, r.score) for r in need.collect()]


@pytest.mark.parametrize("seed", range(3))
def test_exact(vectors, index, seed):
    query = clustered(seed + 40, 1)[0].tolist()
    for k in (1, 10, 300):
        same(index.search(query, k), search.vector_top_k(vectors, query, k))
    keep = F.col("path") == "p1"
    same(index.search(query, 10, keep=keep), search.vector_top_k(vectors, query, 10, keep, "pre"))
    assert index.of() == 4 and not index.stale()


def test_exact_with_all_rows_no_direction_and_repeated_vectors(vectors, index):
    one = vectors.where("id = 99").first().embedding
    same(index.search(one, 60), search.vector_top_k(vectors, one, 60))
    same(index.search(one, 5000), search.vector_top_k(vectors, one, 5000))
    same(index.search([0.0] * 24, 7), search.vector_top_k(vectors, [0.0] * 24, 7))


def test_a_query_reads_few_cells(index):
    query = clustered(77, 1)[0].tolist()
    plan = index.search(query, 5)._jdf.queryExecution().toString()
    read = index._vectors(index.latest()[1])
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert read.select("cell").distinct().count() > 15


def brute(m, ids, k):
    u = cells.units(m)
    sims = np.round(u[ids] @ u.T, 6)
    sims[np.arange(len(ids)), ids] = -3
    return {int(i): [int(j) for j in np.lexsort((np.arange(len(m)), -s))[:k]] for i, s in zip(ids, sims)}


def test_many_queries(spark, vectors, index, monkeypatch):
    monkeypatch.setattr("gleaner.sources.vector_index.BLOCK", 50)
    m = np.stack([r.embedding for r in vectors.orderBy("id").collect()]).astype(np.float64)
    ids = np.arange(0, 3000, 50)
    need = brute(m, ids, 10)
    got = {}
    for r in index.search_many(vectors.where("id % 50 = 0"), 10).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r.id)
    assert got == need
    near = index.search_many(vectors.where("id % 50 = 0"), 10, probes=4).collect()
    hits = sum(r.id in need[r.query] for r in near)
    assert hits >= 0.9 * 10 * len(ids)


def test_updates(spark, tmp_path):
    m = clustered(3, 600)
    index = VectorIndex(spark, str(tmp_path / "i"), cell_rows=50)
    index.build(frame(spark, m))
    m[10:20] = clustered(9, 10)
    index.update(frame(spark, m[10:20], 10), spark.createDataFrame([(k,) for k in [*range(10, 20), 30, 31]], "id long"), of=2)
    more = clustered(11, 40)
    index.update(frame(spark, more, 600), spark.createDataFrame([], "id long"), of=3)
    rows = frame(spark, np.concatenate([m, more])).where("id not in (30, 31)")
    for seed in range(3):
        query = clustered(seed + 60, 1)[0].tolist()
        same(index.search(query, 25), search.vector_top_k(rows, query, 25))
    assert index.of() == 3 and not index.stale()


def test_no_vectors(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.build(spark.createDataFrame([(1, None)], "id long, embedding array<float>"))
    assert index.search([1.0, 0.0]).collect() == []
    index.update(spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 0.0])], "id long, embedding array<float>"), spark.createDataFrame([], "id long"))
    assert [(r.id, r.score) for r in index.search([1.0, 0.0]).collect()] == [(2, 1.0), (3, 0.0)]


def test_recall_on_the_table(spark, sf_dir, tmp_path):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    m = np.array(t["embedding"], np.float64)
    rows = frame(spark, m)
    index = VectorIndex(spark, str(tmp_path / "i"), cell_rows=25)
    index.build(rows)
    ids = np.arange(0, len(m), 50)
    need = brute(m, ids, 10)
    got = index.search_many(rows.where("id % 50 = 0"), 10, probes=16).collect()
    recall = sum(r.id in need[r.query] for r in got) / (10 * len(ids))
    print("recall", recall, "cells", index._vectors(index.latest()[1]).select("cell").distinct().count())
    assert recall >= 0.9


def test_the_engine_keeps_its_index(spark, tmp_path):
    engine, plain = (Engine(spark, str(tmp_path), settings=Settings(embed_size=16, vector_index_bytes=n)) for n in (0, 1 << 40))
    chunk = lambda k, text: {"id": f"k{k}", "document_id": "d", "corpus_id": "ab"[k % 2], "doc_path": "a.md", "position": k, "text": text, "embedding": engine.embedder.embed([text])[0]}
    engine._put("chunk", [chunk(k, f"tea number {k % 7} river {k}") for k in range(60)])
    assert engine.search("tea river 5", 7) == plain.search("tea river 5", 7) and engine._vectors("chunk").of() == 1
    engine._put("chunk", [chunk(5, "coffee"), chunk(99, "tea river 5")])
    assert engine._vectors("chunk").of() == 2 and len(engine._vectors("chunk").latest()[1]["generations"]) == 2
    assert engine.search("tea river 5", 7) == plain.search("tea river 5", 7) and engine.search("tea river 5", 1)[0]["id"] == "k99"
