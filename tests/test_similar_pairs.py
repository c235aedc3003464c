"""The similarity join against all pairs, and how much of it is compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import columns as C
from gleaner.operators import cells, discover


def frame(spark, m):
    return spark.createDataFrame([(k, None if x is None else [float(v) for v in x]) for k, x in enumerate(m)], "id long, embedding array<float>")


def clustered(seed, n, clusters=20, size=16, spread=0.08):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, size))
    return np.float32(middle[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, size)))


def brute(m, threshold, most):
    at = [k for k, x in enumerate(m) if x is not None]
    u = cells.units(np.array([m[k] for k in at], np.float64))
    sims = np.round(u @ u.T, 6)
    return {(at[i], at[j]): sims[i, j] for i, j in zip(*np.nonzero((sims >= threshold) & (sims <= most))) if i < j}


def found(df):
    rows = df.collect()
    out = {(r.a, r.b): r.similarity for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("threshold, most, block, cell_rows", [(0.9, 1.0, 1024, 40), (0.65, 0.97, 30, 50), (0.0, 1.0, 64, 60), (-1.0, 0.2, 100, 50), (0.9, 1.0, 1024, 5000)])
def test_like_all_pairs(spark, threshold, most, block, cell_rows):
    m = list(clustered(2, 500))
    m[3] = m[4] = np.zeros(16)
    m[7] = None
    m[50:90] = [m[49]] * 40
    assert found(discover.similar_pairs(frame(spark, m), threshold, most, block, cell_rows)) == pytest.approx(brute(m, threshold, most), abs=2e-6)


def test_few_pairs_are_compared(spark):
    rows = frame(spark, clustered(5, 2000))
    compared, every = discover.comparisons(rows, 0.9, block=200, cell_rows=100)
    assert every == 2000 * 1999 // 2 and compared < every / 4
    same, _ = discover.comparisons(rows, -1.0, block=200, cell_rows=100)
    assert same == every


def test_no_vectors(spark):
    none = frame(spark, []).limit(0)
    assert discover.similar_pairs(none).collect() == [] and discover.comparisons(none) == (0, 0)
    assert discover.similar_pairs(frame(spark, [None, [1.0, 0.0]])).collect() == []
    zeros = frame(spark, [[0.0, 0.0]] * 40)
    assert discover.similar_pairs(zeros, 0.5, cell_rows=10, block=10).collect() == [] and discover.similar_pairs(zeros, 0.0, cell_rows=10, block=10).count() == 780


def documents(spark, m, paths, lengths):
    rows = [(k, [float(v) for v in x], p, None if n is None else "x" * n, ("bridge", "hub", "gap", None)[k % 4], (k % 17) / 17) for k, (x, p, n) in enumerate(zip(m, paths, lengths))]
    return spark.createDataFrame(rows, "id long, embedding array<float>, doc_path string, text string, strategy string, score double")


@pytest.fixture(scope="module", params=["clustered", "scattered"])
def chunks(request, spark):
    """More than one group's rows, with and without cells that rule others out."""
    n = 2300
    m = clustered(7, n) if request.param == "clustered" else np.float32(np.random.default_rng(8).normal(size=(n, 16)))
    m[100:140] = m[99]
    m[200] = 0
    rng = np.random.default_rng(9)
    paths = [None if k == 5 else f"d{k}/f{j}.md" for k, j in zip(rng.integers(0, 6, n), rng.integers(0, 7, n))]
    rows = documents(spark, m, paths, [None if k % 50 == 1 else k % 450 for k in range(n)]).cache()
    return rows, spark.createDataFrame([(a, b, float(v)) for (a, b), v in brute(list(m), 0.7, 1.0).items()], "a long, b long, similarity double").cache()


def sides(rows, pairs):
    side = lambda s: rows.select(*[F.col(c).alias(s if c == "id" else f"{c}_{s}") for c in ("id", "doc_path", "text", "strategy", "score")])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def same(got, need):
    columns = sorted(need.columns)
    x, y = (sorted((tuple(str(v) for v in r) for r in df.select(columns).collect())) for df in (got, need))
    assert x == y and x


def test_vectors_are_copied_no_more_often_in_larger_tables(spark):
    few = lambda n, block: {(x, y) for x, y in discover._deal(spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("embedding")), -1.0, block, 10**9).tiles}
    for n in (3_000, 30_000):
        tiles = few(n, 100)
        assert max(x for x, _ in tiles) < discover.GROUPS and len(tiles) <= discover.GROUPS * (discover.GROUPS + 1) // 2


def test_bridged_pairs_are_left_out_group_by_group(spark, chunks):
    rows, pairs = chunks
    bridged = pairs.where("(a + b) % 3 = 0").select("a", "b").unionByName(spark.createDataFrame([(-1, 5), (7, 7), (9, 3)], "a long, b long"))
    need = sides(rows, pairs.where("(a + b) % 3 <> 0")).where("strategy_a <> strategy_b")
    score = F.col("similarity") * (0.5 + 0.5 * (F.col("score_a") + F.col("score_b")) / 2)
    got = discover.meta_pairs(rows, bridged, 0.7)
    same(got, need.select("a", "b", "strategy_a", "strategy_b", "similarity", F.round(score, 6).alias("score")))
    assert "SortMergeJoin" not in got._jdf.queryExecution().sparkPlan().toString().split("MapInArrow")[0]


@pytest.mark.parametrize("k", [None, 25])
def test_bridges_like_all_pairs(chunks, k):
    rows, pairs = chunks
    x = sides(rows, pairs).where("doc_path_a <> doc_path_b")
    score = C.bridge_score(F.col("similarity"), C.path_distance(F.col("doc_path_a"), F.col("doc_path_b")), (F.length("text_a") + F.length("text_b")) / 2)
    x = x.select("a", "b", F.least("doc_path_a", "doc_path_b").alias("doc_a"), F.greatest("doc_path_a", "doc_path_b").alias("doc_b"), "similarity", F.round(score, 6).alias("score"))
    best = x.withColumn("r", F.row_number().over(Window.partitionBy("doc_a", "doc_b").orderBy(F.desc("score"), "a", "b"))).where("r = 1").drop("r")
    got = discover.bridges(rows, 0.7, k)
    same(got, best if k is None else best.orderBy(F.desc("score"), "a", "b").limit(k))
    assert "SortMergeJoin" not in got._jdf.queryExecution().sparkPlan().toString()


def test_hubs_like_all_pairs(chunks):
    rows, pairs = chunks
    x = sides(rows, pairs).where("doc_path_a <> doc_path_b")
    both = x.selectExpr("a id", "doc_path_a doc_path", "doc_path_b other", "similarity").unionByName(x.selectExpr("b id", "doc_path_b doc_path", "doc_path_a other", "similarity"))
    stats = both.groupBy("id", "doc_path").agg(F.countDistinct("other").alias("reach"), (F.round(F.sum(F.round(F.col("similarity") * 1e6).cast("long")) / F.count(F.lit(1))) / 1e6).alias("strength"))
    docs = rows.agg(F.countDistinct("doc_path")).first()[0]
    stats = stats.withColumn("score", F.round(F.col("reach") / (docs - 1) * (0.4 + 0.6 * F.col("strength")), 6))
    best = stats.withColumn("r", F.row_number().over(Window.partitionBy("doc_path").orderBy(F.desc("score"), "id"))).where("r = 1").drop("r")
    got = discover.hubs(rows, 0.7)
    same(got, best)
    assert "SortMergeJoin" not in got._jdf.queryExecution().sparkPlan().toString()


def test_the_most_similar_pairs_of_two_documents(chunks):
    rows, pairs = chunks
    need = sides(rows, pairs).where("doc_path_a <> doc_path_b").select("a", "b", "similarity")
    same(discover.cross_document_pairs(rows, 0.7), need)
    same(discover.cross_document_pairs(rows, 0.7, k=33), need.orderBy(F.desc("similarity"), "a", "b").limit(33))


def test_six_places_as_spark_rounds(spark):
    rng = np.random.default_rng(3)
    sims = np.round(rng.uniform(-1, 1, 4000), 6)
    x = np.concatenate([sims * (0.5 + 0.5 * np.round(rng.integers(0, 17, 4000) / 17, 6) / 2), sims * 0.5, sims * 0.75, [0.0, -1e-9, 1e-7, 0.0617285, 1.0000005, np.nan, 3e12]])
    need = [r.y for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    np.testing.assert_array_equal(discover._six_places(x), np.array(need))


def test_bridged_pairs_go_to_their_tiles_packed(spark):
    pairs = spark.range(0, 3000, 1, 2).select((F.col("id") % 3).cast("int").alias("tile"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = discover._packed(pairs).collect()
    assert len(rows) == 6
    assert sorted((r.tile, a, b) for r in rows for a, b in zip(r.a, r.b)) == sorted((k % 3, k, k + 1) for k in range(3000))


def test_pairs_of_unknown_score(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0], s, v) for k, (s, v) in enumerate([("a", 0.5), ("b", None), ("b", 0.25), ("a", 1.0)])], "id long, embedding array<float>, strategy string, score double")
    bridged = spark.createDataFrame([(0, 2)], "a long, b long")
    assert sorted((r.a, r.b, r.score) for r in discover.meta_pairs(rows, bridged, 0.9).collect() if r.score is not None) == [(2, 3, 0.8125)]
    assert sorted((r.a, r.b) for r in discover.meta_pairs(rows, bridged, 0.9).collect()) == [(0, 1), (1, 3), (2, 3)]
