"""Importance resampling against a brute-force version, and its rank offsets."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.llm import queries, resampling

from .shared import ODD, frame, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text, ngrams=(1, 1)):
    words = WORD.findall(lower(text or ""))
    return words, [" ".join(words[k : k + n]) for n in range(ngrams[0], ngrams[1] + 1) for k in range(len(words) - n + 1)]


def expected(rows, target, *, percent, min_words, buckets=10_000, ngrams=(1, 1), seed=2024):
    of = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    bags = [(i, *bag(x, ngrams)) for i, x in rows]
    for _, _, f in bags:
        s.update(map(of, f))
    for x in target:
        t.update(map(of, bag(x, ngrams)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for i, words, f in bags:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(of(x)) for x in f)
        out.append([i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ranked = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(ranked[: len(ranked) * percent // 100], 1):
        r[5] = k
    return sorted(map(str, out))


def got(df):
    return sorted(str([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]]) for r in df.collect())


def test_query(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    target = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()["text"]
    need = expected(list(zip(docs["doc_id"], docs["text"])), target, percent=10, min_words=20)
    found = queries.op11_importance_resampling(spark, sf_dir).collect()
    assert sum(r["rank"] is not None for r in found) > 50
    drop = lambda x: x[:1] + x[2:]  # noqa: E731  (the query leaves n_words out)
    assert sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in found) == sorted(str(drop(eval(x))) for x in need)


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (2, 3)])
def test_odd_rows(spark, ngrams):
    words = spark.createDataFrame([("two words",), (None,), ("a line of two words",)], "text string")
    out = resampling.resample(frame(spark), words, percent=60, ngrams=ngrams, buckets=100)
    assert got(out) == expected(ODD, ["two words", None, "a line of two words"], percent=60, min_words=0, ngrams=ngrams, buckets=100)


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert resampling.resample(none, none, percent=10).collect() == []
    rows = [(1, "a b"), (2, None)]
    assert got(resampling.resample(frame(spark, rows), none, percent=50, ngrams=(1, 1))) == expected(rows, [], percent=50, min_words=0)
    assert all(r["rank"] is None for r in resampling.resample(frame(spark, rows), none, percent=50, min_words=3).collect())


def test_counts_above_a_score_over_many_levels(spark):
    scores = [0, 1, -1, 1023, 1024, 1025, -1024, 5_000_000_000, -7_000_000_000_000, 42, 43, 2_000_000]
    hist = [(x, k % 3 + 1) for k, x in enumerate(scores)]
    found = {r.score: (r.n, r.above) for r in resampling.higher(spark.createDataFrame(hist, "score long, n long")).collect()}
    assert found == {x: (n, sum(m for y, m in hist if y > x)) for x, n in hist}


def test_many_ties_at_the_cutoff(spark):
    """All rows have one score, so the smaller ids are drawn."""
    rows = spark.range(1000).select(F.col("id"), F.lit(5).cast("long").alias("n_words"), F.lit(5).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), F.lit(7).cast("long").alias("score"))
    found = resampling.ranked(rows, F.col("id") % 2 == 0, 10).collect()
    assert {r.id: r["rank"] for r in found if r["rank"]} == {2 * k: k + 1 for k in range(50)} and len(found) == 1000


def test_texts_like_the_target_come_first(spark):
    rows = [(k, " ".join(f"{'near' if k % 4 == 0 else 'far'}{j}" for j in range(30))) for k in range(200)]
    target = spark.createDataFrame([(" ".join(f"near{j}" for j in range(30)),)], "text string")
    out = resampling.resample(frame(spark, rows, extra=False), target, percent=20, ngrams=(1, 2)).where("rank is not null").collect()
    assert len(out) == 40 and all(r.doc_id % 4 == 0 for r in out)
