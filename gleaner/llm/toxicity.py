"""Toxicity: a character n-gram linear classifier with naive Bayes features.

Features are hashed character n-grams, present or absent in a whole text.  A
feature's value is its naive Bayes log-count ratio between the classes; a
logistic regression learns weights for these scaled features.

The classifier is fitted on a bounded sample of labelled rows
(``max_per_class`` rows of each class, lowest seeded hash of the id first);
scoring reads every row and every whole text.  The share of the classes comes
from all labels: the intercept is corrected for what the sample leaves out.

Edge cases.  Null text counts as empty.  Empty texts, and texts shorter than
the shortest n-gram, get the intercept's probability.  Rows that repeat are
scored alike, each on its own.  Labels that are null, or whose id is null,
aren't learned from; if an id has several labels the largest counts.  Without
both classes among the labels the score is the smoothed share of class 1
everywhere (0.5 without labels).  Long texts count whole.  Ids of equal hash
rank are drawn by id, features of equal surety by their number.  Other columns are not read,
so none can clash.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import input_columns, package_on_workers, released

#: Lengths of the n-grams, in characters.
NGRAMS = (3, 4, 5)
#: Buckets of hashed n-grams.
BUCKETS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_last: dict[int, np.ndarray] = {}


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The distinct buckets of a text's character n-grams (in lower case)."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < NGRAMS[0]:
        return np.empty(0, np.int64)
    codes = codes.astype(np.uint64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    found = []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, NGRAMS[-1] + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :] + np.uint64(n)
        if n in NGRAMS:
            found.append(((h ^ (h >> np.uint64(29))) * _MIX >> shift).astype(np.int64))
    every = np.concatenate(found)
    # The last place of each bucket stays: distinct without a sort.
    last = _last.get(buckets)
    if last is None:
        last = _last[buckets] = np.empty(buckets, np.int64)
    at = np.arange(len(every))
    last[every] = at
    return every[last[every] == at]


@dataclass
class Model:
    """weights: one per bucket, log-count ratio times learned weight."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[ngram_buckets(text, len(self.weights))].sum(dtype=np.float64))
        return 1.0 / (1.0 + np.exp(-z)) if z > -700 else 0.0


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """The ids that can be learned from, each once: id, y."""
    one = labels.select(*input_columns(labels, id=id_col, y=label_col)).where("id is not null and y in (0, 1)")
    return one.groupBy("id").agg(F.max("y").alias("y"))


def sample(one: DataFrame, max_per_class: int, seed: int) -> DataFrame:
    """At most max_per_class labelled ids (id, y) of each class."""
    rank = F.xxhash64("id", F.lit(seed))
    picked = [one.where(f"y = {k}").orderBy(rank, "id").limit(max_per_class) for k in (0, 1)]
    return picked[0].unionByName(picked[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_per_class: int = 3000,
    features: int | None = 16384,
    min_rows: int = 4,
    smoothing: float = 1.0,
    l2: float = 1.0,
    seed: int = 7,
) -> Model:
    """Learns from labelled rows; bounds: 2 * max_per_class rows, and of the
    buckets that min_rows of them have the ``features`` whose log-count ratio is
    the surest; None takes all of them (with min_rows 1, all there are).

    The driver gets a count for each bucket (BUCKETS at most) and a bitmap of
    ``features`` bits for each sampled row (of BUCKETS bits, 128 KB, for None),
    however long the texts are.
    """
    spark = docs.sparkSession
    package_on_workers(spark)
    one = labelled(labels, id_col, label_col)
    ids = sample(one, max_per_class, seed)
    # Labels for each one that is in the sample, of each class.
    drawn = {int(r.y): max(1.0, r.n / max_per_class) for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight0, weight1 = drawn.get(0, 1.0), drawn.get(1, 1.0)
    # 2 * max_per_class rows of two numbers: a bound that doesn't grow.
    rows = docs.select(*input_columns(docs, id=id_col, text=text_col)).join(F.broadcast(ids), "id").select("text", F.col("y").cast("int").alias("y"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = np.zeros((2, BUCKETS), np.int64)
        rows_of = np.zeros(2, np.int64)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                of[y, ngram_buckets(text)] += 1
                rows_of[y] += 1
        at = np.flatnonzero(of.any(axis=0))
        yield pd.DataFrame({"b": at, "n0": of[0, at], "n1": of[1, at]})
        yield pd.DataFrame({"b": [-1], "n0": rows_of[:1], "n1": rows_of[1:]})

    partial = rows.mapInPandas(released(counted), "b long, n0 long, n1 long")
    counts = partial.groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where((F.col("b") < 0) | (F.col("n0") + F.col("n1") >= min_rows)).toPandas()
    totals = counts[counts["b"] < 0]
    n0, n1 = (int(totals[c].sum()) for c in ("n0", "n1"))
    empty = np.zeros(BUCKETS, np.float32)
    if not n0 or not n1:
        p = (n1 * weight1 + 1) / (n0 * weight0 + n1 * weight1 + 2)
        return Model(empty, float(np.log(p / (1 - p))))
    counts = counts[counts["b"] >= 0].sort_values("b")
    c0, c1, at = (counts[c].to_numpy(np.float64) for c in ("n0", "n1", "b"))
    ratio = np.log(((c1 + smoothing) / (n1 + smoothing)) / ((c0 + smoothing) / (n0 + smoothing)))
    sure = np.abs(ratio) / np.sqrt(1 / (c0 + smoothing) + 1 / (c1 + smoothing))
    best = np.sort(np.argsort(-sure, kind="stable")[:features])
    place = np.full(BUCKETS, -1, np.int32)
    place[at[best].astype(np.int64)] = np.arange(len(best))
    ratio = ratio[best]
    places = spark.sparkContext.broadcast(place)
    width = len(best)

    def bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text in batch["text"]:
                bits = np.zeros(width, np.bool_)
                p = places.value[ngram_buckets(text)]
                bits[p[p >= 0]] = True
                made.append(np.packbits(bits).tobytes())
            yield pd.DataFrame({"y": batch["y"], "bits": made})

    got = rows.mapInPandas(released(bitmaps), "y int, bits binary").toPandas()
    got = got.sort_values(["y", "bits"], kind="stable")  # the order rows come in doesn't matter
    y = got["y"].to_numpy(np.float64)
    ends, cols = [0], []
    for bits in got["bits"]:
        cols.append(np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=width)).astype(np.int32))
        ends.append(ends[-1] + len(cols[-1]))
    w, b = _logistic(np.concatenate(cols), np.asarray(ends), y, ratio, l2)
    weights = empty
    weights[at[best].astype(np.int64)] = w * ratio
    return Model(weights, b + float(np.log(weight1 / weight0)))


def _logistic(cols: np.ndarray, ends: np.ndarray, y: np.ndarray, scale: np.ndarray, l2: float, rounds: int = 150) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression, full-batch gradient steps (Adam).
    Row i has the features cols[ends[i]:ends[i + 1]], each of value scale[c]."""
    row = np.repeat(np.arange(len(y)), np.diff(ends))
    values = scale[cols]
    p = np.zeros(len(scale) + 1)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        z = np.bincount(row, p[cols] * values, minlength=len(y)) + p[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.append(np.bincount(cols, r[row] * values, minlength=len(scale)) + l2 * p[:-1], r.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:-1], float(p[-1])


def scorer(df: DataFrame, model: Model):
    """A function of a text column that gives the score, for df's session."""
    package_on_workers(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sent.value.score(x) for x in texts], dtype="float64")

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(of_texts)(batches)

    return lambda text: scored(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted for every row."""
    rows = docs.select(*input_columns(docs, id=id_col, text=text_col))
    rows = rows.select(F.col("id").alias(id_col), scorer(docs, model)(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True for the rows that are only for testing; null ids are never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))
