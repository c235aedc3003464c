"""Importance resampling towards a target distribution.

Texts are bags of hashed word n-grams.  A bucket's gain is the scaled log-ratio
of its smoothed shares in the target and in the corpus, rounded down; a row's
weight is the sum of the gains of its features.  With Gumbel noise that follows
from a row's id, the rows with the highest scores are a sample without
replacement by exp(weight / 1000).

Scores are integers, so ranks come from an exact histogram: a row's rank is the
number of rows with higher scores plus its place by id among those of its own.
The higher scores are counted by suffix sums over a tree of bins: each level
sums up to 2^10 bins of the level below, so no window holds more than that, and
only the uppermost level goes to the driver.  Rows below the cutoff score are
not moved.

The gains are an array of ``buckets`` numbers in the plan; that is the only
thing sent to executors, and its size is a parameter.  Noise spreads rows of
one weight over thousands of scores: the most frequent score of a group of
copies has 0.04 % of it.

Edge cases.  Null and empty texts have no features, and weight 0.  Long texts
count whole.  Ties go to the smaller id, then to fewer features and fewer
words; rows that repeat an id are ranked one by one, rows without id have the
noise of the bare seed and come last in a tie.  Other columns of the inputs are
not read, so none can clash.  An empty target gives gains of corpus rarity; no
rows give no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, input_columns, lowered, pinned, scope

#: Bins of a level that make one bin of the next, as a power of two.
FAN_BITS = 10


def features(words: Column, ngrams: tuple[int, int] = (1, 1)) -> Column:
    """All runs of so many consecutive words, joined by one space."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    of = lambda n: words if n == 1 else F.when(F.size(words) >= n, runs(n)).otherwise(F.array().cast("array<string>"))
    parts = [of(n) for n in range(ngrams[0], ngrams[1] + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def _bags(docs: DataFrame, ngrams: tuple[int, int], id_col: str | None, text_col: str) -> DataFrame:
    """id, words and features of each row."""
    names = {"text": text_col} | ({"id": id_col} if id_col else {})
    rows = docs.select(*input_columns(docs, **names))
    words = F.regexp_extract_all(lowered(F.coalesce("text", F.lit(""))), F.lit(WORD), 0)
    return rows.withColumn("words", words).withColumn("features", features(F.col("words"), ngrams)).drop("text")


def counts(docs: DataFrame, buckets: int, ngrams: tuple[int, int] = (1, 1), text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    found = _bags(docs, ngrams, None, text_col).select(F.explode(F.transform("features", lambda x: bucket(x, buckets))).alias("bucket"))
    out = np.zeros(buckets)
    for r in found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> list[int]:
    n = len(corpus)
    ratio = (target + 1) * (corpus.sum() + n) / ((corpus + 1) * (target.sum() + n))
    return np.floor(scale * np.log(ratio)).astype(np.int64).tolist()


def noise(id_col: Column, seed: int, scale: int = 1000) -> Column:
    """Gumbel noise, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score(docs: DataFrame, gain: list[int], *, ngrams: tuple[int, int] = (1, 1), seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score of every row."""
    # Folded into one literal by the optimizer.
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    weight = F.aggregate("features", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.get(table, bucket(x, len(gain))))
    rows = _bags(docs, ngrams, id_col, text_col)
    rows = rows.select("id", F.size("words").cast("long").alias("n_words"), F.size("features").cast("long").alias("n_features"), weight.alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def higher(hist: DataFrame) -> DataFrame:
    """score, n and ``above`` (rows with a higher score) of a histogram
    (score, n) that holds each score once."""
    ends = hist.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    levels = [hist.select(F.col("score").alias("bin"), "n")]
    low, high = ends.low or 0, ends.high or 0
    while (high >> FAN_BITS * (len(levels) - 1)) - (low >> FAN_BITS * (len(levels) - 1)) >= 1 << FAN_BITS:
        levels.append(levels[-1].groupBy(F.shiftright("bin", FAN_BITS).alias("bin")).agg(F.sum("n").alias("n")))
    top = sorted(levels.pop().collect(), key=lambda r: -r.bin)
    after = [0, *accumulate(r.n for r in top)]
    out = hist.sparkSession.createDataFrame([(r.bin, r.n, a) for r, a in zip(top, after)], "bin long, n long, above long")
    for level in reversed(levels):
        up = out.select(F.col("bin").alias("up"), F.col("above").alias("start"))
        later = Window.partitionBy("up").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        inner = level.withColumn("up", F.shiftright("bin", FAN_BITS)).withColumn("inner", F.coalesce(F.sum("n").over(later), F.lit(0)))
        out = inner.join(up, "up").select("bin", "n", (F.col("start") + F.col("inner")).alias("above"))
    return out.select(F.col("bin").alias("score"), "n", "above")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """scored with ``rank``: 1, 2, 3... of the highest scores of the eligible
    rows, floor(percent / 100) of them; null for the others."""
    spark = scored.sparkSession
    none = F.lit(None).cast("long").alias("rank")
    with scope(spark) as kept:
        hist = pinned(scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")))
        draw = (hist.agg(F.sum("n")).first()[0] or 0) * percent // 100
        if not draw:
            return scored.select("*", none)
        starts = pinned(higher(hist).where(F.col("above") < draw))
        kept.append(starts)
    cutoff = starts.agg(F.min("score")).first()[0]
    in_reach = F.coalesce(eligible & (F.col("score") >= cutoff), F.lit(False))
    own = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "n_words")
    placed = scored.where(in_reach).withColumn("place", F.row_number().over(own)).join(starts.select("score", "above"), "score")
    rank = F.col("above") + F.col("place")
    drawn = placed.select(*scored.columns, F.when(rank <= draw, rank).alias("rank"))
    return drawn.unionByName(scored.where(~in_reach).select("*", none))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int,
    buckets: int = 10_000,
    ngrams: tuple[int, int] = (1, 2),
    min_words: int = 0,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every row of docs;
    percent of the rows with min_words words or more have a rank."""
    gain = gains(counts(docs, buckets, ngrams, text_col), counts(target, buckets, ngrams, target_text_col))
    scored = pinned(score(docs, gain, ngrams=ngrams, seed=seed, id_col=id_col, text_col=text_col))
    return ranked(scored, F.col("n_words") >= min_words, percent).withColumnRenamed("id", id_col)
