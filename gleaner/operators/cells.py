"""Coarse cells of vectors by direction, and what their angles rule out.

Cells are k-means clusters by cosine, trained on a bounded sample.  A cell has a
centre and a radius (the largest angle of its vectors to the centre), so angles
between a vector and all of a cell, or between two cells, are bounded from below
by the triangle inequality: what can't come near enough is never compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot
from ..sources.staging import package_on_workers

#: Rows that cells are trained on, at most about so many.
SAMPLE = 50_000
#: The cell of vectors without a direction.
NOWHERE = -1
#: Angles are taken this much wider than they are, for rounding.
SLACK = 1e-6


def units(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def centres(rows: DataFrame, k: int, n: int, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """At most k centres [cells, dimensions] of n rows (id, embedding)."""
    of = max(1, n // sample)
    e = F.col("embedding").cast("array<double>")
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(of)) == 0).select(e.alias("e")).where(dot(F.col("e"), F.col("e")) > 0)
    vectors = some.select(array_to_vector("e").alias("features"))
    if vectors.isEmpty():
        return np.zeros((0, 1))
    model = KMeans(k=max(2, k), seed=1, maxIter=rounds, distanceMeasure="cosine").fit(vectors)
    return units(np.array(model.clusterCenters()))


def placed(rows: DataFrame, middle: np.ndarray) -> DataFrame:
    """rows (embedding) with cell and angle (to its centre)."""
    package_on_workers(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(middle)

    @F.pandas_udf("cell int, angle double")
    def nearest(embeddings: pd.Series) -> pd.DataFrame:
        if not len(embeddings):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "angle": pd.Series(dtype="float64")})
        x = units(np.stack(embeddings).astype(np.float64))
        if not len(sent.value):
            return pd.DataFrame({"cell": np.full(len(x), NOWHERE, np.int32), "angle": 0.0})
        sims = x @ sent.value.T
        cell = sims.argmax(1)
        angle = np.arccos(np.clip(sims[np.arange(len(x)), cell], -1, 1)) + SLACK
        return pd.DataFrame({"cell": np.where(x.any(1), cell, NOWHERE).astype(np.int32), "angle": angle})

    at: Column = nearest("embedding")
    return rows.withColumn("at", at).select(*rows.columns, "at.cell", "at.angle")


def highest(query: np.ndarray, middle: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cell the highest cosine that one of its vectors can have."""
    norm = np.linalg.norm(query)
    angle = np.arccos(np.clip(middle @ (query / norm if norm else query), -1, 1))
    return np.cos(np.maximum(0.0, angle - radius - SLACK)) if norm else np.zeros(len(middle))


def meeting(middle: np.ndarray, radius: np.ndarray, threshold: float) -> np.ndarray:
    """For each two cells whether vectors of theirs can have this cosine."""
    angle = np.arccos(np.clip(middle @ middle.T, -1, 1))
    return angle - radius[:, None] - radius[None, :] - SLACK <= np.arccos(np.clip(threshold - SLACK, -1, 1))
