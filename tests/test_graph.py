"""Trees of any depth."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import graph


def test_trees_may_be_deep_but_have_no_cycles(spark):
    n = 150
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = {(r.node, r.ancestor, r.hops) for r in graph.ancestors(chain).collect()}
    assert got == {(x, y, x - y) for x in range(n) for y in range(x + 1)}
    scores = spark.range(n).select("id", F.col("id").cast("double").alias("score"))
    assert {r.id: r.visits for r in graph.rollup(chain, scores).collect()} == {x: n - x for x in range(n)}
    assert [r.id for r in graph.best_path(chain, scores).orderBy("step").collect()] == list(range(n))
    with pytest.raises(ValueError, match="cycle"):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, parent long"))
