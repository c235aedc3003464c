"""How rows of the synthetic tables are dealt."""

from gleaner.operators import graph
from gleaner.plans import tables


def test_names_are_made_after_rows_are_dealt(spark, small_dir):
    plan = tables.extractions(spark, small_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and plan.count("quote ") == 1


def test_tasks_grow_with_the_table(spark, small_dir, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    n = -(-tables.table(spark, small_dir, "lineitem").count() // 100)
    assert tables.parts(spark, small_dir) == n > 8
    mentions = tables.mentions(spark, small_dir)
    plan = graph.chunks_of(mentions, mentions.select("entity").withColumnRenamed("entity", "id"), n)._jdf.queryExecution().executedPlan().toString()
    assert f", {n}), REPARTITION_BY_NUM" in plan
