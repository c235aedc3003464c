"""Operators that run in one driver at the same time."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from gleaner.llm import queries
from gleaner.llm._common import setting


def test_two_queries_in_two_threads(spark, small_dir):
    names = ["op5_exact_dedup", "op7_minhash_near_dedup", "op11_importance_resampling", "op12_conversation_repair"]
    run = lambda n: sorted(map(str, queries.queries()[n](spark, small_dir).collect()))
    alone = {n: run(n) for n in names}
    with ThreadPoolExecutor(len(names)) as pool:
        assert dict(zip(names, pool.map(run, names))) == alone


def test_a_setting_comes_back_with_the_last_thread(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    inside, first_left = Barrier(2), Barrier(2)

    def one(value, first):
        with setting(spark, name, value):
            inside.wait(60)
            if not first:
                first_left.wait(60)
                held = spark.conf.get(name)
        if first:
            first_left.wait(60)
            return None
        return held

    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(one, "111", True), pool.submit(one, "222", False)]
        assert [j.result(60) for j in jobs] == [None, "222"]
    assert spark.conf.get(name) == before
    with setting(spark, name, 5):
        with setting(spark, name, 6):
            assert spark.conf.get(name) == "6"
        assert spark.conf.get(name) == "5"
    assert spark.conf.get(name) == before
