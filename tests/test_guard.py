"""Read-only queries: what is let through, and what isn't."""

import pytest

from gleaner.engine import Engine
from gleaner.sources import guard

KNOWN = frozenset(["chunk", "insight"])


@pytest.mark.parametrize(
    "text, used",
    [
        ("SELECT 'Command' AS x, 'InsertInto' AS y", set()),
        ("SELECT * FROM chunk WHERE id <> :x", {"chunk"}),
        ("SELECT upper(text), count(*) FILTER (WHERE id > 'a') AS n FROM CHUNK GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC LIMIT 3 OFFSET 1", {"chunk"}),
        ("WITH a AS (SELECT id FROM chunk), b AS (SELECT * FROM a) SELECT * FROM b JOIN insight USING (id)", {"chunk", "insight"}),
        ("SELECT (SELECT max(id) FROM insight) AS m, EXISTS (SELECT 1 FROM chunk c WHERE c.id = o.id) AS e FROM insight o WHERE id IN (SELECT id FROM chunk)", {"chunk", "insight"}),
        ("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(x, y) UNION ALL SELECT position, id FROM chunk", {"chunk"}),
        ("SELECT id, row_number() OVER (PARTITION BY a ORDER BY id) AS r FROM chunk LATERAL VIEW explode(embedding) t AS a", {"chunk"}),
        ("SELECT transform(embedding, x -> x + 1) AS t, CASE WHEN id LIKE 'a%' THEN 1 END AS c, CAST(position AS string) AS p FROM chunk", {"chunk"}),
        ("SELECT * FROM chunk PIVOT (count(text) FOR heading IN ('a', 'b'))", {"chunk"}),
        ("SELECT * FROM chunk, LATERAL (SELECT id AS other FROM insight WHERE insight.id = chunk.id)", {"chunk", "insight"}),
        ("SELECT * FROM explode(array(1, 2))", set()),
    ],
)
def test_queries(spark, text, used):
    assert guard.tables_of(spark, text, KNOWN) == used


@pytest.mark.parametrize(
    "text",
    [
        "SELECT java_method('java.lang.System', 'setProperty', 'gleaner.probe', 'x')",
        "SELECT reflect('java.lang.System', 'exit', 1)",
        "SELECT try_reflect('java.lang.System', 'nanoTime')",
        "SELECT count(*) FROM text.`/etc/hostname`",
        "SELECT count(*) FROM parquet.`/tmp`",
        "SELECT id FROM chunk WHERE id IN (SELECT value FROM text.`/etc/hostname`)",
        "SELECT (SELECT java_method('java.lang.System', 'nanoTime')) AS x",
        "SELECT * FROM VALUES (java_method('java.lang.System', 'nanoTime')) AS t(x)",
        "WITH a AS (SELECT reflect('java.lang.System', 'nanoTime')) SELECT * FROM a",
        "SELECT sum(position) FILTER (WHERE java_method('java.lang.System', 'nanoTime') > '0') FROM chunk",
        "SELECT * FROM chunk ORDER BY java_method('java.lang.System', 'nanoTime')",
        "SELECT max(id) OVER (ORDER BY reflect('java.lang.System', 'nanoTime')) FROM chunk",
        "SELECT * FROM other",
        "SELECT * FROM default.chunk",
        # A name in a subquery's scope is none outside it.
        "SELECT * FROM other WHERE EXISTS (WITH other AS (SELECT 1) SELECT * FROM other)",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
        "SELECT * FROM IDENTIFIER('chunk')",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'nanoTime')",
        "SELECT TRANSFORM(id) USING 'cat' AS x FROM chunk",
        "SELECT * FROM range(10)",
        "SELECT system.builtin.upper('x')",
        "SELECT no_such_function(1)",
        "SELECT input_file_name() FROM chunk",
        "FROM chunk INSERT INTO chunk SELECT *",
        "DROP TABLE chunk",
        "CREATE TABLE x AS SELECT 1",
        "CREATE TEMPORARY VIEW x AS SELECT 1",
        "SET a = b",
        "EXPLAIN SELECT 1",
        "SHOW TABLES",
        "ADD JAR x",
        "CACHE TABLE chunk",
        "BEGIN SELECT 1; END",
    ],
)
def test_refused(spark, text):
    with pytest.raises(PermissionError):
        guard.tables_of(spark, text, KNOWN)
    assert spark.sparkContext._jvm.java.lang.System.getProperty("gleaner.probe") is None


def test_a_function_of_the_session_is_refused(spark):
    spark.udf.register("gleaner_own", lambda x: x)
    with pytest.raises(PermissionError):
        guard.tables_of(spark, "SELECT gleaner_own(id) FROM chunk", KNOWN)


def test_the_engines_tool(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    assert engine.sql("SELECT 'Command' AS x") == [{"x": "Command"}]
    assert engine.sql("SELECT count(*) AS n FROM chunk WHERE id <> :x", x="a'b") == [{"n": 0}]
    for bad in ("SELECT java_method('java.lang.System', 'nanoTime')", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM reward"):
        with pytest.raises(PermissionError):
            engine.sql(bad)
