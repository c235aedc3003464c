import pytest
from pyspark.sql import functions as F

from gleaner.functions import columns as C
from gleaner.models import HashEmbedder, OverlapReferee, parsed, scores_in
from gleaner.ontology import Kind, Ontology, generated, type_name
from gleaner.models import Scripted
from gleaner.operators import bandit, chunks, discover, search


def values(spark, rows, ddl, expr):
    return [r[0] for r in spark.createDataFrame(rows, ddl).coalesce(1).select(expr).collect()]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([3.0, 4.0, 9.0], [3.0, 4.0])]
    got = values(spark, rows, "a array<double>, b array<double>", C.cosine(F.col("a"), F.col("b")))
    # The product is over the shorter vector; each length is its own.
    assert got == pytest.approx([1, 0, -1, 0, 1, 25 / 5 / 106**0.5])


def test_path_distance(spark):
    rows = [("a/b/c.md", "a/b/c.md"), ("a/x.md", "b/y.md"), ("a/b/c.md", "a/b/d.md"), ("", ""), ("a", "a/b")]
    assert values(spark, rows, "a string, b string", C.path_distance(F.col("a"), F.col("b"))) == pytest.approx([0, 1, 1 / 3, 0, 0.5])


def test_noise(spark):
    noisy = ["docs/diffs/a.md", "x.json", "a/b.json", ".history/x", "node_modules/a/b.js", "dist/x", ".git/config"]
    kept = ["a/dist/x", "src/a.py", "docs/a.md", "README.md"]
    assert values(spark, [(p,) for p in noisy + kept], "p string", C.noisy(F.col("p"))) == [True] * 7 + [False] * 4


def test_type_names(spark):
    rows = [("works at",), ("a--b__c",), ("9lives",), ("_x_",), ("!!",), ("",), ("Ünï",)]
    assert values(spark, rows, "r string", C.type_name(F.col("r"))) == ["WORKS_AT", "A_B_C", "REL_9LIVES", "X", None, None, "N"]
    assert type_name("works-at") == "WORKS_AT"
    with pytest.raises(ValueError):
        type_name("?!")


def test_gap_rules(spark):
    rows = [("MODULE", 3, 1), ("PERSON", 3, 1), ("MODULE", 10, 1), ("MODULE", 20, 5), ("PRICING_ENGINE", 3, 1), (None, 3, 1)]
    assert values(spark, rows, "t string, i int, m int", C.gap_kept(F.col("t"), F.col("i"), F.col("m"))) == [False, True, True, False, False, True]


def test_json(spark):
    rows = [('{"a": 1}',), ('```json\n{"a": 2}\n```',), ('well: {"a": 3} so',), ("x [1, 2] y",), ("nothing",), ("",)]
    got = values(spark, rows, "t string", C.lenient_json(F.col("t")).cast("string"))
    assert got == ['{"a":1}', '{"a":2}', '{"a":3}', "[1,2]", None, None]
    assert parsed('```json\n{"a": 2}\n```') == {"a": 2} and parsed("no") is None
    assert scores_in('x {"novelty": 7} y') == {"novelty": 1.0, "relevance": 0.5, "actionability": 0.5}
    assert scores_in('"novelty": 0.25, broken')["novelty"] == 0.25


def test_small_ones(spark):
    assert values(spark, [("a_discovery",), ("b_detection",)], "s string", C.arm_name(F.col("s"))) == ["a", "b"]
    assert values(spark, [("a+b:c",)], "s string", C.escaped_query(F.col("s"))) == ["a\\+b\\:c"]
    assert values(spark, [(None,), (" ",), ("x",)], "s string", C.embedding_text(F.col("s"))) == [" ", " ", "x"]
    assert values(spark, [(429, None), (None, "timeout"), (404, None), (None, None)], "c int, k string", C.transient(F.col("c"), F.col("k"))) == [True, True, False, False]
    assert values(spark, [([1, 2, 3, 4],), ([1],), ([],)], "x array<int>", C.last_n(F.col("x"), 3)) == [[2, 3, 4], [1], []]
    ids = values(spark, [(" Al ",), ("al",)], "n string", C.entity_id(F.lit("c"), F.lit("T"), F.col("n")))
    assert ids[0] == ids[1] and len(ids[0]) == 20


def test_chunks(spark):
    sentence = "word " * 180 + "end. " + "x" * 200
    rows = [(1, 0, "h", ""), (1, 1, "h", " \n "), (1, 2, "h", "short"), (1, 3, "h", "y" * 3000), (2, 0, "g", sentence)]
    got = chunks.chunk(spark.createDataFrame(rows, "document_id long, section int, heading string, text string"), 1000, 200).orderBy("document_id", "position").collect()
    one = [r for r in got if r.document_id == 1]
    assert [r.position for r in one] == list(range(len(one))) and one[0].text == "short" and len(one) >= 4
    assert max(len(r.text) for r in got) <= 1000
    assert [r.text for r in got if r.document_id == 2][0].endswith("end.")
    with pytest.raises(ValueError):
        chunks.windows(F.lit(""), 100, 90)


def test_searches(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "cat cat dog"), (3, None), (4, "bird")], "id long, text string")
    got = search.bm25(docs, "cat CAT?").collect()
    assert [r.id for r in got] == [2, 1]
    c = lambda *rows: spark.createDataFrame(rows, "id string, score double")
    got = {r.id: (r.score, r.channel) for r in search.fuse({1: c(("a", 0.5), ("b", 0.9)), 2: c(("a", 0.7)), 3: c(("b", 0.5)), 4: c(("c", 0.0), ("a", 9.0)), 5: c(("a", 0.6), ("d", 0.2))}, seen=["x"]).collect()}
    assert got == {"a": (0.7, 2), "b": (0.55, 3), "c": (0.8, 4), "d": (0.2, 5)}


def test_spread_picks():
    items = [{"pair": p, "n": i} for i, p in enumerate("aaaabba")]
    assert [x["n"] for x in discover.spread_picks(items, 7)] == [0, 1, 4, 5, 6, 2, 3]
    assert [x["n"] for x in discover.spread_picks(items, 3)] == [0, 1, 4]


def test_bandits(spark):
    log = spark.createDataFrame([("bridge", 1.0, 1.0), ("bridge", 1.0, 1.0), ("hub", 1.5, 1.0), ("hub", -0.3, 1.0)], "arm string, score double, weight double")
    arms = spark.createDataFrame([("bridge",), ("hub",), ("gap",)], "arm string")
    got = {r.arm: r for r in bandit.posteriors(log, arms).collect()}
    assert (got["bridge"].alpha, got["hub"].alpha, got["hub"].beta, got["gap"].mean) == (3.0, 2.0, 2.0, 0.5)
    rows = [{"arm": "a", "alpha": 900.0, "beta": 1.0}, {"arm": "b", "alpha": 1.0, "beta": 900.0}]
    assert bandit.thompson(rows, seed=1) == "a" and bandit.thompson(rows, {"a"}, 1) == "b" and bandit.thompson(rows, {"a", "b"}, 1) == "a"
    ids = spark.createDataFrame([(k, "a", 0.5) for k in range(200)], "id long, arm string, score double")
    r = bandit.bernoulli(ids, 1).first()
    assert r.won + r.lost == 200 and 60 < r.won < 140 and bandit.bernoulli(ids, 1).first() == r


def test_models():
    e = HashEmbedder(64).embed(["the same words", "the same words", "others here", ""])
    assert e[0] == e[1] != e[2] and sum(x * x for x in e[0]) == pytest.approx(1) and e[3] == [0.0] * 64
    assert OverlapReferee().evaluate("q", "a b", ["a c"]) == 0.5 and OverlapReferee().evaluate("q", "", []) == 0.0
    o = Ontology("c", [Kind("A", 'say "x"', parent="B")], [Kind("R", domain="A", range="B")])
    assert Ontology.from_json(o.to_json()) == o and "rdfs:subClassOf :B" in o.to_turtle() and "R (A to B)" in o.instructions()
    made = generated("c", {"hub": [{"text": "t", "score": 0.5, "layer": 1}]}, Scripted(lambda s, u: 'ok {"classes": [{"name": "a b"}, {"name": "!"}, 3], "relations": [{"name": "r"}]}'))
    assert [c.name for c in made.classes] == ["A_B", "CONCEPT"] and made.relations[0].domain == "CONCEPT"
