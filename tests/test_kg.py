import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import kg

DDL = "document string, chunk_ord int, chunk_id string, entities array<struct<name: string, type: string, description: string, aliases: array<string>>>, relations array<struct<source: string, target: string, type: string, evidence: string, confidence: double>>"
TYPES, RELS = ["PERSON", "COMPANY", "CONCEPT", "PLACE"], ["WORKS_AT", "FOUNDED", "LOCATED_IN", "KNOWS"]


def ent(name, kind="PERSON", text="", aliases=()):
    return (name, kind, text, list(aliases))


def rel(a, b, kind="KNOWS", quote="q", sure=0.5):
    return (a, b, kind, quote, sure)


def fold(spark, *chunks):
    x = spark.createDataFrame([("d", i, c[2] if len(c) > 2 else f"ch{i}", list(c[0]), list(c[1])) for i, c in enumerate(chunks)], DDL).repartition(3)
    rows = kg.entity_rows(x, "c1", TYPES)
    return kg.entities(rows, "c1").collect(), kg.mentions(rows).collect(), kg.relations(x, rows, RELS).collect()


def test_entities(spark):
    e, m, _ = fold(spark, ([ent("Al", text="abc", aliases=["A"])], []), ([ent("AL ", text="abcdef", aliases=["B", "A"])], []), ([ent("al", text="abcd")], []))
    assert len(e) == 1 and len(m) == 3
    assert (e[0].name, e[0].description, e[0].aliases) == ("Al", "abcdef", ["A", "B"])


def test_types(spark):
    e, m, _ = fold(spark, ([ent("X"), ent("X", "COMPANY"), ent("Y", "ALIEN"), ent(None), ent(" "), ent("X")], []))
    assert sorted((r.name, r.entity_type) for r in e) == [("X", "COMPANY"), ("X", "PERSON"), ("Y", "CONCEPT")] and len(m) == 3


def test_relations_fold(spark):
    two = [ent("A"), ent("B")]
    _, _, r = fold(spark, (two, [rel("A", "B", quote="one", sure=0.6)]), (two, [rel("a", "b", quote="two", sure=5.0), rel("A", "B", quote="one")]), (two, [rel("A", "C"), rel("A", "B", "HATES")]))
    assert len(r) == 1
    assert (r[0].source_chunks, r[0].confidence, r[0].evidence) == (["ch0", "ch1"], 1.0, "one || two")


def test_evidence_is_cut_at_every_step(spark):
    two = [ent("A"), ent("B")]
    _, _, r = fold(spark, (two, [rel("A", "B", quote="x" * 400)]), (two, [rel("A", "B", quote="y" * 200)]), (two, [rel("A", "B", quote="y" * 200)]))
    assert len(r[0].evidence) == 500 and r[0].evidence.startswith("x" * 400 + " || y")


def test_alias_in_the_chunk(spark):
    e, _, r = fold(spark, ([ent("Robert", aliases=["Bob"]), ent("Ann")], [rel("Bob", "Ann")]))
    ids = {x.name: x.id for x in e}
    assert (r[0].source_id, r[0].target_id) == (ids["Robert"], ids["Ann"])


def test_scope_grows_with_the_chunks(spark):
    first = ([ent("Robert"), ent("Ann")], [rel("Bob", "Ann")])
    later = ([ent("Robert", aliases=["Bob"])], [])
    _, _, r = fold(spark, first, later)
    assert len(r) == 1  # by the document's only Bob
    x = ([ent("Robert", aliases=["Bob"]), ent("Roberta", aliases=["Bob"])], [])
    e, _, r = fold(spark, x, ([ent("Robert"), ent("Ann")], [rel("Bob", "Ann")]))
    ids = {q.name: q.id for q in e}
    assert r[0].source_id == ids["Robert"]  # the alias of an earlier chunk


def test_ambiguous_alias(spark):
    bobs = ([ent("Robert", aliases=["Bob"])], []), ([ent("Roberta", aliases=["Bob"])], [])
    _, _, r = fold(spark, *bobs, ([ent("Ann"), ent("Eve")], [rel("Bob", "Ann")]))
    assert r == []
    with_ann = ([ent("Robert", aliases=["Bob"]), ent("Ann")], [])
    e, _, r = fold(spark, with_ann, bobs[1], ([ent("Ann"), ent("Eve")], [rel("Bob", "Eve")]))
    ids = {q.name: q.id for q in e}
    assert [x.source_id for x in r] == [ids["Robert"]]


def test_last_claim_wins_and_repeated_chunk_ids(spark):
    e, _, r = fold(spark, ([ent("X", aliases=["Z"]), ent("Y", aliases=["Z"])], [rel("Z", "X")]))
    ids = {q.name: q.id for q in e}
    assert r[0].source_id == ids["Y"]
    _, m, _ = fold(spark, ([ent("X")], [], "same"), ([ent("X")], [], "same"))
    assert len(m) == 1


def resolved(chunks):
    """(chunk, name, entity) by going through a document's chunks in order."""
    known, scope, of = {}, [], {}
    for at, (entities, _) in enumerate(chunks):
        own = {}
        for name, kind, _, aliases in entities:
            key = (kind, name.lower())
            held = known.setdefault(key, [name])
            held += [a for a in aliases if a not in held]
            of.setdefault(key, set()).add(at)
            for n in held:
                own[n] = own[n.lower()] = key
        scope.append(own)
    out = set()
    for at, (_, relations) in enumerate(chunks):
        for name in {n for r in relations for n in r[:2]}:
            found = scope[at].get(name) or scope[at].get(name.lower())
            if not found:
                cands = [k for k, held in known.items() if name.lower() in {n.lower() for n in held}]
                near = set(scope[at].values())
                score = {c: sum(len(of[c] & of[n]) for n in near - {c}) for c in cands}
                best = [c for c in cands if score[c] and score[c] == max(score.values())]
                found = cands[0] if len(cands) == 1 else best
            out.add((f"ch{at}", name, tuple(sorted(found)) if isinstance(found, list) else (found,)))
    return out


def test_names_go_as_if_chunk_by_chunk(spark):
    rng = random.Random(2)
    words = ["Al", "al", "Bo", "BO", "Cy", "Di", "Ed", "ed"]
    for _ in range(8):
        chunks = [([ent(rng.choice(words), rng.choice(TYPES[:2]), aliases=rng.sample(words, rng.randrange(3))) for _ in range(rng.randrange(4))], [rel(rng.choice(words), rng.choice(words)) for _ in range(3)]) for _ in range(7)]
        x = spark.createDataFrame([("d", i, f"ch{i}", e, r) for i, (e, r) in enumerate(chunks)], DDL)
        rows = kg.entity_rows(x, "c1", TYPES)
        keys = {r.entity_id: (r.type, r.name.lower()) for r in rows.collect()}
        names = x.select("document", "chunk_id", F.explode("relations").alias("r"))
        names = names.select("document", "chunk_id", F.col("r.source").alias("name")).unionByName(names.select("document", "chunk_id", F.col("r.target").alias("name")))
        got = {(r.chunk_id, r.name): keys[r.entity_id] for r in kg.resolve(names, rows).collect()}
        for chunk, name, ways in resolved(chunks):
            ways = [w for w in ways if w]
            assert got.get((chunk, name)) in ways if ways else (chunk, name) not in got, (chunk, name, ways)
        claims = {(got[f"ch{i}", a], got[f"ch{i}", b]) for i, (_, r) in enumerate(chunks) for a, b, *_ in r if (f"ch{i}", a) in got and (f"ch{i}", b) in got}
        assert {(keys[r.source_id], keys[r.target_id]) for r in kg.relations(x, rows, RELS).collect()} == claims


@pytest.mark.parametrize("bad", [rel(None, "A"), rel("A", " "), rel("A", "A", "?")])
def test_bad_relations(spark, bad):
    assert fold(spark, ([ent("A")], [bad]))[2] == []


def test_chunks_with_their_entities_fold_alike(spark):
    rng = random.Random(5)
    words = ["Al", "al", "Bo", "BO", "Cy", "Di", "Ed", "ed"]
    chunks = [(f"d{rng.randrange(3)}", rng.randrange(12), f"ch{rng.randrange(9)}", [ent(rng.choice(words), rng.choice(TYPES[:2]), aliases=rng.sample(words, rng.randrange(3))) for _ in range(rng.randrange(4))] or None, [rel(rng.choice(words), rng.choice(words), quote=f"q{i}") for _ in range(rng.randrange(3))] or None) for i in range(90)]
    x = spark.createDataFrame(chunks, DDL).dropDuplicates(["document", "chunk_ord", "chunk_id"]).localCheckpoint()
    rows = kg.entity_rows(x, "c1", TYPES)
    kept = lambda df: sorted((r.document, r.source_id, r.type, r.target_id, sorted(set(r.source_chunks)), r.confidence) for r in df.collect())
    got, need = kept(kg.relations(kg.with_entities(x, "c1", TYPES), rows, RELS)), kept(kg.relations(x, rows, RELS))
    assert got == need and got


def test_extractions_that_are_dealt_by_document_are_not_moved_again(spark, small_dir, monkeypatch):
    from gleaner.plans import queries

    written = []
    pinned = kg.pinned
    for module in (kg, queries):
        monkeypatch.setattr(module, "pinned", lambda df: written.append(df) or pinned(df))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (queries.relation_fold(spark, small_dir), *written)]
    assert len(written) == 1
    assert sum(plan.count("Exchange hashpartitioning(document") for plan in plans) == 2
