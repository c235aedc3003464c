"""What explore's strategies find and how their findings are judged."""

import math

from gleaner import models
from gleaner.engine import Engine

LONG = "a passage that is long enough to be kept in a sample of chunks, and then some more words "


def chunk(i, path, vector):
    return {"id": i, "document_id": path, "corpus_id": "c", "doc_path": path, "position": 0, "text": LONG + i, "embedding": vector}


def asked(spark, root, mention=()):
    """The findings, and the pairs of texts the model was asked about: 10 chunks of one
    document have 45 similar pairs, closer than those with the one chunk of another."""
    prompts = []

    def answer(system, user):
        prompts.append([p.split()[-1] for p in user.split("\n--\n")])
        return '{"contradicts": true, "why": "so"}'

    engine = Engine(spark, str(root), completer=models.Scripted(answer))
    unit = lambda x, i: [math.sqrt(x), *(math.sqrt(1 - x) if k == i else 0.0 for k in range(12))]
    rows = [chunk(f"a{i}", "a.md", unit(0.8, i)) for i in range(10)] + [chunk("b", "b.md", [0.7 / math.sqrt(0.8), *[0.0] * 10, math.sqrt(1 - 0.6125), 0.0]), chunk("z", "z.md", [*[0.0] * 12, 1.0])]
    engine._put("chunk", rows)
    engine._put("mention", [{"id": f"{e}{c}", "chunk_id": c, "entity_id": e} for e, c in mention])
    return engine.candidates("contradiction", k=5), prompts


def test_pairs_of_one_document_take_no_place_among_contradictions(spark, tmp_path):
    found, prompts = asked(spark, tmp_path / "d")
    assert len(found) == 1 and "a.md and b.md" in found[0]["text"] and len(prompts) == 1


def test_pairs_of_one_entity_are_asked_first(spark, tmp_path):
    found, prompts = asked(spark, tmp_path / "d", [("e", "b"), ("e", "z")])
    assert prompts[0] == ["b", "z"] and found[0]["score"] == 0.85 and len(found) == 2


class Noting(models.OverlapReferee):
    def __init__(self):
        self.calls = []

    def evaluate(self, question, answer, evidence):
        self.calls.append((question, answer, evidence))
        return super().evaluate(question, answer, evidence)


def test_gaps_have_sources_and_are_judged_on_their_context(spark, tmp_path):
    def answer(system, user):
        return '{"verdict": "support", "confidence": 0.9}' if "back the claim" in system else '[{"gap": "words that are long", "score": 0.4}]'

    engine = Engine(spark, str(tmp_path / "d"), completer=models.Scripted(answer), referee=Noting())
    engine._put("chunk", [chunk(f"k{i}", f"{i}.md", [1.0, float(i)]) for i in range(8)])
    engine._put("entity", [{"id": e, "name": e.title(), "entity_type": "THING"} for e in ("passage", "x", "y", "z")])
    engine._put("mention", [{"id": f"m{i}", "chunk_id": f"k{i}", "entity_id": "passage"} for i in range(6)])
    engine._put("relation", [{"id": f"r{e}{t}", "source_id": e, "target_id": "passage", "type": t, "confidence": 0.5} for e in "xyz" for t in ("A", "B", "C")])
    found = engine.explore("", "gap", 4, ground=True)
    assert [f["sources"] for f in found][0] == ["k0", "k1", "k2", "k3", "k4"] and len(found[1]["sources"]) == 5
    assert all(f["score"] > 0 and f["grounding"] == "support" for f in found)
    assert {r.score for r in engine.rewards().collect()} == {f["score"] for f in found}
    question, _, evidence = engine.referee.calls[0]
    assert question == "gap" and evidence[:5] == [LONG + f"k{i}" for i in range(5)]
    assert evidence[5] == "Passage (THING)" and evidence[6].split("\n") == [f"Passage -[{t}]-> X" for t in "ABC"]
    # A finding that comes again isn't held against itself.
    assert engine.explore("", "gap", 1) and all(found[0]["text"] not in q for q, *_ in engine.referee.calls)


def test_links_between_findings_are_judged_on_the_findings(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "d"), referee=Noting())
    same = engine.embedder.embed(["Two findings meet: bridge and hub"])[0]
    engine._put("insight", [{"id": i, "corpus_id": "c", "text": f"text {i}", "strategy": s, "score": 0.5, "layer": n, "embedding": same} for i, s, n in (("p", "bridge", 1), ("q", "hub", 1), ("r", "meta", 2))])
    (found,) = engine.explore("", "meta", 2)
    assert found["sources"] == ["p", "q"] and found["score"] > 0
    assert engine.referee.calls == [("meta\nFound already: text r", found["text"], ["bridge: text p", "hub: text q"])]


def test_scores_of_hubs_do_not_depend_on_the_quota(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "d"))
    engine._put("chunk", [chunk(f"k{i}", f"{i}.md", [1.0, float(i)]) for i in range(8)])
    engine._put("entity", [{"id": e, "name": e, "entity_type": "THING"} for e in "ef"])
    engine._put("mention", [{"id": f"{e}{i}", "chunk_id": f"k{i}", "entity_id": e} for e, r in (("e", range(4)), ("f", range(5, 8))) for i in r])
    assert [round(f["score"], 6) for f in engine.candidates("hub", k=2, threshold=2.0)] == [round(1.5 * 4 / 7, 6)]
