import io
import json

import pytest
from pyspark.sql import functions as F

from gleaner import actions, models
from gleaner.__main__ import parser, run, serve
from gleaner.engine import Engine
from gleaner.ontology import Kind, Ontology
from gleaner.settings import Settings
from gleaner.sources import bulk, files, store
from gleaner.streaming import rewards

TEXTS = {"a/one.md": "# Ann\nAnn works at Acme and likes green tea a lot, in the old town by the river, every day.\n## Tea\nGreen tea comes from the hills of the old town and Acme sells it in every shop of the land.", "b/two.txt": "Acme sells green tea in every shop of the land and Ann works at Acme by the river every day.\n\nAnother paragraph on tea, long enough to be kept as a chunk of its own in this small corpus.", "c/three.json": '{"Zed": {"b": 1, "a": "ü"}, "Alpha": "text of some length on tea"}', "d/four.json": '[{"title": "T", "x": 1}, {"id": 7}, "plain", {"name": "N"}]', "e/bad.json": "{nope", ".hidden.md": "x", "f/x.bin": "x", "g/empty.md": "", ".git/h.md": "x"}


def respond(system, user):
    if "entity types" in system:
        has = [n for n in ("Ann", "Acme") if n in user]
        return json.dumps({"entities": [{"name": n, "type": "PERSON" if n == "Ann" else "COMPANY", "description": f"{n} here", "aliases": []} for n in has], "relations": [{"source": "Ann", "target": "Acme", "type": "works at", "evidence": "says so", "confidence": 0.9}] if len(has) == 2 else []})
    if "ontology" in system:
        return '{"classes": [{"name": "person"}, {"name": "company"}], "relations": [{"name": "works at"}]}'
    if "contradict each other" in system:
        return '{"contradicts": true, "why": "they do"}'
    if "back the claim" in system:
        return '{"verdict": "contradict", "confidence": 0.9}'
    if "Merge" in system:
        return '{"description": "merged", "aliases": ["m"]}'
    if "search queries" in system:
        return '["tea", "Acme"]'
    return "Ann works at Acme"


class Pleased(models.Referee):
    def evaluate(self, question, answer, evidence):
        return 0.9 if answer and evidence else 0.4


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in TEXTS.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return root


def test_readers(spark, corpus):
    found = files.sections(files.scan(spark, str(corpus)), "c")
    got = {}
    for r in found.orderBy("path", "section").collect():
        got.setdefault(r.path.lstrip("/"), []).append((r.heading, r.text))
    assert [h for h, _ in got["a/one.md"]] == ["Ann", "Tea"]
    assert len(got["b/two.txt"]) == 2 and got["b/two.txt"][0][0] == "two"
    assert got["c/three.json"][0] == ("Zed", '{\n  "b": 1,\n  "a": "ü"\n}') and got["c/three.json"][1][0] == "Alpha"
    assert [h for h, _ in got["d/four.json"]] == ["T", "7", "item_2", "N"]
    assert got["e/bad.json"] == [("bad", "{nope")]
    one = spark.createDataFrame([("s", "")], "stem string, text string")
    assert one.select(files.markdown(F.col("stem"), F.col("text"))).first()[0] == [("s", "")]
    assert not any(".git" in p or "hidden" in p or "x.bin" in p for p in got)


def test_life_cycle(spark, corpus, tmp_path):
    engine = Engine(spark, str(tmp_path / "data"), completer=models.Scripted(respond), referee=Pleased())
    first = engine.ingest(str(corpus), "demo")
    assert first["documents"] == 5 and engine.ingest(str(corpus), "demo")["documents"] == 0
    assert engine.resolve_corpus("demo") == engine.resolve_corpus(engine.resolve_corpus("demo"))
    with pytest.raises(ValueError):
        engine.resolve_corpus("none")
    cid = engine.resolve_corpus("demo")
    onto = engine.ontology(cid)
    assert {c.name for c in onto.classes} == {"PERSON", "COMPANY", "CONCEPT"}
    done = engine.extract(cid, onto)
    assert (done["entities"], done["relations"], done["errors"]) == (2, 1, 0)
    assert engine.extract(cid, onto)["chunks"] == 0
    assert engine.synthesize(cid)["synthesized"] == 2 and engine.synthesize(cid)["dirty_total"] == 0
    assert {r.description for r in engine.read("entity").collect()} == {"merged"}
    bridges = engine.explore("demo", "bridge", 3, threshold=0.2, output=str(tmp_path / "out"))
    assert bridges and spark.read.text(str(tmp_path / "out/insights")).count() == len(bridges)
    assert engine.explore("demo", "hub", 2, threshold=0.1) is not None
    assert engine.explore("demo", "contradiction", 2, threshold=0.1)
    assert engine.explore("demo", "bridge", 3, ground=True, threshold=0.2, persist=False) == []
    assert engine.rate(bridges[0]["id"], 7.0) == "bridge" and engine.rate("nobody", 1.0) is None
    means = {r["arm"]: r for r in engine.posteriors(cid)}
    assert means["bridge"]["observations"] >= 3 and means["gap"]["observations"] == 0
    assert engine.search("green tea", 2)[0]["score"] > 0 and engine.fulltext("tea", 2)
    assert engine.entity_search("Ann", 1)[0]["name"] == "Ann"
    assert [n["other_name"] for n in engine.entity_graph("Ann")["neighbors"]] == ["Acme"]
    assert "error" in engine.entity_graph("qqqq")
    got = engine.answer("Where does Ann work?", iterations=4, depth=3, feedback=True)
    assert got["answer"] and got["best_score"] > 0 and engine.trees(got["tree_id"])[0]["parent_id"] is None
    assert len(engine.trees()) == 1
    assert engine.sql("SELECT count(*) AS n FROM chunk WHERE id <> :x", x="a'b")[0]["n"] == first["chunks"]
    for bad in ("DROP TABLE chunk", "CREATE TABLE x AS SELECT 1", "SET a = b", "INSERT INTO chunk SELECT * FROM chunk"):
        with pytest.raises(PermissionError):
            engine.sql(bad)
    stats = engine.stats()
    assert stats["corpora"] == 1 and stats["entities"] == 2 and stats["insights_l1"] >= 1
    assert engine.reembed("insight") == 0 and engine.reembed("chunk", missing_only=False) == first["chunks"]
    out = io.StringIO()
    serve(engine, ['{"tool": "stats"}', '{"tool": "nope"}', "bad", '{"tool": "get_insights", "args": {"limit": 1}}'], out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert replies[0]["result"] == stats and "error" in replies[1] and "error" in replies[2] and len(replies[3]["result"]) == 1
    assert run(engine, parser().parse_args(["stats"])) == stats


def test_failures_are_tried_again_or_marked(spark, corpus, tmp_path):
    def flaky(system, user):
        if "Green tea" in user:
            raise TimeoutError
        if "paragraph" in user:
            raise RuntimeError("bad")
        return respond(system, user)

    engine = Engine(spark, str(tmp_path / "data"), completer=models.Scripted(flaky))
    engine.ingest(str(corpus), "demo")
    onto = Ontology("x", [Kind("PERSON"), Kind("COMPANY"), Kind("CONCEPT")], [Kind("WORKS_AT")])
    done = engine.extract(engine.resolve_corpus("demo"), onto)
    assert done["again"] == 1 and done["errors"] == 1
    assert engine.extract(engine.resolve_corpus("demo"), onto)["chunks"] == 1
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "data")).extract("x", onto)


class Refused(Exception):
    def __init__(self, status):
        self.response = type("Response", (), {"status_code": status})()


def test_a_refusal_for_now_leaves_a_chunk_pending(spark, corpus, tmp_path):
    """Every call is counted in a file, since workers make it."""

    def busy(system, user, log=str(tmp_path / "calls")):
        status = 429 if "Green tea" in user else 401 if "paragraph" in user else None
        with open(log, "a") as f:
            f.write(f"{status}\n")
        if status:
            raise Refused(status)
        return respond(system, user)

    engine = Engine(spark, str(tmp_path / "data"), completer=models.Scripted(busy), settings=Settings(wait=0.0))
    chunks = engine.ingest(str(corpus), "demo")["chunks"]
    onto = Ontology("x", [Kind("PERSON"), Kind("COMPANY"), Kind("CONCEPT")], [Kind("WORKS_AT")])
    cid = engine.resolve_corpus("demo")
    done = engine.extract(cid, onto)
    calls = (tmp_path / "calls").read_text().split()
    assert (done["chunks"], done["again"], done["errors"]) == (chunks, 1, 1)
    assert calls.count("429") == 3 and calls.count("401") == 1
    pending = engine.read("chunk").join(engine.read("extraction_done"), "id", "left_anti").collect()
    assert len(pending) == 1 and "Green tea" in pending[0].text
    # The refusal has passed: the chunk that was left is worked on.
    again = Engine(spark, str(tmp_path / "data"), completer=models.Scripted(respond)).extract(cid, onto)
    assert (again["chunks"], again["again"], again["errors"]) == (1, 0, 0)


def test_failures_are_told_apart():
    import urllib.error

    class ReadTimeout(Exception):
        pass

    class ConnectError(Exception):
        pass

    class ReadError(Exception):
        pass

    passing = [Refused(s) for s in (429, 500, 502, 503, 504)] + [TimeoutError(), ConnectionRefusedError(), ReadTimeout(), ConnectError(), ReadError(), models.Transient(), urllib.error.URLError(TimeoutError()), urllib.error.HTTPError("u", 503, "m", None, None)]
    lasting = [Refused(s) for s in (400, 401, 404)] + [ValueError(), KeyError("x"), urllib.error.HTTPError("u", 404, "m", None, None)]
    assert all(models.passing(e) for e in passing) and not any(models.passing(e) for e in lasting)
    calls = []

    def fails(e, times):
        calls.append(e)
        if len(calls) <= times:
            raise e
        return "got"

    assert models.tried(lambda: fails(TimeoutError(), 2), wait=0) == "got" and len(calls) == 3
    for e, n in ((TimeoutError(), 3), (ValueError(), 1)):
        calls.clear()
        with pytest.raises(type(e)):
            models.tried(lambda e=e: fails(e, 9), wait=0)
        assert len(calls) == n


def test_paced_embedder():
    sizes = []

    class Service:
        def embed(self, texts):
            sizes.append(len(texts))
            if len(sizes) == 2:
                raise Refused(429)
            return [[float(len(t))] for t in texts]

    texts = ["x" * k for k in range(45)]
    assert models.Paced(Service(), pause=0.0).embed(texts) == [[float(k)] for k in range(45)] and sizes == [20, 20, 20, 5]
    assert models.Paced(Service(), pause=0.0).embed([]) == []


def test_changed_files_lose_old_chunks(spark, tmp_path):
    root = tmp_path / "c"
    root.mkdir()
    (root / "x.txt").write_text("one\n\ntwo\n\nthree")
    engine = Engine(spark, str(tmp_path / "data"))
    assert engine.ingest(str(root), "n")["chunks"] == 3
    (root / "x.txt").write_text("only one")
    assert engine.ingest(str(root), "n") == {"documents": 1, "chunks": 1}


def test_merges_repeat(spark):
    old = spark.createDataFrame([("1", "n", "long text", ["a"])], "id string, name string, description string, aliases array<string>")
    new = spark.createDataFrame([("1", "m", "short", ["b", "a"]), ("2", "k", None, [])], old.schema)
    once = store.merge_entities(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.merge_entities(once, new).collect())) == [("1", "n", "long text", ["a", "b"]), ("2", "k", None, [])]
    with pytest.raises(ValueError):
        store.require(new.withColumn("p", F.lit("zz")), "p", old)


def test_merges_keep_lists_where_new_ones_are_null(spark):
    entity = "id string, name string, description string, aliases array<string>"
    old = spark.createDataFrame([("1", "n", "d", ["a", "b"]), ("2", "n", "d", None), ("3", "n", "d", None)], entity)
    new = spark.createDataFrame([("1", "n", "d", None), ("2", "n", "d", ["c", None]), ("3", "n", "d", None)], entity)
    assert {r.id: r.aliases for r in store.merge_entities(old, new).collect()} == {"1": ["a", "b"], "2": ["c", None], "3": []}
    relation = "id string, source_id string, target_id string, type string, confidence double, source_chunks array<string>"
    old = spark.createDataFrame([("1", "1", "2", "T", 0.5, ["x"])], relation)
    new = spark.createDataFrame([("1", "1", "2", "T", 0.7, None), ("2", "1", "nobody", "T", 0.7, None)], relation)
    assert [(r.id, r.confidence, r.source_chunks) for r in store.merge_relations(old, new, spark.createDataFrame([("1",), ("2",)], "id string")).collect()] == [("1", 0.7, ["x"])]


def test_two_writers_of_one_version(spark, tmp_path):
    first, second = store.Table(spark, str(tmp_path / "t")), store.Table(spark, str(tmp_path / "t"))
    first.write(spark.range(3))
    second.version = lambda: 0  # it began before the first was done
    with pytest.raises(RuntimeError):
        second.write(spark.range(9))
    assert first.read().count() == 3 and first.write(spark.range(4)) == 2
    (tmp_path / "t" / "CURRENT.3").write_text("")  # a writer that died at the last step
    assert first.read().count() == 4 and first.write(spark.range(5)) == 4 and first.read().count() == 5


def test_parents_are_checked(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "d"), referee=Pleased())
    engine._put("chunk", [{"id": "k1", "document_id": "d", "corpus_id": "c", "doc_path": "a.md", "position": 0, "text": "t" * 90, "embedding": [1.0]}])
    engine.candidates = lambda *a, **k: [{"score": 0.5, "text": "a finding", "sources": ["k1", "gone"]}]
    engine.explore("", "hub")
    assert [r.source for r in engine.read("insight_source").collect()] == ["k1"]
    with pytest.raises(ValueError):
        store.require(engine._rows("document", [{"id": "d", "corpus_id": "nowhere"}]), "corpus_id", engine.read("corpus"))


def test_settings(spark, tmp_path):
    found = Settings.from_env({"GLEANER_DISABLED_STRATEGIES": "gap, meta,", "GLEANER_GROUNDING": "Yes", "GLEANER_SYNTHESIS_BUDGET": "7", "GLEANER_WAIT": "0.5", "GLEANER_DOMAIN": "Tea."})
    assert (found.disabled_strategies, found.grounding, found.synthesis_budget, found.wait) == (("gap", "meta"), True, 7, 0.5)
    assert found.told("Do.") == "Tea.\n\nDo." and Settings().told("Do.") == "Do." and Settings.from_env({}) == Settings()
    rest = ("bridge", "outlier", "hub", "meta", "contradiction")
    engine = Engine(spark, str(tmp_path / "d"), settings=Settings(disabled_strategies=rest))
    picked = []
    engine.candidates = lambda arm, *a, **k: picked.append(arm) or []
    for seed in range(5):
        engine.explore(seed=seed)
    assert picked == ["gap"] * 5


def test_bandit_snapshot(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "d"))
    means = lambda e, **k: {r["arm"]: (r["alpha"], r["beta"]) for r in e.posteriors("c", **k)}
    reward = lambda arm, score, **k: {"corpus": "c", "mode": "insight", "arm": arm, "score": score, "insight_id": "i", **k}
    engine.log([reward("hub_discovery", 0.75), reward("gap", 2.0, mode="dropped_grounding")])
    assert means(engine)["hub"] == (1.75, 1.25) and means(engine)["gap"] == (1, 1)
    engine.log([reward("hub", 0.5), reward("gap", 1.0, weight=3.0), reward("hub", 1.0, corpus="other")])
    assert means(engine)["hub"] == (2.25, 1.75) and means(engine)["gap"] == (4, 1) and means(engine) == means(engine, replay=True)
    (held,) = (tmp_path / "d" / "state" / "c").glob("rewards.snapshot*.json")
    # What the snapshot says goes, as long as it can be read and is of this version and mode.
    state = json.loads(held.read_text())
    held.with_name(f".{held.name}.crc").unlink()
    held.write_text(json.dumps(state | {"arms": {"hub": [9, 1]}}))
    assert means(engine)["hub"] == (9, 1)
    for bad in ("{broken", json.dumps(state | {"version": 2}), json.dumps(state | {"arms": 5})):
        held.with_name(f".{held.name}.crc").unlink(missing_ok=True)
        held.write_text(bad)
        assert means(engine)["hub"] == (2.25, 1.75)
    drawn = Engine(spark, str(tmp_path / "d"), settings=Settings(bandit_mode="bernoulli"))
    a, b = means(drawn)["hub"]
    assert a + b == 4 and a == int(a) and means(drawn) == means(drawn, replay=True)
    # An explicit log takes the rewards of all corpora.
    own = Engine(spark, str(tmp_path / "d"), reward_log=str(tmp_path / "log"))
    own.log([reward("hub", 1.0), reward("hub", 1.0, corpus="other")])
    assert means(own)["hub"] == (2, 1) and own.posteriors("other")[2]["alpha"] == 2.0


def test_reembedding_by_corpus_and_in_bulk(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "d"))
    engine._put("corpus", [{"id": "c", "name": "one"}, {"id": "e", "name": "two"}])
    engine._put("chunk", [{"id": f"{c}{k}", "corpus_id": c, "doc_path": "p", "position": k, "text": f"text {c} {k}", "embedding": [0.5] if k else None} for c in "ce" for k in range(2)])
    engine._put("insight", [{"id": f"i{k}", "corpus_id": c, "text": "t", "strategy": "hub", "layer": n} for k, (c, n) in enumerate((("c", 1), ("e", None), (None, 2), ("", None)))])
    engine._put("entity", [{"id": "x", "corpus_id": "c", "name": "X", "entity_type": "T"}, {"id": "y", "corpus_id": "e", "name": "Y", "entity_type": "T"}])
    vectors = lambda name: {r.id: r.embedding for r in engine.read(name).collect()}
    said = run(engine, parser().parse_args(["re-embed", "--corpus", "one", "--force"]))
    assert said == {"chunk": 2} and len(vectors("chunk")["c1"]) == 768 and vectors("chunk")["e1"] == [0.5] and vectors("chunk")["e0"] is None
    said = run(engine, parser().parse_args(["re-embed", "--corpus", "two", "--include-entities"]))
    assert said == {"chunk": 1, "entity": 1} and vectors("chunk")["e1"] == [0.5] and vectors("entity")["x"] is None
    one = {n: vectors(n) for n in ("chunk", "entity")}
    said = run(engine, parser().parse_args(["re-embed", "--corpus", "one", "--include-insights", "--include-entities", "--batch-api", "--poll", "0"]))
    assert said == {"chunk": 2, "insight": 3, "entity": 1}
    assert vectors("chunk") == one["chunk"] and vectors("entity")["x"] and vectors("insight")["i1"] is None and vectors("insight")["i3"]
    assert [r.id for r in engine.texts_to_embed("insight").collect()] == ["i1"]
    assert run(engine, parser().parse_args(["embed-insights"])) == {"layers": 2, "embedded": 1}
    assert {r.id: r.layer for r in engine.read("insight").collect()} == {"i0": 1, "i1": 1, "i2": 2, "i3": 1}

    class Failing(bulk.LocalBulk):
        states = ["queued", "running", "failed"]

        def state(self, job):
            return self.states.pop(0)

    with pytest.raises(RuntimeError):
        engine.reembed_in_bulk(["chunk"], service=Failing(spark, engine.embedder), poll=0)
    lines = spark.createDataFrame([(x,) for x in ('{"key": "chunk:a:b", "response": {"embeddings": [{"values": [1, 2]}]}}', "", "no", '{"key": "", "response": {"embeddings": [{"values": [1]}]}}', '{"key": "chunk:c", "response": {"embeddings": []}}', '{"key": "chunk:d"}')], "value string")
    assert [tuple(r) for r in bulk.results(lines).collect()] == [("chunk", "a:b", [1.0, 2.0])]


def test_many_mentions_are_merged_part_by_part(spark, tmp_path):
    sizes = []

    def merged(system, user):
        n = user.count("\n- ")
        return json.dumps({"description": f"{n} lines", "aliases": [f"a{n}"]})

    engine = Engine(spark, str(tmp_path / "d"), completer=models.Scripted(merged), settings=Settings(prompt_mentions=10, wait=0.0))
    engine._put("entity", [{"id": e, "corpus_id": "c", "name": e, "entity_type": "T", "aliases": []} for e in ("big", "small")])
    engine._put("mention", [{"id": f"m{k}", "chunk_id": f"k{k}", "entity_id": "big", "name_as_extracted": "big", "description": f"d{k}", "created_at": "2000"} for k in range(150)] + [{"id": "s", "chunk_id": "k", "entity_id": "small", "name_as_extracted": "s", "description": "d", "created_at": "2000"}])
    assert engine.synthesize("c")["synthesized"] == 2
    got = {r.id: r.description for r in engine.read("entity").collect()}
    assert got["small"] == "1 lines" and int(got["big"].split()[0]) <= 10


def test_actions_are_plug_ins(spark, tmp_path):
    class Recall(actions.Action):
        name = "recall"

        def expand(self, engine, node):
            return None if node["evidence_ids"] else {"evidence_ids": ["k"], "answer": "from memory"}

    engine = Engine(spark, str(tmp_path / "d"), referee=Pleased(), actions=(Recall(),))
    engine._put("chunk", [{"id": "k", "corpus_id": "c", "doc_path": "p", "position": 0, "text": "what is known", "embedding": [1.0]}])
    got = engine.answer("What?", iterations=2, depth=2)
    assert got["answer"] == "from memory" and got["evidence_ids"] == ["k"] and got["best_score"] == 0.9
    assert [(r.evidence) for r in engine.read("node_evidence").collect()] == ["k"]


def test_every_command(spark, corpus, tmp_path):
    engine = Engine(spark, str(tmp_path / "d"), completer=models.Scripted(respond), referee=Pleased(), settings=Settings(wait=0.0))
    said = lambda *a: run(engine, parser().parse_args(list(map(str, a))))
    assert said("ingest", corpus, "--name", "demo")["documents"] == 5
    assert said("ontology", "--corpus", "demo", "--output", tmp_path / "o.json")["classes"]
    assert said("extract", "--corpus", "demo", "--ontology", tmp_path / "o.json", "--limit", 2)["chunks"] == 2
    assert said("extract", "--corpus", "demo")["chunks"] > 0
    assert said("synthesize-entities", "--corpus", "demo", "--max-calls", 1)["remaining"] == 1
    source = engine.read("chunk").orderBy("id").first().id
    engine.candidates = lambda arm, *a, **k: [{"score": 0.5, "text": "Ann is everywhere", "sources": [source]}]
    found = said("explore", "--corpus", "demo", "--strategy", "hub", "--max", 2, "--no-eval")
    assert found[0]["grounding"] is None and found[0]["text"] == "Ann is everywhere"
    assert said("explore", "--corpus", "demo", "--strategy", "hub", "--max", 2, "--ground") == []
    (kept,) = said("explore", "--corpus", "demo", "--strategy", "hub", "--max", 1)
    assert kept["text"] == "[hub] Ann works at Acme\n\n---\nAnn is everywhere" and kept["score"] == 0.9
    assert said("bandit", "--corpus", "demo")[2]["observations"] > 0
    assert said("rate", found[0]["id"], 0.5) == {"strategy": "hub"} and said("rate", "x", 0.5) == {"strategy": None}
    assert said("answer", "Who works at Acme?", "--iterations", 2)["answer"] and said("embed-insights") == {"layers": 0, "embedded": 0}
    assert said("stats")["documents"] == 5


def test_table_versions(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"))
    assert t.read() is None and t.write(spark.range(2)) == 1 and t.write(spark.range(3)) == 2 and t.read().count() == 3


def test_reward_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = lambda **x: json.dumps(x) + "\n"
    (log / "1.json").write_text(line(corpus="c", strategy="hub_discovery", score=1.0) + "not json\n\n" + line(corpus="c", strategy="hub"))
    stream = rewards.log(spark, str(log))
    first = rewards.refresh(stream, str(tmp_path / "cp"), "posteriors_1").collect()
    assert [(r.arm, r.alpha, r.beta) for r in first] == [("hub", 2.5, 1.5)]
    (log / "2.json").write_text(line(corpus="c", strategy="hub", score=0.0, weight=3.0))
    again = rewards.refresh(rewards.log(spark, str(log)), str(tmp_path / "cp"), "posteriors_2").collect()
    assert [(r.arm, r.alpha, r.beta) for r in again] == [("hub", 2.5, 4.5)]
