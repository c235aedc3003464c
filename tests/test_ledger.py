"""The ledger of model calls: nothing that was answered is paid for again."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner import __main__ as cli
from gleaner import models
from gleaner.engine import Engine
from gleaner.ontology import Kind, Ontology
from gleaner.settings import Settings
from gleaner.sources.ledger import Ledger
from gleaner.sources.store import Table

from .test_engine import respond

ONTOLOGY = Ontology("x", [Kind("PERSON"), Kind("COMPANY"), Kind("CONCEPT")], [Kind("WORKS_AT")])


def calls(path):
    return path.read_text().split("\n")[:-1] if path.exists() else []


def counted(path, fail=None):
    def ask(row, path=str(path)):
        with open(path, "a") as f:
            f.write(f"{row['text']}\n")
        if fail and fail(row["text"]):
            raise fail(row["text"])
        return row["text"].upper()

    return ask


def asked(spark, names):
    return spark.createDataFrame([(n, n) for n in names], "call string, text string")


def test_a_run_that_is_killed_keeps_its_answers(spark, tmp_path, monkeypatch):
    log, names = tmp_path / "log", [f"t{k}" for k in range(40)]
    ledger = Ledger(spark, str(tmp_path / "ledger"), batch=8, task=2)
    change, done = Table.change, []

    def dies(self, *rows, **gone):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(change(self, *rows, **gone))
        return done[-1]

    monkeypatch.setattr(Table, "change", dies)
    with pytest.raises(KeyboardInterrupt):
        ledger.answered(asked(spark, names), counted(log))
    monkeypatch.undo()
    kept = {r.call for r in ledger.read().collect()}
    assert len(kept) == sum(done) > 0 and kept <= set(calls(log))
    got = Ledger(spark, str(tmp_path / "ledger"), batch=8, task=2).answered(asked(spark, [*names, "t0"]), counted(log))
    assert {r.call: r.answer for r in got.collect()} == {n: n.upper() for n in names}
    paid = calls(log)
    # Each kept answer was paid for once, and no other more than twice.
    assert all(paid.count(n) == 1 for n in kept) and len(paid) <= len(names) + 8 + 2
    assert ledger.answered(asked(spark, names), counted(log)).count() == 40 and len(calls(log)) == len(paid)


def test_failures(spark, tmp_path):
    log = tmp_path / "log"
    fail = lambda t: {"a": TimeoutError("busy"), "b": ValueError("bad")}.get(t)
    ledger = Ledger(spark, str(tmp_path / "ledger"), attempts=2, wait=0.0)
    got = {r.call: r for r in ledger.answered(asked(spark, "abc"), counted(log, fail)).collect()}
    assert (got["a"].kind, got["b"].error, got["c"].answer) == ("timeout", "ValueError: bad", "C") and sorted(calls(log)) == ["a", "a", "b", "c"]
    got = {r.call: r for r in ledger.answered(asked(spark, "abc"), counted(log)).collect()}
    assert got["a"].answer == "A" and got["a"].attempts == 2 and got["b"].answer is None and sorted(calls(log)) == ["a", "a", "a", "b", "c"]
    assert {r.answer for r in ledger.answered(asked(spark, "abc"), counted(log), again=True).collect()} == {"A", "B", "C"}
    ledger.forget(asked(spark, "ab"))
    assert [r.call for r in ledger.read().collect()] == ["c"]
    assert ledger.answered(asked(spark, []), counted(log)).collect() == []


def test_a_task_makes_few_calls(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), batch=1000, task=5)
    ids = ledger.answered(asked(spark, [str(k) for k in range(50)]), lambda row: __import__("pyspark").TaskContext.get().partitionId().__str__())
    assert max(r["count"] for r in ids.groupBy("answer").count().collect()) <= 10


@pytest.fixture
def corpus(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for k in range(12):
        (docs / f"{k}.md").write_text(f"# Part {k}\nAnn works at Acme, note {k}, and likes green tea a lot in the old town by the river.")
    return docs


def test_extraction_goes_on_where_it_stopped(spark, corpus, tmp_path, monkeypatch):
    log = tmp_path / "calls"

    def answer(system, user, log=str(log)):
        if "entity types" in system:
            with open(log, "a") as f:
                f.write("x\n")
        return respond(system, user)

    engine = Engine(spark, str(tmp_path / "data"), completer=models.Scripted(answer), settings=Settings(call_batch=4, call_task=1))
    engine.ingest(str(corpus), "demo")
    cid = engine.resolve_corpus("demo")
    monkeypatch.setattr(Engine, "_fold", lambda *a: (_ for _ in ()).throw(MemoryError("the driver died")))
    with pytest.raises(MemoryError):
        engine.extract(cid, ONTOLOGY)
    assert len(calls(log)) == 12
    monkeypatch.undo()
    done = engine.extract(cid, ONTOLOGY)
    assert (done["chunks"], done["entities"], done["relations"]) == (12, 2, 1) and len(calls(log)) == 12
    assert engine._ledger("extract").read().count() == 0 and engine.extract(cid, ONTOLOGY)["chunks"] == 0
    aliases = engine.read("relation").first().source_chunks
    docs = {r.id: r.document_id for r in engine.read("chunk").collect()}
    assert [docs[c] for c in aliases] == sorted(docs[c] for c in aliases)


def test_another_instruction_is_another_call(spark, corpus, tmp_path):
    engine = Engine(spark, str(tmp_path / "data"), completer=models.Scripted(respond))
    asked_for = spark.createDataFrame([("d", "t")], "doc_path string, text string")
    call = lambda told: asked_for.select(F.sha2(F.concat_ws("\0", F.lit(told), "doc_path", "text").cast("binary"), 256)).first()[0]
    assert call("one") != call("two") and engine._ledger("x").read().count() == 0


class Strict:
    """A client whose JSON mode some servers refuse."""

    def __init__(self, error=None):
        self.error = error

    def complete_json(self, system, user):
        if self.error:
            raise self.error
        return '{"mode": "json"}'

    def complete(self, system, user):
        return '{"mode": "plain"}'


class BadRequest(Exception):
    status_code = 400


def test_json_mode():
    assert json.loads(models.json_from(Strict(), "", ""))["mode"] == "json"
    assert json.loads(models.json_from(Strict(BadRequest()), "", ""))["mode"] == "plain"
    assert json.loads(models.json_from(models.Scripted(lambda s, u: '{"mode": "only"}'), "", ""))["mode"] == "only"
    with pytest.raises(TimeoutError):
        models.json_from(Strict(TimeoutError()), "", "")


class Recording:
    def __init__(self, path):
        self.path = path

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write(f"{len(texts)}\n")
        return [[1.0, 0.0] for _ in texts]


def test_embedding_is_paced(spark, corpus, tmp_path):
    engine = Engine(spark, str(tmp_path / "data"), embedder=Recording(str(tmp_path / "sizes")), settings=Settings(embed_batch=3, embed_pause=0.0))
    engine.ingest(str(corpus), "demo")
    assert max(map(int, calls(tmp_path / "sizes"))) <= 3 and engine.read("chunk").where("embedding is null").count() == 0


def test_the_command_line_has_a_model(spark, corpus, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("GLEANER_COMPLETER", "tests.stand_ins:completer")
    monkeypatch.setenv("GLEANER_EMBEDDER", "tests.stand_ins:embedder")
    run = lambda *a: (cli.main(["--root", str(tmp_path / "data"), *a]), json.loads(capsys.readouterr().out))[1]
    assert run("ingest", str(corpus), "--name", "demo")["documents"] == 12
    done = run("extract", "--corpus", "demo")
    assert (done["chunks"], done["errors"], done["entities"]) == (12, 0, 2)
    assert run("synthesize-entities", "--corpus", "demo")["synthesized"] == 2
    monkeypatch.delenv("GLEANER_COMPLETER")
    with pytest.raises(ValueError):
        run("extract", "--corpus", "demo")
