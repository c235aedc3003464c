"""Ingest in batches, and what is read again."""

import os

import pytest

from gleaner.engine import Engine
from gleaner.settings import Settings


def made(folder, n):
    folder.mkdir()
    for k in range(n):
        (folder / f"{k}.md").write_text(f"# Part {k}\nA note of some length on part {k}, which is long enough to be a chunk.")
    return folder


def texts(engine):
    return {r.doc_path: r.text for r in engine.read("chunk").collect()}


def test_an_interrupted_run_goes_on(spark, tmp_path, monkeypatch):
    docs = made(tmp_path / "docs", 24)
    engine = Engine(spark, str(tmp_path / "data"), settings=Settings(ingest_batch=6))
    change, done = Engine._change, []

    def dies(self, table, name, *rest):
        if name == "document" and len(done) == 2:
            raise KeyboardInterrupt
        change(self, table, name, *rest)
        if name == "document":
            done.append(1)

    monkeypatch.setattr(Engine, "_change", dies)
    with pytest.raises(KeyboardInterrupt):
        engine.ingest(str(docs), "demo")
    monkeypatch.undo()
    kept = engine.read("document").count()
    assert 0 < kept < 24 and engine.read("ingested").count() == kept
    assert engine.ingest(str(docs), "demo") == {"chunks": 24, "documents": 24 - kept}
    assert len(texts(engine)) == 24 and engine.read("ingested").count() == 24


def test_a_file_that_is_done_is_not_opened(spark, tmp_path):
    docs = made(tmp_path / "docs", 3)
    engine = Engine(spark, str(tmp_path / "data"))
    assert engine.ingest(str(docs), "demo")["documents"] == 3
    # As long as before and of the same time: only who opens it can tell.
    at, text = os.stat(docs / "1.md"), (docs / "1.md").read_text()
    (docs / "1.md").write_text(text.replace("note", "word"))
    os.utime(docs / "1.md", ns=(at.st_atime_ns, at.st_mtime_ns))
    assert engine.ingest(str(docs), "demo")["documents"] == 0 and "note" in texts(engine)["1.md"]
    os.utime(docs / "1.md", ns=(at.st_atime_ns, at.st_mtime_ns + 5_000_000))
    os.utime(docs / "2.md", ns=(at.st_atime_ns, at.st_mtime_ns + 5_000_000))
    assert engine.ingest(str(docs), "demo")["documents"] == 1 and "word" in texts(engine)["1.md"]
    assert engine.ingest(str(docs), "other")["documents"] == 3 and engine.read("chunk").count() == 6


def test_names_that_look_like_patterns(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "a{b}").mkdir(parents=True)
    for name in ("a{b}/x[1].md", "a b.md", "ü*.md"):
        (docs / name).write_text("# T\nSome text of a length that makes it a chunk of its own here.")
    engine = Engine(spark, str(tmp_path / "data"))
    assert engine.ingest(str(docs), "demo")["documents"] == 3
    assert sorted(texts(engine)) == ["a b.md", "a{b}/x[1].md", "ü*.md"]


def test_a_reward_whose_snapshot_was_lost_counts(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "data"))
    reward = {"corpus": "c", "mode": "insight", "arm": "hub", "score": 1.0, "insight_id": "i"}
    hub = lambda: next(r["alpha"] for r in engine.posteriors("c") if r["arm"] == "hub")
    engine.log([reward])
    assert hub() == 2.0
    monkeypatch.setattr(Engine, "_keep_snapshot", lambda *a: (_ for _ in ()).throw(MemoryError("the driver died")))
    with pytest.raises(MemoryError):
        engine.log([reward])
    monkeypatch.undo()
    assert hub() == 3.0
