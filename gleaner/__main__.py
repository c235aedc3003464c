"""Command line: one command for each job of the engine."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner")
    p.add_argument("--root", default="gleaner-data", help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, /, **options) -> None:
        c = sub.add_parser(name)
        for key, value in options.items():
            flag = key if key in ("path", "query", "insight_id", "rating") else "--" + key.replace("_", "-")
            if value is False:
                c.add_argument(flag, action="store_true")
            elif isinstance(value, type):
                c.add_argument(flag, type=value, **({"required": True} if flag.startswith("--") else {}))
            else:
                c.add_argument(flag, type=type(value), default=value)

    command("ingest", path=str, name=str, description="")
    command("explore", corpus="", max=5, cycles=1, strategy="", no_eval=False, dry_run=False, no_persist=False, output_dir="", ground=False)
    command("answer", query=str, iterations=20, depth=5, feedback=False, corpus="")
    command("bandit", corpus="")
    command("embed-insights")
    command("re-embed", corpus=str, include_insights=False, include_entities=False, force=False, batch_api=False, poll=30)
    command("ontology", corpus=str, output="")
    command("extract", corpus=str, ontology="", limit=0)
    command("rate", insight_id=str, rating=float)
    command("synthesize-entities", corpus=str, limit=0, max_calls=500)
    command("stats")
    command("serve")
    return p


def run(engine, a: argparse.Namespace):
    """The result of a command, as JSON can hold it."""
    from .ontology import Ontology

    if a.command == "ingest":
        return engine.ingest(a.path, a.name, a.description)
    if a.command == "explore":
        cycles = [engine.explore(a.corpus, a.strategy or None, a.max, not a.no_eval, a.ground or None, persist=not (a.dry_run or a.no_persist), output=a.output_dir or None) for _ in range(a.cycles)]
        return [{k: v for k, v in f.items() if k != "embedding"} for c in cycles for f in c]
    if a.command == "answer":
        return engine.answer(a.query, a.iterations, a.depth, corpus=a.corpus, feedback=a.feedback)
    if a.command == "bandit":
        return engine.posteriors(engine.resolve_corpus(a.corpus))
    if a.command == "embed-insights":
        return engine.embed_insights()
    if a.command == "re-embed":
        names = ["chunk", *["insight"] * a.include_insights, *["entity"] * a.include_entities]
        corpus = engine.resolve_corpus(a.corpus)
        if a.batch_api:
            return engine.reembed_in_bulk(names, corpus, poll=a.poll)
        return {n: engine.reembed(n, not a.force, corpus) for n in names}
    if a.command == "ontology":
        made = engine.ontology(engine.resolve_corpus(a.corpus)).to_json()
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(made)
        return json.loads(made)
    if a.command == "extract":
        corpus = engine.resolve_corpus(a.corpus)
        with_file = None
        if a.ontology:
            with open(a.ontology, encoding="utf-8") as f:
                with_file = Ontology.from_json(f.read())
        return engine.extract(corpus, with_file or engine.ontology(corpus), a.limit)
    if a.command == "rate":
        return {"strategy": engine.rate(a.insight_id, a.rating)}
    if a.command == "synthesize-entities":
        return engine.synthesize(engine.resolve_corpus(a.corpus), a.limit, a.max_calls)
    return engine.stats()


def serve(engine, lines=sys.stdin, out=sys.stdout) -> None:
    """Answers one JSON request a line: {"tool": name, "args": {...}}."""
    tools = {"search": engine.search, "fulltext": engine.fulltext, "sql": lambda query: engine.sql(query), "stats": engine.stats, "get_insights": engine.insights, "answer": lambda query, max_iterations=20, max_depth=5: engine.answer(query, max_iterations, max_depth), "reasoning_trees": lambda tree_id="": engine.trees(tree_id), "entity_search": engine.entity_search, "entity_graph": lambda entity_name, hops=1: engine.entity_graph(entity_name), "rate_insight": lambda insight_id, score: {"strategy": engine.rate(insight_id, score)}}
    for line in lines:
        try:
            asked = json.loads(line)
            reply = {"result": tools[asked["tool"]](**asked.get("args", {}))}
        except (KeyError, TypeError, ValueError, PermissionError) as e:
            reply = {"error": f"{type(e).__name__}: {e}"}
        print(json.dumps(reply, default=str, ensure_ascii=False), file=out, flush=True)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from . import models
    from .engine import Engine
    from .settings import Settings

    a, settings = parser().parse_args(argv), Settings.from_env()
    spark = SparkSession.builder.appName("gleaner").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    completer = models.made_by(settings.completer)
    referee = models.FallbackReferee(models.DebateReferee(completer), models.OverlapReferee()) if completer else None
    engine = Engine(spark, a.root, models.made_by(settings.embedder), completer, referee, settings)
    if a.command == "serve":
        serve(engine)
    else:
        print(json.dumps(run(engine, a), default=str, ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
