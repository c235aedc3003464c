"""What the answer search can do at a node: plug-ins with a name.

A node is a dict with query, answer, challenge and evidence_ids.  expand()
gives what changes in the child, or None where the action has nothing to do.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from . import models
from .functions.columns import last_n
from .operators import browse, chunks, graph, search

if TYPE_CHECKING:
    from .engine import Engine


class Action(ABC):
    name: str

    @abstractmethod
    def expand(self, engine: Engine, node: dict) -> dict | None: ...


class _Evidence(Action):
    """An action that finds evidence."""

    def expand(self, engine: Engine, node: dict) -> dict | None:
        held = node["evidence_ids"]
        more = list(dict.fromkeys(x for x in self.found(engine, node) if x and x not in held))
        return {"evidence_ids": held + more} if more else None

    @abstractmethod
    def found(self, engine: Engine, node: dict) -> list[str]: ...


class Search(_Evidence):
    name = "search"

    def found(self, engine: Engine, node: dict) -> list[str]:
        held, ids = node["evidence_ids"], engine.ids
        vector = engine.embedder.embed([node["query"]])[0]
        top = engine.entity_search(node["query"], 5)
        of = graph.chunks_of(engine.mentions(), ids(t["id"] for t in top)).select(F.col("chunk").alias("id"), F.lit(0.8).alias("score")) if top else ids([]).withColumn("score", F.lit(0.8))
        near = engine.nearest("insight", vector, 5)
        channels = {1: engine.nearest("chunk", vector, 8), 2: engine.words("chunk", node["query"], 8), 3: near, 4: of}
        if not held and engine.completer:
            told = engine.settings.told("Up to four search queries for this question, as a JSON list.")
            facets = models.parsed(models.json_from(engine.completer, told, node["query"]))
            for f in [x for x in facets if isinstance(x, str)][:4] if isinstance(facets, list) else []:
                more = engine.nearest("chunk", engine.embedder.embed([f])[0], 5)
                channels[5] = channels[5].unionByName(more) if 5 in channels else more
        return [r.id for r in search.fuse(channels, seen=held).collect()]


class FollowRef(_Evidence):
    name = "follow_ref"

    def found(self, engine: Engine, node: dict) -> list[str]:
        if not node["evidence_ids"]:
            return []
        held = engine.spark.createDataFrame([(node["evidence_ids"],)], "ids array<string>")
        recent = held.select(F.explode(last_n(F.col("ids"), 3)).alias("id"))
        links = chunks.next_links(engine.read("chunk"), "document_id", "position", "id")
        near = browse.follow(recent, links, engine.read("insight_source")).orderBy("seed", "how", "found").collect()
        far = graph.hops(engine.mentions(), engine.relations(), recent).select("seed", "entity", "other", "found").orderBy("seed", "entity", "other", "found").collect()
        return [r.found for r in (*near, *far)]


class EntityWalk(_Evidence):
    name = "entity_walk"

    def found(self, engine: Engine, node: dict) -> list[str]:
        top = [t["id"] for t in engine.entity_search(node["query"], 5)[:3]]
        if not top:
            return []
        return [r.chunk for r in graph.walk(engine.mentions(), engine.relations(), engine.ids(top)).orderBy("step", "entity", "chunk").collect()]


class Challenge(Action):
    name = "challenge"

    def expand(self, engine: Engine, node: dict) -> dict | None:
        if not node["answer"] or not engine.completer:
            return None
        return {"challenge": engine.completer.complete(engine.settings.told("Name the weakest point of this answer."), f"{node['query']}\n{node['answer']}")}


class Synthesize(Action):
    name = "synthesize"

    def expand(self, engine: Engine, node: dict) -> dict | None:
        texts = engine.texts(node["evidence_ids"], 10, 500)
        if not texts:
            return None
        if not engine.completer:
            return {"answer": " ".join(texts)[:800]}
        return {"answer": engine.completer.complete(engine.settings.told("Answer the question from the evidence."), f"{node['query']}\n{node['challenge']}\n" + "\n--\n".join(texts))}


#: In the order in which they are tried if the first choice has nothing to do.
DEFAULT = (Search(), FollowRef(), Challenge(), Synthesize(), EntityWalk())
