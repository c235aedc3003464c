"""The engine: tables in a folder, and the jobs and tools that work on them."""

from __future__ import annotations

import functools
import json
import math
import random
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import actions as registry
from . import models
from .functions import columns as C
from .functions.columns import content_id
from .ontology import Ontology, generated
from .operators import bandit, browse, chunks, discover, graph, kg, search
from .settings import Settings
from .sources import bulk, files, guard
from .sources.ledger import Ledger
from .sources.staging import pinned, scope
from .sources.store import Table, known, merge_entities, merge_relations, require, update
from .sources.text_index import TextIndex
from .sources.vector_index import VectorIndex

SCHEMAS = {
    "corpus": "id string, name string, description string, source_path string, created_at string",
    "document": "id string, corpus_id string, path string, title string, content_hash string, ingested_at string",
    "ingested": "corpus_id string, path string, length long, modified long",
    "chunk": "id string, document_id string, corpus_id string, doc_path string, heading string, position int, text string, embedding array<float>",
    "insight": "id string, corpus_id string, text string, strategy string, score double, layer int, grounding string, human_score double, embedding array<float>, created_at string",
    "insight_source": "insight string, source string",
    "entity": "id string, corpus_id string, name string, entity_type string, description string, aliases array<string>, embedding array<float>, synthesized_at string",
    "mention": "id string, chunk_id string, entity_id string, name_as_extracted string, description string, aliases array<string>, created_at string",
    "relation": "id string, source_id string, target_id string, type string, evidence string, confidence double, source_chunks array<string>",
    "extraction_done": "id string",
    "reasoning_node": "id string, tree_id string, query string, answer string, action string, parent_id string, evidence_ids array<string>, visits int, total double, depth int, created_at string",
    "node_evidence": "node string, evidence string",
    "reward": "corpus string, mode string, arm string, score double, weight double, insight_id string, at string",
}
#: What tells rows apart, where it isn't the id.
KEYS = {"ingested": ("corpus_id", "path"), "insight_source": ("insight", "source"), "node_evidence": ("node", "evidence")}
#: The texts of the tables that have an index of words, and the tables that
#: have one of vectors.
TEXTS = {"chunk": lambda: F.col("text"), "entity": lambda: C.entity_text(F.col("name"), F.coalesce("description", F.lit("")))}
VECTORS = ("chunk", "insight")
STRATEGIES = ("bridge", "outlier", "hub", "meta", "contradiction", "gap")
#: Of the files that hold a bandit's state.
SNAPSHOT_VERSION = 1
PAYLOAD = "entities array<struct<name: string, type: string, description: string, aliases: array<string>>>, relations array<struct<source: string, target: string, type: string, evidence: string, confidence: double>>"


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _merged_answer(text: str) -> tuple[str, list[str]]:
    got = models.parsed(text)
    got = got if isinstance(got, dict) else {}
    names = got.get("aliases")
    return str(got.get("description") or "").strip(), [a.strip() for a in names if isinstance(a, str) and a.strip()] if isinstance(names, list) else []


class Engine:
    """settings: see there.  actions: of the answer search, by default
    actions.DEFAULT.  reward_log: a folder for all rewards, in place of one for
    each corpus below root."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        embedder: models.Embedder | None = None,
        completer: models.Completer | None = None,
        referee: models.Referee | None = None,
        settings: Settings | None = None,
        actions: tuple[registry.Action, ...] = registry.DEFAULT,
        reward_log: str | None = None,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.settings = settings or Settings.from_env()
        self.embedder, self.completer, self.referee = embedder or models.HashEmbedder(self.settings.embed_size), completer, referee or models.OverlapReferee()
        # Whoever asks a service for many texts is paced.
        self.paced = self.embedder if isinstance(self.embedder, models.HashEmbedder) else models.Paced(self.embedder, self.settings.embed_batch, self.settings.embed_pause)
        self.actions = {a.name: a for a in actions}
        self._reward_log = reward_log

    # Tables

    def _table(self, name: str) -> Table:
        return Table(self.spark, f"{self.root}/{name}", KEYS.get(name, ("id",)), grace=self.settings.retain)

    def _held(self, table: Table, name: str, keys: list[tuple] | None = None) -> DataFrame:
        found = table.read(keys)
        return self.spark.createDataFrame([], SCHEMAS[name]) if found is None else found

    def read(self, name: str) -> DataFrame:
        return self._held(self._table(name), name)

    def _full(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with all columns of the table, in their types."""
        schema = T.StructType.fromDDL(SCHEMAS[name])
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def _texts(self, name: str) -> TextIndex:
        return TextIndex(self.spark, f"{self.root}/index/{name}", grace=self.settings.retain)

    def _vectors(self, name: str) -> VectorIndex:
        return VectorIndex(self.spark, f"{self.root}/vectors/{name}", grace=self.settings.retain)

    def _change(self, table: Table, name: str, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Changes a table that was just read, and those of its indexes that are
        there and up to date."""
        rows = rows if rows is None else self._full(name, rows)
        before = table.version()
        kept = [(index, shown) for at, make, shown in ((TEXTS, self._texts, "text"), (VECTORS, self._vectors, "embedding")) if name in at and (index := make(name)).of() == before]
        if not kept:
            table.change(rows, gone)
            return
        with scope(self.spark):
            new = pinned(self.spark.createDataFrame([], SCHEMAS[name]) if rows is None else rows)
            keys = new.select("id") if gone is None else new.select("id").unionByName(gone.select("id")).distinct()
            old = pinned(self._held(table, name).join(keys, "id", "left_semi"))
            table.change(rows and new, gone)
            after = table.version()
            for index, shown in kept:
                of = lambda df: df.select("id", (TEXTS[name]() if shown == "text" else F.col(shown)).alias(shown))  # noqa: B023, E731
                same = of(new).withColumnRenamed(shown, "now").join(of(old), "id").where(F.col("now").eqNullSafe(F.col(shown))).select("id")
                added, removed = pinned(of(new).join(same, "id", "left_anti")), pinned(of(old).join(same, "id", "left_anti"))
                if added.isEmpty() and removed.isEmpty():
                    index.renamed(after)
                else:
                    index.update(added, removed, after)

    def words(self, name: str, query: str, limit: int) -> DataFrame:
        """id, score of the texts of a table that match a query best.  The index
        is built when it is first asked for, or out of date."""
        table, index = self._table(name), self._texts(name)
        if index.of() != (version := table.version()):
            index.build(self._held(table, name).select("id", TEXTS[name]().alias("text")), version)
        return index.search(query, limit)

    def nearest(self, name: str, vector: list[float], k: int) -> DataFrame:
        """id, score of the k rows whose vectors are nearest.  A large table has
        an index, built when it is first asked for or out of date."""
        table = self._table(name)
        rows = self._held(table, name).select("id", "embedding")
        found = table.latest()[1]
        if not found or table.bytes(found["folders"]) < self.settings.vector_index_bytes:
            return search.vector_top_k(rows, vector, k).select("id", "score")
        index = self._vectors(name)
        if index.of() != (version := table.version()) or index.stale():
            index.build(rows, version)
        return index.search(vector, k, self.settings.vector_probes or None).select("id", "score")

    def _merge(self, name: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Writes merge(old, rows) for the old rows that have the keys of rows;
        the number of rows of the table."""
        table = self._table(name)
        old = self._held(table, name)
        with scope(self.spark):
            rows = pinned(self._full(name, rows))
            self._change(table, name, merge(old.join(rows.select(*table.key), list(table.key), "left_semi"), rows))
        return self.read(name).count()

    def _add(self, name: str, rows: DataFrame) -> None:
        """Writes the rows whose keys the table doesn't have."""
        table = self._table(name)
        old, key = self._held(table, name), list(table.key)
        self._change(table, name, self._full(name, rows).dropDuplicates(key).join(old.select(*key), key, "left_anti"))

    def _set(self, name: str, changes: DataFrame, only_null: bool = False) -> None:
        """Writes the rows that changes (id and columns) name, changed."""
        table = self._table(name)
        self._change(table, name, update(self._held(table, name), changes, only_null=only_null, touched=True))

    def _rows(self, name: str, rows: list[dict]) -> DataFrame:
        schema = T.StructType.fromDDL(SCHEMAS[name])
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    def _put(self, name: str, rows: list[dict]) -> None:
        self._change(self._table(name), name, self._rows(name, rows))

    def ids(self, ids) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def nodes(self) -> DataFrame:
        """id, label, text of whatever can be evidence."""
        return browse.nodes(chunk=self.read("chunk"), insight=self.read("insight"))

    def _file(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # Rewards: a log for each corpus, and a snapshot of the state that it gives

    def _state(self, corpus: str) -> str:
        return self._reward_log or f"{self.root}/state/{corpus or 'none'}/rewards"

    def log(self, rows: list[dict]) -> None:
        """Appends to the reward logs; snapshots that are there move along."""
        rows = [{"weight": 1.0, "at": now()} | r for r in rows]
        of = lambda c: [r for r in rows if (r.get("corpus") or "") == c]
        corpora = {c: self._snapshot(c) for c in sorted({r.get("corpus") or "" for r in rows})}
        for corpus in corpora:
            self._rows("reward", of(corpus)).coalesce(1).write.mode("append").json(self._state(corpus))
        for corpus, held in corpora.items():
            own = of(corpus)
            if held is not None:
                # An arm that isn't there yet starts where all do.
                for r in self._counted(self._rows("reward", own)).collect():
                    arm = held.setdefault(r.arm, [1.0, 1.0])
                    arm[0] += r.won
                    arm[1] += r.lost
                self._keep_snapshot(corpus, held)

    def rewards(self, mode: str = "insight", corpus: str = "") -> DataFrame:
        schema = T.StructType.fromDDL(SCHEMAS["reward"])
        where, fs = self._file(self._state(corpus))
        if not fs.exists(where):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("mode", "DROPMALFORMED").json(self._state(corpus))
        return rows.where((F.col("mode") == mode) & (F.coalesce("corpus", F.lit("")) == corpus)).withColumn("arm", C.arm_name(F.col("arm")))

    def _counted(self, rows: DataFrame) -> DataFrame:
        """arm, won, lost of the rewards that strategies get."""
        rows = rows.where("mode = 'insight'").withColumn("arm", C.arm_name(F.col("arm"))).withColumn("id", F.concat_ws(":", "at", "insight_id", "arm"))
        if self.settings.bandit_mode == "bernoulli":
            return bandit.bernoulli(rows)
        s = C.clamped(F.coalesce("score", F.lit(0.5)))
        return rows.groupBy("arm").agg(F.sum(s * F.col("weight")).alias("won"), F.sum((1 - s) * F.col("weight")).alias("lost"))

    def _log_files(self, corpus: str) -> int:
        where, fs = self._file(self._state(corpus))
        return sum(x.getPath().getName().startswith("part-") for x in fs.listStatus(where)) if fs.exists(where) else 0

    def _snapshot(self, corpus: str) -> dict[str, list[float]] | None:
        """alpha and beta by arm; None if there is no snapshot, if it can't be
        read, if it is of another version or mode, or if it doesn't cover the
        log: its writer may have died after it wrote to that."""
        where, fs = self._file(f"{self._state(corpus)}.snapshot.{corpus or 'none'}.json")
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            data = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            if (data["version"], data["mode"], data["files"]) != (SNAPSHOT_VERSION, self.settings.bandit_mode, self._log_files(corpus)):
                return None
            return {arm: [float(a), float(b)] for arm, (a, b) in data["arms"].items()}
        except (ValueError, KeyError, TypeError, AttributeError, Py4JJavaError):
            return None
        finally:
            stream.close()

    def _keep_snapshot(self, corpus: str, arms: dict[str, list[float]]) -> None:
        where, fs = self._file(f"{self._state(corpus)}.snapshot.{corpus or 'none'}.json")
        out = fs.create(where, True)
        out.write(bytearray(json.dumps({"version": SNAPSHOT_VERSION, "mode": self.settings.bandit_mode, "files": self._log_files(corpus), "arms": arms, "updated_at": now()}).encode()))
        out.close()

    def posteriors(self, corpus: str = "", replay: bool = False) -> list[dict]:
        """The strategies' posteriors: from the snapshot, or else (or if asked
        for) from the whole log, which makes a snapshot."""
        held = None if replay else self._snapshot(corpus)
        if held is None:
            held = {r.arm: [1 + r.won, 1 + r.lost] for r in self._counted(self.rewards("insight", corpus)).collect()}
            self._keep_snapshot(corpus, held)
        out = []
        for arm in STRATEGIES:
            a, b = held.get(arm, (1.0, 1.0))
            out.append({"arm": arm, "alpha": round(a, 6), "beta": round(b, 6), "mean": round(a / (a + b), 6), "observations": round(a + b - 2, 6)})
        return out

    # Ingest

    def resolve_corpus(self, ref: str) -> str:
        """The id of a corpus by id or name; no corpus for an empty one."""
        if not ref:
            return ""
        found = self.read("corpus").where((F.col("id") == ref) | (F.col("name") == ref)).select("id").first()
        if not found:
            raise ValueError(f"unknown corpus: {ref}")
        return found[0]

    def ingest(self, path: str, name: str, description: str = "") -> dict:
        """Takes in the files below path, batch by batch.  A batch that is done
        stays when a later one fails; a file that is done isn't opened again
        while its length and its time stay."""
        corpus = self.spark.range(1).select(content_id(F.lit(name))).first()[0]
        self._put("corpus", [{"id": corpus, "name": name, "description": description, "source_path": path, "created_at": now()}])
        todo = files.listed(self.spark, path).withColumn("corpus_id", F.lit(corpus))
        todo = todo.join(self.read("ingested"), ["corpus_id", "path", "length", "modified"], "left_anti")
        documents = 0
        with scope(self.spark):
            todo = pinned(todo)
            batches = max(1, -(-todo.count() // self.settings.ingest_batch))
            todo = todo.withColumn("batch", F.pmod(F.xxhash64("path"), F.lit(batches)))
            for k in range(batches):
                rows = todo.where(F.col("batch") == k)
                paths = [r.path for r in rows.select("path").orderBy("path").collect()]
                if paths:
                    documents += self._ingested(corpus, path, paths)
                    self._change(self._table("ingested"), "ingested", rows)
        return {"chunks": self.read("chunk").count(), "documents": documents}

    def _ingested(self, corpus: str, root: str, paths: list[str]) -> int:
        """Takes in a batch of files; the number of documents that are new or
        have changed."""
        old = self.read("document")
        found = files.scan(self.spark, root, old.where(F.col("corpus_id") == corpus), paths).withColumn("id", content_id(F.lit(corpus), F.col("path")))
        docs = found.select("id", F.lit(corpus).alias("corpus_id"), "path", F.col("stem").alias("title"), "content_hash", F.lit(now()).alias("ingested_at"))
        made = chunks.chunk(files.sections(found, corpus), self.settings.chunk_chars, self.settings.chunk_overlap).join(docs.select(F.col("id").alias("document_id"), "path", "corpus_id"), "document_id")
        made = made.withColumnRenamed("path", "doc_path").withColumn("embedding", models.embedding(F.col("text"), self.paced))
        # A file that has changed loses the chunks of its old content.
        table = self._table("chunk")
        gone = self._held(table, "chunk").join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id")
        self._change(table, "chunk", made, gone)
        n = docs.count()
        self._change(self._table("document"), "document", require(docs.select(*old.columns), "corpus_id", self.read("corpus")))
        return n

    def texts_to_embed(self, name: str, missing_only: bool = True, corpus: str = "") -> DataFrame:
        """id, text, embedding of the rows of chunk, insight or entity that lack
        a vector, or of all, by id; of a corpus, insights of none too."""
        rows = self.read(name)
        rows = browse.in_corpus(rows, corpus, or_none=name == "insight") if corpus else rows
        text = C.entity_text(F.col("name"), F.coalesce("description", F.lit(""))) if name == "entity" else F.col("text")
        return browse.to_embed(rows.select("id", text.alias("text"), "embedding"), missing_only)

    def reembed(self, name: str, missing_only: bool = True, corpus: str = "") -> int:
        """Embeds what texts_to_embed names; the number of rows."""
        todo = self.texts_to_embed(name, missing_only, corpus)
        n = todo.count()
        if n:
            self._set(name, todo.select("id", models.embedding(F.col("text"), self.paced).alias("embedding")))
        return n

    def reembed_in_bulk(self, names: list[str], corpus: str = "", service: models.BulkEmbedder | None = None, poll: float = 30.0) -> dict[str, int]:
        """Embeds all rows by one job of a service (by default a stand-in)."""
        service = service or bulk.LocalBulk(self.spark, self.embedder)
        tables = {n: self.texts_to_embed(n, False, corpus) for n in names}
        got = bulk.run(self.spark, f"{self.root}/bulk/{now().replace(':', '')}", tables, service, self.settings.embed_size, poll)
        counts = {r.kind: r.n for r in got.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        for n in names:
            if counts.get(n):
                self._set(n, got.where(F.col("kind") == n).select("id", "embedding").dropDuplicates(["id"]))
        return {n: counts.get(n, 0) for n in names}

    def embed_insights(self, layer: int = 1) -> dict[str, int]:
        """Gives insights without a layer this one, and vectors to those without."""
        rows = self.read("insight")
        missing = rows.where("layer is null").select("id", F.lit(layer).alias("layer"))
        n = missing.count()
        if n:
            self._set("insight", missing, only_null=True)
        return {"layers": n, "embedded": self.reembed("insight")}

    # Explore

    def mentions(self) -> DataFrame:
        place = self.read("chunk").select(F.col("id").alias("chunk_id"), F.col("document_id").alias("doc"), F.col("doc_path").alias("path"))
        return self.read("mention").join(place, "chunk_id").select(F.col("entity_id").alias("entity"), F.col("chunk_id").alias("chunk"), "doc", "path")

    def relations(self) -> DataFrame:
        return self.read("relation").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", "confidence")

    def _numbered(self, rows: DataFrame) -> tuple[DataFrame, dict[int, str]]:
        """A bounded sample under numbers, as similar_pairs takes them."""
        names = [r[0] for r in rows.select("id").orderBy("id").collect()]
        numbers = self.spark.createDataFrame(list(enumerate(names)), "n long, id string")
        return rows.join(numbers, "id").drop("id").withColumnRenamed("n", "id"), dict(enumerate(names))

    def candidates(self, strategy: str, corpus: str = "", k: int = 10, threshold: float = discover.THRESHOLD, seed: int = 0) -> list[dict]:
        """Findings of a strategy: score, text, sources, layer."""
        rows = self.read("chunk")
        rows = rows.where(F.col("corpus_id") == corpus) if corpus else rows
        raw, final = {"bridge": (240, 120), "gap": (100, 30)}.get(strategy, (200, 100))
        quota = max(0, k // 2)
        names = lambda found: {r.id: r.name for r in self.read("entity").select("id", "name").where(F.col("id").isin([f.entity for f in found])).collect()}
        if strategy == "meta":
            first = browse.sampled_insights(self.read("insight").where("embedding is not null"), self.read("insight_source"), 60, 1, seed).drop("sources")
            done = {tuple(r) for r in discover.bridged_pairs(self.read("insight_source"), first).collect()}
            numbered, ids = self._numbered(first)
            none = self.spark.createDataFrame([], "a long, b long")
            found = discover.meta_pairs(numbered, none, threshold).orderBy(F.desc("score"), "a", "b").collect()
            items = [{"pair": tuple(sorted((r.strategy_a, r.strategy_b))), "score": r.score, "sources": [ids[r.a], ids[r.b]]} for r in found]
            items = [x for x in items if tuple(sorted(x["sources"])) not in done]
            return [{"score": x["score"], "layer": 2, "sources": x["sources"], "text": f"Two findings meet: {' and '.join(x['pair'])}"} for x in discover.spread_picks(items, k)]
        sample = discover.sampled(rows, raw, final, seed, noise=self.settings.noise_patterns)
        out = []
        if strategy == "gap":
            kinds = self.read("entity").select(F.col("id").alias("entity"), F.col("entity_type").alias("type"))
            found = discover.entity_gaps(self.relations().select(F.col("target").alias("entity")), self.mentions(), kinds, quota).collect()
            named = names(found)
            five = F.slice(F.array_sort(F.collect_set("chunk")), 1, 5).alias("chunks")
            places = {r.entity: r.chunks for r in graph.chunks_of(self.mentions(), self.ids(r.entity for r in found)).groupBy("entity").agg(five).collect()}
            out = [{"score": r.score, "text": f"{named[r.entity]} is referred to {r.incoming} times and mentioned {r.mentions} times", "sources": places.get(r.entity, [])} for r in found]
            if self.completer and len(out) < k:
                drawn = sample.select("id", "text").collect()
                texts = "\n--\n".join(r.text[:300] for r in drawn)
                gaps = models.parsed(models.json_from(self.completer, 'Name what these passages leave open, as JSON: [{"gap", "score"}]', texts)) or []
                out += [{"score": max(0.0, min(1.0, float(g.get("score", 0.5)))), "text": g["gap"], "sources": [r.id for r in drawn[:5]]} for g in gaps if isinstance(g, dict) and g.get("gap")][: k - len(out)]
            return out[:k]
        numbered, ids = self._numbered(sample)
        if strategy == "bridge":
            found = [(r.score, ids[r.a], ids[r.b]) for r in discover.bridges(numbered, threshold, k).collect()]
            found += [(r.score, r.a, r.b) for r in discover.cooccurrences(self.mentions(), 50, seed).collect()]
            path = {r.id: r.doc_path for r in self.read("chunk").where(F.col("id").isin([i for f in found for i in f[1:]])).select("id", "doc_path").collect()}
            seen = set()
            for score, a, b in sorted(found, key=lambda f: (-f[0], f[1:])):
                pair = tuple(sorted((path[a], path[b])))
                if pair not in seen:
                    seen.add(pair)
                    out.append({"score": score, "text": f"{path[a]} and {path[b]} are linked", "sources": [a, b]})
            return out[:k]
        if strategy == "outlier":
            found = discover.outliers(numbered).orderBy(F.desc("score"), "id").limit(k).collect() if len(ids) >= 5 else []
            return [{"score": r.score, "text": f"{r.doc_path} stands apart (mean similarity {r.avg_similarity})", "sources": [ids[r.id]]} for r in found]
        if strategy == "hub":
            found = discover.entity_hubs(self.mentions()).orderBy(F.desc("docs"), "entity").limit(quota).collect() if quota else []
            named = names(found)
            out = [{"score": r.score, "text": f"{named[r.entity]} spans {r.docs} documents", "sources": [r.sample_chunk]} for r in found]
            more = discover.hubs(numbered, threshold).orderBy(F.desc("score"), "id").limit(k - len(out)).collect() if len(ids) >= 5 else []
            return out + [{"score": r.score, "text": f"{r.doc_path} reaches {r.reach} documents", "sources": [ids[r.id]]} for r in more]
        if strategy == "contradiction":
            if not self.completer:
                return []
            # Pairs of one entity go first: at 0.85 they are never below similar pairs.
            near = sorted((0.85, r.a, r.b) for r in discover.cooccurrences(self.mentions(), 30, seed).collect())
            near += [(r.similarity, ids[r.a], ids[r.b]) for r in discover.cross_document_pairs(numbered, threshold, 0.85).orderBy(F.desc("similarity"), "a", "b").limit(30).collect()]
            text = {r.id: (r.doc_path, r.text) for r in self.read("chunk").where(F.col("id").isin([i for f in near for i in f[1:]])).select("id", "doc_path", "text").collect()}
            seen = set()
            for score, a, b in near[:30]:
                pair = tuple(sorted((text[a][0], text[b][0])))
                if pair in seen:
                    continue
                verdict = models.parsed(models.json_from(self.completer, 'Do these contradict each other? JSON: {"contradicts", "why"}', f"{text[a][1][:800]}\n--\n{text[b][1][:800]}"))
                if isinstance(verdict, dict) and verdict.get("contradicts"):
                    seen.add(pair)
                    out.append({"score": score, "text": f"{pair[0]} and {pair[1]} disagree: {verdict.get('why', '')}", "sources": [a, b]})
                if len(out) == k:
                    break
            return out
        raise ValueError(f"unknown strategy: {strategy}")

    def grounded(self, finding: dict) -> tuple[str, float]:
        """Verdict and confidence of a finding on its first source chunk; what
        can't be judged is unsupported."""
        chunk = self.read("chunk").where(F.col("id").isin(finding["sources"][:1])).select("text").first() if finding["sources"] else None
        if not chunk or not self.completer:
            return "unsupported", 0.0
        try:
            got = models.parsed(models.json_from(self.completer, 'Does the passage back the claim? JSON: {"verdict": "support"|"contradict"|"unsupported", "confidence"}', f"Claim: {finding['text'][:600]}\nPassage: {chunk[0][:800]}"))
            verdict = got["verdict"] if got["verdict"] in ("support", "contradict") else "unsupported"
            return verdict, max(0.0, min(1.0, float(got.get("confidence", 0.0))))
        except (TypeError, KeyError, ValueError, OSError):
            return "unsupported", 0.0

    def _contexts(self, found: list[dict]) -> list[tuple[list[str], list[str]]]:
        """What each finding (id, embedding, sources) is judged on: evidence and
        insights like it.  Evidence is the texts of its source chunks or source
        insights, the chunks' entities and the relations of these."""
        asked = self.spark.createDataFrame([(f["id"], f["sources"]) for f in found], "id string, sources array<string>")
        told = F.when(F.col("label") == "insight", F.concat("strategy", F.lit(": "), "text")).otherwise(F.col("text"))
        texts = self.nodes().join(self.read("insight").select("id", "strategy"), "id", "left").select("id", told.alias("text"))
        around = {r.id: r for r in browse.contexts(asked, texts, self.mentions(), self.relations(), self.read("entity")).collect()}
        out = []
        for f in found:
            r = around[f["id"]]
            like = search.insight_top_k(self.read("insight").where(~F.col("id").isin([f["id"], *f["sources"]])), f["embedding"], 3).where(F.col("similarity") >= discover.THRESHOLD)
            lines = [x for x in (", ".join(r.entities), "\n".join(r.paths)) if x]
            out.append((r.texts + lines, [x.text for x in like.orderBy(F.desc("similarity"), "id").select(C.shortened(F.col("text"), 300).alias("text"), "similarity", "id").collect()]))
        return out

    def _rewritten(self, finding: dict, arm: str) -> str:
        """A finding's text with the model's explanation before it; the text
        itself if the model fails."""
        try:
            told = self.settings.told("Explain in two or three sentences what this finding means and why it matters.")
            return f"[{arm}] {self.completer.complete(told, finding['text'])}\n\n---\n{finding['text']}"
        except Exception:  # whatever the client raises, the finding stays as it is
            return finding["text"]

    def explore(self, corpus: str = "", strategy: str | None = None, k: int = 10, evaluate: bool = True, ground: bool | None = None, persist: bool = True, output: str | None = None, threshold: float = discover.THRESHOLD, seed: int | None = None) -> list[dict]:
        """One cycle: pick, find, rewrite, judge, ground, keep, log.

        ground: None goes by the settings."""
        ground = self.settings.grounding if ground is None else ground
        corpus = self.resolve_corpus(corpus)
        arm = strategy or bandit.thompson(self.posteriors(corpus), set(self.settings.disabled_strategies), seed)
        found = self.candidates(arm, corpus, k, threshold, seed or 0)
        self._artifact(output, "candidates", found)
        log = []
        keyed = self.spark.createDataFrame([(i, arm, ",".join(sorted(f["sources"])), f["text"]) for i, f in enumerate(found)], "i int, s string, src string, t string")
        ids = {r.i: r.id for r in keyed.select("i", content_id(F.col("s"), F.col("src"), F.col("t")).alias("id")).collect()}
        vectors = self.embedder.embed([f["text"] for f in found]) if found else []
        for i, f in enumerate(found):
            f |= {"id": ids[i], "embedding": vectors[i], "strategy": arm, "layer": f.get("layer", 1), "corpus_id": corpus, "created_at": now()}
        contexts = self._contexts(found) if evaluate and found else [([], [])] * len(found)
        for f, (evidence, like) in zip(found, contexts):
            if evaluate:
                if self.completer:
                    f["text"] = self._rewritten(f, arm)
                # Insights that are there already bear on what is new; they are no evidence.
                try:
                    f["score"] = self.referee.evaluate("\n".join([arm, *(f"Found already: {x}" for x in like)]), f["text"], evidence)
                except Exception as e:  # the candidate's own score stays
                    f["error"] = str(e)
            f["grounding"], f["sure"] = self.grounded(f) if ground and f["layer"] == 1 else (None, 0.0)
        self._artifact(output, "evaluated", found)
        if found:
            judged = self.spark.createDataFrame([(f["id"], f["layer"], f["grounding"], f["sure"]) for f in found], "id string, layer int, verdict string, sure double")
            gone = {r.id for r in judged.where(C.contradicted(F.col("layer"), F.col("verdict"), F.col("sure"))).collect()}
            log += [{"corpus": corpus, "mode": "dropped_grounding", "arm": arm, "score": 0.0, "insight_id": i} for i in sorted(gone)]
            found = [f for f in found if f["id"] not in gone]
        for f in found:
            weight = (1.0 if evaluate else 0.5) * (0.5 if f["grounding"] == "unsupported" else 1.0)
            log.append({"corpus": corpus, "mode": "insight", "arm": arm, "score": f["score"] * weight, "insight_id": f["id"]})
        if persist and found:
            self._put("insight", found)
            # Sources that aren't there have no edge.
            edges = self.spark.createDataFrame([(f["id"], s) for f in found for s in f["sources"]], "insight string, source string")
            self._add("insight_source", known(edges, "source", self.nodes()))
        self.log(log)
        self._artifact(output, "insights", found)
        return found

    def _artifact(self, folder: str | None, stage: str, rows: list[dict]) -> None:
        if folder and rows:
            short = [(json.dumps({k: (v[:500] if isinstance(v, str) else v) for k, v in r.items() if k != "embedding"}, ensure_ascii=False),) for r in rows]
            self.spark.createDataFrame(short, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{stage}")

    def rate(self, insight: str, score: float) -> str | None:
        """A person's score, which counts three times for the strategy."""
        table = self._table("insight")
        held = self._held(table, "insight", [(insight,)]).where(F.col("id") == insight)
        row = held.first()
        if not row:
            return None
        score = max(0.0, min(1.0, score))
        self._change(table, "insight", held.withColumn("human_score", F.lit(score)))
        self.log([{"corpus": row.corpus_id, "mode": "insight", "arm": row.strategy, "score": score, "weight": 3.0, "insight_id": insight}])
        return row.strategy

    # Extract

    def ontology(self, corpus: str) -> Ontology:
        if not self.completer:
            raise ValueError("an ontology needs a completer")
        rows = browse.in_corpus(self.read("insight"), corpus, or_none=True)
        findings: dict[str, list[dict]] = {}
        for r in browse.best_of_each(rows, "strategy", 20).orderBy("strategy", "place").select("strategy", "text", "score", "layer").collect():
            findings.setdefault(r.strategy, []).append(r.asDict())
        return generated(corpus, findings, self.completer)

    def extract(self, corpus: str, ontology: Ontology, limit: int = 0) -> dict:
        """Entities, mentions and relations of all chunks that aren't done.

        A call that fails for now is made again a few times; if it still fails
        the chunk stays, and is worked on the next time.  Other failures mark
        the chunk as done, so that it isn't tried for ever."""
        if not self.completer:
            raise ValueError("extraction needs a completer")
        pending = self.read("chunk").where(F.col("corpus_id") == corpus).join(self.read("extraction_done"), "id", "left_anti").orderBy("doc_path", "position")
        pending = pending.limit(limit) if limit else pending
        completer, told = self.completer, self.settings.told(ontology.instructions())

        def ask(row: dict) -> str:
            data = models.parsed(models.json_from(completer, told, f"From {row['doc_path']}:\n\n{row['text']}"))
            return json.dumps(data if isinstance(data, dict) else {})

        call = F.sha2(F.concat_ws("\0", F.lit(told), "doc_path", "text").cast("binary"), 256).alias("call")
        with scope(self.spark):  # what the folds write for themselves goes
            asked = pinned(pending.select(call, "id", "document_id", "position", "doc_path", "text"))
            ledger = self._ledger("extract")
            lines = ledger.answered(asked.select("call", "doc_path", "text"), ask)
            status = F.when(F.col("error").isNull(), "done").when(C.transient(F.col("code"), F.col("kind")), "again").otherwise("failed")
            answers = pinned(asked.join(lines, "call").select("id", "document_id", "position", "call", F.coalesce("answer", F.lit("{}")).alias("payload"), status.alias("status")))
            entities, relations = self._fold(corpus, ontology, answers)
            # What is in the tables needn't be known any more.
            ledger.forget(answers.where("status <> 'again'"))
            counts = {r.status: r.n for r in answers.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"chunks": sum(counts.values()), "errors": counts.get("failed", 0), "again": counts.get("again", 0), "entities": entities, "relations": relations}

    def _ledger(self, name: str) -> Ledger:
        s = self.settings
        return Ledger(self.spark, f"{self.root}/calls/{name}", s.call_batch, s.call_task, s.attempts, s.wait, s.retain)

    def _fold(self, corpus: str, ontology: Ontology, answers: DataFrame) -> tuple[int, int]:
        """Merges what the answers hold, and marks their chunks; the number of
        entities and of relations that there are then."""
        x = answers.withColumn("p", F.from_json("payload", PAYLOAD)).select(F.col("document_id").alias("document"), F.col("position").alias("chunk_ord"), F.col("id").alias("chunk_id"), "p.entities", "p.relations")
        kinds = [c.name for c in ontology.classes]
        rows = kg.entity_rows(x, corpus, kinds)
        made = kg.entities(rows, corpus)
        # An entity of several documents comes several times: folded first.
        # In the order of documents, whatever order rows come in.
        in_order = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("document", F.col(c).alias("v")))), lambda x: x["v"]))).alias(c)
        longest = F.min_by("description", F.struct(-F.length("description"), "document")).alias("description")
        one_of = made.groupBy("id").agg(*[F.min_by(c, "document").alias(c) for c in ("corpus_id", "name", "entity_type")], longest, in_order("aliases"))
        entities = self._merge("entity", one_of, merge_entities)
        told_of = self._full("mention", kg.mentions(rows).withColumn("created_at", F.lit(now())))
        told_of = require(require(told_of, "chunk_id", self.read("chunk")), "entity_id", self.read("entity"))
        self._add("mention", told_of)
        claims = kg.relations(kg.with_entities(x, corpus, kinds), rows, [r.name for r in ontology.relations])
        claims = claims.groupBy("id", "source_id", "target_id", "type").agg(F.min_by("evidence", "document").alias("evidence"), F.max("confidence").alias("confidence"), in_order("source_chunks"))
        relations = self._merge("relation", claims, lambda old, new: merge_relations(old, new, self.read("entity")))
        self._add("extraction_done", answers.where("status <> 'again'"))
        return entities, relations

    def synthesize(self, corpus: str, limit: int = 0, budget: int | None = None) -> dict:
        """One description and alias list for each entity with new mentions,
        from the model or else from the mentions, and a new vector.

        A prompt holds a bounded number of mentions; an entity with more is
        merged part by part, and the parts like mentions."""
        with scope(self.spark):
            return self._synthesized(corpus, limit, budget)

    def _synthesized(self, corpus: str, limit: int, budget: int | None) -> dict:
        budget = self.settings.synthesis_budget if budget is None else budget
        own = self.read("entity").where(F.col("corpus_id") == corpus)
        seen = self.read("mention").select(F.col("entity_id").alias("entity"), F.col("created_at").alias("at"))
        todo = graph.dirty(own, seen).orderBy("id")
        todo = todo.limit(limit) if limit else todo
        total = todo.count()
        picked = todo.select("id").limit(budget)
        ms = self.read("mention").select(F.col("entity_id").alias("id"), F.col("chunk_id").alias("key"), "name_as_extracted", "description", "aliases").join(picked, "id")
        rounds, finished, calls = 0, None, []
        while True:
            parts = ms.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / self.settings.prompt_mentions).cast("int").alias("parts"))
            part = F.pmod(F.xxhash64("key", F.lit(rounds)), F.col("parts")).cast("int").alias("part")
            dealt = ms.join(parts, "id").select("*", part).groupBy("id", "part", "parts").agg(F.array_sort(F.collect_list(F.struct("key", "name_as_extracted", "description", "aliases"))).alias("ms"))
            done = self._merged(dealt.join(own.select("id", "name", "entity_type"), "id"))
            calls.append(done.select("call"))
            last = done.where("parts = 1 or error is not null")
            finished = last if finished is None else finished.unionByName(last)
            ms = done.where("parts > 1 and error is null").select("id", F.concat(F.lit("part "), F.col("part")).alias("key"), F.col("name").alias("name_as_extracted"), "description", "aliases")
            rounds += 1
            if ms.isEmpty():
                break
        bad = finished.where("error is not null").select("id").distinct()
        good = finished.where("error is null").join(bad, "id", "left_anti").select("id", "description", "aliases", F.lit(now()).alias("synthesized_at"))
        n = good.count()
        if n:
            rows = good.join(own.select("id", "name"), "id")
            vectors = models.embedding(C.entity_text(F.col("name"), F.col("description")), self.paced)
            self._set("entity", rows.withColumn("embedding", vectors).drop("name"))
        if self.completer:
            self._ledger("synthesize").forget(functools.reduce(DataFrame.unionByName, calls))
        return {"dirty_total": total, "synthesized": n, "errors": bad.count(), "embedded": n, "remaining": total - n if total > budget else 0}

    def _merged(self, dealt: DataFrame) -> DataFrame:
        """dealt with one description and alias list for each row's mentions
        (ms), and call: from the model, or else from the mentions."""
        completer, told = self.completer, self.settings.told('Merge these mentions. JSON: {"description", "aliases"}')
        names = F.array_distinct(F.flatten(F.transform("ms", lambda m: F.coalesce(m["aliases"], F.array().cast("array<string>")))))
        # The longest description, the first of several.
        texts = F.transform("ms", lambda m, i: F.struct(F.length(F.coalesce(m["description"], F.lit(""))).alias("n"), (-i).alias("i"), F.coalesce(m["description"], F.lit("")).alias("d")))
        lines = F.array_join(F.transform("ms", lambda m: F.concat(F.lit("- "), F.coalesce(m["name_as_extracted"], F.lit("None")), F.lit(": "), F.coalesce(m["description"], F.lit("None")))), "\n")
        shown = F.concat("name", F.lit(" ("), F.coalesce("entity_type", F.lit("None")), F.lit(")\n"), lines)
        rows = dealt.select("id", "part", "parts", "name", shown.alias("shown"), F.array_max(texts)["d"].alias("longest"), names.alias("names"))
        rows = pinned(rows.withColumn("call", F.sha2(F.concat_ws("\0", F.lit(told), "id", "shown").cast("binary"), 256)))
        if completer:
            lines = self._ledger("synthesize").answered(rows.select("call", "shown"), lambda row: models.json_from(completer, told, row["shown"]), again=True)
        else:
            lines = rows.select("call", F.lit("{}").alias("answer"), F.lit(None).cast("string").alias("error"))
        read = F.udf(_merged_answer, "description string, aliases array<string>")
        got = rows.join(lines.select("call", "answer", "error"), "call").withColumn("got", F.when(F.col("error").isNull(), read("answer")))
        text = F.when(F.coalesce("got.description", F.lit("")) == "", F.col("longest")).otherwise(F.col("got.description"))
        aliases = F.when(F.size(F.coalesce("got.aliases", F.array().cast("array<string>"))) == 0, F.col("names")).otherwise(F.col("got.aliases"))
        here = lambda c: F.when(F.col("error").isNull(), c)
        return pinned(got.select("id", "part", "parts", "name", "call", here(text).alias("description"), here(aliases).alias("aliases"), "error"))

    # Tools

    def search(self, query: str, limit: int = 10, corpus: str = "") -> list[dict]:
        corpus = self.resolve_corpus(corpus)
        hits = self.nearest("chunk", self.embedder.embed([query])[0], limit).collect()
        rows = self._held(self._table("chunk"), "chunk", [(r.id,) for r in hits]) if hits else self.read("chunk").limit(0)
        rows = rows.where(F.col("corpus_id") == corpus) if corpus else rows
        texts = {r.id: r for r in rows.where(F.col("id").isin([r.id for r in hits])).select("id", "doc_path", "text").collect()}
        return [texts[r.id].asDict() | {"score": r.score} for r in hits if r.id in texts]

    def fulltext(self, query: str, limit: int = 10) -> list[dict]:
        rows = self.read("chunk")
        return [r.asDict() for r in self.words("chunk", query, limit).join(rows.select("id", "doc_path", "text"), "id").orderBy(F.desc("score"), "id").collect()]

    def sql(self, text: str, **params) -> list[dict]:
        """A query over the tables, by name; whatever else is refused before it
        is analyzed."""
        for name in guard.tables_of(self.spark, text, frozenset(SCHEMAS) - {"reward"}):
            self.read(name).createOrReplaceTempView(name)
        return [r.asDict(recursive=True) for r in self.spark.sql(text, args=params or None).collect()]

    def stats(self) -> dict:
        layers = {r.layer: r.n for r in self.read("insight").groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}
        tables = {"corpora": "corpus", "documents": "document", "chunks": "chunk", "entities": "entity", "relations": "relation"}
        n = browse.sizes(**{name: self.read(t) for name, t in tables.items()}).first()
        return {"corpora": n.corpora, "documents": n.documents, "chunks": n.chunks, "insights_l1": layers.get(1, 0), "insights_l2": layers.get(2, 0), "entities": n.entities, "relations": n.relations}

    def insights(self, corpus: str = "", strategy: str = "", limit: int = 10) -> list[dict]:
        corpus = self.resolve_corpus(corpus)
        rows = browse.chosen(self.read("insight"), corpus_id=corpus, strategy=strategy)
        paths = self.read("chunk").select("id", F.col("doc_path").alias("path"))
        out = graph.sources_of(rows, self.read("insight_source").withColumnRenamed("source", "chunk"), paths).select("id", "paths")
        return [r.asDict() for r in rows.drop("embedding").join(out, "id").orderBy(F.desc("score"), "id").limit(limit).collect()]

    def entity_search(self, query: str, limit: int = 10) -> list[dict]:
        rows = self.read("entity")
        hits = self.words("entity", query, limit)
        degree = browse.mentioned(self.read("mention").select(F.col("entity_id").alias("entity"), F.col("chunk_id").alias("doc"))).select(F.col("entity").alias("id"), "mentions")
        return [r.asDict() for r in hits.join(rows.select("id", "name", "entity_type", "description"), "id").join(degree, "id", "left").fillna(0, ["mentions"]).orderBy(F.desc("score"), "id").collect()]

    def entity_graph(self, name: str) -> dict:
        hits = self.entity_search(name, 1)
        if not hits:
            return {"error": f"no entity like {name}"}
        near = graph.neighbors(self.relations(), self.spark.createDataFrame([(hits[0]["id"],)], "id string"), 20)
        names = self.read("entity").select(F.col("id").alias("other"), F.col("name").alias("other_name"))
        return {"entity": hits[0], "neighbors": [r.asDict() for r in near.join(names, "other").collect()]}

    def trees(self, tree: str = "") -> list[dict]:
        rows = self.read("reasoning_node")
        rows = rows.where(F.col("tree_id") == tree).orderBy("depth", "id") if tree else rows.where("parent_id is null").orderBy(F.desc("created_at"), "id").limit(20)
        return [r.asDict() for r in rows.collect()]

    # Answer

    def texts(self, ids: list[str], n: int, chars: int) -> list[str]:
        """Of the last n ids the beginnings of the texts, in their order."""
        held = self.spark.createDataFrame([("", ids)], "node string, ids array<string>")
        return [r.text for r in browse.evidence_texts(held, self.nodes(), n, chars).orderBy("place").collect()]

    def _expanded(self, action: str, node: dict) -> dict | None:
        same = {"query": node["query"], "answer": node["answer"], "evidence_ids": list(node["evidence_ids"]), "challenge": node.get("challenge", "")}
        made = self.actions[action].expand(self, same)
        return same | made | {"action": action} if made else None

    def answer(self, query: str, iterations: int | None = None, depth: int | None = None, c: float | None = None, corpus: str = "", feedback: bool = False) -> dict:
        """A bounded tree search: select by UCT, expand by UCB1 over actions,
        judge, and carry the score up.  What isn't given is as in the settings."""
        given = lambda x, default: default if x is None else x
        iterations, depth, c = given(iterations, self.settings.answer_iterations), given(depth, self.settings.answer_depth), given(c, self.settings.uct)
        names = list(self.actions)
        corpus = self.resolve_corpus(corpus)
        tree = content_id(F.lit(query), F.lit(now()), length=16)
        tree = self.spark.range(1).select(tree).first()[0]
        rng = random.Random(tree)
        new = lambda i, parent, d, **kw: {"id": f"{tree}{i:04d}", "tree_id": tree, "parent_id": parent, "depth": d, "visits": 0, "total": 0.0, "created_at": now(), "children": [], **kw}
        root = new(0, None, 0, query=query, answer="", evidence_ids=[], action="root")
        nodes = {root["id"]: root}
        past = {r.arm: r for r in self.rewards("answer_action", corpus).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s")).collect()}
        visits = {a: past[a].n if a in past else 0 for a in names}
        total = {a: past[a].s if a in past else 0.0 for a in names}
        log, best, best_score = [], root, 0.0
        for _ in range(iterations):
            node = root
            while node["children"]:
                children = [nodes[i] for i in node["children"]]
                fresh = [x for x in children if not x["visits"]]
                if fresh:
                    node = rng.choice(fresh)
                    break
                node = max(children, key=lambda x: x["total"] / x["visits"] + c * math.sqrt(math.log(max(node["visits"], 1)) / x["visits"]))
            if node["depth"] < depth:
                if not node["evidence_ids"] and "search" in names:
                    first = "search"
                elif not node["answer"] and "synthesize" in names:
                    first = "synthesize"
                else:
                    n = max(1, sum(visits.values()))
                    first = max(names, key=lambda a: math.inf if not visits[a] else total[a] / visits[a] + c * math.sqrt(math.log(n) / visits[a]))
                for action in [first, *[a for a in names if a != first]]:
                    made = self._expanded(action, node)
                    if made:
                        child = new(len(nodes), node["id"], node["depth"] + 1, **made)
                        nodes[child["id"]] = child
                        node["children"].append(child["id"])
                        node = child
                        break
            score = self.referee.evaluate(query, node["answer"], self.texts(node["evidence_ids"], 5, 300)) if node["answer"] else 0.1
            up = node
            while up:
                up["visits"] += 1
                up["total"] += score
                up = nodes.get(up["parent_id"])
            if node["action"] != "root":
                visits[node["action"]] += 1
                total[node["action"]] += score
                log.append({"corpus": corpus, "mode": "answer_action", "arm": node["action"], "score": score})
            if score > best_score:
                best, best_score = node, score
        self._put("reasoning_node", list(nodes.values()))
        # Evidence that isn't there has no edge.
        used = self.spark.createDataFrame([(n["id"], e) for n in nodes.values() for e in n["evidence_ids"]], "node string, evidence string")
        self._add("node_evidence", known(used, "evidence", self.nodes()))
        self.log([*log, {"corpus": corpus, "mode": "answer", "arm": "answer", "score": best_score}])
        rewarded = self.feedback(best["evidence_ids"], best_score) if feedback else 0
        path, at = [], best
        while at:
            path.insert(0, at["id"])
            at = nodes.get(at["parent_id"])
        return {"tree_id": tree, "answer": best["answer"], "best_score": best_score, "mean_score": best["total"] / best["visits"] if best["visits"] else 0.0, "evidence_ids": best["evidence_ids"], "path": path, "nodes": len(nodes), "rewarded": rewarded}

    def feedback(self, evidence: list[str], score: float) -> int:
        """Rewards the strategies of the insights that an answer rests on."""
        if score < 0.5 or not evidence:
            return 0
        rows = browse.by_ids(self.read("insight"), self.ids(evidence)).select("id", "strategy", "corpus_id").collect()
        self.log([{"corpus": r.corpus_id, "mode": "insight", "arm": r.strategy, "score": 0.3 * score, "insight_id": r.id} for r in rows])
        return len(rows)
