"""Knowledge graph of a document: entities, mentions and relations from the
extractions of its chunks.

Extractions: document, chunk_ord, chunk_id, entities array<struct<name, type,
description, aliases>>, relations array<struct<source, target, type, evidence,
confidence>>.  Everything is ordered by (chunk_ord, place in the array).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import clamped, content_id, entity_id, once, stripped, type_name
from ..sources.staging import package_on_workers, pinned

EVIDENCE_CHARS = 500


def _kind(e: Column, types: list[str]) -> Column:
    return once(type_name(F.coalesce(e["type"], F.lit("CONCEPT"))), lambda k: F.when(k.isin(*types), k).otherwise("CONCEPT"))


def _aliases(e: Column) -> Column:
    return F.filter(F.transform(F.coalesce(e["aliases"], F.array().cast("array<string>")), lambda a: stripped(a)), lambda a: a.isNotNull() & (a != ""))


def entity_rows(extractions: DataFrame, corpus: str, types: list[str]) -> DataFrame:
    """One row per extracted entity, with the id that its name and type give."""
    rows = extractions.select("document", "chunk_ord", "chunk_id", F.posexplode("entities").alias("place", "e"))
    e = F.col("e")
    rows = rows.select("document", "chunk_ord", "chunk_id", "place", stripped(e["name"]).alias("name"), _kind(e, types).alias("type"), F.coalesce("e.description", F.lit("")).alias("description"), _aliases(e).alias("aliases"))
    return rows.where("name is not null and name <> ''").withColumn("entity_id", entity_id(F.lit(corpus), F.col("type"), F.col("name")))


def _keys(aliases: Column) -> Column:
    """Aliases, each followed by its lower case if that is another."""
    return F.flatten(F.transform(aliases, lambda n: F.array_distinct(F.array(n, F.lower(n)))))


def with_entities(extractions: DataFrame, corpus: str, types: list[str]) -> DataFrame:
    """Extractions with what entity_rows has of each chunk in a column: said."""
    one = lambda e, i: F.struct(i.alias("place"), stripped(e["name"]).alias("name"), _kind(e, types).alias("type"), _keys(_aliases(e)).alias("aliases"))
    named = F.filter(F.transform("entities", one), lambda x: F.coalesce(x["name"], F.lit("")) != "")
    known = lambda x: F.struct(x["place"].alias("place"), entity_id(F.lit(corpus), x["type"], x["name"]).alias("entity_id"), x["name"].alias("name"), F.lower(x["name"]).alias("low"), x["aliases"].alias("aliases"))
    return extractions.withColumn("said", F.transform(named, known)).drop("entities")


def _ordered(field: str) -> Column:
    """The values of a field in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", "place", F.col(field).alias("v")))), lambda x: x["v"])


def _longest(field: str) -> Column:
    """The longest value, the first of several."""
    return F.max_by(field, F.struct(F.length(field), -F.col("chunk_ord"), -F.col("place")))


def entities(rows: DataFrame, corpus: str) -> DataFrame:
    """One row per document and entity: first name, longest description, aliases in order."""
    first = F.min_by("name", F.struct("chunk_ord", "place")).alias("name")
    out = rows.groupBy("document", "entity_id", "type").agg(first, _longest("description").alias("description"), F.array_distinct(F.flatten(_ordered("aliases"))).alias("aliases"))
    return out.select("document", F.col("entity_id").alias("id"), F.lit(corpus).alias("corpus_id"), "name", F.col("type").alias("entity_type"), "description", "aliases")


def mentions(rows: DataFrame) -> DataFrame:
    """One row per chunk and entity."""
    first = F.min_by("name", F.struct("chunk_ord", "place")).alias("name_as_extracted")
    out = rows.groupBy("document", "chunk_id", "entity_id").agg(first, _longest("description").alias("description"), F.array_distinct(F.flatten(_ordered("aliases"))).alias("aliases"))
    return out.withColumn("id", content_id(F.col("chunk_id"), F.col("entity_id")))


class _Names:
    """The names of a document's entities so far, and those of its chunks at
    one place in the order.  A chunk's entities count up to their last mention
    in it, those mentioned later first."""

    def __init__(self):
        self._first: dict[str, dict[str, tuple]] = {}
        self._ord, self._here = None, {}
        self._lost: set[str] = set()

    def mention(self, ord_: int, place: int, chunk: str, entity: str, own: tuple[str, str], aliases: list[str], last: bool) -> None:
        """last: whether the chunk isn't met again at a later place."""
        self._at(ord_)
        held = self._first.get(entity)
        if held is None:
            # Of the names an entity is extracted by, the first one counts.
            held = self._first[entity] = dict.fromkeys(own, (ord_, place))
        for name in aliases:
            held.setdefault(name, (ord_, place))
        if last:
            self._here.setdefault(chunk, {})[entity] = place

    def _at(self, ord_: int) -> None:
        if ord_ != self._ord:
            self._ord, self._here = ord_, {}

    def entities(self, ord_: int, chunk: str, names: list[str], low: list[str]) -> list[str | None]:
        """What names stand for in a chunk: as written, then in lower case."""
        self._at(ord_)
        # The first entity that has a key is the one mentioned last.
        known: dict[str, str] = {}
        for place, entity in sorted(((place, entity) for entity, place in self._here.get(chunk, {}).items()), reverse=True):
            here = (ord_, place)
            for key, first in self._first[entity].items():
                if first <= here:
                    known.setdefault(key, entity)
        out = [known.get(n) or known.get(m) for n, m in zip(names, low)]
        self._lost.update(m for m, found in zip(low, out) if found is None)
        return out

    def candidates(self) -> dict[str, list[str]]:
        """The document's entities that have a name which stood for none in a
        chunk, by that name in lower case."""
        out: dict[str, list[str]] = {}
        if self._lost:
            for entity, held in self._first.items():
                for key in held.keys() & self._lost:
                    out.setdefault(key, []).append(entity)
        return out


class _Lists:
    """The rows' lists of a column as Python values."""

    def __init__(self, column: pa.Array):
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        self.ends = np.append(0, np.cumsum(sizes)).tolist()
        self.flat = column.flatten()

    def values(self) -> list:
        return self.flat.to_numpy(zero_copy_only=False).tolist()

    def field(self, name: str) -> list:
        return pc.struct_field(self.flat, name).to_numpy(zero_copy_only=False).tolist()


def _said_and_asked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """document, ord, chunk_id, last, what is said and what is asked (or None) of each row."""
    of = lambda c: batch.column(c).to_numpy(zero_copy_only=False).tolist()
    said, names, lows = (_Lists(batch.column(c)) for c in ("said", "names", "lows"))
    keys = _Lists(pc.struct_field(said.flat, "aliases"))
    alias = keys.values()
    aliases = [alias[i:j] for i, j in zip(keys.ends, keys.ends[1:])]
    entities = list(zip(*(said.field(c) for c in ("place", "name", "low", "entity_id")), aliases))
    name, low, asks = names.values(), lows.values(), batch.column("names").is_valid().to_numpy(zero_copy_only=False).tolist()
    for i, (document, ord_, chunk, last) in enumerate(zip(*map(of, ("document", "ord", "chunk_id", "last")))):
        asked = (name[names.ends[i] : names.ends[i + 1]], low[lows.ends[i] : lows.ends[i + 1]]) if asks[i] else None
        yield document, ord_, chunk, last, entities[said.ends[i] : said.ends[i + 1]], asked


def _in_order(rows: DataFrame) -> DataFrame:
    """document, chunk_id, ids, carry, low, cands for rows (document, ord,
    chunk_id, last, said, names, lows, carry) that are dealt and sorted by
    document and ord: for names that aren't null the entities that they stand
    for, and for each document the names (low) that some chunk's scope lacks
    but the document has, with their entities (cands).
    """
    carried = rows.schema["carry"].dataType
    kinds = T.StructType([rows.schema["document"], rows.schema["chunk_id"], T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("carry", carried), T.StructField("low", T.StringType()), T.StructField("cands", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document = at = schema = None
        held, said, asked = _Names(), [], []
        done, lost = [], []

        def place() -> None:
            """What is said at one place in the order comes before what is asked there."""
            nonlocal said, asked
            for (place, name, low, entity, aliases), chunk, last in sorted(said, key=lambda x: x[0][:2]):
                held.mention(at, place, chunk, entity, (name, low), aliases, last)
            for where, chunk, (names, lows) in asked:
                done.append((where, held.entities(at, chunk, names, lows)))
            said, asked = [], []

        def end() -> None:
            lost.extend((document, low, entities) for low, entities in held.candidates().items())

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal done, lost
            parts = {}
            for (batch, i), ids in done:
                parts.setdefault(id(batch), (batch, [], []))
                parts[id(batch)][1].append(i)
                parts[id(batch)][2].append(ids)
            for batch, rows_, ids in parts.values():
                own = batch.take(pa.array(rows_))
                none = [pa.nulls(len(ids), t) for t in (pa.string(), pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([own.column("document"), own.column("chunk_id"), pa.array(ids, pa.list_(pa.string())), own.column("carry"), *none], names=kinds.names)
            if lost:
                docs, lows, cands = zip(*lost)
                none = [pa.nulls(len(docs), schema.field(c).type) for c in ("chunk_id", "carry")]
                yield pa.RecordBatch.from_arrays([pa.array(docs, schema.field("document").type), none[0], pa.nulls(len(docs), pa.list_(pa.string())), none[1], pa.array(lows), pa.array(cands, pa.list_(pa.string()))], names=kinds.names)
            done, lost = [], []

        for batch in batches:
            schema = batch.schema
            for i, (doc, ord_, chunk, last, entities, ask) in enumerate(_said_and_asked(batch)):
                if doc != document or ord_ != at:
                    place()
                    if doc != document:
                        end()
                        document, held = doc, _Names()
                    at = ord_
                said += [(e, chunk, last) for e in entities]
                if ask is not None:
                    asked.append(((batch, i), chunk, ask))
            yield from ready()
        place()
        end()
        yield from ready()

    package_on_workers(rows.sparkSession)
    return rows.mapInArrow(run, kinds)


def scoped(asks: DataFrame, rows: DataFrame) -> DataFrame:
    """document, chunk_id, ids, carry, low, cands (see _in_order) for asks
    (document, chunk_id, names, carry): for each of the names the entity that it
    stands for in its chunk, by the names that are known up to there, or null.
    If a chunk id comes twice its last place holds.

    One ordered pass: a document's entities and asks are dealt to one task and
    sorted, by Spark, which spills; the task goes through them and holds the
    different names of the document at hand.
    """
    entity = F.struct("place", "entity_id", "name", F.lower("name").alias("low"), _keys(F.col("aliases")).alias("aliases"))
    said = rows.select("document", "chunk_id", F.col("chunk_ord").cast("long").alias("ord"), F.array(entity).alias("said"))
    both = said.unionByName(asks.select("document", "chunk_id", "names", F.transform("names", F.lower).alias("lows"), "carry"), allowMissingColumns=True).repartition("document")
    last = F.max("ord").over(Window.partitionBy("document", "chunk_id"))
    # Names of a chunk without entities stand for none; where they come is open.
    both = both.withColumn("last", F.coalesce("ord", F.lit(-1)) == F.coalesce(last, F.lit(-1))).withColumn("ord", F.coalesce("ord", last, F.lit(-1)))
    return _in_order(both.sortWithinPartitions("document", "ord"))


def scoped_chunks(chunks: DataFrame) -> DataFrame:
    """As scoped for chunks (document, chunk_ord, chunk_id, said, names, carry)
    that hold both their entities (with_entities) and what is asked.

    If they are dealt by document already they aren't moved.
    """
    rows = chunks.withColumn("ord", F.col("chunk_ord").cast("long")).withColumn("lows", F.transform("names", F.lower))
    # Rows of the same chunk; dealt by document, since the pass goes by that.
    same = Window.partitionBy("document").orderBy("chunk_id").rangeBetween(Window.currentRow, Window.currentRow)
    rows = rows.withColumn("at", F.coalesce(F.max(F.when(F.size("said") > 0, F.col("ord"))).over(same), "ord"))
    row = lambda ord_, last, *fields: F.struct(F.col(ord_).alias("ord"), F.lit(last).alias("last"), *[F.col(c) if c in fields else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("said", "names", "lows", "carry")])
    asked = ("names", "lows", "carry")
    parts = F.when(F.col("at") == F.col("ord"), F.array(row("ord", True, "said", *asked))).otherwise(F.array(row("ord", False, "said"), row("at", True, *asked)))
    return _in_order(rows.select("document", "chunk_id", F.inline(parts)).sortWithinPartitions("document", "ord"))


def _in_document(names: DataFrame, known: DataFrame, rows: DataFrame) -> DataFrame:
    """document, chunk_id, name, entity_id of names that no chunk's scope has:
    the only entity of the document with that name (known: document, low,
    cands); of several the one that shares most chunks with the entities of
    this chunk (smallest id on a tie)."""
    met = names.withColumn("low", F.lower("name")).join(known, ["document", "low"]).select("document", "chunk_id", "name", "cands")
    only = met.where(F.size("cands") == 1).select("document", "chunk_id", "name", F.col("cands")[0].alias("entity_id"))
    if known.where(F.size("cands") > 1).isEmpty():
        return only
    several = pinned(met.where(F.size("cands") > 1).select("document", "chunk_id", "name", F.explode("cands").alias("cand")))
    chunks = pinned(rows.groupBy("document", "chunk_id", "entity_id").agg(F.max("chunk_ord").alias("ord")))
    last = Window.partitionBy("document", "chunk_id")
    near = chunks.withColumn("last", F.max("ord").over(last)).where("ord = last").select("document", "chunk_id", F.col("entity_id").alias("near"))
    met = pinned(several.join(near, ["document", "chunk_id"]).where("near <> cand"))
    # Chunks that two entities share are counted once for each two, not for
    # each name that asks for them.
    of = lambda c: chunks.select("document", F.col("entity_id").alias(c), F.col("chunk_id").alias("shared"))
    shared = met.select("document", "cand", "near").distinct().join(of("cand"), ["document", "cand"]).join(of("near"), ["document", "near", "shared"])
    shared = shared.groupBy("document", "cand", "near").agg(F.count(F.lit(1)).alias("n"))
    scored = met.join(pinned(shared), ["document", "cand", "near"]).groupBy("document", "chunk_id", "name", "cand").agg(F.sum("n").alias("overlap"))
    best = scored.groupBy("document", "chunk_id", "name").agg(F.min_by("cand", F.struct(-F.col("overlap"), "cand")).alias("entity_id"))
    return only.unionByName(best)


def resolve(names: DataFrame, rows: DataFrame) -> DataFrame:
    """document, chunk_id, name, entity_id for the names that can be resolved:
    in the chunk's scope, or else in the document (see scoped, _in_document)."""
    asked = names.groupBy("document", "chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    pairs = F.arrays_zip(F.col("carry").alias("name"), F.col("ids").alias("entity_id"))
    # What several steps read is written once, not computed for each.
    found = pinned(scoped(asked.withColumn("carry", F.col("names")), rows).select("document", "chunk_id", pairs.alias("pairs"), "low", "cands"))
    each = found.where("pairs is not null").select("document", "chunk_id", F.inline("pairs"))
    rest = each.where("entity_id is null").drop("entity_id")
    return each.where("entity_id is not null").unionByName(_in_document(rest, found.where("cands is not null").select("document", "low", "cands"), rows))


def evidence_fold(quotes: Column) -> Column:
    """Quotes joined by " || " unless they are part of it already, cut to
    EVIDENCE_CHARS after every step."""

    def add(held: Column, quote: Column) -> Column:
        more = F.when(held == "", quote).otherwise(F.concat(held, F.lit(" || "), quote))
        return F.when((quote == "") | held.contains(quote), held).otherwise(F.left(more, F.lit(EVIDENCE_CHARS)))

    return F.aggregate(quotes, F.lit(""), add)


def relations(extractions: DataFrame, rows: DataFrame, types: list[str]) -> DataFrame:
    """One row per document and claim (source, type, target)."""
    claim = lambda r: F.struct(stripped(r["source"]).alias("source"), stripped(r["target"]).alias("target"), type_name(r["type"]).alias("type"), F.left(F.coalesce(r["evidence"], F.lit("")), F.lit(EVIDENCE_CHARS)).alias("evidence"), clamped(F.coalesce(r["confidence"], F.lit(0.5))).alias("confidence"))
    usable = lambda c: (F.coalesce(c["source"], F.lit("")) != "") & (F.coalesce(c["target"], F.lit("")) != "") & F.coalesce(c["type"].isin(*types), F.lit(False))
    made = extractions.withColumn("carry", F.struct("chunk_ord", F.filter(F.transform("relations", lambda r, i: F.struct(i.alias("place"), claim(r).alias("c"))), lambda r: usable(r["c"])).alias("rs"))).drop("relations")
    made = made.withColumn("names", F.when(F.size("carry.rs") > 0, F.flatten(F.transform("carry.rs", lambda r: F.array(r["c"]["source"], r["c"]["target"])))))
    found = scoped_chunks(made) if "said" in made.columns else scoped(made.where("names is not null").select("document", "chunk_id", "names", "carry"), rows)
    # A name is kept where it stands for none.
    lost = lambda r, c, at: F.when(at.isNull(), r["c"][c]).alias(c)
    end = lambda r, s, t: F.struct(r["place"].alias("place"), lost(r, "source", s), lost(r, "target", t), *[r["c"][c].alias(c) for c in ("type", "evidence", "confidence")], s.alias("source_id"), t.alias("target_id"))
    ends = F.transform("carry.rs", lambda r, i: end(r, F.get("ids", 2 * i), F.get("ids", 2 * i + 1)))
    found = pinned(found.select("document", "chunk_id", F.col("carry.chunk_ord").alias("chunk_ord"), ends.alias("ends"), "low", "cands"))
    raw = found.where("ends is not null").select("document", "chunk_ord", "chunk_id", F.inline("ends"))
    done = raw.where("source_id is not null and target_id is not null").drop("source", "target")
    known = found.where("cands is not null").select("document", "low", "cands")
    if not known.isEmpty():
        open_ = raw.where("source_id is null or target_id is null")
        lost = open_.where("source is not null").select("document", "chunk_id", F.col("source").alias("name")).unionByName(open_.where("target is not null").select("document", "chunk_id", F.col("target").alias("name"))).distinct()
        wide = _in_document(lost, known, rows)
        for c in ("source", "target"):
            end = wide.select("document", "chunk_id", F.col("name").alias(c), F.col("entity_id").alias(f"{c}_wide"))
            open_ = open_.join(end, ["document", "chunk_id", c], "left").withColumn(f"{c}_id", F.coalesce(f"{c}_id", f"{c}_wide")).where(f"{c}_id is not null")
        done = done.unionByName(open_.select(*done.columns))
    # By document: its rows come one after the other, in which they take least room.
    raw = done.repartition("document")
    out = raw.groupBy("document", "source_id", "type", "target_id").agg(F.array_distinct(_ordered("chunk_id")).alias("source_chunks"), F.max("confidence").alias("confidence"), evidence_fold(_ordered("evidence")).alias("evidence"))
    return out.withColumn("id", content_id(F.col("source_id"), F.col("type"), F.col("target_id")))
