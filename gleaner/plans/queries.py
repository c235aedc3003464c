"""Queries over the synthetic tables, each with one operator as its point."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import bandit, browse, chunks, discover, graph, kg, search
from ..sources import bulk, store
from ..sources.staging import forget_at_end, pinned, shared_dir
from ..sources.text_index import TextIndex
from ..streaming import rewards
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Similar enough: the synthetic vectors have no closer pairs.
NEAR = 0.3
ARMS = ("click", "error", "purchase", "signup", "view", "none")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sections(s, d):
    return T.documents(s, d).select(F.col("id").alias("document_id"), F.lit(0).alias("section"), "path", F.col("path").alias("heading"), "text")


@query
def chunk_documents(s, d):
    out = chunks.chunk(_sections(s, d))
    return out.select("document_id", "position", "id", F.length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query
def chunk_next_links(s, d):
    return chunks.next_links(chunks.chunk(_sections(s, d)), "document_id", "position", "id")


@query
def conversation_next_links(s, d):
    turns = T.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id", "turn")
    return chunks.next_links(turns, "conv_id", "turn", "node")


@query
def document_ids_and_hash(s, d):
    docs = T.documents(s, d)
    return docs.select(F.col("id").alias("doc_id"), C.content_id(F.col("corpus"), F.col("path")).alias("id"), F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(16)).alias("content_hash"))


@query
def path_distances(s, d):
    docs = T.documents(s, d).select("path", F.col("id").alias("doc_id"))
    other = F.concat(F.lit("en/src"), (F.col("doc_id") % 20).cast("string"), F.lit("/a/b.txt"))
    return docs.select("doc_id", F.round(C.path_distance(F.col("path"), other), 6).alias("distance"))


@query
def noise_and_length_filter(s, d):
    docs = T.documents(s, d)
    path = F.concat(F.element_at(F.array(*map(F.lit, ("docs/diffs/", "a/dist/", "dist/", "x/"))), (F.col("id") % 4 + 1).cast("int")), F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, ".json").otherwise(".md"))
    return docs.withColumn("doc_path", path).where(~C.noisy(F.col("doc_path")) & (F.length("text") >= 80)).select("id", "doc_path")


@query
def hash_order_sample(s, d):
    rows = T.vectors(s, d)
    return discover.sampled(rows, 240, 120, seed=7).select("id", "doc_path")


def _query_vector() -> list[float]:
    return [((7 * k) % 13 - 6) / 6 for k in range(64)]


@query
def vector_topk_post_filter(s, d):
    return search.vector_top_k(T.vectors(s, d), _query_vector(), 25, F.col("doc_path").startswith("d1/"), "post").select("id", "score")


@query
def vector_topk_pre_filter(s, d):
    return search.vector_top_k(T.vectors(s, d), _query_vector(), 25, F.col("doc_path").startswith("d1/"), "pre").select("id", "score")


@query
def vector_index_exact(s, d):
    keep = F.col("doc_path").startswith("d1/")
    return T.vector_index(s, d).search(_query_vector(), 25, keep=keep).select("id", "score")


@query
def vector_neighbors(s, d):
    """The ten nearest others of each vector whose id is divisible by 50."""
    return T.vector_index(s, d).search_many(T.vectors(s, d).where("id % 50 = 0"), 10).select("query", "id", "place")


@query
def similarity_pairs_band(s, d):
    return discover.similar_pairs(T.vectors(s, d), NEAR, 0.4)


@query
def bridge_candidates(s, d):
    return discover.bridges(T.vectors(s, d), NEAR, 50)


@query
def outlier_scores(s, d):
    return discover.outliers(T.vectors(s, d))


@query
def hub_connectivity(s, d):
    return discover.hubs(T.vectors(s, d), NEAR)


@query
def contradiction_candidates(s, d):
    """Pairs of one entity have the score 0.85; similar pairs are of two documents."""
    near = discover.cross_document_pairs(T.vectors(s, d), NEAR, 0.45, k=30)
    near = near.select("a", "b", F.col("similarity").alias("score"), F.lit("embedding").alias("source"))
    shared = discover.cooccurrences(T.mentions(s, d), 20, seed=3, parts=T.parts(s, d)).select("a", "b", F.lit(0.85).alias("score"), F.lit("entity").alias("source"))
    return near.unionByName(shared).orderBy(F.desc("score"), "a", "b", "source").limit(30)


@query
def entity_cooccurrence_bridge(s, d):
    return discover.cooccurrences(T.mentions(s, d), 50, seed=1, parts=T.parts(s, d))


@query
def entity_hubs(s, d):
    return discover.entity_hubs(T.mentions(s, d))


@query
def entity_gaps(s, d):
    incoming = T.relations(s, d).select(F.col("target").alias("entity"))
    lines = T.table(s, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("chunk"))
    kinds = T.table(s, d, "part").select(F.col("p_partkey").alias("entity"), C.type_name(F.col("p_type")).alias("type"))
    return discover.entity_gaps(incoming, lines, kinds)


@query
def entity_neighbors(s, d):
    return graph.neighbors(T.relations(s, d), T.table(s, d, "part").select(F.col("p_partkey").alias("id")), 5)


@query
def chunks_for_entity(s, d):
    return graph.chunks_of(T.mentions(s, d), T.table(s, d, "part").select(F.col("p_partkey").alias("id")), T.parts(s, d))


@query
def entities_for_chunk(s, d):
    return graph.entities_of(T.mentions(s, d), T.table(s, d, "orders").select(F.col("o_orderkey").alias("id")))


@query
def follow_refs(s, d):
    # The seeds themselves aren't found, so they are one status of three.
    return graph.hops(T.mentions(s, d), T.relations(s, d), T.table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")))


@query
def entity_walk(s, d):
    return graph.walk(T.mentions(s, d), T.relations(s, d), T.table(s, d, "part").select(F.col("p_partkey").alias("id")), parts=T.parts(s, d))


@query
def unprocessed_documents(s, d):
    orders = T.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc"))
    return graph.unprocessed(orders, T.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")))


@query
def dirty_entities(s, d):
    part = T.table(s, d, "part")
    stamp = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "1996-01-01").otherwise("2100-01-01")
    seen = T.table(s, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"))
    return graph.dirty(part.select(F.col("p_partkey").alias("id"), stamp.alias("synthesized_at")), seen)


@query
def graph_stats(s, d):
    docs = T.documents(s, d)
    return browse.sizes(corpora=docs.select("corpus").distinct(), documents=docs, chunks=T.table(s, d, "embeddings"), entities=T.table(s, d, "part"), relations=T.relations(s, d))


@query
def entity_stats(s, d):
    return browse.entity_counts(T.table(s, d, "part").select(F.col("p_partkey").alias("entity")), T.mentions(s, d), T.relations(s, d))


def _derived(s, d):
    """insight, chunk: an insight for each customer from its orders."""
    return T.table(s, d, "orders").select(F.col("o_custkey").alias("insight"), F.col("o_orderkey").alias("chunk"))


@query
def insight_browse_sources(s, d):
    found = T.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    chunk_paths = T.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderpriority"), F.lit("/"), F.col("o_orderstatus")).alias("path"))
    out = graph.sources_of(found, _derived(s, d), chunk_paths)
    return out.select("id", "score", F.array_join("paths", ";").alias("paths"))


@query
def already_bridged_pairs(s, d):
    among = T.table(s, d, "orders").where("o_orderpriority like '1%' or o_orderpriority like '2%'").select(F.col("o_orderkey").alias("id"))
    return discover.bridged_pairs(_derived(s, d).withColumnRenamed("chunk", "source"), among)


@query
def meta_pairs_anti(s, d):
    rows = T.insights(s, d)
    bridged = discover.similar_pairs(rows, NEAR).where("(a + b) % 3 = 0").select("a", "b")
    return discover.meta_pairs(rows, bridged, NEAR)


@query
def shared_entities(s, d):
    pairs = T.table(s, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    out = discover.shared_entities(T.mentions(s, d), _derived(s, d), F.col("a"), F.col("b"), pairs, T.parts(s, d))
    return out.select("a", "b", F.concat_ws(",", F.transform("shared", lambda x: x.cast("string"))).alias("shared"))


WORDS = "the idiot worthless entre nicht para token"


def _texts(s, d):
    return T.text_index(s, d, "documents", T.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query
def fulltext_bm25(s, d):
    return _texts(s, d).search(WORDS, None)


@query
def fulltext_after_updates(s, d):
    """The index of texts of which a third were others, and some weren't there."""
    docs = T.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    part = F.pmod(F.xxhash64("id"), F.lit(9))
    before = docs.where(part > 0).withColumn("text", F.when(part < 4, F.concat(F.lit("the idiot "), F.reverse("text"))).otherwise(F.col("text")))
    gone = docs.select((-1 - F.col("id")).alias("id"), F.lit("token para nicht").alias("text")).where("id % 10 = 0")
    path = f"{shared_dir(s)}/text-updates-{uuid.uuid4().hex}"
    index = TextIndex(s, path)
    forget_at_end(s, path)
    index.build(before.unionByName(gone))
    index.update(docs.where(part == 0), gone)
    index.update(docs.where(part.between(1, 3)), before.where(part.between(1, 3)))
    return index.search(WORDS, None)


@query
def entity_fulltext(s, d):
    part = T.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    hits = T.text_index(s, d, "part", part).search("STEEL Brand#12 1 7 42", 20)
    degree = T.mentions(s, d).groupBy(F.col("entity").alias("id")).agg(F.count(F.lit(1)).alias("mentions"))
    return hits.join(degree, "id", "left").fillna(0, ["mentions"])


@query
def hybrid_fusion(s, d):
    e = T.vectors(s, d)
    near = search.vector_top_k(e, _query_vector(), 8).select("id", "score")
    words = _texts(s, d).search(WORDS, 8)
    found = search.vector_top_k(e, _query_vector()[::-1], 5).select("id", "score")
    named = T.mentions(s, d).where("entity = 7").select(F.col("chunk").alias("id"), F.lit(0.0).alias("score")).distinct().orderBy("id").limit(3)
    facet = search.vector_top_k(e, [-x for x in _query_vector()], 5).select("id", "score")
    return search.fuse({1: near, 2: words, 3: found, 4: named, 5: facet}, seen=[-1], k=15)


def _arms(s):
    return s.range(1).select(F.explode(F.array(*map(F.lit, ARMS))).alias("arm"))


@query
def bandit_posteriors(s, d):
    return bandit.posteriors(T.rewards(s, d), _arms(s))


@query
def bandit_weighted_feedback(s, d):
    labels = T.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    of = T.rewards(s, d).select("id", "arm")
    log = T.rewards(s, d).withColumn("score", bandit.discounted(F.col("score"), F.col("id") % 2 == 0, F.col("id") % 3 != 0))
    human = bandit.human_feedback(labels, of)
    answers = bandit.answer_feedback(labels.where("score = 1").select("id"), of, 0.8)
    return bandit.posteriors(log.select("arm", "score", "weight").unionByName(human).unionByName(answers), _arms(s))


@query
def bandit_running_posterior(s, d):
    return bandit.running(T.rewards(s, d))


@query
def ucb1_scores(s, d):
    out = bandit.ucb1(T.rewards(s, d), _arms(s))
    return out.withColumn("score", F.when(F.col("visits") == 0, 1e9).otherwise(F.col("score")))


@query
def uct_scores(s, d):
    e = T.table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("visits"), F.sum("value").alias("total"))
    n = T.table(s, d, "events").agg(F.count(F.lit(1)).alias("n"))
    return e.crossJoin(F.broadcast(n)).select("user_id", F.round(C.uct(F.col("total"), F.col("visits"), F.col("n")), 6).alias("score"))


@query
def tree_rollup(s, d):
    return graph.rollup(*T.tree(s, d))


@query
def best_path(s, d):
    return graph.best_path(*T.tree(s, d))


KINDS = ["THING", "CONCEPT"]


def _extracted(s, d, twice=False):
    """Extractions, written first if they are read twice, and their entities."""
    x = pinned(T.extractions(s, d)) if twice else T.extractions(s, d)
    return x, kg.entity_rows(x, "c1", KINDS)


@query
def entity_fold(s, d):
    out = kg.entities(_extracted(s, d)[1], "c1")
    return out.select("document", "id", "name", "entity_type", "description", F.array_join("aliases", ",").alias("aliases"))


@query
def mention_fold(s, d):
    out = kg.mentions(_extracted(s, d)[1])
    return out.select("document", "chunk_id", "entity_id", "id", "name_as_extracted", "description", F.array_join("aliases", ",").alias("aliases"))


@query
def alias_resolution(s, d):
    x, rows = _extracted(s, d, twice=True)
    names = x.select("document", "chunk_id", F.explode("relations").alias("r"))
    names = names.select("document", "chunk_id", F.col("r.source").alias("name")).unionByName(names.select("document", "chunk_id", F.col("r.target").alias("name")))
    return kg.resolve(names, rows)


@query
def relation_fold(s, d):
    x, rows = _extracted(s, d)
    out = kg.relations(kg.with_entities(x, "c1", KINDS), rows, ["GOES_WITH"])
    return out.select("document", "source_id", "target_id", "id", F.array_join("source_chunks", ",").alias("source_chunks"), F.round("confidence", 6).alias("confidence"), "evidence")


@query
def keyed_merge_entity(s, d):
    part = T.table(s, d, "part")
    rows = lambda k: part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(f" {k}")).alias("name"), F.repeat(F.lit(k), (F.col("p_size") % (3 if k == "o" else 4)).cast("int")).alias("description"), F.array(F.lit(k), F.lit("both")).alias("aliases"))
    # Each part is on one side at least, some are on both; lists may be null.
    lists = F.when(F.col("id") % 5 > 0, F.col("aliases")).alias("aliases")
    old, new = (x.select("id", "name", "description", lists) for x in (rows("o").where("id % 3 <> 0"), rows("n").where("id % 3 <> 1")))
    out = store.merge_entities(old, new)
    return out.select("id", "name", "description", F.array_join("aliases", ",").alias("aliases"))


@query
def keyed_merge_relation(s, d):
    r = T.relations(s, d).select(F.concat_ws(":", "source", "type", "target").alias("id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), "type", F.col("confidence"), F.lit("quote").alias("evidence"), F.array(F.col("type")).alias("source_chunks"))
    # Each relation is on one side at least, some are on both.
    new = r.where("target_id % 3 <> 1").withColumn("confidence", F.lit(0.05)).withColumn("evidence", F.lit("later")).withColumn("source_chunks", F.array(F.lit("x"), F.col("type")))
    # Parts of one size aren't known as ends, so new relations of theirs stay out.
    ends = T.table(s, d, "part").where("p_size <> 7").select(F.col("p_partkey").alias("id")).unionByName(T.table(s, d, "supplier").select((-F.col("s_suppkey")).alias("id")))
    out = store.merge_relations(r.where("target_id % 3 <> 0"), new, ends)
    return out.select("id", "confidence", "evidence", F.array_join("source_chunks", ",").alias("source_chunks"))


@query
def update_by_key(s, d):
    old = T.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("layer"), "c_name")
    new = T.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderstatus").alias("layer"))
    return store.update(old, new, only_null=True)


@query
def last_write_and_insert_only(s, d):
    part = T.table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    new = part.where("id % 3 = 0").select("id", F.upper("p_name").alias("p_name")).unionByName(part.where("id < 10").select((-F.col("id")).alias("id"), "p_name"))
    return store.last_write(part, new).withColumn("how", F.lit("last")).unionByName(store.insert_only(part, new).withColumn("how", F.lit("insert")))


@query
def type_name_sanitizer(s, d):
    part = T.table(s, d, "part")
    raw = F.concat(F.when(F.col("p_size") % 5 == 0, "9-").otherwise(" "), F.col("p_brand"), F.lit("--"), F.col("p_type"), F.lit(" !_"))
    return part.select(F.col("p_partkey").alias("id"), C.type_name(raw).alias("name"))


@query
def lenient_json(s, d):
    e = T.table(s, d, "events")
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.col("props"), F.lit(" }{")))
    return e.select("event_id", F.try_variant_get(C.lenient_json(wrapped), "$.k", "long").alias("k"))


@query
def top_insights_per_strategy(s, d):
    return browse.best_of_each(T.insights(s, d).select("id", "strategy", "score"), "strategy", 20)


@query
def last_evidence(s, d):
    """The last three of each customer's orders, in order."""
    rows = _derived(s, d).groupBy("insight").agg(F.array_sort(F.collect_list("chunk")).alias("ids"))
    return rows.select("insight", F.array_join(C.last_n(F.col("ids"), 3), ",").alias("last"))


@query
def typed_keys(s, d):
    key = F.concat(F.element_at(F.array(*map(F.lit, ("chunk", "insight", "entity"))), (F.col("vec_id") % 3 + 1).cast("int")), F.lit(":"), F.col("vec_id").cast("string"), F.lit(":x"))
    kind, id_ = bulk.typed(key)
    return T.table(s, d, "embeddings").select("vec_id", kind.alias("kind"), id_.alias("key"))


# Listings and look-ups


def _insights(s, d):
    """Vectors as findings of two corpora and two layers, some without either."""
    text = F.concat(F.lit("finding "), F.col("id").cast("string"))
    corpus = F.element_at(F.array(F.lit("c1"), F.lit("c2"), F.lit(""), F.lit(None).cast("string")), (F.col("id") % 4 + 1).cast("int"))
    return T.insights(s, d).withColumns({"text": text, "corpus_id": corpus, "layer": F.when(F.col("id") % 6 > 0, (F.col("id") % 6 > 4).cast("int") + 1)})


@query
def node_lookup(s, d):
    found = browse.nodes(chunk=T.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), entity=T.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))
    asked = T.table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("asked"))
    return browse.by_ids(found, asked).select("asked", "id", "label", F.length("text").alias("n_chars"))


@query
def corpus_or_unscoped(s, d):
    return browse.in_corpus(_insights(s, d), "c1", or_none=True).select("id", "strategy")


@query
def insight_browse(s, d):
    rows = browse.chosen(_insights(s, d), corpus_id="c2", strategy="")
    chunk_paths = T.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderpriority"), F.lit("/"), F.col("o_orderstatus")).alias("path"))
    return graph.sources_of(rows, _derived(s, d), chunk_paths).select("id", "score", F.array_join("paths", ";").alias("paths"))


@query
def insight_vector_topk(s, d):
    return search.insight_top_k(_insights(s, d), _query_vector(), 40, "c1").select("id", "strategy", "score", "layer", "similarity")


@query
def insight_sample(s, d):
    sources = _derived(s, d).withColumnRenamed("chunk", "source")
    out = browse.sampled_insights(_insights(s, d), sources, 50, 1, seed=5)
    return out.select("id", "strategy", F.array_join("sources", ",").alias("sources"))


@query
def missing_embeddings(s, d):
    rows = T.vectors(s, d).withColumn("embedding", F.when(F.col("id") % 4 > 0, F.col("embedding")))
    return browse.to_embed(rows, limit=100).select("id", F.length("text").alias("n_chars"))


@query
def follow_links(s, d):
    turns = T.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id", "turn")
    # Two ways on from each turn: to the next one, and to the one after that.
    links = chunks.next_links(turns, "conv_id", "turn", "node")
    far = links.join(links.select(F.col("id").alias("next_id"), F.col("next_id").alias("after")), "next_id").select("id", F.col("after").alias("next_id"))
    seeds = turns.select(F.col("node").alias("id")).unionByName(T.table(s, d, "customer").select(F.col("c_custkey").alias("id")))
    return browse.follow(seeds, links.unionByName(far), _derived(s, d).withColumnRenamed("chunk", "source"))


@query
def evaluation_context(s, d):
    found = _derived(s, d).groupBy(F.col("insight").alias("id")).agg(F.array_sort(F.collect_list("chunk")).alias("sources"))
    texts = T.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    names = T.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_size") % 2 == 0, "Type ").otherwise("type "), F.col("p_type")).alias("name"), F.col("p_brand").alias("entity_type"))
    names = names.unionByName(T.table(s, d, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("entity_type")))
    out = browse.contexts(found, texts, T.mentions(s, d), T.relations(s, d), names, chars=8, parts=T.parts(s, d))
    return out.select("id", *[F.array_join(c, ";").alias(c) for c in ("texts", "entities", "paths")])


@query
def evidence_texts(s, d):
    held = _derived(s, d).groupBy(F.col("insight").alias("node")).agg(F.array_sort(F.collect_list("chunk")).alias("ids"))
    texts = T.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    return browse.evidence_texts(held, texts, 5, 6)


@query
def two_channel_quota(s, d):
    first = T.table(s, d, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_acctbal").alias("score")).where("score > 9000")
    second = T.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return browse.quota(first, second, 41)


@query
def budgeted_work(s, d):
    pending = T.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source").alias("path"))
    first, remaining = browse.budgeted(pending, 123, "path", "id")
    return first.crossJoin(F.broadcast(remaining))  # one row


@query
def text_forms(s, d):
    part = T.table(s, d, "part")
    raw = F.concat(F.col("p_type"), F.lit(" (+"), F.col("p_brand"), F.lit(") "), F.col("p_size").cast("string"))
    blank = F.when(F.col("p_size") % 3 == 0, " ").when(F.col("p_size") % 3 == 1, F.col("p_name"))
    arm = F.concat(F.col("p_brand"), F.element_at(F.array(F.lit("_discovery"), F.lit("_detection"), F.lit("_other")), (F.col("p_size") % 3 + 1).cast("int")))
    return part.select(F.col("p_partkey").alias("id"), C.escaped_query(raw).alias("escaped"), C.embedding_text(blank).alias("to_embed"), C.entity_text(F.col("p_name"), F.col("p_type")).alias("entity"), C.arm_name(arm).alias("arm"), C.shortened(blank, 4).alias("short"), C.hop(F.col("p_name"), C.type_name(F.col("p_type")), F.col("p_brand")).alias("hop"))


@query
def transient_errors(s, d):
    e = T.table(s, d, "events")
    code = F.element_at(F.array(*[F.lit(x).cast("int") for x in (200, 404, 429, 500, 502, 503, 504, None)]), (F.col("event_id") % 8 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("timeout", "connect", "read", "status", "other"))), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select("event_id", C.transient(code, kind).alias("again"))


@query
def grounding_filter(s, d):
    rows = _insights(s, d)
    verdict = F.element_at(F.array(*map(F.lit, ("support", "contradict", "unsupported"))), (F.col("id") % 3 + 1).cast("int"))
    rows = rows.withColumns({"verdict": verdict, "sure": (F.col("id") % 11) / 10})
    kept = rows.where(~C.contradicted(F.col("layer"), F.col("verdict"), F.col("sure")))
    reward = bandit.discounted(F.col("score"), F.lit(True), F.col("verdict") != "unsupported")
    return kept.select("id", "verdict", F.round(reward, 6).alias("reward"))


@query
def bandit_bernoulli(s, d):
    return bandit.posteriors(T.rewards(s, d), _arms(s), "bernoulli")


@query
def reward_stream_posteriors(s, d):
    """The posteriors of a log that is read as a stream, all there is of it."""
    import uuid

    # A pattern may name a file; a path without one has to be a folder.
    events = s.readStream.schema(T.table(s, d, "events").schema).parquet(f"{d}/event[s].parquet")
    log = events.select(F.lit("c").alias("corpus"), F.concat("event_type", F.lit("_discovery")).alias("strategy"), (F.col("value") / 100).alias("score"), F.lit(1.0).alias("weight"))
    key = uuid.uuid4().hex
    out = rewards.refresh(log, f"{shared_dir(s)}/stream-{key}", f"posteriors_{key}")
    return out.select("arm", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


@query
def known_sources(s, d):
    """Edges from insights to chunks, without those whose chunk isn't known."""
    edges = T.table(s, d, "lineitem").select(F.col("l_suppkey").alias("insight"), F.col("l_partkey").alias("source")).distinct()
    return store.known(edges, "source", T.table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))).select("insight", "source")


@query
def update_overwrite(s, d):
    old = T.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("description"), F.lit("").alias("stamp"), "c_name")
    new = T.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.nullif(F.max("o_orderstatus"), F.lit("P")).alias("description"), F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("stamp"))
    return store.update(old, new)


@query
def bulk_results(s, d):
    """Result lines of a bulk job, some of which can't be used."""
    e = T.table(s, d, "embeddings").select(F.element_at(F.array(*map(F.lit, ("chunk", "insight", "entity"))), (F.col("vec_id") % 3 + 1).cast("int")).alias("kind"), "vec_id", F.slice("embedding", 1, 4).alias("e"))
    key = F.when(F.col("vec_id") % 7 > 0, F.concat_ws(":", "kind", F.col("vec_id").cast("string"), F.lit("x")))
    values = F.when(F.col("vec_id") % 5 > 0, F.col("e")).otherwise(F.array().cast("array<float>"))
    line = F.to_json(F.struct(key.alias("key"), F.struct(F.array(F.struct(values.alias("values"))).alias("embeddings")).alias("response")))
    out = bulk.results(e.select(F.when(F.col("vec_id") % 11 > 0, line).otherwise(F.left(line, F.lit(30))).alias("value")))
    return out.select("kind", "id", F.size("embedding").alias("n"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))
