"""The queries in DuckDB's SQL, over views of the same tables."""

from __future__ import annotations

_DOCS = "docs AS (SELECT doc_id AS id, lang AS corpus, lang || '/' || source || '/' || doc_id || '.txt' AS path, text FROM documents)"
_VEC = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, 'd' || (label % 3) || '/f' || label || '.md' AS doc_path, (vec_id % 450)::DOUBLE AS len FROM embeddings)"
_MENT = "ment AS (SELECT DISTINCT l_partkey AS entity, l_orderkey AS chunk, o_custkey AS doc, 'c' || (o_custkey % 10) || '/' || o_custkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_REL = "rel AS (SELECT -l_suppkey AS source, l_partkey AS target, l_returnflag AS type, max(l_discount) AS confidence FROM lineitem GROUP BY ALL)"
_INS = "ins AS (SELECT vec_id AS id, ['bridge', 'outlier', 'hub', 'gap'][label % 4 + 1] AS strategy, round((vec_id % 17) / 17, 6) AS score, embedding::DOUBLE[] AS e FROM embeddings)"
_EVENTS = "log AS (SELECT event_id AS id, event_type AS arm, ts, value / 100 AS score, 1.0::DOUBLE AS weight FROM events)"
_ARMS = "arms AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'none']) AS arm)"
_CLAMP = "greatest(0.0, least(1.0, score))"


def _cos(a: str, b: str) -> str:
    return f"(CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END)"


def _dist(a: str, b: str) -> str:
    x, y = (f"list_filter(string_split({p}, '/'), lambda s: s <> '' AND s <> '.')" for p in (a, b))
    same = f"list_transform(list_zip({x}, {y}), lambda z: coalesce(z[1] = z[2], false))"
    shared = f"(CASE WHEN list_contains({same}, false) THEN list_position({same}, false) - 1 ELSE len({x}) END)"
    return f"(CASE WHEN greatest(len({x}), len({y})) = 0 THEN 0.0 ELSE 1.0 - {shared} / greatest(len({x}), len({y})) END)"


def _pairs(least: float, most: float = 1.0, of: str = "vec") -> str:
    return f"pairs AS (SELECT * FROM (SELECT x.id AS a, y.id AS b, round({_cos('x.e', 'y.e')}, 6) AS similarity FROM {of} x JOIN {of} y ON x.id < y.id) WHERE similarity BETWEEN {least} AND {most})"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CHUNKS = rf"""WITH RECURSIVE {_DOCS},
step(id, start, fin) AS (
  SELECT id, 0::BIGINT, 0::BIGINT FROM docs WHERE length(text) > 2000
  UNION ALL
  SELECT id, CASE WHEN fin < n THEN fin - (CASE WHEN start = 0 AND fin = 0 THEN 0 ELSE 200 END) ELSE n END,
         CASE WHEN stop < n AND found > stop - 400 THEN found + 1 ELSE stop END
  FROM (SELECT *, CASE WHEN ln > 0 THEN stop - ln WHEN se > 0 THEN stop - se - 1 ELSE -1 END AS found
        FROM (SELECT *, instr(tail, chr(10)) AS ln, instr(tail, ' .') AS se
              FROM (SELECT s.id, s.start, s.fin, length(d.text) AS n,
                           least((CASE WHEN s.fin = 0 THEN 0 ELSE s.fin - 200 END) + 2000, length(d.text)) AS stop,
                           reverse(substr(d.text, least((CASE WHEN s.fin = 0 THEN 0 ELSE s.fin - 200 END) + 2000, length(d.text)) - 400 + 1, 400)) AS tail
                    FROM step s JOIN docs d USING (id) WHERE s.fin < length(d.text))))),
parts AS (
  SELECT s.id, s.start, {_STRIP.format('substr(d.text, s.start + 1, s.fin - s.start)')} AS text FROM step s JOIN docs d USING (id) WHERE s.fin > 0
  UNION ALL SELECT id, 0, text FROM docs WHERE length(text) <= 2000 AND {_STRIP.format('text')} <> ''),
chunks AS (
  SELECT id AS document_id, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS position, text FROM parts WHERE text <> '')
"""

_LINES = """x AS (
  SELECT o_custkey AS document, o_orderkey AS ord, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place,
         'part ' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'THING' ELSE 'CONCEPT' END AS type, repeat('d', (l_quantity % 9)::INT) AS description,
         'alias' || (p_partkey % 7) AS alias, lead(p_partkey) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS other,
         'quote ' || l_returnflag AS evidence, greatest(0.0, least(1.0, l_quantity / 40)) AS confidence, p_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
rows_ AS (SELECT *, left(sha256('c1:' || type || ':' || name), 20) AS entity_id FROM x),
local_ AS (
  SELECT document, ord, alias AS key, arg_max(entity_id, place) AS entity_id FROM rows_ GROUP BY ALL
  UNION ALL SELECT document, ord, name, any_value(entity_id) FROM rows_ GROUP BY ALL)
"""


def _bm25(docs: str, words: str) -> str:
    return rf"""texts AS ({docs}),
asked AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower('{words}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS word),
words AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM texts),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
tf AS (SELECT id, size, word, count(*) AS tf FROM (SELECT id, len(w) AS size, unnest(w) AS word FROM words) WHERE word IN (SELECT word FROM asked) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
bm25 AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (word), corpus GROUP BY id)"""


_Q = [((7 * k) % 13 - 6) / 6 for k in range(64)]
_BM25_DOCS = _bm25("SELECT doc_id AS id, text FROM documents", "the idiot worthless entre nicht para token")


def _top(query: list[float], k: int, where: str = "true") -> str:
    return f"SELECT id, doc_path, round({_cos('e', f'{query}::DOUBLE[]')}, 6) AS score FROM vec WHERE {where} ORDER BY score DESC, id LIMIT {k}"


_POSTERIOR = """SELECT arm, round(1 + won, 6) AS alpha, round(1 + lost, 6) AS beta, round((1 + won) / (2 + won + lost), 6) AS mean, round(won + lost, 6) AS observations
FROM (SELECT arm, coalesce(sum(greatest(0.0, least(1.0, score)) * weight), 0.0) AS won, coalesce(sum((1 - greatest(0.0, least(1.0, score))) * weight), 0.0) AS lost FROM arms LEFT JOIN {} USING (arm) GROUP BY arm)"""
_COOC = """SELECT entity, a, b, mentions, round(0.7 * (0.5 + 0.5 * {dist}) * (0.5 + 0.5 * least(mentions / 10, 1.0)), 6) AS score FROM (
  WITH one AS (SELECT entity, doc, arg_min(chunk, h) AS chunk, arg_min(path, h) AS path, min(h) AS h FROM (SELECT *, sha256('{seed}:' || entity || ':' || chunk) AS h FROM ment) GROUP BY entity, doc),
  few AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY entity ORDER BY h) <= {most}),
  n AS (SELECT entity, count(*) AS mentions, count(DISTINCT doc)::DOUBLE AS docs FROM ment GROUP BY entity)
  SELECT entity, x.chunk AS a, y.chunk AS b, x.path AS px, y.path AS py, mentions,
    -ln((('0x' || left(sha256('{seed}:' || entity || ':' || x.chunk || ':' || y.chunk), 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) * (least(docs, {most}) * (least(docs, {most}) - 1)) / (docs * (docs - 1)) AS key
  FROM few x JOIN few y USING (entity) JOIN n USING (entity) WHERE x.chunk < y.chunk AND x.doc <> y.doc
  ORDER BY key, entity, a, b LIMIT {k})"""
_SEEN = "both_ AS (SELECT source AS seed, target AS other, type, confidence, source AS from_id, target AS to_id FROM rel UNION ALL SELECT target, source, type, confidence, source, target FROM rel WHERE source <> target)"


def _near(n: int) -> str:
    return f"near AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, other, type, from_id) <= {n})"


_TREE = """node AS (SELECT a.conv_id * 1000 + a.turn AS id, b.conv_id * 1000 + b.turn AS parent, round((coalesce(length(a.text), 0) % 101) / 100, 6) AS score
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
up AS (SELECT id AS node, id AS ancestor, 0 AS hops FROM node UNION ALL SELECT u.node, n.parent, u.hops + 1 FROM up u JOIN node n ON u.ancestor = n.id WHERE n.parent IS NOT NULL)"""

SQL: dict[str, str] = {
    "chunk_documents": _CHUNKS + "SELECT document_id, position, left(sha256(document_id || ':' || position), 20) AS id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM chunks",
    "chunk_next_links": _CHUNKS + "SELECT left(sha256(document_id || ':' || position), 20) AS id, left(sha256(document_id || ':' || (position + 1)), 20) AS next_id FROM chunks c WHERE EXISTS (SELECT 1 FROM chunks d WHERE d.document_id = c.document_id AND d.position = c.position + 1)",
    "conversation_next_links": "SELECT a.conv_id * 1000 + a.turn AS id, min(b.conv_id * 1000 + b.turn) AS next_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn GROUP BY 1",
    "document_ids_and_hash": f"WITH {_DOCS} SELECT id AS doc_id, left(sha256(corpus || ':' || path), 20) AS id, left(sha256(text), 16) AS content_hash FROM docs",
    "path_distances": f"WITH {_DOCS}, q AS (SELECT id, path, 'en/src' || (id % 20) || '/a/b.txt' AS other FROM docs) SELECT id AS doc_id, round({_dist('path', 'other')}, 6) AS distance FROM q",
    "noise_and_length_filter": f"""WITH {_DOCS}, q AS (SELECT id, text, ['docs/diffs/', 'a/dist/', 'dist/', 'x/'][id % 4 + 1] || id || CASE WHEN id % 5 = 0 THEN '.json' ELSE '.md' END AS doc_path FROM docs)
SELECT id, doc_path FROM q WHERE length(text) >= 80 AND NOT (doc_path GLOB 'docs/diffs/*' OR doc_path GLOB '*.json' OR doc_path GLOB 'dist/*')""",
    "hash_order_sample": f"""WITH {_VEC}, drawn AS (SELECT *, sha256('7:' || id) AS o FROM vec ORDER BY o LIMIT 240) SELECT id, doc_path FROM drawn WHERE len >= 80 ORDER BY o LIMIT 120""",
    "vector_topk_post_filter": f"WITH {_VEC}, top AS ({_top(_Q, 25)}) SELECT id, score FROM top WHERE starts_with(doc_path, 'd1/')",
    "vector_topk_pre_filter": f"""WITH {_VEC}, top AS ({_top(_Q, 25, "doc_path LIKE 'd1/%'")}) SELECT id, score FROM top""",
    "vector_index_exact": f"""WITH {_VEC}, top AS ({_top(_Q, 25, "doc_path LIKE 'd1/%'")}) SELECT id, score FROM top""",
    "vector_neighbors": f"""WITH {_VEC} SELECT query, id, place FROM (SELECT x.id AS query, y.id, row_number() OVER (PARTITION BY x.id ORDER BY round({_cos('x.e', 'y.e')}, 6) DESC, y.id) AS place
FROM vec x JOIN vec y ON x.id <> y.id WHERE x.id % 50 = 0) WHERE place <= 10""",
    "similarity_pairs_band": f"WITH {_VEC}, {_pairs(0.3, 0.4)} SELECT * FROM pairs",
    "bridge_candidates": f"""WITH {_VEC}, {_pairs(0.3)},
s AS (SELECT a, b, least(x.doc_path, y.doc_path) AS doc_a, greatest(x.doc_path, y.doc_path) AS doc_b, similarity,
  round(similarity * (0.5 + 0.5 * {_dist('x.doc_path', 'y.doc_path')}) * (0.6 + 0.4 * least((x.len + y.len) / 2 / 400, 1.0)), 6) AS score
  FROM pairs JOIN vec x ON a = x.id JOIN vec y ON b = y.id WHERE x.doc_path <> y.doc_path
  QUALIFY row_number() OVER (PARTITION BY least(x.doc_path, y.doc_path), greatest(x.doc_path, y.doc_path) ORDER BY score DESC, a, b) = 1)
SELECT * FROM s ORDER BY score DESC, a, b LIMIT 50""",
    "outlier_scores": f"""WITH {_VEC}, m AS (SELECT x.id, x.doc_path, x.len, avg({_cos('x.e', 'y.e')}) AS mean FROM vec x JOIN vec y ON x.id <> y.id GROUP BY ALL)
SELECT id, doc_path, round(mean, 6) AS avg_similarity, round((1 - mean) * (0.5 + 0.5 * least(len / 400, 1.0)), 6) AS score FROM m
QUALIFY row_number() OVER (PARTITION BY doc_path ORDER BY score DESC, id) = 1""",
    "hub_connectivity": f"""WITH {_VEC}, {_pairs(0.3)}, d AS (SELECT a AS id, b AS o, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs),
s AS (SELECT d.id, x.doc_path, count(DISTINCT y.doc_path) AS reach, round(sum(round(similarity * 1e6)::BIGINT) / count(*)) / 1e6 AS strength FROM d JOIN vec x ON d.id = x.id JOIN vec y ON o = y.id WHERE x.doc_path <> y.doc_path GROUP BY ALL),
t AS (SELECT id, doc_path, reach, strength, round(reach / (SELECT count(DISTINCT doc_path) - 1 FROM vec) * (0.4 + 0.6 * strength), 6) AS score FROM s)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_path ORDER BY score DESC, id) = 1""",
    "contradiction_candidates": f"""WITH {_VEC}, {_pairs(0.3, 0.45)}, {_MENT}, c AS ({_COOC.format(dist=_dist('px', 'py'), seed=3, k=20, most=7)}),
e AS (SELECT a, b, similarity FROM pairs JOIN vec x ON a = x.id JOIN vec y ON b = y.id WHERE x.doc_path <> y.doc_path)
SELECT a, b, similarity::DOUBLE AS score, 'embedding' AS source FROM e UNION ALL SELECT a, b, 0.85::DOUBLE, 'entity' FROM c ORDER BY score DESC, a, b, source LIMIT 30""",
    "entity_cooccurrence_bridge": f"WITH {_MENT} " + _COOC.format(dist=_dist("px", "py"), seed=1, k=50, most=11),
    "entity_hubs": f"""WITH {_MENT}, top AS (SELECT entity, count(DISTINCT doc) AS docs, min(chunk) AS sample_chunk FROM ment GROUP BY 1 HAVING docs >= 3 ORDER BY docs DESC, entity LIMIT 20)
SELECT entity, docs, sample_chunk, round(least(1.5 * docs / (SELECT count(DISTINCT doc) FROM ment WHERE entity IN (SELECT entity FROM top)), 1.0), 6) AS score FROM top""",
    "entity_gaps": f"""WITH {_REL}, i AS (SELECT target AS entity, count(*) AS incoming FROM rel GROUP BY 1),
m AS (SELECT l_partkey AS entity, count(DISTINCT l_orderkey) AS mentions FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT entity, p_type AS type, incoming, coalesce(mentions, 0) AS mentions, round(least(0.6 + 0.4 * (incoming - coalesce(mentions, 0)) / greatest(incoming, 1), 1.0), 6) AS score
FROM i JOIN part ON entity = p_partkey LEFT JOIN m USING (entity) WHERE incoming >= 2 AND coalesce(mentions, 0) < incoming ORDER BY score DESC, incoming DESC, entity LIMIT 15""",
    "entity_neighbors": f"WITH {_REL}, {_SEEN}, {_near(5)} SELECT * FROM near WHERE seed IN (SELECT p_partkey FROM part)",
    "chunks_for_entity": f"WITH {_MENT} SELECT entity, chunk, doc FROM ment JOIN part ON entity = p_partkey",
    "entities_for_chunk": f"WITH {_MENT} SELECT chunk, entity FROM ment JOIN orders ON chunk = o_orderkey",
    "follow_refs": f"""WITH {_MENT}, {_REL}, {_SEEN}, {_near(3)}, seeds AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'),
own AS (SELECT chunk, entity FROM ment WHERE chunk IN (SELECT id FROM seeds) QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY entity) <= 2),
there AS (SELECT entity, chunk FROM ment QUALIFY row_number() OVER (PARTITION BY entity ORDER BY doc, chunk) <= 2)
SELECT DISTINCT own.chunk AS seed, own.entity, near.type, near.other, there.chunk AS found FROM own JOIN near ON near.seed = own.entity JOIN there ON there.entity = near.other
WHERE there.chunk NOT IN (SELECT id FROM seeds)""",
    "entity_walk": f"""WITH {_MENT}, {_REL}, {_SEEN}, {_near(5)}, r AS (SELECT entity, chunk, row_number() OVER (PARTITION BY entity ORDER BY doc, chunk) AS n FROM ment)
SELECT entity, 0 AS step, chunk FROM r WHERE n <= 2 AND entity IN (SELECT p_partkey FROM part)
UNION SELECT seed, 1, chunk FROM near JOIN r ON other = entity WHERE n = 1 AND seed IN (SELECT p_partkey FROM part)""",
    "unprocessed_documents": "SELECT o_custkey AS doc, count(*) AS pending FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1",
    "dirty_entities": """SELECT p_partkey AS id, max(strftime(l_shipdate, '%Y-%m-%d')) AS last, count(*) AS mentions FROM part JOIN lineitem ON l_partkey = p_partkey
GROUP BY p_partkey, p_size HAVING last > CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '1996-01-01' ELSE '2100-01-01' END""",
    "graph_stats": f"WITH {_REL} SELECT (SELECT count(DISTINCT lang) FROM documents) AS corpora, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM rel) AS relations",
    "entity_stats": f"WITH {_MENT}, {_REL} SELECT p_partkey AS entity, (SELECT count(*) FROM ment WHERE entity = p_partkey) AS mentions, (SELECT count(DISTINCT doc) FROM ment WHERE entity = p_partkey) AS docs, (SELECT count(*) FROM rel WHERE target = p_partkey) AS incoming FROM part",
    "insight_browse_sources": "SELECT c_custkey AS id, c_acctbal AS score, coalesce(string_agg(DISTINCT o_orderpriority || '/' || o_orderstatus, ';' ORDER BY o_orderpriority || '/' || o_orderstatus), '') AS paths FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    "already_bridged_pairs": "SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2') GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) = 2",
    "meta_pairs_anti": f"""WITH {_INS}, {_pairs(0.3, of='ins')}
SELECT a, b, x.strategy AS strategy_a, y.strategy AS strategy_b, similarity, round(similarity * (0.5 + 0.5 * (x.score + y.score) / 2), 6) AS score
FROM pairs JOIN ins x ON a = x.id JOIN ins y ON b = y.id WHERE x.strategy <> y.strategy AND (a + b) % 3 <> 0""",
    "shared_entities": f"""WITH {_MENT}, first AS (SELECT o_custkey AS insight, o_orderkey AS chunk FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3),
names AS (SELECT DISTINCT insight, entity FROM first JOIN ment USING (chunk)), has AS (SELECT DISTINCT insight FROM names)
SELECT c_custkey AS a, c_custkey + 1 AS b, coalesce((SELECT string_agg(x.entity, ',' ORDER BY x.entity) FROM names x JOIN names y USING (entity) WHERE x.insight = c_custkey AND y.insight = c_custkey + 1), '') AS shared
FROM customer WHERE c_custkey IN (SELECT insight FROM has) AND c_custkey + 1 IN (SELECT insight FROM has)""",
    "fulltext_bm25": f"WITH {_BM25_DOCS} SELECT id, score FROM bm25",
    "fulltext_after_updates": f"WITH {_BM25_DOCS} SELECT id, score FROM bm25",
    "entity_fulltext": "WITH " + _bm25("SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part", "STEEL Brand#12 1 7 42") + f", {_MENT}, top AS (SELECT * FROM bm25 ORDER BY score DESC, id LIMIT 20) SELECT id, score, (SELECT count(*) FROM ment WHERE entity = id) AS mentions FROM top",
    "hybrid_fusion": f"""WITH {_VEC}, {_MENT}, {_BM25_DOCS}, c1 AS ({_top(_Q, 8)}), c2 AS (SELECT * FROM bm25 ORDER BY score DESC, id LIMIT 8), c3 AS ({_top(_Q[::-1], 5)}),
c4 AS (SELECT DISTINCT chunk AS id FROM ment WHERE entity = 7 ORDER BY 1 LIMIT 3), c5 AS ({_top([-x for x in _Q], 5)}),
every AS (SELECT id FROM c1 UNION SELECT id FROM c2 UNION SELECT id FROM c3 UNION SELECT id FROM c4 UNION SELECT id FROM c5),
m AS (SELECT id, c1.score AS s1, c2.score AS s2, c3.score * 1.1 AS s3, CASE WHEN c4.id IS NOT NULL THEN 0.8 END AS s4, c5.score AS s5
  FROM every LEFT JOIN c1 USING (id) LEFT JOIN c2 USING (id) LEFT JOIN c3 USING (id) LEFT JOIN c4 USING (id) LEFT JOIN c5 USING (id)),
f AS (SELECT *, coalesce(s3, CASE WHEN s1 IS NULL OR s2 > s1 THEN s2 ELSE s1 END, s4) AS f FROM m)
SELECT id, round(CASE WHEN f IS NULL OR s5 > f THEN s5 ELSE f END, 6) AS score,
  CASE WHEN f IS NULL OR s5 > f THEN 5 WHEN s3 IS NOT NULL THEN 3 WHEN s1 IS NOT NULL AND (s2 IS NULL OR s1 >= s2) THEN 1 WHEN s2 IS NOT NULL THEN 2 ELSE 4 END AS channel
FROM f ORDER BY score DESC, id LIMIT 15""",
    "bandit_posteriors": f"WITH {_EVENTS}, {_ARMS} " + _POSTERIOR.format("log"),
    "bandit_weighted_feedback": f"""WITH {_EVENTS}, {_ARMS}, mixed AS (
  SELECT arm, score * CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.5 END * CASE WHEN id % 3 <> 0 THEN 1.0 ELSE 0.5 END AS score, 1.0 AS weight FROM log
  UNION ALL SELECT arm, greatest(0, least(1, quality)), 3.0 FROM labels JOIN log ON id = doc_id
  UNION ALL SELECT arm, 0.3 * 0.8, 1.0 FROM labels JOIN log ON id = doc_id WHERE quality = 1) """ + _POSTERIOR.format("mixed"),
    "bandit_running_posterior": f"WITH {_EVENTS} SELECT id, arm, round(1 + sum({_CLAMP}) OVER w, 6) AS alpha, round(1 + sum(1 - {_CLAMP}) OVER w, 6) AS beta FROM log WINDOW w AS (PARTITION BY arm ORDER BY ts, id ROWS UNBOUNDED PRECEDING)",
    "ucb1_scores": f"""WITH {_EVENTS}, {_ARMS}, s AS (SELECT arm, count(score) AS visits, coalesce(sum(score), 0.0) AS total FROM arms LEFT JOIN log USING (arm) GROUP BY arm)
SELECT arm, visits, round(CASE WHEN visits > 0 THEN total / visits ELSE 0 END, 6) AS mean,
  CASE WHEN visits = 0 THEN 1e9 ELSE round(total / visits + 1.41 * sqrt(ln((SELECT sum(visits) FROM s)) / visits), 6) END AS score FROM s""",
    "uct_scores": "SELECT user_id, round(sum(value) / count(*) + 1.41 * sqrt(ln((SELECT count(*) FROM events)) / count(*)), 6) AS score FROM events GROUP BY 1",
    "tree_rollup": f"WITH RECURSIVE {_TREE} SELECT ancestor AS id, count(*) AS visits, round(sum(score), 6) AS total FROM up JOIN node ON node.id = up.node GROUP BY 1",
    "best_path": f"WITH RECURSIVE {_TREE}, best AS (SELECT id FROM node ORDER BY score DESC, id LIMIT 1) SELECT max(hops) OVER () - hops AS step, ancestor AS id FROM up WHERE node = (SELECT id FROM best)",
    "entity_fold": f"WITH {_LINES} SELECT document, entity_id AS id, any_value(name) AS name, any_value(type) AS entity_type, max(description) AS description, any_value(alias) AS aliases FROM rows_ GROUP BY document, entity_id",
    "mention_fold": f"WITH {_LINES} SELECT document, ord::VARCHAR AS chunk_id, entity_id, left(sha256(ord || ':' || entity_id), 20) AS id, any_value(name) AS name_as_extracted, max(description) AS description, any_value(alias) AS aliases FROM rows_ GROUP BY document, ord, entity_id",
    "alias_resolution": f"""WITH {_LINES}, names AS (SELECT document, ord, alias AS name FROM rows_ UNION SELECT document, ord, coalesce('PART ' || other, 'PART nobody') FROM rows_)
SELECT document, ord::VARCHAR AS chunk_id, name, entity_id FROM names JOIN local_ USING (document, ord) WHERE key = lower(name)""",
    "relation_fold": f"""WITH {_LINES}, claim AS (
  SELECT r.document, r.ord, r.place, s.entity_id AS source_id, t.entity_id AS target_id, r.confidence, r.evidence FROM rows_ r
  JOIN local_ s ON s.document = r.document AND s.ord = r.ord AND s.key = r.alias JOIN local_ t ON t.document = r.document AND t.ord = r.ord AND t.key = 'part ' || r.other),
c AS (SELECT document, source_id, target_id, string_agg(ord, ',' ORDER BY ord) AS source_chunks FROM (SELECT DISTINCT document, source_id, target_id, ord FROM claim) GROUP BY ALL),
e AS (SELECT document, source_id, target_id, string_agg(evidence, ' || ' ORDER BY ord, place) AS evidence FROM (SELECT document, source_id, target_id, evidence, ord, place FROM claim QUALIFY row_number() OVER (PARTITION BY document, source_id, target_id, evidence ORDER BY ord, place) = 1) GROUP BY ALL),
m AS (SELECT document, source_id, target_id, max(confidence) AS confidence FROM claim GROUP BY ALL)
SELECT document, source_id, target_id, left(sha256(source_id || ':GOES_WITH:' || target_id), 20) AS id, source_chunks, round(confidence, 6) AS confidence, evidence FROM m JOIN c USING (document, source_id, target_id) JOIN e USING (document, source_id, target_id)""",
    "keyed_merge_entity": """WITH o AS (SELECT p_partkey AS id, p_name || ' o' AS name, repeat('o', p_size % 3) AS d FROM part WHERE p_partkey % 3 IN (1, 2)),
n AS (SELECT p_partkey AS id, p_name || ' n' AS name, repeat('n', p_size % 4) AS d FROM part WHERE p_partkey % 3 IN (0, 2))
SELECT id, coalesce(o.name, n.name) AS name, CASE WHEN o.id IS NULL OR length(n.d) > length(o.d) THEN n.d ELSE o.d END AS description,
  CASE WHEN id % 5 = 0 THEN '' WHEN o.id IS NULL THEN 'n,both' WHEN n.id IS NULL THEN 'o,both' ELSE 'o,both,n' END AS aliases FROM o FULL JOIN n USING (id)""",
    "keyed_merge_relation": f"""WITH {_REL}, r AS (SELECT source || ':' || type || ':' || target AS id, rel.*, p_size FROM rel JOIN part ON target = p_partkey)
SELECT id, CASE WHEN target % 3 = 0 OR target % 3 = 2 AND p_size <> 7 AND confidence < 0.05 THEN 0.05 ELSE confidence END AS confidence, CASE WHEN target % 3 = 0 THEN 'later' ELSE 'quote' END AS evidence,
  CASE WHEN target % 3 = 0 THEN 'x,' || type WHEN target % 3 = 1 OR p_size = 7 THEN type ELSE type || ',x' END AS source_chunks FROM r WHERE target % 3 <> 0 OR p_size <> 7""",
    "update_by_key": "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, (SELECT min(o_orderstatus) FROM orders WHERE o_custkey = c_custkey)) AS layer, c_name FROM customer",
    "last_write_and_insert_only": """WITH n AS (SELECT p_partkey AS id, upper(p_name) AS p_name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT -p_partkey, p_name FROM part WHERE p_partkey < 10 AND p_partkey % 3 <> 0 OR p_partkey IN (3, 6, 9)
  UNION ALL SELECT 0, p_name FROM part WHERE p_partkey = 0)
SELECT id, p_name, 'last' AS how FROM n UNION ALL SELECT p_partkey, p_name, 'last' FROM part WHERE p_partkey NOT IN (SELECT id FROM n)
UNION ALL SELECT p_partkey, p_name, 'insert' FROM part UNION ALL SELECT id, p_name, 'insert' FROM n WHERE id NOT IN (SELECT p_partkey FROM part)""",
    "type_name_sanitizer": """SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'REL_9_' ELSE '' END || upper(replace(p_brand, '#', '')) || '_' || replace(replace(upper(p_type), ' ', '_'), '-', '_') AS name FROM part""",
    "lenient_json": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "top_insights_per_strategy": f"WITH {_INS} SELECT id, strategy, score, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, id) AS place FROM ins QUALIFY place <= 20",
    "last_evidence": "SELECT o_custkey AS insight, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS last FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3) GROUP BY 1",
    "typed_keys": "SELECT vec_id, ['chunk', 'insight', 'entity'][vec_id % 3 + 1] AS kind, vec_id || ':x' AS key FROM embeddings",
    "node_lookup": """WITH n AS (SELECT doc_id AS id, 'chunk' AS label, length(text) AS n_chars FROM documents UNION ALL SELECT p_partkey, 'entity', length(p_name) FROM part)
SELECT o_orderkey AS asked, id, label, n_chars FROM orders JOIN n ON id = o_custkey""",
    "corpus_or_unscoped": f"WITH {_INS} SELECT id, strategy FROM ins WHERE id % 4 <> 1",
    "insight_browse": f"""WITH {_INS} SELECT id, any_value(score) AS score, coalesce(string_agg(DISTINCT o_orderpriority || '/' || o_orderstatus, ';' ORDER BY o_orderpriority || '/' || o_orderstatus), '') AS paths
FROM ins LEFT JOIN orders ON o_custkey = id WHERE id % 4 = 1 GROUP BY id""",
    "insight_vector_topk": f"""WITH {_INS}, top AS (SELECT id, strategy, score, round({_cos('e', f'{_Q}::DOUBLE[]')}, 6) AS similarity FROM ins ORDER BY similarity DESC, id LIMIT 40)
SELECT id, strategy, score, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 5 THEN 2 ELSE 1 END AS layer, similarity FROM top WHERE id % 4 = 0""",
    "insight_sample": f"""WITH {_INS}, drawn AS (SELECT * FROM ins WHERE id % 6 BETWEEN 1 AND 4 ORDER BY sha256('5:' || id) LIMIT 50)
SELECT id, any_value(strategy) AS strategy, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS sources FROM drawn LEFT JOIN orders ON o_custkey = id GROUP BY id""",
    "missing_embeddings": "SELECT vec_id AS id, vec_id % 450 AS n_chars FROM embeddings WHERE vec_id % 4 = 0 ORDER BY vec_id LIMIT 100",
    "follow_links": """WITH turn AS (SELECT conv_id * 1000 + turn AS node, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, conv_id FROM conversations),
next AS (SELECT DISTINCT a.node AS seed, 'next' AS how, b.node AS found FROM turn a JOIN turn b ON a.conv_id = b.conv_id AND b.n IN (a.n + 1, a.n + 2)),
src AS (SELECT c_custkey AS seed, 'source' AS how, o_orderkey AS found FROM customer JOIN orders ON o_custkey = c_custkey
  UNION SELECT node, 'source', o_orderkey FROM turn JOIN orders ON o_custkey = node)
SELECT * FROM next QUALIFY row_number() OVER (PARTITION BY seed ORDER BY found) <= 2 UNION ALL SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY seed ORDER BY found) <= 3""",
    "evaluation_context": f"""WITH {_MENT}, {_REL}, {_SEEN}, {_near(3)},
ent AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Type ' ELSE 'type ' END || p_type AS name, p_brand AS kind FROM part UNION ALL SELECT -s_suppkey, s_name, 'UNKNOWN' FROM supplier),
src AS (SELECT o_custkey AS id, o_orderkey AS chunk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, left(o_orderpriority || ' ' || o_orderstatus, 8) AS text FROM orders QUALIFY place <= 5),
own AS (SELECT chunk, entity FROM ment QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY entity) <= 5),
named AS (SELECT src.id, place, entity, name, kind FROM src JOIN own USING (chunk) JOIN ent ON ent.id = entity QUALIFY row_number() OVER (PARTITION BY src.id, lower(name) ORDER BY place, entity) = 1),
kinds AS (SELECT id, string_agg(shown, ';' ORDER BY place, entity, shown) AS entities FROM (SELECT *, name || ' (' || kind || ')' AS shown FROM named QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, entity, shown) <= 10) GROUP BY id),
ways AS (SELECT named.id, place, entity, -confidence AS unsure, other, type, named.name || ' -[' || type || ']-> ' || ent.name AS path FROM named JOIN near ON seed = entity JOIN ent ON ent.id = other),
paths AS (SELECT id, string_agg(path, ';' ORDER BY place, entity, unsure, other, type, path) AS paths FROM (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, entity, unsure, other, type, path) <= 10) GROUP BY id),
texts AS (SELECT id, string_agg(text, ';' ORDER BY place) AS texts FROM src GROUP BY id)
SELECT id, texts, coalesce(entities, '') AS entities, coalesce(paths, '') AS paths FROM texts LEFT JOIN kinds USING (id) LEFT JOIN paths USING (id)""",
    "evidence_texts": """SELECT node, place - 1 AS place, id, text FROM (SELECT o_custkey AS node, o_orderkey AS id, left(o_orderpriority || ' ' || o_orderstatus, 6) AS text,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE place > n - 5""",
    "two_channel_quota": """WITH a AS (SELECT 1 AS channel, -s_suppkey AS id, s_acctbal AS score FROM supplier WHERE s_acctbal > 9000 ORDER BY score DESC, id LIMIT 20),
b AS (SELECT 2 AS channel, c_custkey AS id, c_acctbal AS score FROM customer ORDER BY score DESC, id)
SELECT * FROM a UNION ALL SELECT * FROM b QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 41 - (SELECT count(*) FROM a)""",
    "budgeted_work": "SELECT doc_id AS id, lang || '/' || source AS path, (SELECT greatest(count(*) - 123, 0) FROM documents) AS remaining FROM documents ORDER BY path, id LIMIT 123",
    "text_forms": r"""WITH t AS (SELECT *, CASE p_size % 3 WHEN 0 THEN ' ' WHEN 1 THEN p_name END AS blank FROM part)
SELECT p_partkey AS id, p_type || ' \(\+' || p_brand || '\) ' || p_size AS escaped, CASE WHEN p_size % 3 = 1 THEN p_name ELSE ' ' END AS to_embed, p_name || ': ' || p_type AS entity,
  CASE WHEN p_size % 3 = 2 THEN p_brand || '_other' ELSE p_brand END AS arm, left(coalesce(blank, ''), 4) AS short, p_name || ' -[' || replace(replace(upper(p_type), ' ', '_'), '-', '_') || ']-> ' || p_brand AS hop FROM t""",
    "transient_errors": "SELECT event_id, event_id % 8 BETWEEN 2 AND 6 OR user_id % 5 < 3 AS again FROM events",
    "grounding_filter": f"""WITH {_INS} SELECT id, ['support', 'contradict', 'unsupported'][id % 3 + 1] AS verdict, round(CASE WHEN id % 3 = 2 THEN score / 2 ELSE score END, 6) AS reward
FROM ins WHERE NOT (id % 6 BETWEEN 1 AND 4 AND id % 3 = 1 AND id % 11 >= 7)""",
    "bandit_bernoulli": f"""WITH {_EVENTS}, {_ARMS}, win AS (SELECT arm, CASE WHEN ('0x' || left(sha256('0:' || id), 13))::BIGINT / 4503599627370496.0::DOUBLE < {_CLAMP} THEN 1.0::DOUBLE ELSE 0.0 END AS score, 1.0::DOUBLE AS weight FROM log) """ + _POSTERIOR.format("win"),
    "reward_stream_posteriors": f"WITH {_EVENTS} SELECT arm, round(1 + sum({_CLAMP}), 6) AS alpha, round(1 + sum(1 - {_CLAMP}), 6) AS beta FROM log GROUP BY arm",
    "known_sources": "SELECT DISTINCT l_suppkey AS insight, l_partkey AS source FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size > 25",
    "update_overwrite": """SELECT c_custkey AS id, CASE WHEN n.id IS NULL THEN c_mktsegment ELSE n.s END AS description, coalesce(n.stamp, '') AS stamp, c_name
FROM customer LEFT JOIN (SELECT o_custkey AS id, nullif(max(o_orderstatus), 'P') AS s, strftime(max(o_orderdate), '%Y-%m-%d') AS stamp FROM orders GROUP BY 1) n ON n.id = c_custkey""",
    "bulk_results": "SELECT ['chunk', 'insight', 'entity'][vec_id % 3 + 1] AS kind, vec_id || ':x' AS id, 4 AS n, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 7 > 0 AND vec_id % 5 > 0 AND vec_id % 11 > 0",
}
