"""The queries opN_<name> over the synthetic tables, and their SQL.

Each applies its operator, with production parameters, to the whole table and
derives digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, exact_dedup, license_scan, line_dedup, media, near_dedup, packing, resampling, secrets, sharding, toxicity, url_filter
from ._common import pinned, small_batches, table, tokenizer_path

#: Rules of op9.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), reuse=192 << 20)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    shown = F.col("ids").cast("string")  # "[1, 2]", with no string for each id
    joined = F.replace(F.substring(shown, F.lit(2), F.length(shown) - 2), F.lit(", "), F.lit(" "))
    digests = rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
    with small_batches(spark):  # texts, ids and texts again go through workers
        return pinned(digests)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.summaries(media.store(table(spark, sf_dir, "documents")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), words=3, percent=85).drop("h")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    out = url_filter.judge(table(spark, sf_dir, "pages"), outcomes, rules=URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = base + [r.kind for r in secrets.ADDED]
    return out.select("doc_id", *map(count, base), F.sha2(secrets.joined(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans"), every).alias("spans"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = resampling.resample(docs, target, percent=10, ngrams=(1, 1), min_words=20)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))
    return out.drop("rows")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform(base, lambda p: p["start"])
    columns = [F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(F.transform(base, lambda p: p["label"])).alias("base_labels")]
    with small_batches(spark):
        return pinned(found.select("doc_id", "n_words", *columns, joined(F.col("labels")).alias("labels"), "score"))


def queries() -> dict:
    own = [op1_toxicity, op2_best_fit_packing, op3_line_dedup, op4_bpe, op5_exact_dedup, op6_tiff, op7_minhash_near_dedup, op8_sharding, op9_url_filter, op10_secret_scan]
    own += [op11_importance_resampling, op12_conversation_repair, op13_license_scan]
    return {f.__name__: f for f in own}


_OP3 = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT doc_id, place, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM line),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, place, line, keeper IS NOT NULL AND keeper <> doc_id AS dropped
  FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_OP5 = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM normal
"""

_OP9 = r"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM split),
bare AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*\z', ''), '\.+\z', '') AS site FROM parts),
named AS (
  SELECT *, string_split(site, '.') AS p, regexp_matches(site, '^([0-9]{1,3}(\.[0-9]{1,3}){3}\z|\[)') AS address,
         array_to_string(string_split(site, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') AS two FROM bare),
levels AS (
  SELECT page_id, host, path, site, CASE WHEN address THEN site ELSE array_to_string(CASE WHEN two THEN p[-3:] ELSE p[-2:] END, '.') END AS domain,
         CASE WHEN address THEN '[]' ELSE array_to_string(CASE WHEN two THEN p[-2:] ELSE p[-1:] END, '.') END AS suffix FROM named),
outcome AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM labels GROUP BY doc_id),
known AS (SELECT l.*, bad::DOUBLE AS bad FROM levels l JOIN outcome USING (page_id) WHERE bad IS NOT NULL),
top AS (SELECT coalesce(sum(bad), 0) + 1.0::DOUBLE AS a, count(*) - coalesce(sum(bad), 0) + 1.0::DOUBLE AS b FROM known),
-- For each level: outcomes with the mean and the weight of the level above, the correlation, the posterior.
s0 AS (SELECT suffix, sum(bad) AS k, count(*)::DOUBLE AS n, any_value(a / (a + b)) AS m, any_value(a + b) AS w FROM known, top WHERE site <> '' GROUP BY suffix),
sr AS (SELECT CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN
  greatest(0.0001, least(0.5, sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)))) ELSE 1.0 / 21 END AS r FROM s0),
s AS (SELECT suffix, k + m * t AS a, n - k + (1 - m) * t AS b FROM (SELECT *, 1 / least(0.99, r + 1 / (w + 1)) - 1 AS t FROM s0, sr)),
d0 AS (SELECT domain, sum(bad) AS k, count(*)::DOUBLE AS n, any_value(a / (a + b)) AS m, any_value(a + b) AS w FROM known JOIN s USING (suffix) WHERE site <> '' GROUP BY domain),
dr AS (SELECT CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN
  greatest(0.0001, least(0.5, sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)))) ELSE 1.0 / 21 END AS r FROM d0),
d AS (SELECT domain, k + m * t AS a, n - k + (1 - m) * t AS b FROM (SELECT *, 1 / least(0.99, r + 1 / (w + 1)) - 1 AS t FROM d0, dr)),
h0 AS (SELECT site, sum(bad) AS k, count(*)::DOUBLE AS n, any_value(a / (a + b)) AS m, any_value(a + b) AS w FROM known JOIN d USING (domain) WHERE site <> '' GROUP BY site),
hr AS (SELECT CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN
  greatest(0.0001, least(0.5, sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)))) ELSE 1.0 / 21 END AS r FROM h0),
h AS (SELECT site, k + m * t AS a, n - k + (1 - m) * t AS b FROM (SELECT *, 1 / least(0.99, r + 1 / (w + 1)) - 1 AS t FROM h0, hr)),
judged AS (
  SELECT l.*, coalesce(h.a, d.a, s.a, top.a) AS a, coalesce(h.b, d.b, s.b, top.b) AS b
  FROM levels l LEFT JOIN h USING (site) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix), top),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM judged)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b)) / (a + b + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


_OP11 = r"""
WITH RECURSIVE crc_step(byte, k, c) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL
  SELECT byte, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM crc_step WHERE k = 8),
word AS (
  SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
bytes AS (
  SELECT w, list_transform(range(1, length(hex(encode(w))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT w FROM word)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM word JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts),
bag AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM word JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN bag ON id = doc_id),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS draw FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

_OP12 = r"""
WITH RECURSIVE crc_step(byte, k, c) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL
  SELECT byte, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM crc_step WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b FROM conversations),
dealt AS (
  SELECT * EXCLUDE (b, t), xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM dealt, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
line AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, substr(role, 1, 1) AS r FROM damaged),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM line),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
-- From each state (none, system, user, assistant as a letter) to those that up to two insertions reach.
inserts(q, p, cost, letters) AS (
  VALUES ('-', '-', 0, ''), ('-', 'u', 5, 'I'), ('-', 'a', 10, 'II'), ('s', 's', 0, ''), ('s', 'u', 5, 'I'), ('s', 'a', 10, 'II'),
         ('u', 'u', 0, ''), ('u', 'a', 5, 'I'), ('a', 'a', 0, ''), ('a', 'u', 5, 'I')),
due(q, p) AS (VALUES ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
legal(q, r) AS (VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
edit AS (
  SELECT conv_id, i, d.q, 'D' AS letter, d.q AS p, 2 AS cost FROM judged, due d
  UNION ALL
  SELECT conv_id, i, d.q, 'R', d.p, 1 + CASE WHEN fault IS NULL THEN 0 ELSE 5 END FROM judged, due d WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL
  SELECT conv_id, i, l.q, 'K', l.r, CASE WHEN fault IS NULL THEN 0 ELSE 5 END FROM judged j JOIN legal l ON l.r = j.r WHERE fault IS NULL OR fault = 'truncated'),
-- The cheapest way to each state after i rows, then the least letters: nine digits of costs, and the letters.
way(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, n.p, printf('%09d', n.cost) || n.letters FROM counted, inserts n WHERE n.q = '-'
  UNION ALL
  SELECT w.conv_id, e.i, n.p, min(printf('%09d', substr(w.best, 1, 9)::BIGINT + e.cost + n.cost) || substr(w.best, 10) || e.letter || n.letters)
  FROM way w JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.q = w.q JOIN inserts n ON n.q = e.p
  GROUP BY w.conv_id, e.i, n.p),
solved AS (
  SELECT c.conv_id, min(best) AS best FROM counted c JOIN way w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n WHERE w.q IN ('-', 'a') GROUP BY c.conv_id),
-- Letters one by one, with the number of the row that they use and of the turn that they give.
letter AS (
  SELECT conv_id, k, substr(best, k + 9, 1) AS e, length(replace(substr(best, 10, k), 'I', '')) AS i, length(replace(substr(best, 10, k), 'D', '')) AS out
  FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS k FROM solved)),
opened AS (
  SELECT l.*, j.role, j.text, max(CASE WHEN e = 'K' AND j.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS has_system
  FROM letter l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i AND l.e <> 'I' WHERE e <> 'D'),
shown AS (
  SELECT conv_id, out, CASE WHEN e = 'K' THEN role WHEN (out - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
         CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM opened),
repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY out) AS whole FROM shown GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(substr(best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _OP3, "op5_exact_dedup": _OP5, "op9_url_filter": _OP9, "op11_importance_resampling": _OP11, "op12_conversation_repair": _OP12}
