"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import chat, clusters, decontam, langid, neardup, packing, quality, resample, simhash, suffix, topk, urls, warc
from quillmark.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def remainder(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def op4_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 20 == 0)


def op5_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.digest(packing.pack(docs, F.col("doc_id"), F.col("text"), public_tokenizers.path("word_bpe_49k.json")))


#: Rules of the registered url query.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_host_segmentation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    words = urls.lexicon(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), pages)
    out = urls.judge(pages, F.col("url"), ["page_id"], URL_RULES, words)
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("tokens", " ").alias("words"), "block_odds")


def op2_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.where(remainder(F.col("doc_id"), 4) != 2)
    model = quality.fit(docs, F.col("doc_id"), F.col("text"), learned, F.col("doc_id"), F.col("quality"))
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return quality.classify(rows, F.col("text"), ["doc_id", "held_out"], model)


def op3_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 7) == 2
    tree, counts, buckets = suffix.fit(docs.where(~held), F.col("text"))
    out = suffix.score(docs.select("doc_id", held.alias("held_out"), "text"), F.col("text"), ["doc_id", "held_out"], tree, counts, buckets)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_bbit_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neardup.near_duplicates(docs, F.col("doc_id"), F.col("text"), words=3, percent=85)


def op7_token_level_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    text = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    chats = chat.format_chats(rows, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"), path, pattern)
    return chat.digests(chats, path, pattern)


def op8_zip_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    manifest = warc.write_archives(pages, F.col("page_id"), F.col("url"), payload, warc.archive_folder(pages))
    return warc.read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    profiles = langid.fit(docs.where(~held), F.col("text"), F.col("lang"))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return langid.identify(rows, F.col("text"), profiles, ["doc_id", "held_out"])


def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = decontam.scan(docs, F.col("text"), bench, F.col("item_id"), F.col("text"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_tiled_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, F.col("doc_id"), F.col("text")).select("doc_id", "fingerprint", "component_id")


def op12_position_table_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.resample(docs, F.col("doc_id"), F.col("text"), bench, F.col("text"))


def op13_dual_tree_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return clusters.cluster(vectors, F.col("vec_id"), F.col("embedding"))[0]


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_host_segmentation_filter, op2_rule_ensemble_quality, op3_suffix_tree_scoring, op4_norm_bucketed_topk, op5_power_of_two_packing, op6_bbit_minhash_neardup, op7_token_level_chat, op8_zip_warc_reader, op9_hyperdimensional_langid, op10_winnowing_decontamination, op11_tiled_simhash_neardup, op12_position_table_resampling, op13_dual_tree_clustering)}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round is two tables: who is nearest to whom, and the new centroids."""
    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS INTEGER) AS c, e FROM v QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, vec_id, v.e, c, list_dot_product(v.e, v.e) + list_dot_product(x.e, x.e) - 2 * list_dot_product(v.e, x.e) AS d
  FROM v, c{r} x QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.e, o.e) AS e FROM c{r} o LEFT JOIN (
    SELECT c, list(m ORDER BY i) AS e FROM (
      SELECT c, i, floor(sum(x) / count(*)) AS m FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) n USING (c))""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(x.e, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} x USING (c)
"""


ORACLE_SQL: dict[str, str] = {
    "op13_dual_tree_clustering": _clustering_sql(),
    "op12_position_table_resampling": rf"""
WITH t AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) r(i))),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, false AS aim, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT -row_number() OVER (), true, NULL, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (
  SELECT rid, aim, unnest(w) AS g FROM d
  UNION ALL
  SELECT rid, aim, array_to_string(w[i : i + 1], ' ') FROM (SELECT rid, aim, w, unnest(range(1, len(w))) AS i FROM d)),
k AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i : i + 1] AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT g, hex(encode(g)) AS x FROM f), t),
n AS (SELECT b, count(*) FILTER (NOT aim) AS s, count(*) FILTER (aim) AS t FROM f JOIN k USING (g) GROUP BY b),
q AS (
  SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM n),
m AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM f JOIN k USING (g) JOIN q USING (b) WHERE NOT aim GROUP BY rid),
r AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(CAST(floor(total / n) AS BIGINT), 0) AS weight,
         CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) AS h
  FROM d LEFT JOIN m USING (rid) WHERE NOT aim),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score, words >= 20 AND doc_id IS NOT NULL AS fit FROM r),
o AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id, n_features) END AS p, count(*) FILTER (fit) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= 25 * n // 100 THEN p END AS rank FROM o
""",
    "op7_token_level_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '### (?:System|User|Assistant|Other):|</turn>')) AS escaped,
         CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 6 + length(role) + len(regexp_extract_all(role, '### (?:System|User|Assistant|Other):|</turn>')) END AS head
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + head + 2 + escaped + 1 + 7 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op8_zip_warc_reader": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM s)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
""",
    "op4_norm_bucketed_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op6_bbit_minhash_neardup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) USING (doc_id)
""",
    "op10_winnowing_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ln AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ln WHERE len(w) >= n)),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
""",
}
