"""The operators as queries with production parameters over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import bucket_of_id, documents, scratch


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import embedding_neardup as t

    return t.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import lm_scoring as t

    return t.score(documents(spark, sf_dir).select("doc_id", "text"), bucket_of_id("doc_id", 5) == 1)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import ngram_jaccard as t

    return t.classes(documents(spark, sf_dir))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import token_output as t

    folder = scratch(spark, "token-ids")
    t.write_token_ids(documents(spark, sf_dir), folder, tokenizer("byte_bpe_50k.json"), end_id=2)
    return t.digests(spark, folder)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import language_id as t

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return t.identify(docs, bucket_of_id("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import decontamination as t

    return t.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrivals by a hash of the id, compacted; each document as the last version's shards hold it.

    ``due_tiers``, ``unlisted_files`` and ``versions`` are 0, 0 and 1 where
    compaction and vacuum did their work.
    """
    from pyspark.sql import functions as F

    from lectern.llm import sharding as t

    store = t.ShardStore(spark, scratch(spark, "shards"))
    store.append_each(documents(spark, sf_dir).withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(8))), "arrival")
    store.compact()
    store.vacuum()
    due, unlisted, versions = len(store.due(store.manifest()[1])), store.unlisted(), len(store.versions())
    kept = store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")
    return kept.withColumns({"due_tiers": F.lit(due).cast("long"), "unlisted_files": F.lit(unlisted).cast("long"), "versions": F.lit(versions).cast("long")})


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import line_dedup as t

    return t.digests(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import suffix_dedup as t

    return t.digests(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import bpe as t

    return t.digests(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the id is divisible by 7, the label is the next one."""
    from pyspark.sql import functions as F

    from lectern.llm import hard_negatives as t

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return t.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import importance as t

    return t.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import fingerprints as t

    return t.digests(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {k[4:].lower(): v.strip() for k, v in globals().items() if k.startswith("SQL_")}


SQL_OP1_EMBEDDING_NEARDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, c FROM reached JOIN links ON reached.vec_id = links.a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM reached LEFT JOIN counts USING (vec_id) GROUP BY vec_id
"""

SQL_OP3_NGRAM_JACCARD = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON c.a = x.doc_id JOIN sizes y ON c.b = y.doc_id WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
pair AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, c) AS (SELECT doc_id, doc_id FROM words UNION SELECT b, c FROM reached JOIN pair ON reached.doc_id = pair.a)
SELECT words.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) JOIN reached USING (doc_id) GROUP BY words.doc_id
"""

SQL_OP6_DECONTAMINATION = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
hits AS (SELECT f.doc_id, f.n, f.i, x.item_id FROM found f JOIN windows x ON f.n = x.n AND f.s = x.s),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

SQL_OP7_SHARDING = """
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS text_md5, lang, source, n_chars,
  CAST(0 AS BIGINT) AS due_tiers, CAST(0 AS BIGINT) AS unlisted_files, CAST(1 AS BIGINT) AS versions FROM documents
"""

SQL_OP9_SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS i FROM d WHERE length(h) >= 100)),
least AS (SELECT hash(s) AS k, s, min(doc_id) AS low FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT p.doc_id, p.i FROM p JOIN least USING (s) WHERE low < p.doc_id),
runs AS (SELECT doc_id, i, CASE WHEN i <= 50 + lag(i) OVER w THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM runs) GROUP BY doc_id, r),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(CAST(length(h) / 2 AS BIGINT)) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SQL_OP11_HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n USING (anchor_id) WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""

SQL_OP12_IMPORTANCE = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
found AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM docs),
wanted AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM items),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT f FROM found UNION SELECT f FROM wanted), crc),
corpus AS (SELECT b, count(*) AS n FROM found JOIN buckets USING (f) GROUP BY b),
target AS (SELECT b, count(*) AS n FROM wanted JOIN buckets USING (f) GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM found) + 10000.0::DOUBLE)
    / ((c.n + 1.0::DOUBLE) * ((SELECT count(*) FROM wanted) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM corpus c LEFT JOIN target t USING (b)),
weights AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM found JOIN buckets USING (f) JOIN gains USING (b) GROUP BY doc_id),
scored AS (
  SELECT docs.doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight, len(w) AS n_words,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || docs.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM docs LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
  QUALIFY rank <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score, CAST(rank AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
