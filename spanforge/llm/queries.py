"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import (
    alignment,
    ann,
    bpe,
    chat_format,
    chunk_bpe,
    fingerprint,
    minhash,
    packing,
    pii,
    suffix_dedup,
    toxicity,
    url_filter,
    vector_codes,
)
from spanforge.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_fingerprint")
def op1_fingerprint(spark, sf):
    made = fingerprint.fingerprint_documents(table(spark, sf, "documents"))
    own, edited = F.col("sketch"), F.col("edited_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(own).alias("fingerprint"),
        fingerprint.as_text(edited).alias("edited_fingerprint"),
        fingerprint.resemblance(own, edited).alias("near_edited"),
        fingerprint.resemblance(own, F.col("next_sketch")).alias("near_next"),
    )


@query("op2_pii")
def op2_pii(spark, sf):
    return pii.find_pii(table(spark, sf, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    scored = toxicity.score_texts(docs, toxicity.learn(docs, table(spark, sf, "labels")))
    held = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_direct", "n_quoted")


OWN_CHAT = "</s>[INST] ok [/INST]"


@query(
    "op4_chat_format",
    rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{OWN_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{OWN_CHAT}'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '[', ''))
    + length(text) - length(replace(text, '<', ''))
    + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 END AS formatted
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
)
def op4_chat_format(spark, sf):
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(OWN_CHAT).alias("text"),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = chat_format.format_chats(rows).select("conv_id", "formatted")
    read = formatted.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


RULES = (
    url_filter.Rule("allow", "com"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


@query(
    "op5_url_filter",
    r"""
WITH RECURSIVE base AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), hits AS (
  SELECT *, rhost || rpath AS rule FROM base JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM hits GROUP BY page_id
), keyed AS (
  SELECT b.*, rule, verdict,
    host || regexp_replace(path, '/+$', '') AS bare,
    array_to_string(list_filter(string_split(regexp_extract(url, '^[^#]*?\?([^#]*)', 1, 's'), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') AS query
  FROM base b LEFT JOIN best USING (page_id)
), named AS (
  SELECT *, CASE WHEN host = '' THEN NULL WHEN query = '' THEN bare ELSE bare || '?' || query END AS key FROM keyed
), blocked AS (SELECT DISTINCT key FROM named WHERE verdict = 'block')
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN b.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  verdict IS NULL AND b.key IS NOT NULL AS alias_blocked
FROM named LEFT JOIN blocked b USING (key)
""",
)
def op5_url_filter(spark, sf):
    return url_filter.filter_urls(table(spark, sf, "pages"), RULES)


@query("op6_byte_bpe")
def op6_byte_bpe(spark, sf):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_texts(table(spark, sf, "documents"), ranks, ids=False)


@query(
    "op7_minhash",
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN list_transform(w, lambda x: [x])
    ELSE list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END) AS s FROM words
), nodes AS (
  SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM sets
), firsts AS (
  SELECT min(doc_id) AS node, any_value(n) AS n, s FROM nodes WHERE n > 0 GROUP BY s
), items AS (
  SELECT node, n, hash(unnest(s)) AS g FROM firsts
), rare AS (
  SELECT g FROM items GROUP BY g HAVING count(*) > 1
), kept AS (
  SELECT node, n, g FROM items SEMI JOIN rare USING (g)
), links AS (
  SELECT a.node AS a, b.node AS b FROM kept a JOIN kept b ON a.g = b.g AND a.node < b.node
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT node AS a, node AS b FROM firsts UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), lowest AS (
  SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, d.n AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id,
  coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM nodes d LEFT JOIN firsts f ON d.s = f.s LEFT JOIN lowest l USING (node)
""",
)
def op7_minhash(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query("op8_nearest")
def op8_nearest(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


@query(
    "op9_suffix_dedup",
    r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), windows AS (
  SELECT doc_id, unnest(range(0, n - 49)) AS pos, h FROM d WHERE n >= 50
), strings AS (
  SELECT doc_id, pos, substr(h, 2 * pos + 1, 100) AS s FROM windows
), earliest AS (
  SELECT s, min(doc_id) AS first_id FROM strings GROUP BY s
), gone AS (
  SELECT doc_id, pos FROM strings JOIN earliest USING (s) WHERE first_id < doc_id
), marked AS (
  SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone
), numbered AS (
  SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked
), spans AS (
  SELECT doc_id, span, min(pos) AS a, max(pos) + 50 AS b FROM numbered GROUP BY doc_id, span
), before AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM spans
), totals AS (
  SELECT b.doc_id, sum(b.b - b.a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM before b JOIN d ON d.doc_id = b.doc_id GROUP BY b.doc_id
)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN totals USING (doc_id)
""",
)
def op9_suffix_dedup(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


@query("op10_packing")
def op10_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_alignment")
def op11_alignment(spark, sf):
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_texts(table(spark, sf, "documents"), first, second)


@query("op12_chunk_bpe")
def op12_chunk_bpe(spark, sf):
    return chunk_bpe.encode_texts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


@query("op13_vector_codes", vector_codes.compress_sql())
def op13_vector_codes(spark, sf):
    return vector_codes.compress(table(spark, sf, "embeddings"))
