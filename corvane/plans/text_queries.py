"""Text functions over the queries, documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import keywords as K
from corvane.operators import querying
from corvane.plans.registry import query
from corvane.session import spread, table

_Z = "'[A-Za-z][A-Za-z0-9]+(?:[-_.][A-Za-z0-9]+)*|[0-9]+|[一-鿿]+|[^ \\t\\r\\n\\f\\v]'"
ZH_SQL = f"flatten(list_transform(regexp_extract_all(coalesce(text, ''), {_Z}), lambda t: CASE WHEN regexp_matches(t, '^[一-鿿]') AND length(t) > 1 THEN list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9]') THEN [lower(t)] ELSE [t] END))"


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[一-鿿]+') AS toks FROM documents)
SELECT doc_id, len(toks)::INT AS n_tokens, len(list_distinct(toks))::INT AS n_distinct, coalesce(list_aggregate(list_transform(toks, lambda x: length(x)), 'max'), 0)::INT AS longest FROM t""")
def t1_tokens(spark: SparkSession, d: str) -> DataFrame:
    toks = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", toks.alias("toks")).select("doc_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_distinct"), F.coalesce(F.array_max(F.transform("toks", F.length)), F.lit(0)).alias("longest"))


@query("""
WITH t AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x))) AS token FROM parsed_chunks)
SELECT token, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks FROM t GROUP BY token""")
def t3_bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "parsed_chunks").select("chunk_id", F.explode(T.bm25_tokens(F.col("text"))).alias("token")).groupBy("token", "chunk_id").agg(F.count("*").alias("tf"))
    return per.groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("n_chunks"))


@query(f"""
WITH t AS (SELECT unnest({ZH_SQL}) AS token FROM parsed_chunks)
SELECT token, count(*) AS n FROM t GROUP BY token""")
def t4_zh_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_chunks").select(F.explode(T.zh_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(coalesce(raw, ''), '[A-Za-z0-9]+|[一-鿿]+'))) AS term FROM preprocessed_queries)
SELECT term, cast(cast(cast('0x' || substr(sha1(term), 1, 16) AS ubigint) AS decimal(20,0)) AS varchar) AS idx FROM t""")
def t5_term_index(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "preprocessed_queries").select(F.explode(F.transform(T.tokens(F.col("raw")), F.lower)).alias("term")).distinct()
    return terms.select("term", T.term_index(F.col("term")).cast("string").alias("idx"))


@query("""
SELECT DISTINCT lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[一-鿿]+'))) AS token FROM parsed_chunks""")
def t6_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return querying.vocabulary(table(spark, d, "parsed_chunks"))


_CORRECT = """
vocab AS (SELECT DISTINCT lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[一-鿿]+'))) AS word FROM parsed_chunks),
qt AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(raw, ''), '[A-Za-z0-9]+|[一-鿿]+')) AS token FROM preprocessed_queries),
unknown AS (SELECT token, lower(token) AS low FROM qt WHERE regexp_matches(token, '^[A-Za-z0-9]{4,}$') AND lower(token) NOT IN (SELECT word FROM vocab)),
cand AS (SELECT token, word, levenshtein(low, word) AS distance FROM unknown JOIN vocab ON abs(length(low) - length(word)) <= 2 WHERE regexp_matches(word, '^[a-z0-9]+$')),
fixes AS (SELECT token, word AS correction, distance::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, word) AS rn FROM cand WHERE distance <= 2) WHERE rn = 1)"""


@query(f"WITH {_CORRECT} SELECT token, correction, distance FROM fixes")
def t7_corrections(spark: SparkSession, d: str) -> DataFrame:
    return querying.corrections(table(spark, d, "preprocessed_queries"), querying.vocabulary(table(spark, d, "parsed_chunks")))


@query()
def t7_ratio_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Corrections by matching ratio, which SQL does not have; tested against a loop over the vocabulary."""
    return querying.ratio_corrections(table(spark, d, "preprocessed_queries"), querying.vocabulary(table(spark, d, "parsed_chunks")))


@query(f"""
WITH {_CORRECT},
q AS (SELECT DISTINCT query_id, raw, regexp_extract_all(coalesce(raw, ''), '[A-Za-z0-9]+|[一-鿿]+') AS toks FROM preprocessed_queries),
e AS (SELECT query_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM q),
w AS (SELECT query_id, pos, lower(coalesce(correction, e.token)) AS term FROM e LEFT JOIN fixes ON e.token = fixes.token),
pairs AS (SELECT * FROM (VALUES ('recall', 1, 'coverage'), ('rerank', 1, 'reranker'), ('glossary', 1, 'terms'), ('glossary', 2, '术语表'), ('drawing', 1, 'blueprint'), ('manual', 1, 'guide')) AS v(term, ix, extra)),
x AS (SELECT query_id, extra, min(pos * 100 + ix) AS loc FROM w JOIN pairs USING (term) GROUP BY query_id, extra),
x2 AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.query_id = x.query_id AND w.term = x.extra)),
a AS (SELECT query_id, term, pos * 100 AS loc FROM w UNION ALL SELECT query_id, extra, 1000000 + loc FROM x2),
b AS (SELECT query_id, string_agg(term, ' ' ORDER BY loc) AS bm25 FROM a GROUP BY query_id)
SELECT q.query_id, q.raw AS dense_query, coalesce(b.bm25, q.raw) AS bm25_query FROM q LEFT JOIN b USING (query_id)""")
def t8_query_pipeline(spark: SparkSession, d: str) -> DataFrame:
    pairs = '{"recall": ["coverage"], "rerank": ["reranker"], "glossary": ["terms", "术语表"], "drawing": ["blueprint"], "manual": ["guide"]}'
    return querying.preprocess(table(spark, d, "preprocessed_queries"), querying.vocabulary(table(spark, d, "parsed_chunks")), querying.expansion_pairs(spark, pairs))


_EN = "(" + ", ".join(f"'{w}'" for w in T.EN_STOPWORDS) + ")"
_ZH1 = "[" + "".join(w for w in T.ZH_STOPWORDS if len(w) == 1) + "]"
_KW_EN = f"""
e AS (SELECT chunk_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT chunk_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '[A-Za-z0-9]+|[一-鿿]+') AS toks FROM parsed_chunks)),
en AS (SELECT chunk_id, tok, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, min(pos)) AS rn FROM e WHERE length(tok) >= 3 AND lower(tok) NOT IN {_EN} GROUP BY chunk_id, tok),
ken AS (SELECT chunk_id, list(tok ORDER BY rn) AS kw FROM en WHERE rn <= 8 GROUP BY chunk_id)"""
_KW_ZH = f"""
c AS (SELECT chunk_id, regexp_replace(regexp_replace(coalesce(text, ''), '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '[^一-鿿]', '', 'g') AS han FROM parsed_chunks),
g AS (SELECT chunk_id, unnest(range(1, length(han))) AS pos, han FROM c WHERE length(han) > 1),
zh AS (SELECT chunk_id, substring(han, pos, 2) AS tok, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, min(pos)) AS rn FROM g WHERE substring(han, pos, 2) NOT IN ('一个', '没有', '我们', '你们', '他们') AND NOT regexp_matches(substring(han, pos, 2), '^{_ZH1}{_ZH1}$') GROUP BY chunk_id, substring(han, pos, 2)),
kzh AS (SELECT chunk_id, list(tok ORDER BY rn) AS kw FROM zh WHERE rn <= 8 GROUP BY chunk_id)"""


@query(f"WITH {_KW_EN} SELECT chunk_id, array_to_string(kw, ' ') AS keywords FROM ken")
def t10_keywords_en(spark: SparkSession, d: str) -> DataFrame:
    return K.keywords_en(spread(table(spark, d, "parsed_chunks").select("chunk_id", "text")), "chunk_id", "text").select("chunk_id", F.array_join("keywords", " ").alias("keywords"))


@query(f"WITH {_KW_ZH} SELECT chunk_id, array_to_string(kw, ' ') AS keywords FROM kzh")
def t11_keywords_zh(spark: SparkSession, d: str) -> DataFrame:
    return K.keywords_zh(spread(table(spark, d, "parsed_chunks").select("chunk_id", "text")), "chunk_id", "text").select("chunk_id", F.array_join("keywords", " ").alias("keywords"))


@query(f"""
WITH {_KW_EN}, {_KW_ZH}
SELECT p.chunk_id, CASE WHEN coalesce(kzh.kw, ken.kw) IS NULL THEN p.text ELSE p.text || chr(10) || chr(10) || '关键词: ' || array_to_string(coalesce(kzh.kw, ken.kw), ' ') END AS enriched
FROM parsed_chunks p LEFT JOIN kzh USING (chunk_id) LEFT JOIN ken USING (chunk_id) WHERE trim(p.text) <> ''""")
def t14_enriched_chunks(spark: SparkSession, d: str) -> DataFrame:
    return K.enrich(spread(table(spark, d, "parsed_chunks").select("chunk_id", "text").where("trim(text) <> ''")), "chunk_id", "text").select("chunk_id", "enriched")


@query("""
SELECT log_seq,
  regexp_replace(asset_id, '_[0-9a-f]{8}$', '') AS bare,
  regexp_replace(asset_id, '(_[0-9a-f]{8})+$', '') AS barest,
  trim(regexp_replace(replace(lower(regexp_replace(asset_id, '(_[0-9a-f]{8})+$', '')), 'ß', 'ss'), '[\\s\\-_]+', '-', 'g'), '-') AS slug,
  nullif(trim(asset_title), '') AS title,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda x: trim(x)), lambda x: x <> ''))), ',') AS tags_text
FROM asset_index_log""")
def t17_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_index_log").select("log_seq", T.strip_hash(F.col("asset_id")).alias("bare"), T.strip_hashes(F.col("asset_id")).alias("barest"), T.slug(F.col("asset_id")).alias("slug"), T.blank_to_null(F.col("asset_title")).alias("title"), F.array_join(F.array_sort(T.clean_list(F.col("tags"))), ",").alias("tags_text"))


@query("""
WITH t AS (SELECT log_seq, list_distinct(list_filter(list_transform(regexp_split_to_array(array_to_string(coalesce(tags, []), '; ') || ',scan，archive', '[,，;；\\n]+'), lambda x: trim(x)), lambda x: x <> '')) AS tags FROM asset_index_log)
SELECT log_seq, array_to_string(list_sort(tags), '|') AS tags FROM t""")
def t16_tags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "; "), F.lit(",scan，archive"))
    return table(spark, d, "asset_index_log").select("log_seq", F.array_join(F.array_sort(T.split_tags(raw)), "|").alias("tags"))


@query("""
SELECT task_seq, CASE WHEN line = '' THEN 'Error: <no message>' WHEN length(line) > 240 THEN substring(line, 1, 240) || '…' ELSE line END AS error,
  coalesce(lower(trim(cast(force AS varchar))) IN ('1','true','yes','y','on'), false) AS force
FROM (SELECT *, regexp_replace(regexp_extract(regexp_replace(regexp_replace(regexp_replace(coalesce(error, ''), 'https?://[^ \\t"'')]+', '<url>', 'g'), 'host=[''"]?[A-Za-z0-9_.-]+[''"]?', 'host=<host>', 'g'), '\\b[A-Za-z0-9.-]+:[0-9]{2,5}\\b', '<host>:<port>', 'g'), '^[^\\n\\r]*'), '[\\x00-\\x08\\x0a-\\x1f]', '', 'g') AS line FROM task_records)""")
def t26_errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_records").select("task_seq", T.scrub_error(F.col("error")).alias("error"), T.as_bool(F.col("force").cast("string")).alias("force"))


@query("""
SELECT doc_id, trim(regexp_replace('<think>' || coalesce(source, '') || '</think>' || substring(text, 1, 8192), '(?s)<think>.*?</think>', '', 'g')) AS visible,
  greatest(1, cast(round(length(text) / 3.5e0) AS int)) AS approx_tokens,
  regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g') AS plain
FROM documents WHERE text IS NOT NULL""")
def t21_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    raw = F.concat(F.lit("<think>"), F.coalesce("source", F.lit("")), F.lit("</think>"), F.substring("text", 1, 8192))
    return docs.select("doc_id", T.strip_think(raw).alias("visible"), T.approx_tokens(F.col("text")).alias("approx_tokens"), T.strip_images(F.col("text")).alias("plain"))
