"""Lexical index and search, against all chunks. Search queries are all queries whose id is divisible by 100, or every one with an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import lexical as L
from corvane.plans.registry import query
from corvane.plans.text_queries import ZH_SQL
from corvane.session import spread, table

INDEXED = "CASE WHEN trim(metadata.context) <> '' THEN metadata.context || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END"
ZH = f"""
docs AS (SELECT id, {ZH_SQL} AS toks FROM (SELECT chunk_id AS id, {INDEXED} AS text FROM parsed_chunks)),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM docs) GROUP BY id, term),
dl AS (SELECT id, len(toks) AS dl FROM docs),
st AS (SELECT count(*)::DOUBLE AS n, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM docs),
idf AS (SELECT term, count(*) AS df, ln(1e0 + ((SELECT n FROM st) - count(*) + 5e-1) / (count(*) + 5e-1)) AS idf FROM tf GROUP BY term),
vec AS (SELECT tf.id, tf.term, idf * tf * 25e-1 / (tf + 15e-1 * (1e0 - 75e-2 + 75e-2 * dl / greatest((SELECT avgdl FROM st), 1e0))) AS w FROM tf JOIN idf USING (term) JOIN dl USING (id))"""
ZH_Q = f"""
qt AS (SELECT query_id, {ZH_SQL} AS toks FROM (SELECT DISTINCT query_id, coalesce(raw, '') AS text FROM preprocessed_queries WHERE query_id % 100 = 0))"""
ZH_HITS = """
zs AS (SELECT query_id, id, round(sum(i.idf * v.w), 6) AS score FROM (SELECT DISTINCT query_id, unnest(toks) AS term FROM qt) q JOIN idf i USING (term) JOIN vec v USING (term) GROUP BY query_id, id),
zr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM zs)"""
_EN = "(" + ", ".join(f"'{w}'" for w in T.EN_STOPWORDS) + ")"
EN = f"""
edocs AS (SELECT id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x NOT IN {_EN}) AS toks FROM (SELECT chunk_id AS id, {INDEXED} AS text FROM parsed_chunks)),
etf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM edocs) GROUP BY id, term),
est AS (SELECT sum(len(toks))::DOUBLE / count(*) AS avgdl FROM edocs),
evec AS (SELECT etf.id, term, tf * 25e-1 / (tf + 15e-1 * (1e0 - 75e-2 + 75e-2 * len(toks) / greatest((SELECT avgdl FROM est), 1e0))) AS w FROM etf JOIN edocs USING (id)),
eq AS (SELECT query_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x NOT IN {_EN}) AS toks FROM (SELECT DISTINCT query_id, coalesce(raw, '') AS text FROM preprocessed_queries WHERE query_id % 100 = 0)),
eqt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(toks) AS term FROM eq) GROUP BY query_id, term),
eqs AS (SELECT sum(len(toks))::DOUBLE / count(*) AS avgdl FROM eq),
eqv AS (SELECT eqt.query_id, term, tf * 25e-1 / (tf + 15e-1 * (1e0 - 75e-2 + 75e-2 * len(toks) / greatest((SELECT avgdl FROM eqs), 1e0))) AS w FROM eqt JOIN eq USING (query_id)),
es AS (SELECT query_id, evec.id, round(sum(eqv.w * evec.w), 6) AS score FROM eqv JOIN evec USING (term) GROUP BY query_id, evec.id),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM es)"""


def every_query(sql: str) -> str:
    """The SQL over every query that has an id instead of those whose id is divisible by 100."""
    return sql.replace("query_id % 100 = 0", "query_id IS NOT NULL")


def zh_docs(spark: SparkSession, d: str) -> DataFrame:
    chunks = spread(table(spark, d, "parsed_chunks").select("chunk_id", "text", "metadata"))
    return L.token_table(chunks, "chunk_id", T.zh_tokens(L.index_text(F.col("text"), F.col("metadata.context"))))


def en_docs(spark: SparkSession, d: str) -> DataFrame:
    chunks = spread(table(spark, d, "parsed_chunks").select("chunk_id", "text", "metadata"))
    return L.token_table(chunks, "chunk_id", T.bm25_tokens(L.index_text(F.col("text"), F.col("metadata.context"))))


def query_rows(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    return table(spark, d, "preprocessed_queries").where("query_id is not null" if every else "query_id % 100 = 0")


def asked(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    return query_rows(spark, d, every).select("query_id", F.coalesce("raw", F.lit("")).alias("raw")).distinct()


def zh_hits(spark: SparkSession, d: str, n: int = 50, every: bool = False) -> DataFrame:
    tokens = asked(spark, d, every).select("query_id", F.explode(T.zh_tokens(F.col("raw"))).alias("term")).distinct()
    return L.search(tokens.withColumn("w", F.lit(1.0)), zh_docs(spark, d), n, 2)


def en_hits(spark: SparkSession, d: str, n: int = 50, every: bool = False) -> DataFrame:
    # The English channel encodes queries like documents.
    q = L.english_vectors(L.token_table(asked(spark, d, every), "query_id", T.bm25_tokens(F.col("raw")))).withColumnRenamed("id", "query_id")
    return L.search(q, L.english_terms(en_docs(spark, d)), n, 0)


@query(f"WITH {ZH} SELECT term, df, round(idf, 6) AS idf FROM idf")
def l1_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = zh_docs(spark, d)
    return L.idf_table(L.term_frequencies(docs), L.corpus_stats(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {ZH} SELECT id AS chunk_id, term, round(w, 6) AS w FROM vec")
def l2_document_vectors(spark: SparkSession, d: str) -> DataFrame:
    return L.document_vectors(zh_docs(spark, d)).select(F.col("id").alias("chunk_id"), "term", F.round("w", 6).alias("w"))


@query(f"WITH {ZH}, qt AS (SELECT query_id, {ZH_SQL} AS toks FROM (SELECT DISTINCT query_id, coalesce(raw, '') AS text FROM preprocessed_queries)) SELECT query_id, term, round(idf, 6) AS w FROM (SELECT DISTINCT query_id, unnest(toks) AS term FROM qt) JOIN idf USING (term)")
def l3_query_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = zh_docs(spark, d)
    every = table(spark, d, "preprocessed_queries").select("query_id", T.zh_tokens(F.col("raw")).alias("tokens")).distinct()
    return L.query_vectors(every, L.idf_table(L.term_frequencies(docs), L.corpus_stats(docs))).withColumn("w", F.round("w", 6))


@query(f"""WITH {ZH}, {ZH_Q},
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(toks) AS term FROM qt) GROUP BY query_id, term),
s AS (SELECT query_id, v.id, round(sum(times * v.w), 6) AS score FROM asked JOIN vec v USING (term) GROUP BY query_id, v.id)
SELECT query_id, id AS chunk_id, score FROM s""")
def l4_scores(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d).select("query_id", T.zh_tokens(F.col("raw")).alias("tokens"))
    return L.multiplicity_scores(q, zh_docs(spark, d)).withColumnRenamed("id", "chunk_id")


_CAP = """
r AS (SELECT chunk_id, metadata.asset_id AS asset_id, metadata.asset_title AS asset_title, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x)) AS toks, row_number() OVER (PARTITION BY metadata.asset_id ORDER BY chunk_id) AS ix FROM parsed_chunks),
per AS (SELECT asset_id, count(*) AS n, avg(len(toks))::DOUBLE AS avgdl, arg_min(coalesce(asset_title, ''), ix) AS title FROM r GROUP BY asset_id),
a AS (SELECT asset_id, n, avgdl, term, count(*) AS times FROM (SELECT asset_id, n, avgdl, unnest(list_transform(regexp_extract_all(coalesce(nullif(title, ''), replace(asset_id, '_', ' ')), '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM per WHERE n > 12) GROUP BY ALL),
t AS (SELECT asset_id, chunk_id, greatest(len(toks), 1) AS dl, unnest(toks) AS term FROM r),
h AS (SELECT asset_id, chunk_id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
j AS (SELECT h.*, n, avgdl, times FROM h JOIN a USING (asset_id, term)),
f AS (SELECT asset_id, term, count(*) AS df FROM j GROUP BY ALL),
s AS (SELECT chunk_id, round(sum(times * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (1e0 - 75e-2 + 75e-2 * dl / avgdl))), 9) AS score FROM j JOIN f USING (asset_id, term) GROUP BY chunk_id),
k AS (SELECT r.chunk_id, r.asset_id, n, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY r.asset_id ORDER BY coalesce(score, 0) DESC, ix) AS kept_rank FROM r JOIN per USING (asset_id) LEFT JOIN s USING (chunk_id))"""


@query(f"WITH {_CAP} SELECT chunk_id, asset_id, round(score, 6) AS score, kept_rank::INT AS kept_rank FROM k WHERE kept_rank <= 12")
def l6_capped_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parsed_chunks").select("chunk_id", "metadata.asset_id", "metadata.asset_title", "text").where("asset_id is not null")
    return L.cap_per_asset(rows.withColumn("asset_title", F.coalesce("asset_title", F.lit(""))), 12).select("chunk_id", "asset_id", F.round("score", 6).alias("score"), "kept_rank")


@query(f"WITH {EN} SELECT query_id, id AS chunk_id, score, rank::INT AS rank FROM er WHERE rank <= 50")
def l7_english_search(spark: SparkSession, d: str) -> DataFrame:
    return en_hits(spark, d).withColumnRenamed("id", "chunk_id")


@query(f"WITH {ZH}, {ZH_Q}, {ZH_HITS} SELECT query_id, id AS chunk_id, score, rank::INT AS rank FROM zr WHERE rank <= 50")
def l9_chinese_search(spark: SparkSession, d: str) -> DataFrame:
    return zh_hits(spark, d).withColumnRenamed("id", "chunk_id")
