"""Vector search, fusion, merging and reranking. Queries are all rows whose id is divisible by 100, or every one with an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import fusion, vectors
from corvane.plans import lexical_queries as X
from corvane.plans.registry import query
from corvane.session import drop, materialize, table, together

#: Ids of hits up to which they are broadcast; more are joined by shuffling.
BROADCAST_HITS = 500_000

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 5)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def probes(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec")


@query(f"""SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT q.vec_id AS query_id, p.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, p.vec_id) AS rank FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0) WHERE rank <= 50""")
def v1_nearest(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(points(spark, d), probes(spark, d), 50).withColumnRenamed("id", "vec_id")


@query(f"""SELECT query_id, vec_id, score FROM (SELECT q.vec_id AS query_id, p.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, p.vec_id) AS rank FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0 AND p.label <> 3) WHERE rank <= 20 AND score >= 24e-2""")
def v5_filtered_with_floor(spark: SparkSession, d: str) -> DataFrame:
    hits = vectors.top_k(points(spark, d).where("label <> 3"), probes(spark, d), 20)
    return vectors.above_floor(hits, 0.24).select("query_id", F.col("id").alias("vec_id"), "score")


_MAXSIM = " + ".join("greatest(" + ", ".join(f"list_dot_product(q.embedding[{16 * a + 1}:{16 * a + 16}]::DOUBLE[], p.embedding[{16 * b + 1}:{16 * b + 16}]::DOUBLE[])" for b in range(4)) + ")" for a in range(4))


@query(f"""SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, p.vec_id, round({_MAXSIM}, 5) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0)) WHERE rank <= 20""")
def v3_late_interaction(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(points(spark, d), probes(spark, d), 20, parts=4).withColumnRenamed("id", "vec_id")


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings""")
def v11_norms(spark: SparkSession, d: str) -> DataFrame:
    wide = F.col("vec").cast("array<double>")
    return points(spark, d).select(F.col("id").alias("vec_id"), F.round(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)), 5).alias("norm"))


_CHUNK = """
ch AS (SELECT chunk_id AS id, coalesce(metadata.asset_id, '') AS asset_id, coalesce(metadata.asset_title, '') AS title, metadata.source_type = 'image' AS is_image,
  concat_ws(chr(10) || chr(10), nullif(concat_ws(' | ', nullif(trim(metadata.asset_title), ''), nullif(trim(metadata.section), '')), ''), substring(coalesce(text, ''), 1, 4000)) AS evidence,
  list_transform(coalesce(metadata.images, []), lambda x: x.path) AS images FROM parsed_chunks)"""


def chunks_of(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """The chunks of ``hits`` (chunk_id). Up to a bound their ids go to every worker, so no text is shuffled to find them."""
    wanted = materialize(hits.select("chunk_id").distinct(), "wanted")
    small = wanted.count() <= BROADCAST_HITS
    return table(spark, d, "parsed_chunks").join(F.broadcast(wanted) if small else wanted, "chunk_id", "left_semi")


def chunk_payload(spark: SparkSession, d: str, hits: DataFrame | None = None) -> DataFrame:
    """What a hit shows; only of the chunks of ``hits`` (chunk_id) if they are given, before any text is put together."""
    m = F.col("metadata")
    rows = table(spark, d, "parsed_chunks") if hits is None else chunks_of(spark, d, hits)
    return rows.select("chunk_id", F.coalesce(m.asset_id, F.lit("")).alias("asset_id"), F.coalesce(m.asset_title, F.lit("")).alias("title"), (m.source_type == "image").alias("is_image"), vectors.evidence(m.asset_title, m.section, F.col("text")).alias("evidence"), F.transform(F.coalesce(m.images, F.array().cast("array<struct<path:string,figure_id:int,caption:string,page:int>>")), lambda x: x.path).alias("images"))


@query(f"WITH {_CHUNK} SELECT id AS chunk_id, evidence FROM ch")
def v9_evidence(spark: SparkSession, d: str) -> DataFrame:
    return chunk_payload(spark, d).select("chunk_id", "evidence")


_FUSED = """
fu AS (SELECT query_id, id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank, 4e-1 AS w FROM er WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 6e-1 AS w FROM zr WHERE rank <= 50) GROUP BY query_id, id)"""


def channels(spark: SparkSession, d: str, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """The hits of the English and of the Chinese channel, a few rows for each query."""
    en, zh = together(lambda: X.en_hits(spark, d, every=every), lambda: X.zh_hits(spark, d, every=every))
    return en, zh


def fused(en: DataFrame, zh: DataFrame) -> DataFrame:
    """Both lexical channels as one list."""
    lists = en.withColumn("route", F.lit("en")).unionByName(zh.withColumn("route", F.lit("zh")))
    return fusion.fuse_channels(lists.withColumnRenamed("id", "chunk_id"), {"en": 0.4, "zh": 0.6})


@query(f"WITH {X.ZH}, {X.ZH_Q}, {X.ZH_HITS}, {X.EN}, {_FUSED} SELECT query_id, id AS chunk_id, score FROM fu")
def f1_fused_channels(spark: SparkSession, d: str) -> DataFrame:
    return fused(*channels(spark, d))


_MERGED = f"""
h AS (SELECT query_id, 'text' AS route, id, score FROM fu JOIN ch USING (id) WHERE NOT coalesce(is_image, false)
  UNION ALL SELECT query_id, 'text_to_image', zr.id, score FROM zr JOIN ch USING (id) WHERE is_image),
hr AS (SELECT h.*, asset_id, title, evidence, images, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, asset_id, h.id) AS rank FROM h JOIN ch USING (id)),
hw AS (SELECT *, CASE route WHEN 'text' THEN 0 ELSE 1 END AS ord, CASE route WHEN 'text' THEN 6e-1 ELSE 4e-1 END AS wt FROM hr WHERE score > 0),
mg AS (SELECT query_id, asset_id, round(sum(wt / (60 + rank)), 9) AS score, min(ord * 1000000 + rank) AS first, arg_min(title, ord * 1000000 + rank) AS title, arg_min(score, ord * 1000000 + rank) AS raw_score,
  first(evidence ORDER BY length(evidence) DESC, ord, rank) AS evidence, array_to_string(list_sort(list_distinct(list(route))), ',') AS routes,
  flatten(list(images ORDER BY ord, rank)) AS pics FROM hw GROUP BY query_id, asset_id),
mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, asset_id) AS rank FROM mg WHERE score >= 1e-3)"""
_ALL = f"{X.ZH}, {X.ZH_Q}, {X.ZH_HITS}, {X.EN}, {_FUSED}, {_CHUNK}, {_MERGED.replace('FROM zr JOIN', 'FROM (SELECT * FROM zr WHERE rank <= 50) zr JOIN')}"


def route_hits(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """(query_id, route, chunk_id, asset_id, title, evidence, score, images); what nobody asks of a hit is not read."""
    en, zh = channels(spark, d, every)
    both = fused(en, zh).withColumn("route", F.lit("text"))
    image = zh.select("query_id", F.col("id").alias("chunk_id"), "score").withColumn("route", F.lit("text_to_image"))
    hits = materialize(both.unionByName(image), "routes")
    drop(en)
    drop(zh)
    rows = hits.join(chunk_payload(spark, d, hits), "chunk_id")
    kept = F.when(F.col("route") == "text", ~F.coalesce("is_image", F.lit(False))).otherwise(F.col("is_image"))
    return rows.where(kept).select("query_id", "route", "chunk_id", "asset_id", "title", "evidence", "score", "images")


def merged(spark: SparkSession, d: str, k: int = 30, every: bool = False) -> DataFrame:
    return fusion.merge_hits(route_hits(spark, d, every), [("text", 0.6), ("text_to_image", 0.4)], k, 0.001)


@query(f"WITH {_ALL} SELECT query_id, rank::INT AS rank, asset_id, score, title, raw_score, md5(evidence) AS evidence_md5, routes, len(list_distinct(pics))::INT AS n_images FROM mr WHERE rank <= 30")
def f4_merged_routes(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select("query_id", "rank", "asset_id", "score", "title", "raw_score", F.md5("evidence").alias("evidence_md5"), F.array_join("routes", ",").alias("routes"), F.size("images").alias("n_images"))


_RERANK = f"""
ce AS (SELECT fu.query_id, fu.id, fu.score, coalesce(is_image, false) AS is_image, fu.score AS raw_score,
  CASE WHEN len(list_distinct(list_concat(eq.toks, et.toks))) > 0 THEN len(list_distinct(list_intersect(eq.toks, et.toks)))::DOUBLE / len(list_distinct(list_concat(eq.toks, et.toks))) ELSE 0e0 END AS ce
  FROM fu JOIN ch USING (id) JOIN (SELECT query_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]+'), lambda x: lower(x)) AS toks FROM (SELECT DISTINCT query_id, coalesce(raw, '') AS text FROM preprocessed_queries WHERE query_id % 100 = 0)) eq USING (query_id)
  JOIN (SELECT id, list_transform(regexp_extract_all(evidence, '[A-Za-z0-9]+|[一-鿿]+'), lambda x: lower(x)) AS toks FROM ch) et USING (id)),
sc AS (SELECT *, CASE WHEN is_image THEN raw_score ELSE ce END AS own FROM ce),
n AS (SELECT *, CASE WHEN max(own) OVER a > min(own) OVER a THEN (own - min(own) OVER a) / (max(own) OVER a - min(own) OVER a) ELSE 1e0 END AS o1,
  CASE WHEN max(score) OVER b > min(score) OVER b THEN (score - min(score) OVER b) / (max(score) OVER b - min(score) OVER b) ELSE 1e0 END AS s1 FROM sc WINDOW a AS (PARTITION BY query_id, is_image), b AS (PARTITION BY query_id)),
bl AS (SELECT query_id, id, score, round(ce, 6) AS ce, round(7e-1 * o1 + 3e-1 * s1, 6) AS blended FROM n)"""


@query(f"WITH {X.ZH}, {X.ZH_Q}, {X.ZH_HITS}, {X.EN}, {_FUSED}, {_CHUNK}, {_RERANK} SELECT query_id, id AS chunk_id, ce, blended, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, score DESC, id) AS rank FROM bl) WHERE rank <= 10")
def r1_reranked(spark: SparkSession, d: str) -> DataFrame:
    toks = lambda c: F.transform(T.tokens(c), F.lower)
    both = materialize(fused(*channels(spark, d)), "fused")
    hits = both.join(chunk_payload(spark, d, both), "chunk_id").join(X.asked(spark, d), "query_id")
    hits = hits.withColumn("ce", fusion.overlap_score(toks(F.col("raw")), toks(F.col("evidence")))).withColumn("raw_score", F.col("score")).withColumn("is_image", F.coalesce("is_image", F.lit(False)))
    return fusion.rerank(hits, 0.7, 10).select("query_id", "chunk_id", F.round("ce", 6).alias("ce"), "blended", "rank")


_IMAGES = "(SELECT chunk_id, (generate_subscripts(metadata.images, 1) - 1)::INT AS ix, unnest(metadata.images) AS i, metadata.asset_title AS title FROM parsed_chunks)"


@query(f"""WITH t AS (SELECT chunk_id, ix, i.figure_id AS figure_id, list_transform(regexp_extract_all(coalesce(title, ''), '[A-Za-z0-9]+|[一-鿿]+'), lambda x: lower(x)) AS a, list_transform(regexp_extract_all(coalesce(i.path, ''), '[A-Za-z0-9]+|[一-鿿]+'), lambda x: lower(x)) AS b FROM {_IMAGES})
SELECT chunk_id AS query_id, ix AS "index", CASE WHEN figure_id IS NULL THEN 0e0 WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_distinct(list_intersect(a, b)))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0e0 END AS score FROM t""")
def r3_aligned_scores(spark: SparkSession, d: str) -> DataFrame:
    """A reader that answers by index scores the numbered images of a chunk against its title; images without an answer get 0."""
    toks = lambda c: F.transform(T.tokens(c), F.lower)
    images = table(spark, d, "parsed_chunks").select(F.col("chunk_id").alias("query_id"), "metadata.asset_title", F.posexplode("metadata.images").alias("index", "i"))
    answers = images.where("i.figure_id is not null").select("query_id", "index", fusion.overlap_score(toks(F.coalesce("asset_title", F.lit(""))), toks(F.coalesce("i.path", F.lit("")))).alias("score"))
    return fusion.align_scores(images.select("query_id", "index"), answers)
