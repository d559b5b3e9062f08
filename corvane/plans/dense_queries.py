"""The dense channel with the offline embedder, three channels fused, and runs over stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import embedding, fusion, vectors
from corvane.plans import lexical_queries as X
from corvane.plans import search_queries as SQ
from corvane.plans.registry import query
from corvane.session import spread, table, together
from corvane.streaming import incremental

_TOK = "list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9]+|[一-鿿]+'), lambda x: lower(x))"


def _vec(name: str, source: str, key: str, col: str) -> str:
    return f"""{name}_n AS (SELECT id, ix, count(*) AS n FROM (SELECT id, (cast('0x' || substr(md5(term), 1, 8) AS ubigint) % 64)::INT AS ix FROM (SELECT {key} AS id, unnest({_TOK.format(c=col)}) AS term FROM {source})) GROUP BY id, ix),
{name} AS (SELECT id, list_transform(range(0, 64), lambda i: coalesce(m[i::INT], 0) / norm) AS vec FROM (SELECT id, map_from_entries(list((ix, n))) AS m, sqrt(sum(n * n)) AS norm FROM {name}_n GROUP BY id))"""


_DV = _vec("dv", "(SELECT chunk_id, substring(text, 1, 8192) AS text FROM parsed_chunks)", "chunk_id", "text")
_QV = _vec("qv", "(SELECT DISTINCT query_id, raw FROM preprocessed_queries WHERE query_id % 100 = 0)", "query_id", "raw")
_DR = "dr AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, d.id, round(list_cosine_similarity(q.vec, d.vec), 5) AS score FROM qv q, dv d)) WHERE rank <= 50)"


def _lower(col: Column) -> Column:
    return F.transform(T.tokens(col), F.lower)


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "parsed_chunks").select("chunk_id", "text"))
    return embedding.hashed_vectors(rows.select(F.col("chunk_id").alias("id"), _lower(F.substring("text", 1, embedding.MAX_CHARS)).alias("tokens")))


def dense_hits(spark: SparkSession, d: str, n: int = 50, every: bool = False) -> DataFrame:
    q = embedding.hashed_vectors(X.asked(spark, d, every).select(F.col("query_id").alias("id"), _lower(F.col("raw")).alias("tokens")))
    return vectors.top_k(chunk_vectors(spark, d), q.withColumnRenamed("id", "query_id"), n)


@query(f"WITH {_DV} SELECT id AS chunk_id, list_sum(list_transform(vec, lambda x, i: round(x, 6) * i)) AS checksum, len(vec)::INT AS dim FROM dv")
def v10_hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate(F.transform("vec", lambda x, i: F.round(x, 6) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return chunk_vectors(spark, d).select(F.col("id").alias("chunk_id"), total.alias("checksum"), F.size("vec").alias("dim"))


@query(f"WITH {_DV}, {_QV}, {_DR} SELECT query_id, id AS chunk_id, score, rank::INT AS rank FROM dr")
def v1_dense_search(spark: SparkSession, d: str) -> DataFrame:
    return dense_hits(spark, d).withColumnRenamed("id", "chunk_id")


@query(f"""WITH {X.every_query(f"{_DV}, {_QV}, {_DR}, {X.ZH}, {X.ZH_Q}, {X.ZH_HITS}, {X.EN}")},
un AS (SELECT query_id, id, rank, 5e-1 AS w FROM dr UNION ALL SELECT query_id, id, rank, 3e-1 FROM zr WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 2e-1 FROM er WHERE rank <= 50),
fu AS (SELECT query_id, id, round(sum(w / (60 + rank)), 9) AS score FROM un GROUP BY query_id, id)
SELECT query_id, f.id AS chunk_id, f.score FROM fu f JOIN parsed_chunks p ON p.chunk_id = f.id WHERE coalesce(p.metadata.source_type, '') <> 'image'""")
def v4_text_search(spark: SparkSession, d: str) -> DataFrame:
    """The text route: dense and both lexical channels, images kept out."""
    dense, zh, en = together(lambda: dense_hits(spark, d, every=True), lambda: X.zh_hits(spark, d, every=True), lambda: X.en_hits(spark, d, every=True))
    lists = dense.withColumn("route", F.lit("dense")).unionByName(zh.withColumn("route", F.lit("zh"))).unionByName(en.withColumn("route", F.lit("en")))
    fused = fusion.fuse_channels(lists.withColumnRenamed("id", "chunk_id"), {"dense": 0.5, "zh": 0.3, "en": 0.2})
    text = table(spark, d, "parsed_chunks").where("coalesce(metadata.source_type, '') <> 'image'").select("chunk_id")
    return fused.join(text, "chunk_id", "left_semi").select("query_id", "chunk_id", "score")


@query("""
WITH r AS (SELECT q.vec_id AS query_id, q.label AS ql, p.vec_id, p.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 5) DESC, p.vec_id) AS rank FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0),
c AS (SELECT query_id, k, max((label = ql)::INT) AS hit, sum((label = ql)::INT)::DOUBLE / k AS precision FROM r, (VALUES (1), (5), (10)) v(k) WHERE rank <= k GROUP BY query_id, k)
SELECT k, count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(precision), 6) AS precision FROM c GROUP BY k""")
def e21_image_to_image_run(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors as queries; a neighbour with the same label is a hit."""
    pts = SQ.points(spark, d)
    hits = vectors.top_k(pts, SQ.probes(spark, d), 10)
    labelled = hits.join(pts.select("id", "label"), "id").join(pts.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    at = labelled.withColumn("k", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10)))).where("rank <= k").withColumn("ok", (F.col("label") == F.col("ql")).cast("int"))
    per = at.groupBy("query_id", "k").agg(F.max("ok").alias("hit"), (F.sum("ok") / F.first("k")).alias("precision"))
    return per.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("precision"), 6).alias("precision"))


@query("""WITH s AS (SELECT DISTINCT task_id, task_seq, status FROM task_records), l AS (SELECT task_id, max(task_seq) AS task_seq, arg_max(status, task_seq) AS status FROM s GROUP BY task_id)
SELECT task_id, task_seq, 'snapshot' AS event, status FROM s UNION ALL SELECT task_id, task_seq, 'done', status FROM l WHERE status IN ('done', 'failed', 'partial', 'cancelled', 'interrupted')""")
def k9_task_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events of tasks from a stream of their rows: a snapshot for each row, and one more when the last state is final."""
    rows = incremental.stream(spark, d, "task_records").select("task_id", "task_seq", "status")
    seen = incremental.drain(rows, "task-rows").distinct()
    last = seen.groupBy("task_id").agg(F.max_by(F.struct("task_seq", "status"), "task_seq").alias("l")).select("task_id", "l.*")
    done = last.where(F.col("status").isin("done", "failed", "partial", "cancelled", "interrupted"))
    event = lambda df, name: df.select("task_id", "task_seq", F.lit(name).alias("event"), "status")
    return event(seen, "snapshot").unionByName(event(done, "done"))


@query(f"WITH {_QV} SELECT id AS query_id, list_sum(list_transform(vec, lambda x, i: round(x, 6) * i)) AS checksum FROM qv")
def u6_registered_embedder(spark: SparkSession, d: str) -> DataFrame:
    """An embedder taken from the registry by its name, on the search queries."""
    embed = embedding.registry.get("embedder", "hashed")
    vecs = embed(X.asked(spark, d).select(F.col("query_id").alias("id"), _lower(F.col("raw")).alias("tokens")))
    total = F.aggregate(F.transform("vec", lambda x, i: F.round(x, 6) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return vecs.select(F.col("id").alias("query_id"), total.alias("checksum"))
