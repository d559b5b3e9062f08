"""Current state of the logs, incremental index and deletion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids
from corvane.functions import text as T
from corvane.operators import index as I
from corvane.operators import state as S
from corvane.plans import lexical_queries as X
from corvane.plans.registry import query
from corvane.session import shared_dir, table

_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY log_seq DESC) AS rn FROM asset_index_log) WHERE rn = 1)"
_ROW = "log_seq, asset_id, sha256, source_type, asset_title, ingested_at, deleted"
_COLS = ["log_seq", "asset_id", "sha256", "source_type", "asset_title", "ingested_at", "deleted"]


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_index_log")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_chunks").select("chunk_id", "metadata.asset_id", "metadata.page", "metadata.chunk_index", "metadata.parser", "text")


@query(f"WITH {_LATEST} SELECT {_ROW} FROM l")
def i5_latest(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(_log(spark, d), ["asset_id"], "log_seq").select(*_COLS)


@query(f"SELECT {_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY log_seq DESC) AS rn FROM asset_index_log WHERE sha256 <> '') WHERE rn = 1 AND NOT deleted")
def i6_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.by_hash(_log(spark, d)).select(*_COLS)


@query(f"WITH {_LATEST} SELECT log_seq, asset_id, true AS deleted, ingested_at + 60 AS deleted_at FROM l WHERE NOT deleted AND source_type = 'unknown'")
def i8_tombstones(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return S.tombstones(log, log.where("source_type = 'unknown'"), F.col("ingested_at") + 60).where("source_type = 'unknown'").select("log_seq", "asset_id", "deleted", "deleted_at")


@query(f"WITH {_LATEST} SELECT asset_id, ingested_at FROM l WHERE NOT deleted ORDER BY ingested_at DESC, asset_id")
def i9_active_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return S.active(_log(spark, d)).select("asset_id", "ingested_at").orderBy(F.desc("ingested_at"), "asset_id")


@query(f"WITH {_LATEST}, x AS (SELECT asset_id FROM l WHERE deleted) SELECT chunk_id, metadata.asset_id AS asset_id FROM parsed_chunks WHERE metadata.asset_id IS NULL OR metadata.asset_id NOT IN (SELECT asset_id FROM x)")
def s6_chunks_without_deleted(spark: SparkSession, d: str) -> DataFrame:
    gone = S.latest(_log(spark, d), ["asset_id"], "log_seq").where("deleted")
    return S.without_assets(_chunks(spark, d), gone).select("chunk_id", "asset_id")


@query(f"WITH {_LATEST}, c AS (SELECT metadata.asset_id AS asset_id, count(*) AS chunks FROM parsed_chunks GROUP BY 1), b AS (SELECT asset_id, count(*) AS blocks FROM ir_blocks GROUP BY 1), t AS (SELECT asset_id, count(*) AS documents FROM documents GROUP BY 1) SELECT l.asset_id, coalesce(chunks, 0) AS chunks, coalesce(blocks, 0) AS blocks, coalesce(documents, 0) AS documents FROM l LEFT JOIN c USING (asset_id) LEFT JOIN b USING (asset_id) LEFT JOIN t USING (asset_id)")
def i10_deletion_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.deletion_counts(_log(spark, d), {"chunks": _chunks(spark, d), "blocks": table(spark, d, "ir_blocks"), "documents": table(spark, d, "documents")})


@query(f"WITH {_LATEST} SELECT asset_id, NOT deleted AS in_index, asset_id IN (SELECT metadata.asset_id FROM parsed_chunks) AS parsed, asset_id IN (SELECT asset_id FROM ir_blocks WHERE asset_id IS NOT NULL) AS has_blocks FROM l")
def i11_asset_detail(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda df, name: df.select("asset_id").distinct().withColumn(name, F.lit(True))
    rows = S.latest(_log(spark, d), ["asset_id"], "log_seq").select("asset_id", (~F.col("deleted")).alias("in_index"))
    rows = rows.join(flag(_chunks(spark, d), "parsed"), "asset_id", "left").join(flag(table(spark, d, "ir_blocks"), "has_blocks"), "asset_id", "left")
    return rows.select("asset_id", "in_index", F.coalesce("parsed", F.lit(False)).alias("parsed"), F.coalesce("has_blocks", F.lit(False)).alias("has_blocks"))


_NAME = "'text:' || coalesce(metadata.asset_id, '') || ':' || coalesce(metadata.page::VARCHAR, 'None') || ':' || md5(coalesce(text, ''))"
_POINT = f"(SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id, asset_id FROM (SELECT chunk_id, metadata.asset_id AS asset_id, sha1(unhex('{ids.URL_NAMESPACE}') || encode({_NAME})) AS h FROM parsed_chunks))"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", "asset_id", ids.point_id(F.col("asset_id"), F.col("page"), F.col("text")).alias("id"))


@query(f"SELECT chunk_id, id FROM {_POINT}")
def i1_point_ids(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("chunk_id", "id")


@query(f"SELECT chunk_id, id FROM {_POINT} WHERE id NOT IN (SELECT id FROM {_POINT} WHERE asset_id IN (SELECT asset_id FROM asset_index_log WHERE batch_id <= 5))")
def i2_new_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of assets beyond the first five batches, which are stored already."""
    points = _points(spark, d)
    stored = _log(spark, d).where("batch_id <= 5").select("asset_id").distinct()
    return S.new_points(points, points.join(stored, "asset_id", "left_semi")).select("chunk_id", "id")


@query(f"""WITH RECURSIVE {X.ZH.replace("(SELECT chunk_id AS id, " + X.INDEXED + " AS text FROM parsed_chunks)", "(SELECT id, arg_min(text, (chunk_id % 2) * 1000000000 + chunk_id) AS text FROM " + _POINT.replace("sha1(", X.INDEXED + " AS text, sha1(").replace("AS id, asset_id FROM", "AS id, text FROM") + " GROUP BY id)")}, {X.ZH_Q}, {X.ZH_HITS}
SELECT query_id, id, score, rank::INT AS rank FROM zr WHERE rank <= 10""")
def i2_text_index(spark: SparkSession, d: str) -> DataFrame:
    """A stored index: built with every other chunk, then with all, of which only the new points are added; searched by its terms."""
    at = I.TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    rows = table(spark, d, "parsed_chunks").select("chunk_id", "metadata.asset_id", "metadata.page", "text", "metadata.context")
    at.build(rows.where("chunk_id % 2 = 0"))
    at.build(rows)
    return at.search(X.asked(spark, d), 10)


@query(f"SELECT DISTINCT id FROM {_POINT} WHERE asset_id IS NULL OR asset_id NOT IN (SELECT asset_id FROM asset_index_log WHERE deleted)")
def i10_deleted_from_index(spark: SparkSession, d: str) -> DataFrame:
    """A stored index after the deletion of assets; a dry run before it changes nothing."""
    at = I.TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    at.build(table(spark, d, "parsed_chunks").select("chunk_id", "metadata.asset_id", "metadata.page", "text", "metadata.context"))
    gone = _log(spark, d).where("deleted").select("asset_id")
    at.delete(gone, dry_run=True).count()
    at.delete(gone)
    return at.points().select("id")


@query("SELECT 'points_64d' AS name UNION ALL SELECT 'points'")
def s14_collections(spark: SparkSession, d: str) -> DataFrame:
    """The stored collections of one base name; others and missing ones are not listed, and a missing one reads as empty."""
    folder = f"{shared_dir(spark)}/collections-{uuid.uuid4().hex}"
    pts = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    for name in ("points", I.collection_name("points", 64), "points_old", "pointless"):
        I.append_collection(pts.where("id < 3"), folder, name)
    empty = I.read_collection(spark, folder, "missing", pts.schema)
    return spark.createDataFrame([(n,) for n in I.collections(spark, folder, "points")], "name string").union(empty.select(F.col("id").cast("string")))


@query("""WITH n AS (SELECT task_seq, generate_subscripts(uploaded_files, 1) AS ix, unnest(uploaded_files) AS file FROM task_records), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY task_seq, ix) AS rn FROM n)
SELECT task_seq, (ix - 1)::INT AS item_ix, CASE WHEN rn > 1 THEN regexp_replace(file, '\\.[^.]*$', '') || '_' || rn || regexp_extract(file, '(\\.[^.]*)$', 1) ELSE file END AS target FROM r""")
def i15_unique_names(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "task_records").select("task_seq", F.posexplode("uploaded_files").alias("item_ix", "file"))
    return S.unique_names(files, "file", ["task_seq", "item_ix"]).select("task_seq", "item_ix", "target")


@query("""SELECT log_seq, coalesce(nullif(trim(asset_title), ''), nullif(trim(regexp_replace(relative_path, '^.*/', '')), ''), asset_id) AS title FROM asset_index_log""")
def i16_resolved_titles(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("log_seq", F.coalesce(T.blank_to_null(F.col("asset_title")), T.blank_to_null(F.regexp_replace("relative_path", "^.*/", "")), "asset_id").alias("title"))


@query("""WITH s AS (SELECT task_id, arg_max(status, task_seq) AS status, arg_max(processed, task_seq) AS processed FROM task_records WHERE kind = 'ingest' GROUP BY 1), m AS (SELECT task_id, arg_max(status, task_seq) AS status, arg_max(processed, task_seq) AS processed FROM task_records WHERE status IN ('running', 'done') GROUP BY 1)
SELECT coalesce(s.task_id, m.task_id) AS task_id, CASE WHEN m.task_id IS NOT NULL THEN m.status ELSE s.status END AS status, CASE WHEN m.task_id IS NOT NULL THEN m.processed ELSE s.processed END AS processed, m.task_id IS NOT NULL AS in_memory FROM s FULL JOIN m ON s.task_id = m.task_id""")
def s17_task_overlay(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "task_records").select("task_seq", "task_id", "kind", "status", "processed")
    return S.task_overlay(S.latest(tasks.where("kind = 'ingest'"), ["task_id"], "task_seq"), S.latest(tasks.where("status in ('running', 'done')"), ["task_id"], "task_seq"), ["status", "processed"])


@query("SELECT task_seq, CASE WHEN status = 'running' AND finished_at IS NULL THEN 'interrupted' ELSE status END AS status FROM task_records")
def s18_history(spark: SparkSession, d: str) -> DataFrame:
    return S.interrupted(table(spark, d, "task_records")).select("task_seq", "status")


@query("SELECT task_id, max(task_seq) AS task_seq, arg_max(status, task_seq) AS status, arg_max(kind, task_seq) AS kind FROM task_records GROUP BY task_id")
def s19_last_task_row(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(table(spark, d, "task_records").select("task_seq", "task_id", "status", "kind"), ["task_id"], "task_seq").select("task_id", "task_seq", "status", "kind")


_FILES = "f AS (SELECT task_seq, generate_subscripts(uploaded_files, 1) - 1 AS item_ix, unnest(uploaded_files) AS file, asset_statuses AS m FROM task_records)"


@query(f"WITH {_FILES}, s AS (SELECT task_seq, item_ix::INT AS item_ix, file, m[regexp_replace(regexp_replace(file, '^.*[/\\\\]', ''), '\\.[^.]*$', '')] AS status FROM f) SELECT * FROM s WHERE status IS NULL OR status IN ('failed', 'skipped', 'failed_index')")
def k7_retry_files(spark: SparkSession, d: str) -> DataFrame:
    return S.retry_files(table(spark, d, "task_records"))


@query("SELECT task_seq, round(coalesce(finished_at, 1740000000e0) - started_at, 3) AS elapsed, CASE WHEN total > 0 THEN round(processed::DOUBLE / total, 3) ELSE 0e0 END AS progress FROM task_records")
def k8_progress(spark: SparkSession, d: str) -> DataFrame:
    return S.progress(table(spark, d, "task_records"), F.lit(1740000000.0))


@query("SELECT task_seq, CASE WHEN failed > 0 AND processed - failed > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'done' END AS outcome FROM task_records")
def k5_outcome(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_records").select("task_seq", F.when((F.col("failed") > 0) & (F.col("processed") - F.col("failed") > 0), "partial").when(F.col("failed") > 0, "failed").otherwise("done").alias("outcome"))


@query("""SELECT o.doc_id, sha256(coalesce(text, '')) AS sha, f.doc_id AS duplicate_of FROM documents o LEFT JOIN (SELECT sha256(coalesce(text, '')) AS sha, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) f ON sha256(coalesce(o.text, '')) = f.sha AND o.doc_id <> f.doc_id""")
def i14_content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return docs.join(first, "sha", "left").select("doc_id", "sha", F.when(F.col("first") != F.col("doc_id"), F.col("first")).alias("duplicate_of"))
