"""Stores and logs, previews, options, tokenizers, models and sources of one's own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunking, embedding, evaluation, index, keywords, lexical, parsing, state
from corvane.plans import evaluation_queries as EQ
from corvane.plans import lexical_queries as X
from corvane.plans import state_queries as SQ
from corvane.plans.registry import query
from corvane.session import shared_dir, spread, table
from corvane.sources import collection, jsonl


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT asset_id, sha256, asset_title, coalesce(deleted, false) AS deleted, array_to_string(list_filter(list_transform(coalesce(tags, []), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM asset_index_log WHERE asset_id <> ''""")
def s4_entries(spark: SparkSession, d: str) -> DataFrame:
    """The log written as JSON lines, where nulls are left out, and read with its defaults."""
    at = _at(spark, "entries")
    jsonl.write_jsonl(table(spark, d, "asset_index_log").drop("log_seq", "batch_id"), at)
    return jsonl.read_entries(spark, at).select("asset_id", "sha256", "asset_title", "deleted", F.array_join("tags", "|").alias("tags"))


@query("""SELECT asset_id, max(log_seq) AS log_seq, arg_max(deleted, log_seq) AS deleted FROM asset_index_log GROUP BY asset_id""")
def s5_appended_log(spark: SparkSession, d: str) -> DataFrame:
    """Live rows first, tombstones appended; the log says what holds."""
    at, log = _at(spark, "log"), table(spark, d, "asset_index_log")
    for rows in (log.where("not deleted"), log.where("deleted")):
        jsonl.write_jsonl(rows, at, "append")
    read = jsonl.read_jsonl(spark, at, "log_seq bigint, " + jsonl.ENTRY)
    return state.latest(read.select("asset_id", "log_seq", "deleted"), ["asset_id"], "log_seq").select("asset_id", "log_seq", "deleted")


@query("""SELECT task_id, max(task_seq) AS task_seq, arg_max(status, task_seq) AS status FROM task_records GROUP BY task_id""")
def s16_task_store(spark: SparkSession, d: str) -> DataFrame:
    """Tasks put into a store in two goes; a task that comes again takes the place of the earlier row."""
    at, rows = _at(spark, "tasks"), table(spark, d, "task_records").select("task_id", "task_seq", "status")
    for part in (rows.where("task_seq % 2 = 0"), rows.where("task_seq % 2 <> 0")):
        state.put_tasks(part, at)
    return state.tasks(spark.read.schema(rows.schema).parquet(at))


@query("""SELECT log_seq, trim(p) <> '' AND NOT regexp_matches(p, '^/|\\\\|\\x00|^[A-Za-z]:|(^|/)\\.\\.(/|$)') AS safe FROM (SELECT log_seq, CASE log_seq % 5 WHEN 0 THEN '../' || coalesce(relative_path, '') WHEN 1 THEN '/' || coalesce(relative_path, '') WHEN 2 THEN 'a/..b/' || coalesce(relative_path, '') WHEN 3 THEN 'C:' || coalesce(relative_path, '') ELSE coalesce(relative_path, '') END AS p FROM asset_index_log)""")
def s25_safe_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the log, four of five bent, and which of them stay below their folder."""
    path, m = F.coalesce("relative_path", F.lit("")), F.col("log_seq") % 5
    bent = F.when(m == 0, F.concat(F.lit("../"), path)).when(m == 1, F.concat(F.lit("/"), path)).when(m == 2, F.concat(F.lit("a/..b/"), path)).when(m == 3, F.concat(F.lit("C:"), path)).otherwise(path)
    return table(spark, d, "asset_index_log").select("log_seq", T.safe_path(bent).alias("safe"))


_STORED = SQ._POINT.replace("sha1(", X.INDEXED + " AS text, sha1(").replace("AS id, asset_id FROM", "AS id, asset_id, text FROM")
_POINTS = X.ZH.replace("(SELECT chunk_id AS id, " + X.INDEXED + " AS text FROM parsed_chunks)", f"(SELECT id, arg_min(text, chunk_id) AS text FROM {_STORED} GROUP BY id)")


def _index(spark: SparkSession, d: str) -> index.TextIndex:
    at = index.TextIndex(spark, _at(spark, "index"))
    at.build(table(spark, d, "parsed_chunks").select("chunk_id", "metadata.asset_id", "metadata.page", "text", "metadata.context"))
    return at


@query(f"WITH {_POINTS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def s24_stored_idf(spark: SparkSession, d: str) -> DataFrame:
    """The IDF table of a stored index."""
    return _index(spark, d).idf().select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT coalesce(asset_id, '') AS asset_id, count(DISTINCT id) AS points FROM {SQ._POINT} GROUP BY 1")
def i12_rebuilt_index(spark: SparkSession, d: str) -> DataFrame:
    """An index that lost assets, rebuilt from all chunks."""
    at = _index(spark, d)
    at.delete(table(spark, d, "asset_index_log").where("deleted").select("asset_id"))
    at.build(table(spark, d, "parsed_chunks").select("chunk_id", "metadata.asset_id", "metadata.page", "text", "metadata.context"), force=True)
    return at.points().groupBy(F.coalesce("asset_id", F.lit("")).alias("asset_id")).agg(F.count("*").alias("points"))


@query("""SELECT asset_id, CASE WHEN asset_id IN (SELECT metadata.asset_id FROM parsed_chunks WHERE metadata.asset_id IS NOT NULL) THEN 'skipped' WHEN asset_id IN (SELECT asset_id FROM ir_blocks WHERE asset_id IS NOT NULL) THEN 'ok' ELSE 'failed' END AS status FROM (SELECT DISTINCT asset_id FROM asset_index_log)""")
def k5_asset_statuses(spark: SparkSession, d: str) -> DataFrame:
    """What a parse run does with each asset: cached ones are skipped, others need blocks to read."""
    return state.parse_statuses(table(spark, d, "asset_index_log"), table(spark, d, "parsed_chunks").select("metadata.asset_id"), table(spark, d, "ir_blocks"))


@query("""WITH f AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS sha, n_chars AS size FROM documents), o AS (SELECT sha, min(id) AS first FROM f WHERE size > 0 GROUP BY sha)
SELECT id, CASE WHEN size <= 0 OR size > 5000 THEN 'rejected' WHEN first <> id THEN 'duplicate' ELSE 'new' END AS verdict, CASE WHEN size > 0 AND size <= 5000 AND first <> id THEN first END AS same_as FROM f LEFT JOIN o USING (sha)""")
def k1_upload_preview(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploads: what a confirmation would take in."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.col("n_chars").alias("size"))
    return state.upload_preview(docs, 5000)


_ALLOWED = {"pdf_parser": ("auto", "docling", "pymupdf"), "enable_ocr": ("true", "false")}


@query("""SELECT task_seq, coalesce(string_agg(k || '=' || v, ';' ORDER BY k) FILTER ((k = 'pdf_parser' AND v IN ('auto', 'docling', 'pymupdf')) OR (k = 'enable_ocr' AND v IN ('true', 'false'))), '') AS options FROM
(SELECT task_seq, e.key AS k, lower(trim(e.value)) AS v FROM (SELECT task_seq, unnest(coalesce(map_entries(parse_options), [])) AS e FROM task_records) UNION ALL SELECT task_seq, NULL, NULL FROM task_records) GROUP BY task_seq""")
def x32_clean_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of tasks that the white lists let through."""
    options = F.transform(F.array_sort(F.map_entries(T.clean_options(F.col("parse_options"), _ALLOWED))), lambda e: F.concat(e.key, F.lit("="), e.value))
    return table(spark, d, "task_records").select("task_seq", F.array_join(options, ";").alias("options"))


@query("""SELECT doc_id, greatest(1, round(length(text) / 35e-1)::INT) AS tokens FROM documents WHERE text IS NOT NULL""")
def c7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by a tokenizer that is not there: the approximation takes its place."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", chunking.token_counter("no such tokenizer")(F.col("text")).alias("tokens"))


@query()
def c11_split_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings first, then the token budget; its sequential part has no SQL."""
    return chunking.split_sections(table(spark, d, "parsed_chunks"), "chunk_id", "text")


@query()
def t11_textrank(spark: SparkSession, d: str) -> DataFrame:
    """Keywords by a rank over the graph of neighbours in each text; iterative, so without SQL."""
    return keywords.textrank(spread(table(spark, d, "parsed_chunks").select("chunk_id", "text")), "chunk_id", "text")


@query("""SELECT doc_id, length(t)::FLOAT AS chars, (length(t) - length(replace(t, 'e', '')))::FLOAT AS es FROM (SELECT doc_id, substring(text, 1, 8192) AS t FROM documents WHERE trim(text) <> '')""")
def u2_model_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A model loaded once in each worker, on texts in Arrow batches; blank texts have no vector."""

    def load():
        return lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]

    rows = embedding.model_vectors(table(spark, d, "documents").where("trim(text) <> ''").select("doc_id", "text"), "text", load)
    return rows.select("doc_id", F.get("vec", 0).alias("chars"), F.get("vec", 1).alias("es"))


@query("""SELECT vec_id AS id, label::INT AS label FROM embeddings""")
def u5_collection_source(spark: SparkSession, d: str) -> DataFrame:
    """A stored collection read through the data source of this package."""
    folder = _at(spark, "source")
    index.append_collection(table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label")), folder, "points")
    collection.register(spark)
    return spark.read.format(collection.NAME).schema("id long, label int").option("path", f"{folder}/points").load()


@query(EQ.E13_SQL)
def s22_report_files(spark: SparkSession, d: str) -> DataFrame:
    """The report of all groups as one JSON text for each cut, read back."""
    report = evaluation.report(evaluation.at_k(evaluation.prepare(EQ.cases(spark, d))))
    kind = f"array<{report.drop('k').schema.simpleString()}>"
    return jsonl.report_json(report, ["k"]).select("k", F.inline(F.from_json("report", kind)))


@query("""SELECT chunk_id, md5('data:image/png;base64,' || base64(encode(text))) AS url_md5 FROM parsed_chunks WHERE text <> ''""")
def x15_figure_urls(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the content of figures, sent as data URLs."""
    url = parsing.data_url(F.encode("text", "UTF-8"), F.lit("PNG"))
    return table(spark, d, "parsed_chunks").where("text <> ''").select("chunk_id", F.md5(F.regexp_replace(url, r"[\r\n]", "")).alias("url_md5"))


_KEY = "md5(coalesce(metadata.asset_id, '') || ':' || coalesce(text, ''))"


@query(f"""WITH c AS (SELECT {_KEY} AS key, max(metadata.context) AS context FROM parsed_chunks WHERE trim(metadata.context) <> '' GROUP BY 1) SELECT chunk_id, c.context FROM parsed_chunks p LEFT JOIN c ON c.key = {_KEY}""")
def k11_cached_context(spark: SparkSession, d: str) -> DataFrame:
    """The context of chunks from a cache by content, so a copy of a chunk needs no second call."""
    rows = table(spark, d, "parsed_chunks").select("chunk_id", "metadata.asset_id", "text", F.col("metadata.context").alias("known"))
    cache = rows.select(lexical.context_key(F.col("asset_id"), F.col("text")).alias("key"), F.col("known").alias("context"))
    return lexical.with_context(rows.drop("known"), cache).select("chunk_id", "context")


@query("""SELECT kind, count(*) AS runs, round(sum(processed) / sum(s), 6) AS per_second, round(count(*) / sum(s), 6) AS runs_per_second FROM (SELECT kind, processed, finished_at - started_at AS s FROM task_records) WHERE s > 0 GROUP BY kind""")
def x46_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Tasks as timed runs: items and runs by second."""
    runs = table(spark, d, "task_records").select("kind", "processed", (F.col("finished_at") - F.col("started_at")).alias("s"))
    return evaluation.throughput(runs, ["kind"], "s", "processed")
