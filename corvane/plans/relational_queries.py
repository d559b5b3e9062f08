"""Relational coverage: joins, grouping, windows, sets, ranges, as-of, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.plans.registry import query
from corvane.session import shared_dir, table
from corvane.sources import jsonl, sniff
from corvane.streaming import incremental as I


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_tax), 6) AS avg_tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def rel_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_tax"), 6).alias("avg_tax"), F.count("*").alias("n"))


@query("""SELECT coalesce(n_name, 'all') AS nation, coalesce(c_mktsegment, 'all') AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)""")
def rel_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.cube("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.coalesce("n_name", F.lit("all")).alias("nation"), F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "orders", "total")


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) EXCEPT SELECT p_partkey FROM part WHERE p_size < 10""")
def rel_anti_and_except(spark: SparkSession, d: str) -> DataFrame:
    parts, sold = table(spark, d, "part"), table(spark, d, "lineitem").where("l_quantity > 48")
    return parts.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey").subtract(parts.where("p_size < 10").select("p_partkey"))


@query("""SELECT o_custkey, o_orderkey, rank::INT AS rank, round(running, 2) AS running FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders) WHERE rank <= 3""")
def rel_top_orders(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"), F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    return rows.where("rank <= 3").select("o_custkey", "o_orderkey", "rank", F.round("running", 2).alias("running"))


@query("""SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def rel_asof(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: both sides in one stream by user and time, the last purchase carried forward; no range join."""
    ev = table(spark, d, "events").where("event_type in ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "purchase", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = ev.withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return rows.where("event_type = 'error'").select("event_id", "last_purchase")


@query("""SELECT a.event_id AS error_id, count(b.event_id) AS clicks FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'error' AND b.event_type = 'click' GROUP BY 1""")
def rel_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Interval join by buckets of an hour: each error meets the buckets its interval touches, then the exact test."""
    ev = table(spark, d, "events").withColumn("s", F.col("ts").cast("timestamp").cast("double"))
    e = ev.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("s").alias("at")).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - 1800) / 3600), F.floor((F.col("at") + 1800) / 3600))))
    c = ev.where("event_type = 'click'").select("event_id", "user_id", "s", F.floor(F.col("s") / 3600).alias("bucket"))
    return e.join(c, ["user_id", "bucket"]).where(F.abs(F.col("s") - F.col("at")) <= 1800).groupBy("error_id").agg(F.count("event_id").alias("clicks"))


@query("""SELECT event_type, count(DISTINCT user_id) AS users, round(avg(cast(json_extract_string(props, '$.k') AS INT)), 6) AS mean_k FROM events GROUP BY 1""")
def rel_json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.round(F.avg(k), 6).alias("mean_k"))


@query("""SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > (SELECT avg(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey))) GROUP BY 1, 2""")
def rel_subqueries(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    hot = sums.where(F.col("q") > sums.agg(F.avg("q").alias("a")).scalar())
    return table(spark, d, "part").join(hot, F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("""SELECT s_nationkey AS nationkey, 'supplier' AS kind, count(*) AS n FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, 'customer', count(*) FROM customer GROUP BY 1""")
def rel_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("supplier"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("customer"))
    return a.unionByName(b).select("nationkey", "kind", "n")


@query("""SELECT chunk_id, text, metadata.asset_id AS asset_id, len(metadata.tags)::INT AS n_tags FROM parsed_chunks""")
def s1_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines next to broken lines, read back without those."""
    at = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    jsonl.write_jsonl(table(spark, d, "parsed_chunks"), at)
    spark.createDataFrame([("{broken",), ("",), ('["no object"',)], "value string").write.mode("append").text(at)
    return jsonl.read_jsonl(spark, at, "chunk_id bigint, " + jsonl.CHUNK).select("chunk_id", "text", "metadata.asset_id", F.when(F.col("metadata.tags").isNotNull(), F.size("metadata.tags")).alias("n_tags"))


@query("""SELECT kind AS grp, task_seq, (ix - 1)::INT AS case_ix, file AS query FROM (SELECT kind, task_seq, generate_subscripts(uploaded_files, 1) AS ix, unnest(uploaded_files) AS file FROM task_records)""")
def s20_eval_cases(spark: SparkSession, d: str) -> DataFrame:
    """Case files, one for each task with its files as the cases of one group, parsed back; those of another version are refused."""
    tasks = table(spark, d, "task_records").where("size(uploaded_files) > 0")
    cases = F.transform("uploaded_files", lambda f: F.struct(f.alias("query"), F.array(f).alias("expected_asset_ids")))
    doc = lambda version: F.to_json(F.struct(F.lit(version).alias("version"), F.create_map(F.col("kind"), cases).alias("groups")))
    both = tasks.select("task_seq", doc("v2").alias("doc")).union(tasks.select("task_seq", doc("v1")))
    return jsonl.eval_cases(both, "doc", "v2", ["task_seq"]).select("grp", "task_seq", "case_ix", "query")


_HEADS = ("255044462D312E37", "89504E470D0A1A0A0000000D4948445200000280000001E0", "47494638396180020100", "424D46000000", "52494646240000005745425056503820", "504B030414000600", "00010203", "FFD8FFE000104A46494600010100000100010000FFC0001108001000200301")


@query("""SELECT log_seq, CASE log_seq % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' WHEN 4 THEN 'webp' WHEN 5 THEN CASE WHEN regexp_extract(lower(coalesce(relative_path, '')), '\\.([a-z0-9]+)$', 1) IN ('docx', 'pptx', 'xlsx') THEN 'office' WHEN regexp_extract(lower(coalesce(relative_path, '')), '\\.([a-z0-9]+)$', 1) IN ('md', 'markdown', 'txt', 'html', 'htm', 'csv') THEN 'text' ELSE 'unknown' END
  WHEN 6 THEN CASE WHEN regexp_extract(lower(coalesce(relative_path, '')), '\\.([a-z0-9]+)$', 1) IN ('md', 'markdown', 'txt', 'html', 'htm', 'csv') THEN 'text' ELSE 'unknown' END ELSE 'jpeg' END AS format,
  CASE log_seq % 8 WHEN 1 THEN 640 WHEN 2 THEN 640 WHEN 7 THEN 32 END AS width, CASE log_seq % 8 WHEN 1 THEN 480 WHEN 2 THEN 1 WHEN 7 THEN 16 END AS height FROM asset_index_log""")
def s7_sniffed_files(spark: SparkSession, d: str) -> DataFrame:
    """The names of the log with first bytes of eight sorts of files: what each is, and the size of images."""
    log = table(spark, d, "asset_index_log").select("log_seq", F.coalesce("relative_path", F.lit("")).alias("path"))
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("log_seq") % 8 + 1).cast("int")))
    rows = log.withColumn("content", head)
    return rows.select("log_seq", sniff.file_format(F.col("path"), F.col("content")).alias("format"), sniff.image_size("content").alias("size")).select("log_seq", "format", "size.width", "size.height")


_ARRIVALS = """m AS (SELECT median(epoch_us(ts::TIMESTAMP)) AS mid FROM events), top AS (SELECT max(ts::TIMESTAMP) AS t FROM events, m WHERE epoch_us(ts::TIMESTAMP) <= mid),
a AS (SELECT event_id, ts::TIMESTAMP AS ts, event_type, value, time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start FROM events),
c AS (SELECT * FROM a UNION ALL SELECT a.* FROM a, top WHERE event_id % 20 = 0 AND start + INTERVAL 1 HOUR > t - INTERVAL 2 HOUR)"""


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of three files in their order of arrival: the older half, the newer half, and a twentieth of all again,
    most of which is late by then."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    middle = events.agg(F.percentile(F.unix_micros("ts"), F.lit(0.5)).alias("m")).scalar()
    older = F.unix_micros("ts") <= middle
    for part in (events.where(older), events.where(~older), events.where("event_id % 20 = 0")):
        part.coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(at)


@query(f"WITH {_ARRIVALS} SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM c GROUP BY 1, 2")
def st1_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over a stream with a watermark of two hours: late rows of closed windows are dropped, others count.

    The rows of a batch are late by the watermark of the batch before the last one, here of the older half.
    """
    out = I.latest_updates(I.windowed_counts(_arrivals(spark, d), late="2 hours"), ["start", "event_type"], "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id FROM events")
def st2_stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive again are dropped: within two hours of the watermark as known ones, before it as late ones."""
    return I.drain(I.first_seen(_arrivals(spark, d), ["event_id"], "ts", "2 hours"), "dedupe").select("event_id")


@query("""SELECT DISTINCT metadata.asset_id AS id FROM parsed_chunks WHERE metadata.asset_id IS NOT NULL""")
def st3_incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Points that arrive in micro-batches, appended if they are new."""
    at = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}"
    rows = I.stream(spark, d, "parsed_chunks").select(F.col("metadata.asset_id").alias("id")).where("id is not null")
    rows.writeStream.option("checkpointLocation", f"{at}-state").foreachBatch(lambda batch, _: I.upsert_points(batch, at)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at)
