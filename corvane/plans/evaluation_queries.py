"""Ranking metrics. The cases are the tasks: their files in order against the ids that got a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import evaluation as E
from corvane.plans.registry import query
from corvane.session import spread, table

_SLUG = "trim(regexp_replace(replace(lower(regexp_replace(x, '(_[0-9a-f]{8})+$', '')), 'ß', 'ss'), '[\\s\\-_]+', '-', 'g'), '-')"
_MATCH = "({a} <> '' AND {e} <> '' AND (contains({a}, {e}) OR contains({e}, {a})))"
_CASES = f"""
d AS (SELECT task_seq AS case_id, kind AS grp, list_transform(coalesce(uploaded_files, []), lambda x: {_SLUG}) AS acts, list_filter(list_transform(coalesce(map_keys(asset_statuses), []), lambda x: {_SLUG}), lambda x: x <> '') AS ex FROM task_records),
c AS (SELECT case_id, grp, acts, list_filter(ex, lambda x, i: list_position(ex, x) = i) AS exps FROM d),
g AS (SELECT case_id, 0 AS pos, []::INT[] AS claimed, []::INT[] AS flags FROM c UNION ALL
  SELECT case_id, pos + 1, CASE WHEN m IS NULL THEN claimed ELSE list_append(claimed, m) END, list_append(flags, (m IS NOT NULL)::INT) FROM
  (SELECT g.*, list_filter(range(1, len(exps) + 1), lambda j: NOT list_contains(claimed, j::INT) AND {_MATCH.format(a='acts[pos + 1]', e='exps[j]')})[1]::INT AS m FROM g JOIN c USING (case_id) WHERE pos < len(acts))),
p AS (SELECT c.*, flags, list_transform(acts, lambda a: (len(list_filter(exps, lambda e: {_MATCH.format(a='a', e='e')})) > 0)::INT) AS hits FROM c JOIN g USING (case_id) WHERE pos = len(acts))"""
_METRICS = """
k AS (SELECT p.*, k, len(exps) AS n, flags[1:k] AS fk FROM p, (VALUES (1), (3), (5), (10)) v(k)),
m AS (SELECT case_id, grp, k, coalesce(list_max(hits[1:k]), 0)::DOUBLE AS hit_rate,
  CASE WHEN list_position(hits, 1) > 0 THEN 1e0 / list_position(hits, 1) ELSE 0e0 END AS rr,
  CASE WHEN n > 0 AND len(acts) > 0 THEN coalesce(list_sum(list_transform(flags, lambda f, i: CASE WHEN f = 1 THEN list_sum(flags[1:i])::DOUBLE / i ELSE 0e0 END)), 0) / n ELSE 0e0 END AS ap,
  CASE WHEN n > 0 AND len(acts) > 0 THEN list_sum(fk)::DOUBLE / least(len(acts), k) ELSE 0e0 END AS precision,
  CASE WHEN n > 0 THEN coalesce(list_sum(fk), 0)::DOUBLE / n ELSE 0e0 END AS recall,
  CASE WHEN n > 0 AND len(acts) > 0 THEN list_sum(list_transform(fk, lambda f, i: f / log2(i + 1e0))) / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1e0 / log2(i + 1e0))) ELSE 0e0 END AS ndcg FROM k),
r AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM m)"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "task_records").select("task_seq", "kind", "uploaded_files", "asset_statuses")).select(F.col("task_seq").alias("case_id"), F.col("kind").alias("grp"), F.col("uploaded_files").alias("actual"), F.map_keys("asset_statuses").alias("expected"))


@query(f"WITH RECURSIVE {_CASES} SELECT case_id, array_to_string(hits, '') AS hits, array_to_string(flags, '') AS flags FROM p")
def e4_greedy_claims(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    return E.prepare(cases(spark, d)).select("case_id", text(F.col("hits")).alias("hits"), text(F.col("flags")).alias("flags"))


@query(f"WITH RECURSIVE {_CASES}, {_METRICS} SELECT case_id, k, hit_rate, round(rr, 6) AS rr, round(ap, 6) AS ap, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(ndcg, 6) AS ndcg FROM r")
def e12_case_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = E.at_k(E.prepare(cases(spark, d)))
    return m.select("case_id", "k", "hit_rate", *[F.round(x, 6).alias(x) for x in ("rr", "ap", "precision", "recall", "f1", "ndcg")])


E13_SQL = f"WITH RECURSIVE {_CASES}, {_METRICS} SELECT k, coalesce(grp, 'all') AS grp, count(*) AS n, round(avg(hit_rate), 6) AS hit_rate, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr, round(avg(ap), 6) AS ap FROM r GROUP BY GROUPING SETS ((k, grp), (k))"


@query(E13_SQL)
def e13_report(spark: SparkSession, d: str) -> DataFrame:
    return E.report(E.at_k(E.prepare(cases(spark, d))))


@query("""
WITH p AS (SELECT DISTINCT regexp_replace(asset_id, '_[^_]*$', '') AS prefix FROM asset_index_log WHERE regexp_matches(asset_id, '_[^_]*$')), i AS (SELECT DISTINCT asset_id AS id FROM asset_index_log WHERE NOT deleted)
SELECT prefix, coalesce(id, prefix) AS id FROM p LEFT JOIN i ON starts_with(id, prefix)""")
def e15_expanded_prefixes(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "asset_index_log")
    prefixes = log.where(F.col("asset_id").rlike("_[^_]*$")).select(F.regexp_replace("asset_id", "_[^_]*$", "").alias("prefix")).distinct()
    return E.expand_prefixes(prefixes, log.where("not deleted").select(F.col("asset_id").alias("id")).distinct())


@query("SELECT DISTINCT asset_id FROM asset_index_log WHERE NOT deleted")
def e16_active_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_index_log").where("not deleted").select("asset_id").distinct()


@query("SELECT lower(regexp_replace(asset_id, '_[0-9a-f]{8}$', '')) AS bare, array_to_string(list_sort(list_distinct(list(asset_id))), '|') AS fulls FROM asset_index_log WHERE NOT deleted GROUP BY 1")
def e17_variants(spark: SparkSession, d: str) -> DataFrame:
    bare = F.lower(F.regexp_replace("asset_id", "_[0-9a-f]{8}$", ""))
    return table(spark, d, "asset_index_log").where("not deleted").groupBy(bare.alias("bare")).agg(F.array_join(F.array_sort(F.collect_set("asset_id")), "|").alias("fulls"))


@query("""
WITH t AS (SELECT kind, finished_at - started_at AS s, row_number() OVER (PARTITION BY kind ORDER BY finished_at - started_at) AS rn, count(*) OVER (PARTITION BY kind) AS n FROM task_records WHERE finished_at - started_at IS NOT NULL)
SELECT kind, count(*) AS n, round(avg(s), 6) AS mean, max(s) FILTER (rn = greatest(floor(50 / 100e0 * n), 1)) AS p50, max(s) FILTER (rn = greatest(floor(95 / 100e0 * n), 1)) AS p95, max(s) FILTER (rn = greatest(floor(99 / 100e0 * n), 1)) AS p99, min(s) AS min, max(s) AS max FROM t GROUP BY kind""")
def e24_latencies(spark: SparkSession, d: str) -> DataFrame:
    return E.stat_block(table(spark, d, "task_records").withColumn("s", F.col("finished_at") - F.col("started_at")), ["kind"], "s")
