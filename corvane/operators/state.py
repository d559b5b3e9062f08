"""Append-only logs: current state, tombstones, incremental upserts, cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key. An aggregate with map-side combining, so a hot key costs no window over its rows."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), order).alias("row")).select("row.*")


def active(log: DataFrame) -> DataFrame:
    """The last row of each asset that is not deleted."""
    return latest(log, ["asset_id"], "log_seq").where("not deleted")


def by_hash(log: DataFrame) -> DataFrame:
    """The last row of each content hash, unless it is a tombstone."""
    return latest(log.where("sha256 is not null and sha256 <> ''"), ["sha256"], "log_seq").where("not deleted")


def tombstones(log: DataFrame, assets: DataFrame, at: Column) -> DataFrame:
    """Rows to append that delete those of ``assets`` (asset_id) that are live now."""
    live = active(log).join(assets.select("asset_id").distinct(), "asset_id", "left_semi")
    return live.withColumn("deleted", F.lit(True)).withColumn("deleted_at", at)


def without_assets(rows: DataFrame, assets: DataFrame, asset_col: str = "asset_id") -> DataFrame:
    """The rows of a table that belong to none of ``assets``; rows without an asset stay."""
    return rows.join(assets.select(F.col("asset_id").alias(asset_col)).distinct(), asset_col, "left_anti")


def deletion_counts(assets: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """For each asset, how many rows of each table a deletion would remove."""
    out = assets.select("asset_id").distinct()
    for name, rows in tables.items():
        # Counted before joining: each table sends one row for each asset.
        n = rows.groupBy("asset_id").agg(F.count("*").alias(name))
        out = out.join(n, "asset_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def new_points(points: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """The points whose id is not stored yet; all with ``force``."""
    return points if force else points.join(existing.select("id"), "id", "left_anti")


def schema_difference(expected: list[str], df: DataFrame) -> tuple[list[str], list[str]]:
    """Columns that are missing and columns that nobody expects."""
    return sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))


def unique_names(rows: DataFrame, name: str, order: list[str], block: int = 4096) -> DataFrame:
    """``target``: the name, with _2, _3 ... before its suffix for further rows of one name.

    Rows are numbered inside blocks of the first order column, and blocks by running sums, so a name that many rows bear is
    spread over many tasks.
    """
    rows = rows.withColumn("blk", F.floor(F.col(order[0]) / block))
    per = rows.groupBy(name, "blk").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(name).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col(name).alias("of"), F.col("blk").alias("in"), "before")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(name, "blk").orderBy(*order)))
    rows = rows.join(before, F.col(name).eqNullSafe(F.col("of")) & (F.col("blk") == F.col("in"))).withColumn("rn", F.col("rn") + F.col("before")).drop("of", "in", "before", "blk")
    numbered = F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.col("rn").cast("string"), F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return rows.withColumn("target", F.when(F.col("rn") > 1, numbered).otherwise(F.col(name))).drop("rn")


def task_overlay(stored: DataFrame, memory: DataFrame, cols: list[str]) -> DataFrame:
    """Tasks of both; the running process knows better than the store."""
    joined = stored.select("task_id", *[F.col(c).alias(f"s_{c}") for c in cols]).join(memory.select("task_id", F.lit(True).alias("in_memory"), *[F.col(c).alias(f"m_{c}") for c in cols]), "task_id", "full_outer")
    return joined.select("task_id", *[F.when(F.col("in_memory"), F.col(f"m_{c}")).otherwise(F.col(f"s_{c}")).alias(c) for c in cols], F.coalesce("in_memory", F.lit(False)).alias("in_memory"))


def interrupted(tasks: DataFrame) -> DataFrame:
    """Tasks that were running and never finished are interrupted."""
    return tasks.withColumn("status", F.when((F.col("status") == "running") & F.col("finished_at").isNull(), "interrupted").otherwise(F.col("status")))


def retry_files(tasks: DataFrame, failed_only: bool = True) -> DataFrame:
    """(task_seq, file, status) of the files to run again: failed, skipped, not indexed, or without a status."""
    files = tasks.select("task_seq", F.posexplode("uploaded_files").alias("item_ix", "file"), F.coalesce("asset_statuses", F.create_map().cast("map<string,string>")).alias("m"))
    stem = F.regexp_replace(F.regexp_replace("file", r"^.*[/\\]", ""), r"\.[^.]*$", "")
    named = files.withColumn("status", F.try_element_at("m", stem)).drop("m")
    return named.where("status is null or status in ('failed', 'skipped', 'failed_index')") if failed_only else named


def progress(tasks: DataFrame, now: Column) -> DataFrame:
    """Seconds so far and the share that is done."""
    elapsed = F.round(F.coalesce("finished_at", now) - F.col("started_at"), 3)
    share = F.when(F.col("total") > 0, F.round(F.col("processed") / F.col("total"), 3)).otherwise(F.lit(0.0))
    return tasks.select("task_seq", elapsed.alias("elapsed"), share.alias("progress"))


def put_tasks(rows: DataFrame, store: str) -> None:
    """Write task rows to a store: rows are appended, and :func:`tasks` shows the last one of each task."""
    rows.write.mode("append").parquet(store)


def tasks(store: DataFrame, order: str = "task_seq") -> DataFrame:
    """The store of :func:`put_tasks` as its users see it."""
    return latest(store, ["task_id"], order)


def parse_statuses(assets: DataFrame, parsed: DataFrame, readable: DataFrame, force: bool = False) -> DataFrame:
    """(asset_id, status) of a parse run: 'skipped' where chunks exist and nothing is forced, 'ok' where there is something to read,
    else 'failed'."""
    flag = lambda df, name: df.select("asset_id").where("asset_id is not null").distinct().withColumn(name, F.lit(True))
    rows = assets.select("asset_id").distinct().join(flag(parsed, "cached"), "asset_id", "left").join(flag(readable, "there"), "asset_id", "left")
    return rows.select("asset_id", F.when(F.col("cached") & F.lit(not force), "skipped").when(F.col("there") | F.col("cached"), "ok").otherwise("failed").alias("status"))


def upload_preview(files: DataFrame, most_chars: int) -> DataFrame:
    """(id, verdict, same_as) of uploads (id, sha, size): refused, a copy of the first file with its hash, or new."""
    first = files.where("size > 0").groupBy("sha").agg(F.min("id").alias("first"))
    rows = files.join(first, "sha", "left")
    refused = (F.col("size") <= 0) | (F.col("size") > most_chars)
    copy = F.col("first") != F.col("id")
    return rows.select("id", F.when(refused, "rejected").when(copy, "duplicate").otherwise("new").alias("verdict"), F.when(~refused & copy, F.col("first")).alias("same_as"))
