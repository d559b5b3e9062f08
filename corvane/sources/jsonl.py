"""JSON-lines sources and sinks with tolerant reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGES = "array<struct<path:string,figure_id:int,caption:string,page:int>>"
CHUNK = f"text string, metadata struct<asset_id:string,asset_title:string,source_type:string,source_path:string,source_url:string,page:int,chunk_index:int,section:string,parser:string,markdown_path:string,tags:array<string>,images_dir:string,images:{IMAGES},context:string>"
ENTRY = "asset_id string, sha256 string, source_type string, relative_path string, asset_title string, ingested_at double, last_task_id string, deleted boolean, deleted_at double, tags array<string>"
TASK = "task_id string, kind string, status string, started_at double, finished_at double, total int, processed int, skipped int, failed int, current_item string, error string, uploaded_files array<string>, parse_options map<string,string>, source string, origin_task_id string, force boolean, failed_only boolean, asset_statuses map<string,string>"
CASES = "version string, groups map<string,array<struct<query:string,image_path:string,expected_asset_ids:array<string>>>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines source; blank and malformed lines are skipped, missing fields are null.

    A path that does not exist raises.
    """
    wanted = T._parse_datatype_string(schema)
    whole = T.StructType([*wanted.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where(F.col("_bad").isNull()).drop("_bad")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; the commit protocol takes the place of locks."""
    df.write.mode(mode).json(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The asset log with defaults: not deleted, no tags, blanks in tags dropped."""
    rows = read_jsonl(spark, path, ENTRY).where("asset_id is not null and asset_id <> ''")
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("tags", tags)


def eval_cases(raw: DataFrame, col: str, version: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """(*keys, grp, case_ix, query, image_path, expected) of case files held in a column; other versions are refused."""
    keys = keys or []
    rows = raw.select(*keys, F.from_json(col, CASES).alias("c")).select(*keys, "c.*").where("groups is not null")
    if version is not None:
        rows = rows.where(F.col("version") == version)
    return rows.select(*keys, F.explode("groups").alias("grp", "cases")).select(*keys, "grp", F.posexplode("cases").alias("case_ix", "c")).select(*keys, "grp", "case_ix", "c.query", "c.image_path", F.col("c.expected_asset_ids").alias("expected"))


def report_json(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text for each group of metric rows."""
    rest = [c for c in metrics.columns if c not in keys]
    return metrics.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("report"))
