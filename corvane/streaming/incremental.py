"""Structured Streaming: incremental upserts, deduplication and windows with watermarks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_dir


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def drain(streamed: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over what is there now and read what it wrote; state and output are in the shared folder."""
    spark = streamed.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = streamed.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{at}-state").option("path", at).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(streamed.schema).parquet(at)


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by tumbling window and type, late ones within the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_updates(streamed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a streaming aggregation in update mode and read the last value of each key; closed windows leave the state."""
    spark = streamed.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # A batch that runs again writes the same folder again.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/part={number}")

    streamed.writeStream.outputMode("update").option("checkpointLocation", f"{at}-state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(at).drop("part")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in streamed.columns if c not in keys]), "batch").alias("last")).select(*keys, "last.*")


def first_seen(rows: DataFrame, keys: list[str], time_col: str, late: str) -> DataFrame:
    """The first row of each key, with state only as old as the watermark."""
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def upsert_points(batch: DataFrame, store: str) -> int:
    """Append the points of a micro-batch that the store does not hold, and say how many; used with foreachBatch.

    A batch that runs again after a failure adds nothing twice, since its ids are found in the store.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["id"])
    try:
        stored = spark.read.parquet(store)
        fresh = fresh.join(stored.select("id"), "id", "left_anti")
    except Exception as e:  # the store does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(store)
    return n
