"""Connected components over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of all ends of ``edges`` (id_1, id_2); the component is named after its least id.

    Alternates between pointing larger neighbours, then smaller ones, at the least neighbour, so long chains halve
    each round. Every round is written to the shared folder, which cuts the lineage and survives lost executors.
    """
    step = materialize(edges.select(F.greatest("id_1", "id_2").alias("a"), F.least("id_1", "id_2").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = step.select("a", "b").union(step.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.where("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        last = step
        step = materialize(small.where("a <> b").distinct(), "edges")
        drop(last)
        mark = step.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if before == tuple(mark):
            break
        before = tuple(mark)
    return step.select(F.col("a").alias("id"), F.col("b").alias("component")).union(step.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
