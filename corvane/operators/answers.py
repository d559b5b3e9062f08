"""From hits to sources, evidence and an answer without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sources(hits: DataFrame) -> DataFrame:
    """The projection shown to users: rounded score, routes or the route alone."""
    return hits.select("query_id", "rank", "asset_id", "title", F.round("score", 4).alias("score"), F.coalesce("routes", F.array("route")).alias("routes"))


def image_hint(asset: Column, images: Column) -> Column:
    """One line that names the figures of a hit; empty without images."""

    def label(i: Column) -> Column:
        tag = F.when(i.figure_id.isNotNull() & (i.figure_id != 0), F.concat(F.lit("图"), i.figure_id.cast("string"))).otherwise(F.lit("图"))
        cap = F.trim(F.coalesce(i.caption, F.lit("")))
        return F.concat(F.when(cap != "", F.concat(tag, F.lit(": "), cap)).otherwise(tag), F.lit(" (/parsed-image/"), asset, F.lit("/"), F.coalesce(i.path, F.lit("")), F.lit(")"))

    return F.when(F.coalesce(F.size(images), F.lit(0)) > 0, F.concat(F.lit("关联图片: "), F.array_join(F.transform(images, label), "; "))).otherwise(F.lit(""))


def evidence_context(hits: DataFrame, most: int = 1200) -> DataFrame:
    """(query_id, context): numbered evidence of all hits of a query, in order of rank. Hits are few for each query."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] asset_id="), F.col("asset_id"), F.lit(" title="), F.col("title"), F.lit(" page="), F.coalesce(F.col("page").cast("string"), F.lit("None")))
    hint = image_hint(F.col("asset_id"), F.col("images"))
    block = F.concat_ws("\n", head, F.substring("evidence", 1, most), F.nullif(hint, F.lit("")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x.b), "\n\n").alias("context"))


def fallback_answer(hits: DataFrame, n: int = 3, most: int = 300) -> DataFrame:
    """(query_id, answer): the beginnings of the first hits; empty ones are skipped after the cut."""
    first = hits.where(F.col("rank") <= n).withColumn("part", F.trim(F.substring("evidence", 1, most)))
    parts = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x.part != ""), lambda x: x.part)
    return first.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("answer"))


def image_parts(hits: DataFrame, per_hit: int = 2, total: int = 4) -> DataFrame:
    """(query_id, rank, ix, path): at most ``per_hit`` images of a hit and ``total`` of a query."""
    rows = hits.select("query_id", "rank", F.posexplode("images").alias("ix", "image")).where(F.col("ix") < per_hit)
    w = Window.partitionBy("query_id").orderBy("rank", "ix")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= total).select("query_id", "rank", "ix", F.col("image.path").alias("path"))
