"""Reciprocal-rank fusion of channels and routes, merging of hits by asset, score blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the constant of reciprocal-rank fusion.
RRF_K = 60


def rrf(rank: Column, weight: Column | float) -> Column:
    return (F.lit(weight) if isinstance(weight, float) else weight) / (RRF_K + rank)


def rank_hits(hits: DataFrame, by: str = "asset_id") -> DataFrame:
    """``rank`` of each hit within its query and route: best score first, ties by ``by`` and chunk."""
    w = Window.partitionBy("query_id", "route").orderBy(F.desc("score"), by, "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w))


def fuse_channels(ranked: DataFrame, weights: dict[str, float], digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, score) of the ranked lists (query_id, route, chunk_id, rank) of several channels."""
    weight = F.lit(0.0)
    for name, value in weights.items():
        weight = F.when(F.col("route") == name, F.lit(value)).otherwise(weight)
    return ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(rrf(F.col("rank"), weight)), digits).alias("score"))


def merge_hits(hits: DataFrame, weights: list[tuple[str, float]], k: int, least: float = 0.0, digits: int = 9) -> DataFrame:
    """One row for each query and asset: the sum of the terms of all its chunk hits over all routes.

    Hits (query_id, route, chunk_id, asset_id, title, evidence, score, images ARRAY<STRING>). Ranks are given before hits
    of no score are dropped; routes without weight are left out. The title and first score are those of the first hit
    seen (order of routes, then rank), the evidence is the longest (the first of equals), the images keep their order.
    """
    order, weight = F.lit(99), F.lit(0.0)
    for ix, (name, value) in enumerate(weights):
        order, weight = F.when(F.col("route") == name, F.lit(ix)).otherwise(order), F.when(F.col("route") == name, F.lit(value)).otherwise(weight)
    rows = rank_hits(hits).withColumn("ord", order).withColumn("wt", weight).where("score > 0 and wt > 0")
    seen = F.struct("ord", "rank")
    merged = rows.groupBy("query_id", "asset_id").agg(
        F.round(F.sum(rrf(F.col("rank"), F.col("wt"))), digits).alias("score"),
        F.min(seen).alias("first"),
        F.min_by("title", seen).alias("title"),
        F.min_by("score", seen).alias("raw_score"),
        F.min_by(F.struct("evidence"), F.struct(-F.length("evidence"), "ord", "rank")).alias("e"),
        F.array_sort(F.collect_set("route")).alias("routes"),
        F.array_sort(F.collect_list(F.struct("ord", "rank", "images"))).alias("pics"),
    )
    merged = merged.withColumn("images", F.array_distinct(F.flatten(F.transform("pics", lambda x: F.coalesce(x.images, F.array().cast("array<string>"))))))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "asset_id")
    out = merged.where(F.col("score") >= least).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "asset_id", "score", "title", "raw_score", F.col("e.evidence").alias("evidence"), "routes", "images")


def min_max(value: Column, *keys: str) -> Column:
    """The value on a scale of 0 to 1 within its group; 1 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(1.0))


def rerank(hits: DataFrame, alpha: float, k: int, digits: int = 6) -> DataFrame:
    """Blend of a reader's score and the fused score: (query_id, chunk_id, ..., blended, rank).

    Hits (query_id, chunk_id, is_image, ce, raw_score, score). Images keep their own raw score instead of the reader's; the
    two kinds are scaled apart, the fused score jointly. Ties keep the fused order.
    """
    own = F.when(F.col("is_image"), F.col("raw_score")).otherwise(F.col("ce"))
    scaled = hits.withColumn("own", min_max(own, "query_id", "is_image")).withColumn("joint", min_max(F.col("score"), "query_id"))
    blended = scaled.withColumn("blended", F.round(alpha * F.col("own") + (1 - alpha) * F.col("joint"), digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("blended"), F.desc("score"), "chunk_id")
    return blended.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("own", "joint")


def overlap_score(query_tokens: Column, text_tokens: Column) -> Column:
    """The offline reader: shared tokens by all tokens."""
    both, either = F.array_intersect(query_tokens, text_tokens), F.array_union(query_tokens, text_tokens)
    return F.when(F.size(either) > 0, F.size(both) / F.size(either)).otherwise(F.lit(0.0))


def align_scores(slots: DataFrame, answers: DataFrame) -> DataFrame:
    """Scores of a reader that answers by index: slots without an answer get 0."""
    return slots.join(answers, ["query_id", "index"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
