"""Figures: references in text, captions and the images next to them, joined by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: References to figures by number, the caption of a figure, image links in Markdown, and the gap in points.
REFERENCES = (r"如\s*图\s*(\d+)", r"见\s*图\s*(\d+)", r"参\s*见\s*图\s*(\d+)", r"图\s*(\d+)\s*所示", r"图\s*(\d+)\s*[-.．、]", r"图\s*(\d+)", r"(?i)Figure\s*(\d+)", r"(?i)Fig\.?\s*(\d+)")
CAPTION = r"(?i)^\s*(?:图|Figure|Fig\.?)\s*(\d+)\s*[:：.、\s]"
MD_IMAGE = r"!\[[^\]]*\]\((images/[^)]+)\)"
SPATIAL_GAP = 120.0


def figure_refs(text: Column) -> Column:
    """The distinct figure numbers that a text mentions, in order."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in REFERENCES])
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def caption_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), CAPTION, 1), F.lit("")).cast("int")


def vertical_gap(one: Column, two: Column) -> Column:
    """The gap between two boxes: 0 where they overlap, infinite where one is missing."""
    return F.when(one.isNull() | two.isNull(), float("inf")).otherwise(F.greatest(one.y0 - two.y1, two.y0 - one.y1, F.lit(0.0)))


def side_by_side(one: Column, two: Column) -> Column:
    """Whether two boxes share a horizontal stretch; a missing box does not rule it out."""
    return F.when(one.isNull() | two.isNull(), True).otherwise(F.least(one.x1, two.x1) > F.greatest(one.x0, two.x0))


def captions(lines: DataFrame, images: DataFrame) -> DataFrame:
    """``(asset_id, page, number, caption, path)``: each caption with the nearest image of its page.

    Lines (asset_id, page, line_ix, text, bbox), images (asset_id, page, image_ix, path, image_bbox). A join by page with a
    predicate on the boxes; the first image wins a tie, and the last caption of a number on a page wins.
    """
    c = lines.withColumn("number", caption_number(F.col("text"))).where("number is not null")
    met = c.join(images, ["asset_id", "page"]).where(side_by_side(F.col("image_bbox"), F.col("bbox")))
    met = met.withColumn("gap", vertical_gap(F.col("image_bbox"), F.col("bbox"))).where(F.col("gap") < float("inf"))
    best = met.groupBy("asset_id", "page", "number", "line_ix").agg(F.min_by(F.struct("path", F.trim("text").alias("caption")), F.struct("gap", "image_ix")).alias("b"))
    return best.groupBy("asset_id", "page", "number").agg(F.max_by("b", "line_ix").alias("b")).select("asset_id", "page", "number", "b.caption", "b.path")


def associate(chunks: DataFrame, images: DataFrame, figures: DataFrame, gap: float = SPATIAL_GAP) -> DataFrame:
    """``(chunk_id, path, figure_id, caption)``: images named in a chunk by number, and images close to it.

    Chunks (chunk_id, asset_id, page, text, bbox). An image found both ways is attached once, by its number.
    """
    named = chunks.select("chunk_id", "asset_id", "page", F.explode(figure_refs(F.col("text"))).alias("number")).join(figures, ["asset_id", "page", "number"])
    named = named.select("chunk_id", "path", F.col("number").alias("figure_id"), "caption", F.lit(0).alias("pass"))
    near = chunks.where("bbox is not null").join(images.where("image_bbox is not null"), ["asset_id", "page"])
    near = near.where(side_by_side(F.col("image_bbox"), F.col("bbox")) & (vertical_gap(F.col("image_bbox"), F.col("bbox")) <= gap))
    near = near.select("chunk_id", "path", F.lit(None).cast("int").alias("figure_id"), F.lit("").alias("caption"), F.lit(1).alias("pass"))
    w = Window.partitionBy("chunk_id", "path").orderBy("pass", F.desc("figure_id"))
    return named.union(near).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("chunk_id", "path", "figure_id", "caption")
