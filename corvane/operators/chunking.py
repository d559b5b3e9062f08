"""From blocks and texts to chunks: headings, sections, coalescing, recursive splitting."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.session import materialize

HEADING_RATIO = 1.4
MAX_HEADING = 80
CHARS_PER_TOKEN = 3.5
#: Separators from the coarsest to the finest.
SEPARATORS = ("\n\n", "\n", "。", ".", "！", "!", "？", "?", "；", ";", " ", "")
ATX = r"^#{1,3}\s+\S"
#: Orders that are numbered together.
ORDER_RUN = 8192


def lines_of(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ix, line) of every line."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("ix", "line"))


def mark_headings(lines: DataFrame) -> DataFrame:
    """Adds ``is_heading``: Markdown headings, and short lines between blank lines or right after a heading.

    With a column ``size`` lines of 1.4 times the median size count too. The start of a text counts as blank, its end
    does not.
    """
    w = Window.partitionBy("id").orderBy("ix")
    s = F.trim(F.regexp_replace("line", r"[\t\r\f]", " "))
    rows = lines.withColumn("s", s).withColumn("before", F.lag("s").over(w)).withColumn("after", F.lead("s").over(w))
    atx = F.col("s").rlike(ATX)
    blank_after, blank_before = F.coalesce(F.col("after") == "", F.lit(False)), F.coalesce(F.col("before") == "", F.lit(True))
    short = (F.length("s") <= MAX_HEADING) & ~F.right("s", F.lit(1)).isin(".", "。", "?", "!", ",", ";")
    big = F.lit(False)
    if "size" in lines.columns:
        median = F.percentile(F.when(F.col("size") > 0, F.col("size")), F.lit(0.5)).over(Window.partitionBy("id"))
        rows = rows.withColumn("median", median)
        big = F.coalesce((F.col("size") >= HEADING_RATIO * F.col("median")) & (F.length("s") <= MAX_HEADING), F.lit(False))
    heading = (F.col("s") != "") & (atx | big | (short & blank_after & (blank_before | F.coalesce(F.col("before").rlike(ATX), F.lit(False)))))
    return rows.withColumn("is_heading", heading).drop("before", "after")


def sections(marked: DataFrame) -> DataFrame:
    """(id, section, heading, body): the lines under each heading, which may be empty before the first one.

    The section number is a running count; bodies are joined in order of their lines.
    """
    w = Window.partitionBy("id").orderBy("ix")
    rows = marked.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("ix", "line")))), lambda x: x.line), "\n")
    out = rows.groupBy("id", "section").agg(F.max(F.when(F.col("is_heading"), F.regexp_replace("s", r"^#{1,3}\s+", ""))).alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    return out.select("id", "section", F.coalesce("heading", F.lit("")).alias("heading"), "body").where("heading <> '' or body <> ''")


def split_keep(text: Column, sep: str) -> Column:
    """Pieces of a text with the separator kept at the end of each."""
    parts = F.split(text, F.lit("\\Q" + sep + "\\E"), F.lit(-1))
    return F.filter(F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit(sep))).otherwise(x)), lambda x: x != "")


def chars_within(tokens: int) -> int:
    """The longest text, in characters, that still counts as so many tokens."""
    return math.ceil((tokens + 0.5) * CHARS_PER_TOKEN) - 1


def leaf_edges(text: str, room: int) -> list[int]:
    """Where the smallest units begin, and the end of the text: separators cut level by level, and only what is longer than ``room``."""
    edges = [0, len(text)]
    for mark in SEPARATORS[:-1]:
        ends = re.compile(re.escape(mark))
        finer = [m.end() for lo, hi in pairwise(edges) if hi - lo > room for m in ends.finditer(text, lo, hi)]
        edges = sorted({*edges, *finer})
    return edges


def piece_edges(text: str, room: int, most: int) -> list[int]:
    """Edges of the pieces: units are taken together while they fit ``room``; a unit above ``most`` characters is cut hard."""
    kept = [0]
    edges = leaf_edges(text, room)
    for before, here in pairwise(edges):
        if here - kept[-1] > room and before > kept[-1]:
            kept.append(before)
    kept.append(len(text))
    hard = chars_within(most)
    step = max(1, int(most * CHARS_PER_TOKEN))
    return sorted({*kept, *(x for lo, hi in pairwise(kept) if hi - lo > hard for x in range(lo, hi, step))})


def overlap_begin(text: str, lo: int, hi: int, size: int) -> int:
    """Where the part of the piece lo..hi begins that the next one repeats: ``size`` characters, or a little more from the coarsest
    separator in the stretch of the same length before."""
    if hi - lo <= size:
        return lo
    first = max(lo, hi - 2 * size)
    stretch = text[first : hi - size]
    cuts = (first + len(head) + len(mark) for head, mark, _ in map(stretch.rpartition, SEPARATORS[:-1]) if mark)
    return next(cuts, hi - size)


def recursive_split(body: str | None, target: int = 500, most: int = 800, overlap: int = 60) -> list[str]:
    """Chunks of about ``target`` tokens, at most ``most`` before the overlap is put in front.

    Pieces lie side by side, so a piece with its overlap is one slice of the text.
    """
    if body is None:
        return []
    room = chars_within(target)
    if len(body) <= room or body.isspace():
        return [body]
    edges = piece_edges(body, room, most)
    size = int(max(overlap, 0) * CHARS_PER_TOKEN)
    begins = [0, *(overlap_begin(body, lo, hi, size) if size else hi for lo, hi in pairwise(edges[:-1]))]
    return [body[lo:hi] for lo, hi in zip(begins, edges[1:], strict=True)]


def split_bodies(rows: DataFrame, body_col: str = "body", target: int = 500, most: int = 800, overlap: int = 60) -> DataFrame:
    """All columns and ``piece_ix``, ``piece``: the body cut to the token budget; blank pieces are left out."""

    @F.pandas_udf("array<string>")
    def cut(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in bodies:
            yield batch.map(lambda b: [p for x in recursive_split(b, target, most, overlap) if (p := x.strip())])

    fits = F.length(body_col) / CHARS_PER_TOKEN <= target
    # Only bodies over the budget go to Python.
    small = rows.where(fits).withColumn("pieces", F.filter(F.array(F.regexp_replace(body_col, r"^\s+|\s+$", "")), lambda x: x != ""))
    return small.union(rows.where(~fits).withColumn("pieces", cut(body_col))).select(*rows.columns, F.posexplode("pieces").alias("piece_ix", "piece"))


def token_counter(name: str | None) -> Callable[[Column], Column]:
    """The counter of a registered tokenizer, or the approximation by characters where there is none of that name."""
    from corvane.operators.engine import registry

    return registry.get("tokenizer", name) if name in registry.names("tokenizer") else T.approx_tokens


def split_sections(texts: DataFrame, id_col: str, text_col: str, target: int = 500, most: int = 800, overlap: int = 60) -> DataFrame:
    """(id, section, heading, piece_ix, piece): texts cut at headings, and every section to the token budget."""
    rows = sections(mark_headings(lines_of(texts, id_col, text_col))).where("body <> ''")
    return split_bodies(rows, "body", target, most, overlap).drop("body")


def number_sections(blocks: DataFrame, run: int = ORDER_RUN) -> DataFrame:
    """Adds ``part``, the running number of the section within the asset.

    Works in runs of ``run`` orders: flags and sums inside a run, and one row for each run that carries over the last
    page and the number of sections so far. So an asset that holds a third of all blocks is spread over many tasks.
    """
    rows = blocks.withColumn("run", F.floor(F.col("ord") / run))
    w, whole = Window.partitionBy("asset_id", "run").orderBy("ord"), Window.partitionBy("asset_id").orderBy("run")
    ends = rows.groupBy("asset_id", "run").agg(F.max_by(F.struct("page"), "ord").alias("end")).withColumn("carried", F.lag("end").over(whole)).drop("end")
    before = F.coalesce(F.lag(F.struct("page")).over(w), F.col("carried"))
    new = (F.coalesce("heading", F.lit("")) != "") | before.isNull() | ~F.col("page").eqNullSafe(before.page)
    rows = rows.join(ends, ["asset_id", "run"]).withColumn("new", new.cast("int"))
    sums = rows.groupBy("asset_id", "run").agg(F.sum("new").alias("n")).withColumn("sofar", F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return rows.join(sums, ["asset_id", "run"]).withColumn("part", F.col("sofar") + F.sum("new").over(w)).drop("run", "carried", "new", "sofar")


def coalesce_blocks(blocks: DataFrame, target_chars: int) -> DataFrame:
    """(asset_id, part, page, heading, body, n_blocks): leaf blocks joined to sections.

    Blocks (asset_id, page, ord, text, heading). A heading or another page begins a section; a section that has reached
    ``target_chars`` is closed before the next block. Islands are found by running sums, so only the cap, which
    depends on what came before, folds over the blocks of one island.
    """
    rows = number_sections(blocks.withColumn("body", F.trim(F.coalesce("text", F.lit("")))).where("body <> ''"))
    grouped = rows.groupBy("asset_id", "part").agg(F.first("page").alias("page"), F.max("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("ord", "body"))).alias("items"))
    empty = F.array().cast("array<struct<body:string,n:int>>")

    def fold(acc: Column, item: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fresh = F.array_append(acc, F.struct(item.body.alias("body"), F.lit(1).alias("n")))
        longer = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(F.concat(last.body, F.lit("\n"), item.body).alias("body"), (last.n + 1).alias("n")))
        return F.when((F.size(acc) == 0) | (F.length(last.body) >= target_chars), fresh).otherwise(longer)

    folded = grouped.withColumn("parts", F.aggregate("items", empty, fold))
    return folded.select("asset_id", "part", "page", "heading", F.posexplode("parts").alias("sub", "p")).select("asset_id", "part", "sub", "page", "heading", "p.body", F.col("p.n").alias("n_blocks"))


def chunk_documents(blocks: DataFrame, target_chars: int = 1750) -> DataFrame:
    """(asset_id, chunk_index, page, section, text): coalesced, split, numbered through the asset."""
    pieces = split_bodies(coalesce_blocks(blocks, target_chars))
    # The number of pieces before a section, by runs of sections; only numbers of one section are given by a window over rows.
    counts = pieces.groupBy("asset_id", "part").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("part") / ORDER_RUN))
    whole = Window.partitionBy("asset_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("asset_id", "run").agg(F.sum("n").alias("n")).withColumn("sofar", F.coalesce(F.sum("n").over(whole), F.lit(0))).drop("n")
    inside = Window.partitionBy("asset_id", "run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(runs, ["asset_id", "run"]).select("asset_id", "part", (F.col("sofar") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("offset"))
    w = Window.partitionBy("asset_id", "part").orderBy("sub", "piece_ix")
    return pieces.join(offsets, ["asset_id", "part"]).select("asset_id", (F.col("offset") + F.row_number().over(w) - 1).cast("int").alias("chunk_index"), "page", F.coalesce("heading", F.lit("")).alias("section"), F.col("piece").alias("text"))


def looks_scanned(blocks: DataFrame, per_page: int) -> DataFrame:
    """(asset_id, chars, pages, scanned): too little text for its pages."""
    agg = blocks.groupBy("asset_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.greatest(F.count_distinct("page"), F.lit(1)).alias("pages"))
    return agg.withColumn("scanned", F.col("chars") < per_page * F.col("pages"))


def markdown_blocks(md: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block_ix, text, heading, level): paragraphs of Markdown; headings of level 1 to 6 are blocks of their own."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n{2,}"), lambda x: F.trim(x)), lambda x: x != "")
    rows = md.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("block_ix", "text"))
    mark = F.regexp_extract("text", r"^(#{1,6})\s+[^\n]+$", 1)
    return rows.withColumn("level", F.length(mark)).withColumn("heading", F.when(F.col("level") > 0, F.regexp_replace("text", r"^#{1,6}\s+", "")).otherwise(F.lit("")))


def ocr_blocks(payload: Column) -> Column:
    """The texts of an OCR answer: blocks, results or data; text, content or value; blanks are dropped."""
    kind = "array<struct<text:string,content:string,value:string>>"
    items = F.coalesce(*[F.from_json(F.get_json_object(payload, f"$.{name}"), kind) for name in ("blocks", "results", "data")], F.array().cast(kind))
    return F.filter(F.transform(items, lambda x: F.trim(F.coalesce(x.text, x.content, x.value))), lambda x: F.coalesce(x, F.lit("")) != "")


def enriched_documents(blocks: DataFrame, images: DataFrame, figures: DataFrame, target_chars: int = 1750) -> DataFrame:
    """(asset_id, chunk_index, page, section, text, images): the whole way from blocks to chunks.

    Blocks are coalesced and split; a chunk takes the images of its page that it names by number or, if the box around its page's
    blocks is close, that lie next to it; its text ends in its keywords. ``images`` and ``figures`` as for
    :func:`corvane.operators.figures.associate`.
    """
    from corvane.operators import figures as G
    from corvane.operators import keywords as K

    chunks = materialize(chunk_documents(blocks, target_chars), "document-chunks")
    named = chunks.select("asset_id", "chunk_index", "page", F.explode(G.figure_refs(F.col("text"))).alias("number")).join(figures, ["asset_id", "page", "number"])
    found = named.groupBy("asset_id", "chunk_index").agg(F.array_sort(F.collect_set(F.struct(F.col("number").alias("figure_id"), "path", "caption"))).alias("images"))
    words = K.keywords(chunks.withColumn("id", F.struct("asset_id", "chunk_index")), "id", "text").select("id.asset_id", "id.chunk_index", "keywords")
    whole = chunks.join(found, ["asset_id", "chunk_index"], "left").join(words, ["asset_id", "chunk_index"], "left")
    text = F.when(F.size("keywords") > 0, T.keyword_footer(F.col("text"), F.col("keywords"))).otherwise(F.col("text"))
    return whole.select("asset_id", "chunk_index", "page", "section", text.alias("text"), F.coalesce("images", F.array().cast("array<struct<figure_id:int,path:string,caption:string>>")).alias("images"))
