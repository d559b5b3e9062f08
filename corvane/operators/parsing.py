"""From parser output to blocks: OCR answers, provenance, tables, pictures, embedded images."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES = "struct<layoutParsingResults:array<struct<markdown:struct<text:string,images:map<string,string>>>>>"
PROV = "array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>>>"


def ocr_pages(raw: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, line, page, text): one block for each page of the JSON lines of an OCR service; pages count from 0 over all lines."""
    lines = raw.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(payload_col), F.lit("")), "\n")).alias("line", "json"))
    parsed = lines.select("id", "line", F.from_json("json", PAGES).alias("p")).select("id", "line", F.posexplode("p.layoutParsingResults").alias("at", "r"))
    w = Window.partitionBy("id").orderBy("line", "at")
    return parsed.select("id", "line", (F.row_number().over(w) - 1).alias("page"), F.col("r.markdown.text").alias("text")).where("trim(text) <> ''")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]+\]|[^/:?#]+)", 1))


def url_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether an image may be fetched: http or https, a listed host or one below it, no address of a private net."""
    host = url_host(url)
    private = host.rlike(r"^(?:localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.|\[)")
    listed = F.lit(False)
    for h in hosts:
        listed = listed | (host == h) | host.endswith(f".{h}")
    return F.coalesce(url, F.lit("")).rlike("^(?i)https?://") & (host != "") & ~private & listed


def data_urls(md: Column) -> Column:
    """The embedded images of a Markdown text: (mime, name, n_bytes), named after their content."""
    found = F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(r"!\[[^\]]*\]\((data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=]+)\)"), F.lit(1))

    def one(url: Column) -> Column:
        mime, data = F.lower(F.regexp_extract(url, "^data:image/([A-Za-z0-9.+-]+);", 1)), F.unbase64(F.regexp_replace(url, "^[^,]*,", ""))
        suffix = F.when(mime == "jpeg", "jpg").otherwise(F.regexp_replace(mime, r"\+.*$", ""))
        return F.struct(mime.alias("mime"), F.concat(F.lit("images/"), F.substring(F.md5(data), 1, 12), F.lit("."), suffix).alias("path"), F.octet_length(data).alias("n_bytes"))

    return F.transform(found, one)


def without_data_urls(md: Column) -> Column:
    """The text with embedded images taken out of their links."""
    return F.regexp_replace(F.coalesce(md, F.lit("")), r"!\[([^\]]*)\]\(data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=]+\)", "![$1](images/embedded)")


def first_provenance(prov: Column) -> Column:
    """(page from 0, bbox) of the first place of an item."""
    p = F.get(F.from_json(prov, PROV), 0)
    return F.struct((p.page_no - 1).alias("page"), corners(p.bbox).alias("bbox"))


def corners(box: Column) -> Column:
    """A box whose corners come in any order."""
    return F.when(box.isNotNull(), F.struct(F.least(box.l, box.r).alias("x0"), F.least(box.t, box.b).alias("y0"), F.greatest(box.l, box.r).alias("x1"), F.greatest(box.t, box.b).alias("y1")))


def union_boxes(rows: DataFrame, keys: list[str], box: str = "bbox") -> DataFrame:
    """The box around all boxes of a group; missing ones do not count."""
    return rows.groupBy(*keys).agg(F.min(f"{box}.x0").alias("x0"), F.min(f"{box}.y0").alias("y0"), F.max(f"{box}.x1").alias("x1"), F.max(f"{box}.y1").alias("y1"))


def inject_pictures(blocks: DataFrame, pictures: DataFrame) -> DataFrame:
    """Blocks (asset_id, page, ord, text) with the pictures (asset_id, page, ref) of their page after the last one.

    Pages with pictures and no block get a block of their own.
    """
    refs = pictures.groupBy("asset_id", "page").agg(F.array_join(F.array_sort(F.collect_list("ref")), "\n").alias("refs"))
    last = blocks.groupBy("asset_id", "page").agg(F.max("ord").alias("ord")).join(refs, ["asset_id", "page"])
    full = blocks.join(last, ["asset_id", "page", "ord"], "left").select("asset_id", "page", "ord", F.concat_ws("\n\n", "text", "refs").alias("text"))
    alone = refs.join(blocks.select("asset_id", "page").distinct(), ["asset_id", "page"], "left_anti")
    return full.unionByName(alone.select("asset_id", "page", F.lit(None).cast("long").alias("ord"), F.col("refs").alias("text")))


def markdown_table(rows: Column) -> Column:
    """A Markdown table of an array of rows of cells; the first row is the head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(F.get(rows, 0))), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(rows, 0)), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")).otherwise(F.lit(""))


def html_text(html: Column) -> Column:
    """Text of HTML as Markdown: headings, lists, links, images, emphasis and cells get their marks, blocks get lines, other tags go."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{n}(?:\s[^>]*)?>", "\n\n" + "#" * n + " ")
    t = F.regexp_replace(t, r"(?is)<img\s[^>]*?alt=[\"']([^\"']*)[\"'][^>]*?src=[\"']([^\"']*)[\"'][^>]*>", "![$1]($2)")
    t = F.regexp_replace(t, r"(?is)<img\s[^>]*?src=[\"']([^\"']*)[\"'][^>]*>", "![]($1)")
    t = F.regexp_replace(t, r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    t = F.regexp_replace(t, r"(?i)</?(?:strong|b)(?:\s[^>]*)?>", "**")
    t = F.regexp_replace(t, r"(?i)</?(?:em|i)(?:\s[^>]*)?>", "*")
    t = F.regexp_replace(t, r"(?i)<li(?:\s[^>]*)?>\s*", "\n- ")
    t = F.regexp_replace(t, r"(?i)[ \t]*</li>[ \t]*", "")
    t = F.regexp_replace(t, r"(?is)</t[dh]>\s*<t[dh][^>]*>", " | ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|ul|ol|table|tr|h[1-6]|br)(?:[\s/][^>]*)?>", "\n\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"^\s+|\s+$", "")


def register_table_functions(spark) -> None:
    """Make the parsers that give many rows for one text callable from SQL: ``corvane_blocks(text)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="block_ix: int, text: string")
    class Blocks:
        """Paragraphs of a text, in order; none for null."""

        def eval(self, text: str):
            parts = (p.strip() for p in re.split(r"\n{2,}", text or ""))
            yield from enumerate(p for p in parts if p)

    spark.udtf.register("corvane_blocks", Blocks)


def parser_choice(scanned: Column, wanted: Column) -> Column:
    """The parser of a PDF: what was asked for, and OCR for scans where the choice is automatic."""
    return F.when(wanted != "auto", wanted).when(scanned, "page-ocr").otherwise("pymupdf")


def json_object(text: Column, schema: str) -> Column:
    """The object in an answer: the text itself, or what stands between the first and the last brace."""
    inner = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.from_json(F.when(F.trim(text).startswith("{") & F.rtrim(text).endswith("}"), text).otherwise(inner), schema)


def data_url(content: Column, suffix: Column) -> Column:
    mime = F.when(F.lower(suffix).isin("jpg", "jpeg"), "jpeg").otherwise(F.lower(suffix))
    return F.concat(F.lit("data:image/"), mime, F.lit(";base64,"), F.base64(content))
