"""Chunking, figures, parsing of payloads and answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import answers as A
from corvane.operators import chunking as C
from corvane.operators import figures as G
from corvane.plans import lexical_queries as X
from corvane.plans import search_queries as SQ
from corvane.plans.registry import query
from corvane.session import materialize, table

_LINES = """
ln AS (SELECT chunk_id AS id, generate_subscripts(ls, 1) - 1 AS ix, unnest(ls) AS line FROM (SELECT chunk_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM parsed_chunks)),
s AS (SELECT *, trim(regexp_replace(line, '[\\t\\r\\f]', ' ', 'g')) AS s FROM ln),
w AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY ix) AS before, lead(s) OVER (PARTITION BY id ORDER BY ix) AS after FROM s),
h AS (SELECT id, ix, line, s, (s <> '' AND (regexp_matches(s, '^#{1,3}\\s+\\S') OR (length(s) <= 80 AND right(s, 1) NOT IN ('.', '。', '?', '!', ',', ';') AND coalesce(after = '', false) AND (coalesce(before = '', true) OR coalesce(regexp_matches(before, '^#{1,3}\\s+\\S'), false))))) AS is_heading FROM w)"""


@query(f"WITH {_LINES} SELECT id, sum(is_heading::INT)::BIGINT AS headings, count(*) AS lines FROM h GROUP BY id")
def c2_headings(spark: SparkSession, d: str) -> DataFrame:
    marked = C.mark_headings(C.lines_of(table(spark, d, "parsed_chunks"), "chunk_id", "text"))
    return marked.groupBy("id").agg(F.sum(F.col("is_heading").cast("long")).alias("headings"), F.count("*").alias("lines"))


@query(f"""WITH {_LINES}, n AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY id ORDER BY ix) AS section FROM h),
g AS (SELECT id, section::BIGINT AS section, coalesce(max(regexp_replace(s, '^#{{1,3}}\\s+', '')) FILTER (is_heading), '') AS heading, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY ix) FILTER (NOT is_heading), ''), '^\\s+|\\s+$', '', 'g') AS body FROM n GROUP BY id, section)
SELECT id, section, heading, md5(body) AS body_md5 FROM g WHERE heading <> '' OR body <> ''""")
def c1_sections(spark: SparkSession, d: str) -> DataFrame:
    marked = C.mark_headings(C.lines_of(table(spark, d, "parsed_chunks"), "chunk_id", "text"))
    return C.sections(marked).select("id", F.col("section").cast("long").alias("section"), "heading", F.md5("body").alias("body_md5"))


@query("""WITH p AS (SELECT chunk_id, string_split(text, '。') AS ps FROM parsed_chunks WHERE text IS NOT NULL)
SELECT chunk_id, array_to_string(list_filter(list_transform(ps, lambda x, i: CASE WHEN i < len(ps) THEN x || '。' ELSE x END), lambda x: x <> ''), '¦') AS pieces FROM p""")
def c8_kept_separators(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_chunks").where("text is not null").select("chunk_id", F.array_join(C.split_keep(F.col("text"), "。"), "¦").alias("pieces"))


@query()
def c9_recursive_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Sequential merging under a budget: no SQL; tested by invariants and by hand."""
    return C.split_bodies(table(spark, d, "parsed_chunks").where("text is not null").select("chunk_id", F.col("text").alias("body"))).drop("body")


_WINDOW = "substring(text, greatest(length(text) - 419, 1), least(210, length(text) - 210))"
_TAILS = "CASE WHEN length(text) <= 210 THEN 0 " + " ".join(f"WHEN contains({_WINDOW}, {mark}) THEN greatest(length(text) - 420, 0) + length({_WINDOW}) - position({back} IN reverse({_WINDOW})) + 1" for mark, back in (("chr(10) || chr(10)", "chr(10) || chr(10)"), ("chr(10)", "chr(10)"), *((f"'{c}'", f"'{c}'") for c in C.SEPARATORS[2:-1]))) + " ELSE length(text) - 210 END"


@query(f"SELECT chunk_id, greatest(1, round(length(text) / 35e-1)::INT) AS tokens, ({_TAILS})::INT AS tail_begin FROM parsed_chunks WHERE text IS NOT NULL")
def c10_tokens_and_tail(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each text, and where the part begins that a next piece would repeat."""
    from corvane.functions import text as T

    @F.pandas_udf("int")
    def begin(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: C.overlap_begin(t, 0, len(t), int(60 * C.CHARS_PER_TOKEN)))

    return table(spark, d, "parsed_chunks").where("text is not null").select("chunk_id", T.approx_tokens(F.col("text")).alias("tokens"), begin("text").alias("tail_begin"))


@query("""SELECT id, block_ix::INT AS block_ix, level::INT AS level, md5(text) AS text_md5 FROM (SELECT id, generate_subscripts(bs, 1) - 1 AS block_ix, unnest(bs) AS text, length(regexp_extract(unnest(bs), '^(#{1,6})\\s+[^\\n]+$', 1)) AS level FROM
(SELECT chunk_id AS id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n{2,}'), lambda x: trim(x)), lambda x: x <> '') AS bs FROM parsed_chunks))""")
def parse_markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.markdown_blocks(table(spark, d, "parsed_chunks"), "chunk_id", "text").select("id", "block_ix", "level", F.md5("text").alias("text_md5"))


@query("SELECT asset_id, coalesce(sum(length(text)), 0)::BIGINT AS chars, greatest(count(DISTINCT page), 1) AS pages, coalesce(sum(length(text)), 0) < 200 * greatest(count(DISTINCT page), 1) AS scanned FROM ir_blocks GROUP BY asset_id")
def parse_looks_scanned(spark: SparkSession, d: str) -> DataFrame:
    return C.looks_scanned(table(spark, d, "ir_blocks"), 200)


_ISLANDS = """
b AS (SELECT asset_id, page, block_id, trim(coalesce(text, '')) AS body, coalesce(heading, '') AS heading FROM ir_blocks WHERE asset_id IS NOT NULL AND trim(coalesce(text, '')) <> ''),
f AS (SELECT *, (heading <> '' OR page IS DISTINCT FROM lag(page) OVER (PARTITION BY asset_id ORDER BY block_id) OR lag(block_id) OVER (PARTITION BY asset_id ORDER BY block_id) IS NULL)::INT AS new FROM b),
p AS (SELECT *, sum(new) OVER (PARTITION BY asset_id ORDER BY block_id) AS part FROM f)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ir_blocks").where("asset_id is not null").select("asset_id", "page", F.col("block_id").alias("ord"), "text", "heading")


@query(f"WITH {_ISLANDS} SELECT asset_id, part::BIGINT AS part, any_value(page) AS page, max(heading) AS heading, count(*) AS n_blocks, md5(string_agg(body, chr(10) ORDER BY block_id)) AS body_md5 FROM p GROUP BY asset_id, part")
def parse_sections_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Coalescing without a cap, which is what SQL states."""
    out = C.coalesce_blocks(_blocks(spark, d), 2_000_000_000)
    return out.select("asset_id", F.col("part").cast("long").alias("part"), "page", F.coalesce("heading", F.lit("")).alias("heading"), F.col("n_blocks").cast("long").alias("n_blocks"), F.md5("body").alias("body_md5"))


@query(f"""WITH RECURSIVE {_ISLANDS},
o AS (SELECT *, row_number() OVER (PARTITION BY asset_id, part ORDER BY block_id) AS rn FROM p),
r AS (SELECT asset_id, part, rn, 0 AS sub, length(body) AS len, body FROM o WHERE rn = 1 UNION ALL
  SELECT o.asset_id, o.part, o.rn, CASE WHEN r.len >= 600 THEN r.sub + 1 ELSE r.sub END, CASE WHEN r.len >= 600 THEN length(o.body) ELSE r.len + 1 + length(o.body) END, o.body FROM r JOIN o ON o.asset_id = r.asset_id AND o.part = r.part AND o.rn = r.rn + 1)
SELECT asset_id, part::BIGINT AS part, sub::INT AS sub, count(*)::BIGINT AS n_blocks, md5(string_agg(body, chr(10) ORDER BY rn)) AS body_md5 FROM r GROUP BY asset_id, part, sub""")
def parse_capped_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.coalesce_blocks(_blocks(spark, d), 600).select("asset_id", F.col("part").cast("long").alias("part"), "sub", F.col("n_blocks").cast("long").alias("n_blocks"), F.md5("body").alias("body_md5"))


@query()
def parse_chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from blocks to chunks; its sequential part has no SQL."""
    return C.chunk_documents(_blocks(spark, d))


@query()
def parse_enriched_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the figures they name or lie close to, and with a footer of keywords; its sequential part has no SQL."""
    lines, images = _boxes(spark, d)
    return C.enriched_documents(_blocks(spark, d), images, G.captions(lines, images))


_REFS = "list_sort(list_distinct(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(coalesce(text, ''), '{p.replace(chr(92), chr(92))}', 1)" for p in G.REFERENCES) + "), lambda x: x::INT)))"


@query(f"SELECT chunk_id, array_to_string({_REFS}, ',') AS refs FROM parsed_chunks")
def g1_figure_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_chunks").select("chunk_id", F.array_join(F.transform(G.figure_refs(F.col("text")), lambda x: x.cast("string")), ",").alias("refs"))


_GAP = "CASE WHEN i.b.y1 <= c.b.y0 THEN c.b.y0 - i.b.y1 WHEN c.b.y1 <= i.b.y0 THEN i.b.y0 - c.b.y1 ELSE 0e0 END"
_OVER = "NOT (i.b.x1 <= c.b.x0 OR c.b.x1 <= i.b.x0)"
_CAPS = f"""
im AS (SELECT asset_id, page, block_id AS image_ix, 'images/b' || block_id || '.png' AS path, bbox AS b FROM ir_blocks WHERE level > 0 AND bbox IS NOT NULL AND asset_id IS NOT NULL AND page IS NOT NULL),
cp AS (SELECT asset_id, page, block_id AS line_ix, trim(text) AS caption, bbox AS b, nullif(regexp_extract(trim(coalesce(text, '')), '{G.CAPTION}', 1), '')::INT AS number FROM ir_blocks WHERE page IS NOT NULL),
mt AS (SELECT c.asset_id, c.page, number, line_ix, caption, path, row_number() OVER (PARTITION BY line_ix ORDER BY {_GAP}, image_ix) AS rn FROM cp c JOIN im i ON c.asset_id = i.asset_id AND c.page = i.page WHERE number IS NOT NULL AND c.b IS NOT NULL AND {_OVER}),
fg AS (SELECT asset_id, page, number, arg_max(caption, line_ix) AS caption, arg_max(path, line_ix) AS path FROM mt WHERE rn = 1 GROUP BY asset_id, page, number)"""


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blocks = table(spark, d, "ir_blocks").where("page is not null and asset_id is not null")
    images = blocks.where("level > 0 and bbox is not null").select("asset_id", "page", F.col("block_id").alias("image_ix"), F.concat(F.lit("images/b"), F.col("block_id").cast("string"), F.lit(".png")).alias("path"), F.col("bbox").alias("image_bbox"))
    return blocks.select("asset_id", "page", F.col("block_id").alias("line_ix"), "text", "bbox"), images


@query(f"WITH {_CAPS} SELECT asset_id, page, number, md5(caption) AS caption_md5, path FROM fg")
def g2_captions(spark: SparkSession, d: str) -> DataFrame:
    return G.captions(*_boxes(spark, d)).select("asset_id", "page", "number", F.md5("caption").alias("caption_md5"), "path")


@query(f"""WITH {_CAPS},
rf AS (SELECT block_id AS chunk_id, asset_id, page, unnest({_REFS}) AS number FROM ir_blocks WHERE page IS NOT NULL),
nm AS (SELECT chunk_id, path, rf.number AS figure_id, 0 AS pass FROM rf JOIN fg USING (asset_id, page, number)),
nr AS (SELECT c.block_id AS chunk_id, path, NULL::INT AS figure_id, 1 AS pass FROM (SELECT block_id, asset_id, page, bbox AS b FROM ir_blocks WHERE bbox IS NOT NULL AND page IS NOT NULL) c JOIN im i ON c.asset_id = i.asset_id AND c.page = i.page WHERE {_OVER} AND {_GAP} <= 120),
un AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, path ORDER BY pass, figure_id DESC) AS rn FROM (SELECT * FROM nm UNION ALL SELECT * FROM nr))
SELECT chunk_id, path, figure_id FROM un WHERE rn = 1""")
def g5_attached_images(spark: SparkSession, d: str) -> DataFrame:
    lines, images = _boxes(spark, d)
    return G.associate(lines.withColumnRenamed("line_ix", "chunk_id"), images, G.captions(lines, images)).select("chunk_id", "path", "figure_id")


@query("""WITH t AS (SELECT chunk_id, coalesce(text, '') || coalesce(list_aggregate(list_transform(metadata.images, lambda i: ' ![fig](' || i.path || ')'), 'string_agg', ''), '') AS md FROM parsed_chunks)
SELECT chunk_id, array_to_string(regexp_extract_all(md, '!\\[[^\\]]*\\]\\((images/[^)]+)\\)', 1), ',') AS paths FROM t WHERE md LIKE '%images/%'""")
def g6_markdown_images(spark: SparkSession, d: str) -> DataFrame:
    md = F.concat(F.coalesce("text", F.lit("")), F.coalesce(F.array_join(F.transform("metadata.images", lambda i: F.concat(F.lit(" ![fig]("), i.path, F.lit(")"))), ""), F.lit("")))
    rows = table(spark, d, "parsed_chunks").select("chunk_id", md.alias("md")).where("md like '%images/%'")
    return rows.select("chunk_id", F.array_join(F.regexp_extract_all("md", F.lit(G.MD_IMAGE), F.lit(1)), ",").alias("paths"))




@query("""SELECT chunk_id, CASE WHEN trim(text) <> '' THEN md5(trim(text)) ELSE md5('') END AS text_md5 FROM parsed_chunks WHERE text IS NOT NULL""")
def parse_ocr_payloads(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, field: F.to_json(F.struct(F.array(F.struct(F.col("text").alias(field))).alias(name)))
    payload = F.when(F.col("chunk_id") % 3 == 0, one("blocks", "text")).when(F.col("chunk_id") % 3 == 1, one("results", "content")).otherwise(one("data", "value"))
    rows = table(spark, d, "parsed_chunks").where("text is not null").select("chunk_id", payload.alias("payload"))
    return rows.select("chunk_id", F.md5(F.array_join(C.ocr_blocks(F.col("payload")), "\n")).alias("text_md5"))


@query("""SELECT chunk_id, concat_ws(chr(10), nullif(trim(metadata.asset_title), ''), nullif(array_to_string(metadata.tags, ', '), ''), trim(text)) AS signal FROM parsed_chunks WHERE metadata.source_type = 'image' AND trim(text) <> ''""")
def parse_image_chunks(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    rows = table(spark, d, "parsed_chunks").where("metadata.source_type = 'image' and trim(text) <> ''")
    return rows.select("chunk_id", F.concat_ws("\n", F.nullif(F.trim(m.asset_title), F.lit("")), F.nullif(F.array_join(m.tags, ", "), F.lit("")), F.trim("text")).alias("signal"))


def _hits(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """The ten best chunks of each query from the fused lexical channels."""
    m = F.col("metadata")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    ranked = materialize(SQ.fused(*SQ.channels(spark, d, every)).withColumn("rank", best).where("rank <= 10"), "ranked")
    rows = SQ.chunks_of(spark, d, ranked).join(ranked.select("query_id", "rank", "chunk_id"), "chunk_id")
    return rows.select("query_id", "rank", "chunk_id", F.coalesce(m.asset_id, F.lit("")).alias("asset_id"), F.coalesce(m.asset_title, F.lit("")).alias("title"), m.page.alias("page"), F.coalesce("text", F.lit("")).alias("evidence"), m.images.alias("images"))


_HITS = f"""{X.ZH}, {X.ZH_Q}, {X.ZH_HITS}, {X.EN}, {SQ._FUSED}, hits AS (SELECT query_id, rank, coalesce(metadata.asset_id, '') AS asset_id, coalesce(metadata.asset_title, '') AS title, metadata.page AS page, coalesce(text, '') AS evidence, metadata.images AS images FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu) f JOIN parsed_chunks p ON p.chunk_id = f.id WHERE rank <= 10)"""


@query(f"""WITH {X.every_query(_HITS)}, b AS (SELECT query_id, rank, concat_ws(chr(10), '[' || rank || '] asset_id=' || asset_id || ' title=' || title || ' page=' || coalesce(page::VARCHAR, 'None'), substring(evidence, 1, 1200),
  CASE WHEN len(images) > 0 THEN '关联图片: ' || array_to_string(list_transform(images, lambda i: CASE WHEN i.figure_id <> 0 THEN '图' || i.figure_id ELSE '图' END || CASE WHEN trim(coalesce(i.caption, '')) <> '' THEN ': ' || trim(i.caption) ELSE '' END || ' (/parsed-image/' || asset_id || '/' || coalesce(i.path, '') || ')'), '; ') END) AS b FROM hits)
SELECT query_id, md5(string_agg(b, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM b GROUP BY query_id""")
def a2_evidence_context(spark: SparkSession, d: str) -> DataFrame:
    return A.evidence_context(_hits(spark, d, every=True)).select("query_id", F.md5("context").alias("context_md5"))


@query(f"WITH {_HITS} SELECT query_id, coalesce(string_agg(trim(substring(evidence, 1, 300)), chr(10) || chr(10) ORDER BY rank) FILTER (trim(substring(evidence, 1, 300)) <> ''), '') AS answer FROM hits WHERE rank <= 3 GROUP BY query_id")
def a4_fallback_answers(spark: SparkSession, d: str) -> DataFrame:
    return A.fallback_answer(_hits(spark, d))


@query(f"WITH {_HITS}, i AS (SELECT query_id, rank, generate_subscripts(images, 1) - 1 AS ix, unnest(images) AS image FROM hits), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, ix) AS rn FROM i WHERE ix < 2) SELECT query_id, rank, ix::INT AS ix, image.path AS path FROM n WHERE rn <= 4")
def a5_image_parts(spark: SparkSession, d: str) -> DataFrame:
    return A.image_parts(_hits(spark, d))
