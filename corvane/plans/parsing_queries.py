"""Parsing steps, remaining state queries, search modes and evaluation runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import engine, index, parsing, state, vectors
from corvane.operators import lexical as L
from corvane.plans import evaluation_queries as EQ
from corvane.plans import lexical_queries as X
from corvane.plans import search_queries as SQ
from corvane.plans.registry import query
from corvane.session import materialize, shared_dir, table


@query("""SELECT asset_id, (row_number() OVER (PARTITION BY asset_id ORDER BY block_id) - 1)::INT AS page, md5(text) AS text_md5 FROM ir_blocks WHERE asset_id IS NOT NULL AND trim(text) <> ''""")
def parse_ocr_pages(spark: SparkSession, d: str) -> DataFrame:
    """Blocks written as the JSON lines of an OCR service, one page a line, and parsed back."""
    b = table(spark, d, "ir_blocks").where("asset_id is not null and trim(text) <> ''")
    line = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("text")).alias("markdown"))).alias("layoutParsingResults")))
    raw = b.select("asset_id", "block_id", line.alias("line")).groupBy("asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "line"))), lambda x: x.line), "\n").alias("payload"))
    return parsing.ocr_pages(raw, "asset_id", "payload").select(F.col("id").alias("asset_id"), "page", F.md5("text").alias("text_md5"))


@query("""WITH u AS (SELECT log_seq, CASE log_seq % 5 WHEN 0 THEN 'https://cdn.files.example/' || asset_id WHEN 1 THEN 'http://127.0.0.1/' || asset_id WHEN 2 THEN 'https://user@files.example:8443/x' WHEN 3 THEN 'ftp://files.example/x' ELSE 'https://files.example.evil/x' END AS url FROM asset_index_log)
SELECT log_seq, log_seq % 5 IN (0, 2) AS allowed, false AS insecure FROM u""")
def parse_allowed_urls(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("log_seq") % 5
    url = F.when(m == 0, F.concat(F.lit("https://cdn.files.example/"), "asset_id")).when(m == 1, F.concat(F.lit("http://127.0.0.1/"), "asset_id")).when(m == 2, "https://user@files.example:8443/x").when(m == 3, "ftp://files.example/x").otherwise("https://files.example.evil/x")
    rows = table(spark, d, "asset_index_log").select("log_seq", url.alias("url"))
    return rows.select("log_seq", parsing.url_allowed(F.col("url"), ["files.example"]).alias("allowed"), T.insecure_url(F.col("url")).alias("insecure"))


@query("""SELECT block_id, page, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM ir_blocks WHERE bbox IS NOT NULL AND page IS NOT NULL""")
def parse_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Places in the form of a layout parser, with corners the wrong way round, read back."""
    b = table(spark, d, "ir_blocks").where("bbox is not null and page is not null")
    prov = F.to_json(F.array(F.struct((F.col("page") + 1).alias("page_no"), F.struct(F.col("bbox.x1").alias("l"), F.col("bbox.y1").alias("t"), F.col("bbox.x0").alias("r"), F.col("bbox.y0").alias("b")).alias("bbox"))))
    return b.select("block_id", parsing.first_provenance(prov).alias("p")).select("block_id", "p.page", "p.bbox.x0", "p.bbox.y0", "p.bbox.x1", "p.bbox.y1")


@query("""SELECT asset_id, page, min(bbox.x0) AS x0, min(bbox.y0) AS y0, max(bbox.x1) AS x1, max(bbox.y1) AS y1 FROM ir_blocks GROUP BY asset_id, page""")
def c5_page_boxes(spark: SparkSession, d: str) -> DataFrame:
    return parsing.union_boxes(table(spark, d, "ir_blocks"), ["asset_id", "page"])


_PICS = "pics AS (SELECT metadata.asset_id AS asset_id, metadata.page AS page, '![](' || i.path || ')' AS ref FROM (SELECT metadata, unnest(metadata.images) AS i FROM parsed_chunks) WHERE metadata.page IS NOT NULL AND metadata.asset_id IS NOT NULL)"


@query(f"""WITH {_PICS}, refs AS (SELECT asset_id, page, string_agg(ref, chr(10) ORDER BY ref) AS refs FROM pics GROUP BY asset_id, page),
b AS (SELECT asset_id, page, block_id AS ord, coalesce(text, '') AS text FROM ir_blocks WHERE asset_id IS NOT NULL AND page IS NOT NULL), l AS (SELECT asset_id, page, max(ord) AS ord FROM b GROUP BY asset_id, page)
SELECT b.asset_id, b.page, b.ord, md5(CASE WHEN refs IS NOT NULL AND l.ord IS NOT NULL THEN b.text || chr(10) || chr(10) || refs ELSE b.text END) AS text_md5 FROM b LEFT JOIN l ON b.asset_id = l.asset_id AND b.page = l.page AND b.ord = l.ord LEFT JOIN refs r ON l.asset_id = r.asset_id AND l.page = r.page
UNION ALL SELECT asset_id, page, NULL, md5(refs) FROM refs WHERE (asset_id, page) NOT IN (SELECT (asset_id, page) FROM b)""")
def parse_injected_pictures(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    pics = table(spark, d, "parsed_chunks").where("metadata.page is not null and metadata.asset_id is not null").select(m.asset_id.alias("asset_id"), m.page.alias("page"), F.explode(m.images).alias("i")).select("asset_id", "page", F.concat(F.lit("![]("), F.col("i.path"), F.lit(")")).alias("ref"))
    blocks = table(spark, d, "ir_blocks").where("page is not null and asset_id is not null").select("asset_id", "page", F.col("block_id").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return parsing.inject_pictures(blocks, pics).select("asset_id", "page", "ord", F.md5("text").alias("text_md5"))


@query("""SELECT task_seq, '| key | value |' || chr(10) || '| --- | --- |' || coalesce(chr(10) || string_agg('| ' || k || ' | ' || replace(coalesce(v, ''), '|', '\\|') || ' |', chr(10) ORDER BY k), '') AS md FROM (SELECT task_seq, unnest(map_keys(parse_options)) AS k, unnest(map_values(parse_options)) AS v FROM task_records) GROUP BY task_seq""")
def parse_tables(spark: SparkSession, d: str) -> DataFrame:
    """Options of tasks as Markdown tables."""
    cells = F.transform(F.array_sort(F.map_entries("parse_options")), lambda e: F.array(e.key, e.value))
    rows = table(spark, d, "task_records").where("size(parse_options) > 0").select("task_seq", F.concat(F.array(F.array(F.lit("key"), F.lit("value"))), cells).alias("rows"))
    return rows.select("task_seq", parsing.markdown_table(F.col("rows")).alias("md"))


@query("""SELECT chunk_id, md5(regexp_replace(regexp_replace(chr(10) || chr(10) || '# ' || coalesce(metadata.section, '') || repeat(chr(10), 4) || plain || chr(10) || chr(10), '[ \\t]+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS md5 FROM (SELECT chunk_id, metadata, coalesce(text, '') AS plain FROM parsed_chunks WHERE NOT regexp_matches(coalesce(text, '') || coalesce(metadata.section, ''), '[<>&]'))""")
def parse_html(spark: SparkSession, d: str) -> DataFrame:
    """Chunks wrapped in HTML and stripped again, where they hold no marks of their own."""
    html = F.concat(F.lit("<html><script>x</script><h1>"), F.coalesce("metadata.section", F.lit("")), F.lit("</h1><p>"), F.coalesce("text", F.lit("")), F.lit("</p></html>"))
    rows = table(spark, d, "parsed_chunks").where(~F.concat(F.coalesce("text", F.lit("")), F.coalesce("metadata.section", F.lit(""))).rlike("[<>&]"))
    return rows.select("chunk_id", F.md5(parsing.html_text(html)).alias("md5"))


@query("""SELECT chunk_id, 'images/' || substr(md5(text), 1, 12) || '.png' AS path, octet_length(encode(text))::INT AS n_bytes FROM parsed_chunks WHERE trim(text) <> ''""")
def parse_data_urls(spark: SparkSession, d: str) -> DataFrame:
    """Texts as embedded images, decoded and named after their content."""
    md = F.concat(F.lit("see ![x](data:image/png;base64,"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", ""), F.lit(")"))
    rows = table(spark, d, "parsed_chunks").where("trim(text) <> ''").select("chunk_id", F.inline(parsing.data_urls(md)))
    return rows.select("chunk_id", "path", "n_bytes")


@query("""WITH s AS (SELECT asset_id, coalesce(sum(length(text)), 0) < 200 * greatest(count(DISTINCT page), 1) AS scanned FROM ir_blocks GROUP BY asset_id), l AS (SELECT DISTINCT asset_id, lower(coalesce(regexp_extract(relative_path, '\\.([A-Za-z0-9]+)$', 1), '')) AS ext FROM asset_index_log)
SELECT asset_id, ext, CASE WHEN ext <> 'pdf' THEN 'markitdown' WHEN coalesce(scanned, false) THEN 'page-ocr' ELSE 'pymupdf' END AS parser FROM l LEFT JOIN s USING (asset_id)""")
def parse_dispatch(spark: SparkSession, d: str) -> DataFrame:
    from corvane.operators import chunking
    from corvane.sources import sniff

    files = table(spark, d, "asset_index_log").select("asset_id", F.coalesce(sniff.extension(F.col("relative_path")), F.lit("")).alias("ext")).distinct()
    rows = files.join(chunking.looks_scanned(table(spark, d, "ir_blocks"), 200), "asset_id", "left")
    return rows.select("asset_id", "ext", parsing.parser_choice(F.coalesce("scanned", F.lit(False)), F.when(F.col("ext") == "pdf", "auto").otherwise("markitdown")).alias("parser"))


@query("""SELECT asset_id, sum(length(text))::BIGINT AS chars FROM ir_blocks WHERE text IS NOT NULL GROUP BY asset_id""")
def parse_text_chars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ir_blocks").where("text is not null").groupBy("asset_id").agg(F.sum(F.length("text")).alias("chars"))


@query("""SELECT query_id, nullif(trim(raw), '') AS raw FROM (SELECT DISTINCT query_id, raw FROM preprocessed_queries)""")
def t23_json_answers(spark: SparkSession, d: str) -> DataFrame:
    """Queries wrapped as answers of a model, with talk around the object for every other one, and salvaged."""
    obj = F.to_json(F.struct(F.col("raw").alias("title")))
    answer = F.when(F.col("query_id") % 2 == 0, obj).otherwise(F.concat(F.lit("Here you are: "), obj, F.lit(" done.")))
    rows = table(spark, d, "preprocessed_queries").select("query_id", "raw").distinct().select("query_id", answer.alias("a"))
    return rows.select("query_id", T.blank_to_null(parsing.json_object(F.col("a"), "title string").title).alias("raw"))


@query("""SELECT q.vec_id AS query_id, p.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0 AND q.vec_id = p.vec_id""")
def v6_self_is_found(spark: SparkSession, d: str) -> DataFrame:
    """Image to image: a stored vector as the query finds itself first."""
    hits = vectors.top_k(SQ.points(spark, d), SQ.probes(spark, d), 1)
    return hits.select("query_id", F.col("id").alias("vec_id"), "score")


_RESULT = f"WITH {SQ._ALL}, top AS (SELECT query_id, rank, asset_id, score FROM mr WHERE rank <= 10)"


def _routes(spark: SparkSession, d: str, every: bool = False) -> dict[str, DataFrame]:
    hits = SQ.route_hits(spark, d, every)
    cols = ["query_id", "chunk_id", "asset_id", "title", "evidence", "score", "images"]
    return {"text": hits.where("route = 'text'").select(*cols), "text-to-image": hits.where("route = 'text_to_image'").select(*cols)}


@query(f"{X.every_query(_RESULT)} SELECT query_id, rank::INT AS rank, asset_id, score FROM top")
def f7_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return engine.search("hybrid", _routes(spark, d, every=True), engine.EngineConfig(least_score=0.001)).select("query_id", "rank", "asset_id", "score")


@query(f"""WITH {X.every_query(SQ._ALL)}, o AS (SELECT query_id, asset_id, round(sum(1e0 / (60 + rank)), 9) AS score, min(rank) AS first FROM hr WHERE route = 'text' AND score > 0 GROUP BY query_id, asset_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, asset_id) AS rank FROM o) SELECT query_id, rank::INT AS rank, asset_id, score FROM r WHERE rank <= 10""")
def f8_text_mode(spark: SparkSession, d: str) -> DataFrame:
    return engine.search("text", _routes(spark, d, every=True)).select("query_id", "rank", "asset_id", "score")


@query(f"{_RESULT} SELECT query_id, rank::INT AS rank, asset_id, round(score, 4) AS score FROM top")
def a1_sources(spark: SparkSession, d: str) -> DataFrame:
    from corvane.operators import answers

    return answers.sources(SQ.merged(spark, d, 10).withColumn("route", F.lit("hybrid"))).select("query_id", "rank", "asset_id", "score")


_NAMES = """nm AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(raw, '[A-Z][a-z]{6,}')) AS name FROM preprocessed_queries WHERE query_id % 100 = 0),
tk AS (SELECT DISTINCT metadata.asset_id AS asset_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS name FROM parsed_chunks WHERE metadata.asset_id IS NOT NULL),
xp AS (SELECT query_id, list(DISTINCT asset_id ORDER BY asset_id) AS ex FROM nm JOIN tk USING (name) GROUP BY query_id),
lb AS (SELECT query_id, min(CASE WHEN lower(lang) IN ('en', 'zh') THEN lower(lang) ELSE 'other' END) AS grp FROM preprocessed_queries WHERE query_id % 100 = 0 GROUP BY query_id)"""
_RUN = f"""
WITH RECURSIVE {SQ._ALL}, {_NAMES}, top AS (SELECT query_id, rank, asset_id FROM mr WHERE rank <= 10),
d AS (SELECT q.query_id AS case_id, CASE WHEN x.ex IS NULL THEN 'negative' ELSE q.grp END AS grp, list_transform(coalesce((SELECT list(asset_id ORDER BY rank) FROM top WHERE top.query_id = q.query_id), []), lambda x: {EQ._SLUG}) AS acts,
  list_transform(coalesce(x.ex, []), lambda x: {EQ._SLUG}) AS ex FROM lb q LEFT JOIN xp x USING (query_id)),
{EQ._CASES[EQ._CASES.index('c AS (SELECT case_id'):]}"""


def _cases(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """(query_id, grp, expected): judged apart from any search: the assets with a chunk that names a name of the query.

    Groups are the declared languages; a query without such an asset is a negative case.
    """
    rows = X.query_rows(spark, d, every)
    name = lambda c: F.explode(F.regexp_extract_all(c, F.lit("[A-Z][a-z]{6,}"), F.lit(0))).alias("name")
    asked = materialize(rows.select("query_id", name(F.col("raw"))).distinct(), "names")
    small = asked.count() <= L.BROADCAST_TERMS
    told = table(spark, d, "parsed_chunks").where("metadata.asset_id is not null").select("metadata.asset_id", name(F.col("text")))
    # The few names of the queries reduce the chunks in place, before anything is shuffled or grouped.
    expected = told.join(F.broadcast(asked) if small else asked, "name").groupBy("query_id").agg(F.array_sort(F.collect_set("asset_id")).alias("expected"))
    grp = F.min(F.when(F.lower("lang").isin("en", "zh"), F.lower("lang")).otherwise("other"))
    cases = rows.groupBy("query_id").agg(grp.alias("grp")).join(expected, "query_id", "left")
    return cases.withColumn("grp", F.when(F.col("expected").isNull(), "negative").otherwise(F.col("grp")))


@query(f"""{X.every_query(_RUN)}, {EQ._METRICS}
SELECT k, coalesce(grp, 'all') AS grp, count(*) AS n, round(avg(hit_rate), 6) AS hit_rate, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr FROM r GROUP BY GROUPING SETS ((k, grp), (k))""")
def e18_evaluation_run(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search of every query with an id against judged cases: the metrics by group and cut."""
    results = materialize(SQ.merged(spark, d, 10, every=True).select("query_id", "rank", "asset_id"), "results")
    return engine.evaluate(results, _cases(spark, d, every=True)).select("k", "grp", "n", "hit_rate", "recall", "ndcg", "rr")


@query(f"""{_RUN} SELECT case_id AS query_id, grp, len(acts)::INT AS returned, CASE WHEN list_position(hits, 1) > 0 THEN list_position(hits, 1) END::INT AS rank,
  CASE WHEN grp = 'negative' THEN len(acts) = 0 ELSE list_position(hits, 1) IS NOT NULL AND list_position(hits, 1) > 0 END AS passed FROM p""")
def e19_grouped_cases(spark: SparkSession, d: str) -> DataFrame:
    """Each case with the rank of its first hit; a negative case passes if nothing is returned."""
    results = materialize(SQ.merged(spark, d, 10).select("query_id", "rank", "asset_id"), "results")
    return engine.run_cases(results, _cases(spark, d))


@query(f"""WITH RECURSIVE {SQ._ALL}, {_NAMES},
o AS (SELECT query_id, asset_id, round(sum(1e0 / (60 + rank)), 9) AS score, min(rank) AS first FROM hr WHERE route = 'text_to_image' AND score > 0 GROUP BY query_id, asset_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, asset_id) AS rank FROM o) WHERE rank <= 5),
im AS (SELECT DISTINCT metadata.asset_id AS asset_id FROM parsed_chunks WHERE metadata.source_type = 'image'),
e AS (SELECT query_id, asset_id FROM (SELECT query_id, unnest(ex) AS asset_id FROM xp) JOIN im USING (asset_id))
SELECT count(DISTINCT e.query_id) AS n, count(DISTINCT CASE WHEN t.query_id IS NOT NULL THEN e.query_id END) AS hits FROM e LEFT JOIN top t ON t.query_id = e.query_id AND t.asset_id = e.asset_id""")
def e20_text_to_image_run(spark: SparkSession, d: str) -> DataFrame:
    """The text-to-image mode against the judged image assets: cases, and cases with a hit among the first five."""
    results = engine.search("text-to-image", _routes(spark, d), engine.EngineConfig(top_k=5)).select("query_id", "asset_id", F.lit(True).alias("hit"))
    images = table(spark, d, "parsed_chunks").where("metadata.source_type = 'image'").select("metadata.asset_id").distinct()
    cases = _cases(spark, d).select("query_id", F.explode("expected").alias("asset_id")).join(images, "asset_id", "left_semi")
    return cases.join(results, ["query_id", "asset_id"], "left").agg(F.count_distinct("query_id").alias("n"), F.count_distinct(F.when(F.col("hit"), F.col("query_id"))).alias("hits"))


@query(f"""WITH {SQ._ALL}, o AS (SELECT query_id, asset_id, round(sum(1e0 / (60 + rank)), 9) AS score, min(rank) AS first FROM hr WHERE route = 'text_to_image' AND score > 0 GROUP BY query_id, asset_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, asset_id) AS rank FROM o) SELECT query_id, rank::INT AS rank, asset_id, score FROM r WHERE rank <= 10""")
def f8_text_to_image_mode(spark: SparkSession, d: str) -> DataFrame:
    return engine.search("text-to-image", _routes(spark, d)).select("query_id", "rank", "asset_id", "score")


@query("""SELECT vec_id AS id, label, (vec_id % 3 <> 0)::INT AS run FROM embeddings""")
def i3_image_index(spark: SparkSession, d: str) -> DataFrame:
    """A stored collection of image points: a third first, then all, of which only the new ones with a vector are added."""
    folder = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"
    pts = SQ.points(spark, d).where("vec is not null")
    name = index.collection_name("images", 64)
    for run, rows in enumerate((pts.where("id % 3 = 0"), pts)):
        stored = index.read_collection(spark, folder, name, "id long, label int, run int")
        index.append_collection(state.new_points(rows, stored).select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.lit(run).alias("run")), folder, name)
    return index.read_collection(spark, folder, name, "id long, label int, run int")


@query("""SELECT 'chunks' AS source, count(*) AS n FROM parsed_chunks WHERE metadata.asset_id IS NULL OR metadata.asset_id NOT IN (SELECT asset_id FROM asset_index_log WHERE deleted) UNION ALL SELECT 'blocks', count(*) FROM ir_blocks WHERE asset_id IS NULL OR asset_id NOT IN (SELECT asset_id FROM asset_index_log WHERE deleted)""")
def i4_deleted_everywhere(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "asset_index_log").where("deleted")
    kept = lambda name, df: state.without_assets(df, gone).agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
    return kept("chunks", table(spark, d, "parsed_chunks").select("metadata.asset_id")).union(kept("blocks", table(spark, d, "ir_blocks").select("asset_id")))


@query("""SELECT block_id, CASE WHEN octet_length(encode(coalesce(text, ''))) > 2000 THEN 'too many bytes' WHEN round(bbox.x1 - bbox.x0)::BIGINT * round(bbox.y1 - bbox.y0)::BIGINT > 20000 THEN 'too many pixels' END AS reason FROM ir_blocks""")
def k3_rejected_files(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as files: their bytes, and the size of their box as the size of an image."""
    from corvane.sources import sniff

    side = lambda a, b: F.round(F.col(f"bbox.{b}") - F.col(f"bbox.{a}")).cast("long")
    return table(spark, d, "ir_blocks").select("block_id", sniff.rejected(F.octet_length(F.coalesce("text", F.lit(""))), side("x0", "x1"), side("y0", "y1"), 2000, 20_000).alias("reason"))


@query("""SELECT task_seq FROM task_records WHERE started_at < 1738000000e0 - 86400e0""")
def k4_expired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_records").where("started_at < 1738000000e0 - 86400e0").select("task_seq")


@query("""SELECT chunk_id, CASE WHEN trim(metadata.context) <> '' THEN metadata.context || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS indexed FROM parsed_chunks""")
def k11_contextual_text(spark: SparkSession, d: str) -> DataFrame:
    from corvane.operators import lexical

    return table(spark, d, "parsed_chunks").select("chunk_id", lexical.index_text(F.col("text"), F.col("metadata.context")).alias("indexed"))


@query("""WITH i AS (SELECT chunk_id, ix, i, a, coalesce(nullif(trim(i.caption), ''), '图' || i.figure_id) AS cap FROM (SELECT chunk_id, generate_subscripts(metadata.images, 1) AS ix, unnest(metadata.images) AS i, metadata.asset_id AS a FROM parsed_chunks)), c AS (SELECT a, i.path AS path, max(cap) AS cached FROM i GROUP BY 1, 2),
d AS (SELECT chunk_id, i.path AS path, min(ix) AS ix, coalesce(max(cap), max(cached)) AS caption FROM i JOIN c ON c.a IS NOT DISTINCT FROM i.a AND c.path = i.i.path GROUP BY chunk_id, i.path)
SELECT chunk_id, string_agg(caption, chr(10) ORDER BY ix) AS captions FROM d WHERE caption IS NOT NULL GROUP BY chunk_id""")
def k14_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions for each chunk: its own or its number, else the one known for the image; each image once."""
    m = F.col("metadata")
    rows = table(spark, d, "parsed_chunks").select("chunk_id", m.asset_id.alias("a"), F.posexplode(m.images).alias("ix", "i")).select("chunk_id", "a", "ix", "i.path", F.coalesce(F.nullif(F.trim("i.caption"), F.lit("")), F.concat(F.lit("图"), F.col("i.figure_id").cast("string"))).alias("own"))
    known = rows.groupBy("a", "path").agg(F.max("own").alias("cached")).withColumnRenamed("a", "b").withColumnRenamed("path", "p")
    each = rows.join(known, F.col("a").eqNullSafe(F.col("b")) & (F.col("path") == F.col("p"))).groupBy("chunk_id", "path").agg(F.min("ix").alias("ix"), F.coalesce(F.max("own"), F.max("cached")).alias("caption")).where("caption is not null")
    return each.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "caption"))), lambda x: x.caption), "\n").alias("captions"))


@query("""SELECT p.vec_id AS id, p.label FROM embeddings p WHERE p.vec_id IN (SELECT vec_id * 2 FROM embeddings)""")
def s13_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    pts = SQ.points(spark, d)
    return pts.join(pts.select((F.col("id") * 2).alias("id")), "id", "left_semi").select("id", "label")


@query("""SELECT 'missing' AS kind, 'checksum' AS name UNION ALL SELECT 'unexpected', 'bbox' UNION ALL SELECT 'unexpected', 'level'""")
def s15_schema_difference(spark: SparkSession, d: str) -> DataFrame:
    missing, more = state.schema_difference(["block_id", "asset_id", "block_ix", "page", "text", "heading", "checksum"], table(spark, d, "ir_blocks"))
    return spark.createDataFrame([("missing", x) for x in missing] + [("unexpected", x) for x in more], "kind string, name string")


@query("""SELECT log_seq, substring(trim(regexp_replace(trim(asset_title), '[\\s/\\\\:*?"<>|]+', '_', 'g')), 1, 80) AS slug FROM asset_index_log WHERE asset_title IS NOT NULL""")
def t15_file_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_index_log").where("asset_title is not null").select("log_seq", T.slugify(F.col("asset_title")).alias("slug"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL)
SELECT doc_id, right(array_to_string(ps[greatest(len(ps) - 1, 1):], '. '), 200) AS tail FROM p""")
def t22_last_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.last_sentences(F.col("text")).alias("tail"))


@query("""SELECT log_seq, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(relative_path, ''), '^.*[/\\\\]', ''), '\\.[^.]*$', ''), '[_-]+', ' ', 'g')), ' '), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ') AS title FROM asset_index_log""")
def s11_default_titles(spark: SparkSession, d: str) -> DataFrame:
    from corvane.sources import sniff

    return table(spark, d, "asset_index_log").select("log_seq", T.default_title(sniff.stem(F.coalesce("relative_path", F.lit("")))).alias("title"))


@query("""SELECT task_seq, array_to_string(list_filter(s, lambda x, i: x <> '' AND list_position(s, x) = i), '|') AS ids FROM (SELECT task_seq, list_transform(coalesce(uploaded_files, []), lambda x: lower(regexp_replace(trim(x), '_[0-9a-f]{8}$', ''))) AS s FROM task_records)""")
def e22_distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform(F.coalesce("uploaded_files", F.array().cast("array<string>")), lambda x: F.lower(T.strip_hash(F.trim(x))))
    return table(spark, d, "task_records").select("task_seq", F.array_join(F.array_distinct(F.filter(names, lambda x: x != "")), "|").alias("ids"))


@query("""SELECT log_seq, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda x: trim(x)), lambda x: x <> ''))), '|') AS tags FROM asset_index_log""")
def x39_manifest_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of a manifest, written as JSON by every other row and delimited by the rest."""
    raw = F.when(F.col("log_seq") % 2 == 0, F.to_json(F.coalesce("tags", F.array().cast("array<string>")))).otherwise(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "))
    rows = table(spark, d, "asset_index_log").select("log_seq", raw.alias("raw"))
    tags = F.when(F.col("raw").startswith("["), T.clean_list(F.from_json("raw", "array<string>"))).otherwise(T.split_tags(F.col("raw")))
    return rows.select("log_seq", F.array_join(F.array_sort(tags), "|").alias("tags"))


@query("""SELECT task_seq, task_id, status, total, array_to_string(uploaded_files, '|') AS files FROM task_records""")
def x31_decoded_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Task rows written as JSON and decoded with the fixed schema; unknown fields are ignored."""
    from corvane.sources import jsonl

    raw = table(spark, d, "task_records").select("task_seq", F.to_json(F.struct("*", F.lit(1).alias("unknown"))).alias("doc"))
    return raw.select("task_seq", F.from_json("doc", jsonl.TASK).alias("t")).select("task_seq", "t.task_id", "t.status", "t.total", F.array_join("t.uploaded_files", "|").alias("files"))


@query("""SELECT asset_id, arg_max(trim(asset_title), log_seq) AS caption FROM asset_index_log WHERE trim(asset_title) <> '' GROUP BY asset_id""")
def x21_cached_captions(spark: SparkSession, d: str) -> DataFrame:
    """The log of titles read as a cache: the last entry of each asset that is not blank."""
    rows = table(spark, d, "asset_index_log").select("asset_id", "log_seq", F.trim("asset_title").alias("caption")).where("caption <> ''")
    return state.latest(rows, ["asset_id"], "log_seq").select("asset_id", "caption")


@query("""SELECT c.chunk_id, u.block_ix::INT AS block_ix, u.text AS text FROM (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n{2,}'), lambda x: trim(x, ' \t\n\r\f\v')), lambda x: x <> '') AS bs FROM parsed_chunks) c, (SELECT unnest(range(0, 10000)) AS i) r, LATERAL (SELECT r.i AS block_ix, c.bs[r.i + 1] AS text) u WHERE r.i < len(c.bs)""")
def u1_parser_table_function(spark: SparkSession, d: str) -> DataFrame:
    """A registered parser as a table function: one text gives many blocks, called from SQL with a lateral join."""
    parsing.register_table_functions(spark)
    table(spark, d, "parsed_chunks").select("chunk_id", "text").createOrReplaceTempView("__corvane_texts")
    return spark.sql("SELECT t.chunk_id, b.block_ix, b.text FROM __corvane_texts t, LATERAL corvane_blocks(t.text) b")


@query("""SELECT kind, count(*) FILTER (s IS NOT NULL) AS n, round(sqrt(sum(s * s) / count(s)), 4) AS rms FROM (SELECT kind, finished_at - started_at AS s FROM task_records) GROUP BY kind""")
def u9_aggregate_function(spark: SparkSession, d: str) -> DataFrame:
    """A registered aggregate: root mean squares of partial sums, which the plan combines before shuffling."""
    s = F.col("finished_at") - F.col("started_at")
    rows = table(spark, d, "task_records").select("kind", s.alias("s"))
    return rows.groupBy("kind").agg(F.count("s").alias("n"), F.round(engine.registry.get("aggregate", "rms")(F.col("s")), 4).alias("rms"))
