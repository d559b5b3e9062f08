"""Small cases with results worked out by hand."""

import io
import zipfile

import math
import uuid

import pytest
from pyspark.sql import functions as F

from corvane.functions import ids
from corvane.functions import text as T
from corvane.operators import answers, chunking, evaluation, figures, fusion, keywords, lexical, querying, state, vectors
from corvane.sources import jsonl, sniff
from corvane.streaming import incremental

HIT = "query_id int, route string, chunk_id int, asset_id string, title string, evidence string, score double, images array<string>"


def hits(spark, rows):
    return spark.createDataFrame([(1, r, c, a, a, "e" * n, s, p) for r, c, a, n, s, p in rows], HIT)


def merged(spark, rows, weights, k=10, least=0.0):
    return {r["asset_id"]: r for r in fusion.merge_hits(hits(spark, rows), weights, k, least).collect()}


def test_merge_sums_routes(spark):
    got = merged(spark, [("text", 1, "a", 1, 1.0, []), ("image", 2, "a", 1, 1.0, [])], [("text", 0.6), ("image", 0.4)])
    assert got["a"]["score"] == pytest.approx(1 / 61, abs=1e-8)
    assert got["a"]["routes"] == ["image", "text"]


def test_merge_counts_each_chunk_and_drops_zero_scores(spark):
    got = merged(spark, [("text", 1, "a", 1, 0.9, ["x"]), ("text", 2, "a", 5, 0.8, ["y", "x"]), ("text", 3, "b", 1, 0.7, None), ("text", 4, "z", 1, 0.0, [])], [("text", 1.0)])
    assert got["a"]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    assert got["b"]["score"] == pytest.approx(1 / 63, abs=1e-8)
    assert "z" not in got
    assert got["a"]["images"] == ["x", "y"] and len(got["a"]["evidence"]) == 5


def test_merge_ignores_routes_without_weight_and_low_scores(spark):
    rows = [("text", 1, "a", 1, 1.0, []), ("image", 2, "b", 1, 1.0, []), ("text", 3, "c", 1, 0.5, [])]
    assert set(merged(spark, rows, [("text", 1.0), ("image", 0.0)])) == {"a", "c"}
    assert set(merged(spark, rows, [("text", 1.0)], least=1 / 62 + 1e-9)) == {"a"}


def test_rank_ties_go_by_asset(spark):
    got = fusion.rank_hits(hits(spark, [("text", 1, "b", 1, 1.0, []), ("text", 2, "a", 1, 1.0, [])])).collect()
    assert {r["asset_id"]: r["rank"] for r in got} == {"a": 1, "b": 2}


def test_rerank_blends(spark):
    df = spark.createDataFrame([(1, 1, False, 0.2, 0.9, 0.9), (1, 2, False, 0.8, 0.1, 0.1)], "query_id int, chunk_id int, is_image boolean, ce double, raw_score double, score double")
    assert [(r["chunk_id"], r["blended"]) for r in fusion.rerank(df, 0.6, 5).orderBy("rank").collect()] == [(2, 0.6), (1, 0.4)]


def test_missing_answers_of_a_reader_are_zero(spark):
    got = fusion.align_scores(spark.createDataFrame([(1, 0), (1, 1)], "query_id int, index int"), spark.createDataFrame([(1, 0, 0.5)], "query_id int, index int, score double"))
    assert {r["index"]: r["score"] for r in got.collect()} == {0: 0.5, 1: 0.0}


def test_idf_and_vectors(spark):
    docs = lexical.token_table(spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "c"])], "id int, t array<string>"), "id", F.col("t"))
    tf, stats = lexical.term_frequencies(docs), lexical.corpus_stats(docs)
    idf = {r["term"]: r["idf"] for r in lexical.idf_table(tf, stats).collect()}
    assert idf["a"] == pytest.approx(math.log(1.2)) and idf["b"] == pytest.approx(math.log(2))
    vec = {(r["id"], r["term"]): r["w"] for r in lexical.document_vectors(docs).collect()}
    assert vec[0, "a"] == pytest.approx(0.182322, abs=1e-6) and vec[0, "b"] == pytest.approx(0.693147, abs=1e-6)
    q = spark.createDataFrame([(9, ["b"])], "query_id int, tokens array<string>")
    dot = lexical.scores(lexical.query_vectors(q, lexical.idf_table(tf, stats)), lexical.document_vectors(docs)).collect()
    assert [(r["id"], r["score"]) for r in dot] == [(0, 0.480453)]
    assert lexical.multiplicity_scores(q, docs).first()["score"] == pytest.approx(0.693147)


def test_empty_corpus_has_no_terms(spark):
    docs = lexical.token_table(spark.createDataFrame([], "id int, t array<string>"), "id", F.col("t"))
    assert lexical.document_vectors(docs).count() == 0


def test_cap_per_asset(spark):
    rows = [(i, "a_x" if i < 4 else "b", "clip model" if i >= 4 else None, f"clip {i}" * (i % 3)) for i in range(10)]
    got = lexical.cap_per_asset(spark.createDataFrame(rows, "chunk_id int, asset_id string, asset_title string, text string"), 3)
    assert {r["asset_id"]: r["count"] for r in got.groupBy("asset_id").count().collect()} == {"a_x": 3, "b": 3}


def metrics(spark, actual, expected, k=5):
    df = spark.createDataFrame([(1, "g", actual, expected)], "case_id int, grp string, actual array<string>, expected array<string>")
    return evaluation.at_k(evaluation.prepare(df), (k,)).first()


def test_greedy_claims_do_not_count_variants_twice(spark):
    m = metrics(spark, ["Resnext_69df8de4_903a9c76", "Resnext_abc12345", "Resnext_def67890"], ["Resnext"])
    assert m["ndcg"] == 1.0 and m["ap"] == 1.0 and m["flags"] == [1, 0, 0] and m["hits"] == [1, 1, 1]
    assert metrics(spark, ["Resnext_69df8de4", "Resnext_abc12345"], ["Resnext"])["precision"] == 0.5


def test_metrics_by_hand(spark):
    assert metrics(spark, ["a", "x", "b"], ["a", "b"])["ap"] == pytest.approx((1 + 2 / 3) / 2)
    assert metrics(spark, ["x", "a"], ["a"])["ndcg"] == pytest.approx(1 / math.log2(3))
    none = metrics(spark, [], ["a"])
    assert none["precision"] == none["recall"] == none["ndcg"] == none["f1"] == 0.0
    assert metrics(spark, None, None)["hit_rate"] == 0.0


def test_slugs(spark):
    df = spark.createDataFrame([("Resnext_69df8de4_903a9c76",), (" Über-Straße_",), (None,)], "x string")
    assert [r[0] for r in df.select(T.slug(F.col("x"))).collect()] == ["resnext", "über-strasse", ""]


def test_uuid5(spark):
    names = ["x", "text:a:None:0", "ü"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(ids.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert got[0] == "4cd605e7-afa2-5360-b5b9-c5e9fb5c76f4"


def test_figure_refs(spark):
    texts = ["如图3所示", "图3、图5 都在", "see Figure 5", "该图展示了", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(figures.figure_refs(F.col("t"))).collect()]
    assert got == [[3], [3, 5], [5], [], []]


def box(y0, y1, x0=0.0, x1=10.0):
    return (x0, y0, x1, y1)


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_captions_and_association(spark):
    images = spark.createDataFrame([("a", 0, 0, "p0", box(0.0, 100.0)), ("a", 0, 1, "p1", box(300.0, 400.0))], f"asset_id string, page int, image_ix int, path string, image_bbox {BOX}")
    lines = spark.createDataFrame([("a", 0, 5, "图 2: 路线", box(410.0, 425.0)), ("a", 0, 6, "如图2所示", box(1.0, 2.0))], f"asset_id string, page int, line_ix int, text string, bbox {BOX}")
    found = figures.captions(lines, images)
    assert [(r["number"], r["path"]) for r in found.collect()] == [(2, "p1")]
    chunks = spark.createDataFrame([(1, "a", 0, "见图2", box(101.0, 140.0)), (2, "a", 0, "text", box(101.0, 140.0, 50.0, 60.0)), (3, "a", 0, "text", None)], f"chunk_id int, asset_id string, page int, text string, bbox {BOX}")
    got = {(r["chunk_id"], r["path"], r["figure_id"]) for r in figures.associate(chunks, images, found).collect()}
    assert got == {(1, "p1", 2), (1, "p0", None)}


def heads(spark, text):
    marked = chunking.mark_headings(chunking.lines_of(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text"))
    return [(r["heading"], r["body"]) for r in chunking.sections(marked).orderBy("section").collect()]


def test_sections(spark):
    assert heads(spark, "# Introduction\nFirst paragraph.\n\n# Methods\nMethods paragraph.") == [("Introduction", "First paragraph."), ("Methods", "Methods paragraph.")]
    assert heads(spark, "First sentence ends here.\n\nSecond sentence.") == [("", "First sentence ends here.\n\nSecond sentence.")]
    assert heads(spark, "") == []


def test_large_type_is_a_heading(spark):
    df = spark.createDataFrame([(1, i, f"line {i}", s) for i, s in enumerate([16.0, 0.0, 10.0, 10.0])], "id int, ix int, line string, size double")
    assert [r["is_heading"] for r in chunking.mark_headings(df).orderBy("ix").collect()] == [True, False, False, False]


@pytest.mark.parametrize("body", ["", " ", "a" * 10_000, "Ein Satz. " * 900, "一句话。" * 2000, "word " * 5000, "p\n\n" * 3000])
def test_recursive_split_invariants(body):
    plain = chunking.recursive_split(body, overlap=0)
    assert "".join(plain) == body
    assert all(len(p) <= 800 * 3.5 for p in plain)
    assert len(chunking.recursive_split(body)) == len(plain)
    assert chunking.recursive_split(None) == []


def test_coalescing(spark):
    rows = [("a", 0, 1, "A", "A"), ("a", 0, 2, "body", ""), ("a", 0, 3, "B", "B"), ("a", 0, 4, "body", ""), ("a", 1, 5, "next page", ""), ("a", 1, 6, None, "")]
    got = chunking.coalesce_blocks(spark.createDataFrame(rows, "asset_id string, page int, ord int, text string, heading string"), 1000)
    assert [r["body"] for r in got.orderBy("part").collect()] == ["A\nbody", "B\nbody", "next page"]
    long = chunking.coalesce_blocks(spark.createDataFrame([("a", 0, i, "x" * 300, "") for i in range(10)], "asset_id string, page int, ord int, text string, heading string"), 1000)
    sizes = [len(r["body"]) for r in long.collect()]
    assert len(sizes) >= 3 and max(sizes) <= 1300


LOG = "log_seq long, asset_id string, sha256 string, deleted boolean"


def test_log_state(spark):
    log = spark.createDataFrame([(1, "a", "h1", False), (2, "a", "h2", False), (3, "b", "h3", False), (4, "b", "h3", True)], LOG)
    assert [(r["asset_id"], r["sha256"]) for r in state.active(log).collect()] == [("a", "h2")]
    assert {r["sha256"] for r in state.by_hash(log).collect()} == {"h1", "h2"}
    assert [r["asset_id"] for r in state.tombstones(log, log, F.lit(9.0)).collect()] == ["a"]


def test_unique_names_and_retries(spark):
    got = state.unique_names(spark.createDataFrame([(1, "x.pdf"), (2, "x.pdf"), (3, "y")], "o int, name string"), "name", "o")
    assert [r["target"] for r in got.orderBy("o").collect()] == ["x.pdf", "x_2.pdf", "y"]
    tasks = spark.createDataFrame([(1, ["d/a.pdf", "b.pdf", "c.pdf"], {"a": "ok", "b": "failed"}), (2, None, None)], "task_seq long, uploaded_files array<string>, asset_statuses map<string,string>")
    assert [r["file"] for r in state.retry_files(tasks).orderBy("item_ix").collect()] == ["b.pdf", "c.pdf"]


def test_query_spelling(spark):
    chunks = spark.createDataFrame([("transformer self-attention paper.",), (None,)], "text string")
    queries = spark.createDataFrame([(1, "TRANSFORMR"), (2, None), (3, "")], "query_id int, raw string")
    got = {r["query_id"]: (r["dense_query"], r["bm25_query"]) for r in querying.preprocess(queries, querying.vocabulary(chunks), querying.expansion_pairs(spark, '{"transformer": ["attention"]}')).collect()}
    assert got == {1: ("TRANSFORMR", "transformer attention"), 2: (None, None), 3: ("", "")}


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Pump pump Pump the valve ![x](images/a.png)"), (2, "水泵水泵台账"), (3, None)], "chunk_id int, text string")
    got = {r["chunk_id"]: r["keywords"] for r in keywords.keywords(df, "chunk_id", "text").collect()}
    assert got[1] == ["Pump", "pump", "valve"] and got[2][0] == "水泵" and got[3] == []


def test_vector_search_keeps_ties_by_id_and_null_scores_below_a_floor(spark):
    pts = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id int, vec array<float>")
    got = vectors.top_k(pts, pts.where("id = 1").select(F.col("id").alias("query_id"), "vec"), 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0)]
    empty = pts.where("false")
    assert vectors.top_k(pts, empty.select(F.col("id").alias("query_id"), "vec"), 2).count() == 0
    scored = spark.createDataFrame([(1, None), (2, 0.3)], "id int, score double")
    assert vectors.above_floor(scored, 0).count() == 2 and vectors.above_floor(scored, 0.24).count() == 1


def test_answers(spark):
    image = "array<struct<path:string,figure_id:int,caption:string,page:int>>"
    df = spark.createDataFrame([(1, 1, "a", "T", 0, "e1", [("p", 3, "c", 0), ("q", None, "", 0), ("r", None, "", 0)]), (1, 2, "b", "U", None, "", None)], f"query_id int, rank int, asset_id string, title string, page int, evidence string, images {image}")
    text = answers.evidence_context(df).first()["context"]
    assert text == "[1] asset_id=a title=T page=0\ne1\n关联图片: 图3: c (/parsed-image/a/p); 图 (/parsed-image/a/q); 图 (/parsed-image/a/r)\n\n[2] asset_id=b title=U page=None\n"
    assert answers.fallback_answer(df).first()["answer"] == "e1"
    assert [r["path"] for r in answers.image_parts(df).orderBy("ix").collect()] == ["p", "q"]


def test_tolerant_json_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"asset_id": "a", "tags": [" x ", ""]}\n\n{broken\n{"asset_id": ""}\n{"asset_id": "b", "deleted": true}\n')
    got = jsonl.read_entries(spark, str(tmp_path)).orderBy("asset_id").collect()
    assert [(r["asset_id"], r["deleted"], r["tags"]) for r in got] == [("a", False, ["x"]), ("b", True, [])]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jsonl.read_jsonl(spark, str(tmp_path / "none"), jsonl.ENTRY)


def test_sniffing(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as out:
        out.writestr("word/document.xml", "<x/>")
    archive = whole.getvalue()
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x07\x03"
    for name, data in {"a_b.pdf": b"%PDF-1.7", "c.png": png, "d.docx": archive, "e.zip": archive, "broken.docx": b"PK\x03\x04", "f.md": b"# x", "g.jpg": jpeg, "h.webp": b"RIFF0000WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), "i.pdf": b"%PDF-1.4 <</Type /Pages>> <</Type /Page>> <</Type/Page >>"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in sniff.sniff(spark, str(tmp_path)).collect()}
    assert {k: r["format"] for k, r in got.items()} == {"a_b.pdf": "pdf", "c.png": "png", "d.docx": "office", "e.zip": "unknown", "broken.docx": "unknown", "f.md": "text", "g.jpg": "jpeg", "h.webp": "webp", "i.pdf": "pdf"}
    assert [(got[k]["width"], got[k]["height"]) for k in ("g.jpg", "h.webp", "f.md")] == [(7, 5), (100, 50), (None, None)]
    assert got["i.pdf"]["pages"] == 2 and got["a_b.pdf"]["pages"] is None
    assert (got["c.png"]["width"], got["c.png"]["height"]) == (640, 480) and got["a_b.pdf"]["title"] == "A B"


def test_upsert_twice_adds_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert incremental.upsert_points(batch, f"{tmp_path}/store") == 2
    assert incremental.upsert_points(batch, f"{tmp_path}/store") == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("<think>a\nb</think> c", "bad https://x.y/z at host:8080\nnext", " YES ", "a, b；a\n")], "t string, e string, b string, g string")
    row = df.select(T.strip_think(F.col("t")), T.scrub_error(F.col("e")), T.as_bool(F.col("b")), T.split_tags(F.col("g")), T.insecure_url(F.lit("http://a.b/c")), T.insecure_url(F.lit("http://localhost:1"))).first()
    assert list(row) == ["c", "bad <url> at <host>:<port>", True, ["a", "b"], True, False]


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_sections_are_numbered_alike_in_runs_of_any_size(spark, run):
    import random

    rng = random.Random(run)
    rows = [(rng.choice("ab"), rng.choice([None, 1, 1, 2]), i * 2, f"t{i}", rng.choice(["", "", "", "H"])) for i in range(60)]
    got = {r["ord"]: r["part"] for r in chunking.number_sections(spark.createDataFrame(rows, "asset_id string, page int, ord int, body string, heading string"), run).collect()}
    last: dict = {}
    for asset, page, at, _, heading in rows:
        part, before = last.get(asset, (0, "none"))
        part += before == "none" or bool(heading) or page != before
        last[asset] = (part, page)
        assert got[at] == part


def test_chunks_are_numbered_through_the_asset(spark, monkeypatch):
    monkeypatch.setattr(chunking, "ORDER_RUN", 3)
    rows = [("a", i // 3, i, f"word{i} " * (700 if i == 4 else 5), "") for i in range(12)] + [("b", 0, 1, "x", "H")]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "asset_id string, page int, ord int, text string, heading string")).collect()
    a = sorted((r["chunk_index"], r["page"]) for r in got if r["asset_id"] == "a")
    assert [i for i, _ in a] == list(range(len(a))) and [p for _, p in a] == sorted(p for _, p in a) and len(a) > 4
    assert [(r["chunk_index"], r["section"], r["text"]) for r in got if r["asset_id"] == "b"] == [(0, "H", "x")]


def test_parsing_helpers(spark):
    from corvane.operators import parsing

    one = spark.range(1)
    html = "<html><style>x{}</style><h2>Head &amp; more</h2><p>One<br>two</p><script>bad()</script></html>"
    assert one.select(parsing.html_text(F.lit(html))).first()[0] == "## Head & more\n\n\n\nOne\n\ntwo"
    assert one.select(parsing.html_text(F.lit(None).cast("string"))).first()[0] == ""
    assert one.select(parsing.data_url(F.lit(b"ab"), F.lit("JPG"))).first()[0] == "data:image/jpeg;base64,YWI="
    md = "a ![x](data:image/png;base64,YWI=) b"
    row = one.select(parsing.data_urls(F.lit(md)).alias("u"), parsing.without_data_urls(F.lit(md)).alias("t")).first()
    assert [(u["mime"], u["n_bytes"]) for u in row["u"]] == [("png", 2)] and "base64" not in row["t"]
    urls = {"https://a.files.example/x": True, "http://files.example": True, "https://files.example.evil": False, "https://10.0.0.1/x": False, "ftp://files.example": False, "": False, None: False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r[0]: r[1] for r in df.select("u", parsing.url_allowed(F.col("u"), ["files.example"])).collect()} == urls
    assert one.select(parsing.json_object(F.lit('Sure: {"a": 1} ok'), "a int")).first()[0]["a"] == 1


def test_engine_modes_and_registry(spark):
    from corvane.operators import engine

    rows = {"text": hits(spark, [("x", 1, "a", 1, 1.0, [])]).drop("route"), "text-to-image": hits(spark, [("x", 2, "b", 1, 1.0, [])]).drop("route")}
    assert [r["asset_id"] for r in engine.search("hybrid", rows).orderBy("rank").collect()] == ["a", "b"]
    assert [r["asset_id"] for r in engine.search("text-to-image", rows).collect()] == ["b"]
    for bad in (lambda: engine.search("none", rows), lambda: engine.search("image-to-image", rows), lambda: engine.EngineConfig(top_k=0)):
        with pytest.raises(ValueError):
            bad()
    reg = engine.Registry()
    reg.register("parser", "x", len)
    assert reg.get("parser", "x") is len and reg.names("parser") == ["x"]
    with pytest.raises(KeyError, match="there are: x"):
        reg.get("parser", "y")


def test_ratio_corrections_equal_a_loop(spark):
    import random
    from difflib import SequenceMatcher

    from corvane.operators import querying

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 16))) for _ in range(150)})
    asked = []
    for w in words[::2]:
        x = list(w)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(x))
            x[at : at + 1] = rng.choice([[], [rng.choice("abcd")], [x[at], rng.choice("abcd")], [x[at].upper()]])
            x = x or ["a"]
        asked.append("".join(x))
    asked = [a for a in asked if len(a) >= 4]
    got = {(r["token"], r["correction"]) for r in querying.ratio_corrections(spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "query_id long, raw string"), spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    want = set()
    for a in set(asked):
        if a.lower() not in words:
            best = max(((SequenceMatcher(None, w, a.lower()).ratio(), w) for w in words), default=(0, ""))
            if best[0] >= 0.85:
                want.add((a, best[1]))
    assert got == want and len(want) > 20


def test_stat_block_equals_sorting(spark):
    import random

    from corvane.operators import evaluation

    rng = random.Random(4)
    rows = [("a", float(rng.choice([1, 1, 1, 2, 7.5, rng.random() * 100]))) for _ in range(997)] + [("b", 3.0)] * 40 + [("c", None), ("c", 5.0), ("d", None)]
    got = {r["k"]: r for r in evaluation.stat_block(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in "abc":
        vals = sorted(v for g, v in rows if g == k and v is not None)
        assert [got[k][f"p{q}"] for q in (50, 95, 99)] == [vals[max(int(q / 100 * len(vals)), 1) - 1] for q in (50, 95, 99)]
        assert (got[k]["n"], got[k]["min"], got[k]["max"]) == (len(vals), vals[0], vals[-1])
    assert set(got) == set("abc")


def test_nearest_vectors_in_small_blocks(spark, monkeypatch):
    import numpy as np

    from corvane.operators import vectors

    rng = np.random.default_rng(5)
    m = rng.integers(-2, 3, (120, 8)).astype(float)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(500, None)], "id long, vec array<double>")
    asked = points.where("id % 10 = 0 or id = 500").withColumnRenamed("id", "query_id")
    unit = vectors.unit(m)
    want = {(q, i, r + 1) for q in range(0, 120, 10) for r, i in enumerate(sorted(range(120), key=lambda j: (-round(float(unit[q] @ unit[j]), 5), j))[:7])}
    for query_bytes, score_bytes in ((16 << 20, 64 << 20), (256, 400)):
        monkeypatch.setattr(vectors, "QUERY_BYTES", query_bytes)
        monkeypatch.setattr(vectors, "SCORE_BYTES", score_bytes)
        assert {(r["query_id"], r["id"], r["rank"]) for r in vectors.top_k(points, asked, 7).collect()} == want


def test_text_index_life(spark, tmp_path):
    from corvane.operators.index import TextIndex

    rows = [(1, "a", 1, "水泵 台账 pump"), (2, "a", 1, "水泵 台账 pump"), (3, "b", None, "valve chart"), (4, "b", None, None)]
    chunks = spark.createDataFrame([(*r, None, "title") for r in rows], "chunk_id long, asset_id string, page int, text string, context string, asset_title string")
    asked = spark.createDataFrame([(7, "pump"), (8, "nothing known")], "query_id long, raw string")
    at = TextIndex(spark, f"{tmp_path}/index")
    assert at.search(asked, 5).count() == 0 and at.points().count() == 0
    assert at.build(chunks.where("chunk_id = 1")) == 1
    assert at.build(chunks) == 2 and at.build(chunks) == 0
    assert [r["query_id"] for r in at.search(asked, 5).collect()] == [7]
    gone = spark.createDataFrame([("a",)], "asset_id string")
    assert at.delete(gone, dry_run=True).first()["points"] == 1 and at.search(asked, 5).count() == 1
    at.delete(gone)
    assert at.search(asked, 5).count() == 0 and at.points().count() == 2
    assert at.build(chunks) == 1 and at.search(asked, 5).count() == 1
    assert at.build(chunks, force=True, cap=1) == 2


def test_names_are_numbered_alike_in_blocks_of_any_size(spark):
    from corvane.operators import state

    rows = spark.createDataFrame([(t, i, "a.pdf" if (t + i) % 2 else None) for t in range(9) for i in range(3)], "task_seq long, item_ix int, file string")
    want = sorted(map(str, state.unique_names(rows, "file", ["task_seq", "item_ix"], 1000).collect()))
    assert sorted(map(str, state.unique_names(rows, "file", ["task_seq", "item_ix"], 2).collect())) == want and any("a_13.pdf" in w for w in want)


def test_enriched_chunks(spark):
    from corvane.operators import figures

    blocks = spark.createDataFrame([("a", 0, 1, "Pump report", "Pump report"), ("a", 0, 2, "As Figure 2 shows, the pump valve holds. Pump valve.", "")], "asset_id string, page int, ord int, text string, heading string")
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    images = spark.createDataFrame([("a", 0, 1, "images/p.png", (0.0, 0.0, 50.0, 50.0))], f"asset_id string, page int, image_ix int, path string, image_bbox {box}")
    lines = spark.createDataFrame([("a", 0, 9, "Figure 2: the pump", (0.0, 60.0, 50.0, 70.0))], f"asset_id string, page int, line_ix int, text string, bbox {box}")
    out = chunking.enriched_documents(blocks, images, figures.captions(lines, images)).collect()
    assert [i["path"] for r in out for i in r["images"]] == ["images/p.png"]
    assert all("关键词: " in r["text"] for r in out) and "Pump" in out[-1]["text"]


def test_textrank_prefers_what_has_many_neighbours(spark):
    from corvane.operators import keywords

    df = spark.createDataFrame([(1, "pump valve. pump chart. pump table. pump gauge"), (2, None), (3, "水泵台账 the of"), (4, "pump pump")], "id int, text string")
    got = {r["id"]: r["keywords"] for r in keywords.textrank(df, "id", "text", k=3).collect()}
    assert got[1][0] == "pump" and got[2] == [] and set(got[3]) == {"水泵", "泵台", "台账"} and got[4] == ["pump"]


def test_paths_options_and_contexts(spark):
    from corvane.operators import lexical

    paths = ["a/b.pdf", "../a", "a/../b", "a/..", "..a/b..", "/a", "C:/a", "a\\b", "", None, " "]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(T.safe_path(F.col("p"))).collect()] == [True, False, False, False, True, False, False, False, False, False, False]
    df = spark.createDataFrame([({"a": " X ", "b": "no", "c": "x", "d": None},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(T.clean_options(F.col("m"), {"a": ("x",), "b": ("yes",), "d": ("x",)})).collect()] == [{"a": "x"}, {}]
    chunks = spark.createDataFrame([(1, "a", "t"), (2, "a", None), (3, None, "t")], "id int, asset_id string, text string")
    cache = chunks.select(lexical.context_key(F.col("asset_id"), F.col("text")).alias("key"), F.when(F.col("id") < 3, F.concat(F.lit("c"), F.col("id"))).otherwise(" ").alias("context"))
    assert {r["id"]: r["context"] for r in lexical.with_context(chunks, cache).collect()} == {1: "c1", 2: "c2", 3: None}


def test_a_missing_collection_is_empty(spark, tmp_path):
    from corvane.operators import index
    from corvane.sources import collection

    collection.register(spark)
    read = lambda at: spark.read.format(collection.NAME).schema("id long").option("path", at).load()
    assert read(f"file://{tmp_path}/none").count() == 0 and index.collections(spark, f"{tmp_path}/none", "x") == []
    index.append_collection(spark.range(10).repartition(3), f"file://{tmp_path}", "x")
    assert sorted(r["id"] for r in read(f"file://{tmp_path}/x").collect()) == list(range(10))


def test_dropped_tables_are_gone(spark):
    from pathlib import Path

    from corvane.session import drop, materialize, shared_dir

    df = materialize(spark.range(5), "gone")
    assert df.count() == 5
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.glob("gone-*")}
    drop(df)
    assert before and not list(folder.glob("gone-*"))


def test_html_to_markdown(spark):
    html = '<style>x{}</style><h4 class="a">Pumps</h4><p>A <b>red</b> <a href="u/v">link</a> &amp; <i>more</i></p><ul><li>one</li> <li>two</li></ul><img alt="fig" src="i.png"/><table><tr><th>k</th><th>v</th></tr></table><pre>kept</pre>'
    from corvane.operators import parsing

    got = spark.createDataFrame([(html,)], "h string").select(parsing.html_text(F.col("h"))).first()[0]
    assert [x for x in got.split("\n") if x.strip()] == ["#### Pumps", "A **red** [link](u/v) & *more*", "- one", "- two", "![fig](i.png)", "k | v", "kept"]
