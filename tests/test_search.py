"""Search scores documents in place: right for repeated rows, ties and nulls, and without pairs of queries and documents in a shuffle."""

import math
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvane.operators import lexical as L
from corvane.plans import lexical_queries as X
from corvane.plans import registry
from tests.compare import connect, rows_of_spark, rows_of_sql

DOCS = [(1, ["a", "b", "a"]), (2, ["a"]), (2, ["b", "b", "c"]), (3, []), (4, None), (None, ["a", "c"]), (5, ["c"]), (6, ["c"]), (7, ["d"])]
ASKED = [(10, "a", 1.0), (10, "c", 2.0), (20, "b", 1.0), (30, "zzz", 1.0), (None, "a", 1.0)]


def brute(power):
    tf, lengths = Counter(), defaultdict(list)
    for i, tokens in DOCS:
        lengths[i].append(len(tokens or []))
        tf.update((i, t) for t in tokens or [])
    n, total = len(DOCS), sum(map(sum, lengths.values()))
    df = Counter(t for _, t in tf)
    out = defaultdict(float)
    for q, term, w in ASKED:
        for (i, t), c in tf.items():
            if t == term and i is not None and q is not None:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                out[q, i] += sum(w * idf**power * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * dl / max(total / n, 1.0))) for dl in lengths[i])
    return {k: round(v, 6) for k, v in out.items()}


@pytest.mark.parametrize("power", [0, 1, 2])
@pytest.mark.parametrize("entries", [1, 400_000])
def test_scores_equal_brute_force(spark, monkeypatch, power, entries):
    monkeypatch.setattr(L, "BLOCK_ENTRIES", entries)
    docs = spark.createDataFrame([(i, t, len(t or [])) for i, t in DOCS], "id long, tokens array<string>, dl int")
    asked = spark.createDataFrame(ASKED, "query_id long, term string, w double")
    got = {(r["query_id"], r["id"]): r["score"] for r in L.search(asked, docs, None, power).collect()}
    assert got == pytest.approx(brute(power))
    best = [(r["query_id"], r["id"]) for r in L.search(asked, docs, 2, power).orderBy("query_id", "rank").collect()]
    want = sorted(got, key=lambda k: (k[0], -got[k], k[1]))
    assert best == [k for q in (10, 20) for k in [x for x in want if x[0] == q][:2]]


@pytest.mark.parametrize("hits", [X.zh_hits, X.en_hits, X.l4_scores])
def test_queries_and_documents_are_not_joined_in_a_shuffle(spark, sf_dir, hits):
    plan = hits(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_text_index_scores_points_in_place(spark, tmp_path):
    """Builds, deletions and searches agree with a search over the live chunks, and no posting is joined in a shuffle."""
    from pyspark.sql import functions as F

    from corvane.functions import ids
    from corvane.functions import text as T
    from corvane.operators.index import TextIndex

    texts = ["水泵 台账 pump pump", "valve chart 水泵", None, "", "pump valve 台账", "阀门 pump 水泵 水泵"]
    rows = [(i, f"a{i % 5}", 1, t, "context pump" if i % 4 == 0 else None) for i, t in enumerate(texts * 3)]
    chunks = spark.createDataFrame([*rows, rows[0]], "chunk_id long, asset_id string, page int, text string, context string")
    asked = spark.createDataFrame([(7, "pump 水泵"), (8, "台账 valve"), (9, "nothing"), (10, None)], "query_id long, raw string")
    at = TextIndex(spark, f"{tmp_path}/index", buckets=3)
    at.build(chunks.where("chunk_id % 2 = 0"))
    at.build(chunks)

    def expected(live):
        best = live.withColumn("first", F.min(F.struct(F.col("chunk_id") % 2, "chunk_id")).over(L.Window.partitionBy("id"))).where("first.chunk_id = chunk_id").dropDuplicates(["id"])
        docs = best.select("id", T.zh_tokens(L.index_text(F.col("text"), F.col("context"))).alias("tokens")).withColumn("dl", F.size("tokens"))
        tf, stats = L.term_frequencies(docs), L.corpus_stats(docs)
        q = asked.select("query_id", T.zh_tokens(F.col("raw")).alias("tokens"))
        return {(r["query_id"], r["id"], r["rank"]): r["score"] for r in L.top_n(L.scores(L.query_vectors(q, L.idf_table(tf, stats)), L.document_vectors(docs)), 4).collect()}

    named = chunks.withColumn("id", ids.point_id(F.col("asset_id"), F.col("page"), F.col("text")))
    found = at.search(asked, 4)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["query_id"], r["id"], r["rank"]): r["score"] for r in found.collect()} == pytest.approx(expected(named))
    at.delete(spark.createDataFrame([("a1",), ("a2",)], "asset_id string"))
    left = named.where("asset_id not in ('a1', 'a2')")
    assert {(r["query_id"], r["id"], r["rank"]): r["score"] for r in at.search(asked, 4).collect()} == pytest.approx(expected(left))
    assert at.build(chunks.where("asset_id = 'a1'")) > 0 and at.build(chunks.where("asset_id = 'a1'")) == 0


def test_hashed_vectors_count_terms_in_place(spark):
    from corvane.operators import embedding

    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["c", None]), (1, ["b", "c"]), (5, ["a"])], "id long, tokens array<string>")
    want = {}
    for i, tokens in docs.collect():
        for t in tokens or []:
            if t is not None:
                want.setdefault(i, Counter())[embedding.bucket(t)] += 1
    got = {r["id"]: r["vec"] for r in embedding.hashed_vectors(docs).collect()}
    assert got == {i: pytest.approx([c[x] / math.sqrt(sum(v * v for v in c.values())) for x in range(64)]) for i, c in want.items()}
    single = embedding.hashed_vectors(docs.where("id > 1"))
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and {r["id"] for r in single.collect()} == {4, 5}


def test_a_task_sends_on_the_best_of_each_query_alone(spark, monkeypatch):
    """Steps of a few points: what goes on is k rows for each query and task, and the ranks are those of all points."""
    from corvane.operators import vectors

    monkeypatch.setattr(vectors, "SCORE_BYTES", 8 * 2 * 3)
    points = [(i, [float(i % 7), float((i * 5) % 11), 1.0]) for i in range(200)]
    sent = vectors._block(spark.createDataFrame(points, "id long, vec array<double>").coalesce(1), vectors.np.array([1, 2]), vectors.np.array([[1.0, 2, 3], [3.0, 0, 1]]), 4, 0, 5)
    rows = [(r["query_id"], -r["score"], r["id"]) for r in sent.collect()]
    assert len(rows) == 8
    unit = vectors.unit(vectors.np.array([v for _, v in points]))
    for q, v in ((1, [1.0, 2, 3]), (2, [3.0, 0, 1])):
        scores = vectors.np.round(vectors.unit(vectors.np.array([v])) @ unit.T, 5)[0]
        assert sorted(i for x, _, i in rows if x == q) == sorted(sorted(range(200), key=lambda i: (-scores[i], i))[:4])


def test_texts_of_few_hits_are_not_shuffled(spark, sf_dir, monkeypatch):
    from corvane.plans import search_queries as SQ

    hits = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, -5)], "query_id long, chunk_id long")
    plans, rows = [], []
    for most in (500_000, 1):
        monkeypatch.setattr(SQ, "BROADCAST_HITS", most)
        found = SQ.chunks_of(spark, sf_dir, hits)
        plans.append(found._jdf.queryExecution().sparkPlan().toString())
        rows.append(sorted(r["chunk_id"] for r in found.collect()))
    assert "BroadcastHashJoin" in plans[0] and rows[0] == rows[1] and set(rows[0]) <= {0, 1} and rows[0]


@pytest.mark.parametrize("name", ["a2_evidence_context", "e18_evaluation_run", "f7_hybrid_search", "f8_text_mode", "v4_text_search"])
def test_every_query_with_an_id_is_searched(spark, sf_dir, tmp_path, name):
    """No id of the smallest data is divisible by 100; a query without an id has no rows."""
    for path in Path(sf_dir).glob("*.parquet"):
        (tmp_path / path.name).symlink_to(path)
    at = tmp_path / "preprocessed_queries.parquet"
    rows = pq.read_table(at)
    at.unlink()
    pq.write_table(pa.concat_tables([rows, rows.slice(0, 2).set_column(0, rows.schema.field(0), pa.nulls(2, rows.schema.field(0).type))]), at)
    got = rows_of_spark(registry.queries()[name](spark, str(tmp_path)))
    assert got[1] and got == rows_of_sql(connect(str(tmp_path)), registry.oracle_sql()[name])
