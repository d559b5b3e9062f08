"""What searches leave on the disk: of the counts of documents, which grow with the corpus, nothing, and one block's at a time."""

import re
from pathlib import Path

import pytest

from corvane.operators import lexical as L
from corvane.plans import parsing_queries as P
from corvane.plans import registry
from corvane.session import shared_dir

QUERIES = registry.queries()


def written(spark, name):
    return {x.name for x in Path(shared_dir(spark).removeprefix("file://")).glob(f"{name}-*")}


def test_counts_of_a_block_go_before_those_of_the_next(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["a", "b"][: 1 + i % 2], 1) for i in range(8)] + [(1, ["b"], 1)], "id long, tokens array<string>, dl int")
    asked = spark.createDataFrame([(q, t, 1.0) for q in range(6) for t in "ab"], "query_id long, term string, w double")
    want = sorted(map(tuple, L.search(asked, docs, 3, 1).collect()))
    before, seen, plans, block = written(spark, "asked"), [], [], L._search_block
    monkeypatch.setattr(L, "BLOCK_ENTRIES", 3)

    def one(*args):
        seen.append(written(spark, "asked-tf") - before)
        found, counts = block(*args)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return found, counts

    monkeypatch.setattr(L, "_search_block", one)
    found = L.search(asked, docs, 3, 1)
    assert len(seen) > 1 and not any(seen) and written(spark, "asked") == before
    assert sorted(map(tuple, found.collect())) == want
    assert not any(x in p for p in plans for x in ("Join", "Aggregate"))


@pytest.mark.parametrize("name", ["a1_sources", "e20_text_to_image_run", "a5_image_parts", "f7_hybrid_search", "a2_evidence_context", "f1_fused_channels", "e18_evaluation_run", "e19_grouped_cases", "r1_reranked", "a4_fallback_answers", "f8_text_mode", "f8_text_to_image_mode"])
def test_no_counts_are_left(spark, sf_dir, name):
    before = written(spark, "asked")
    QUERIES[name](spark, sf_dir)
    assert written(spark, "asked") == before


@pytest.mark.parametrize("name", ["a1_sources", "f7_hybrid_search", "f8_text_mode", "f8_text_to_image_mode"])
def test_ranked_assets_read_no_text(spark, sf_dir, name):
    before = written(spark, "payload")
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: (struct<.*)", plan)
    assert any("metadata" in x for x in read) and not any(re.search(r"\b(text|evidence):", x) for x in read)
    assert written(spark, "payload") == before


def test_names_of_queries_reduce_chunks_without_a_shuffle(spark, sf_dir):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cases = P._cases(spark, sf_dir)
        plan = cases._jdf.queryExecution().sparkPlan().toString()
        rows = sorted(repr(tuple(r)) for r in cases.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin [name" in plan
    assert rows == sorted(repr(tuple(r)) for r in P._cases(spark, sf_dir).collect())
