import pytest

from corvane.llm import queries as Q
from tests.compare import connect, rows_of_spark, rows_of_sql

QUERIES, SQL = Q.queries(), Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_equals_its_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert rows_of_spark(df) == rows_of_sql(connect(sf_dir), SQL[name])
    else:
        # Decoding is exact, so the round trip has no rows; every other query has some on any data.
        assert (df.count() > 0) == (name != "p6_roundtrip")


def test_results_have_the_stated_columns(spark, sf_dir):
    want = {
        "p1_found": [("kind", "string"), ("id_1", "bigint"), ("id_2", "bigint")],
        "p2_found": [("kind", "string"), ("rec_id", "bigint"), ("boundary", "string")],
        "p3_found": [("kind", "string"), ("rec_id", "bigint"), ("noise", "string")],
        "p4_found": [("kind", "string"), ("rec_id", "bigint"), ("item_ix", "int"), ("how", "string")],
        "p5_found": [("kind", "string"), ("rec_id", "bigint"), ("lang", "string")],
        "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p8_found": [("doc_id", "bigint")],
    }
    assert {k: QUERIES[k](spark, sf_dir).dtypes for k in want} == want


def test_cleaned_corpus_and_residue_make_the_whole(spark, sf_dir):
    from corvane.session import table

    bad, good = QUERIES["p8_found"](spark, sf_dir).count(), QUERIES["p8_clean"](spark, sf_dir).count()
    assert bad + good == table(spark, sf_dir, "documents").count()
    assert QUERIES["p6_roundtrip"](spark, sf_dir).count() == 0
