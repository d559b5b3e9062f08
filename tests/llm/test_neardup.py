import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import neardup
from corvane.llm.graph import components
from corvane.llm.shingles import gram_sets, set_signature, shingle_sets

TOKEN = re.compile(r"[a-z0-9ß-öø-ÿ]+|[぀-ヿ一-鿿]")
WORDS = "pump valve chart scan page index archive report table figure note query vector store route layer copy map log card".split()


def brute_sets(text, width, least):
    toks = TOKEN.findall(text.lower())
    return None if len(toks) < least else {tuple(toks[i : i + width]) for i in range(len(toks) - width + 1)}


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    texts = []
    for k in range(n):
        words = [rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.4 else "") for _ in range(60)]
        texts.append(" ".join(words))
        for _ in range(k % 3):
            edited = list(words)
            for _ in range(rng.randrange(0, 5)):
                edited[rng.randrange(60)] = "水泵" if rng.random() < 0.5 else "Straße"
            texts.append(" ".join(edited))
    return list(enumerate(texts))


def test_shingles_equal_a_loop():
    texts = ["", "a b c", "A b C d E", "水泵台账 abc×def ÷ x", "é" * 5000, "a  b\nc\td e", "𠮷野 x y z w"]
    for width in (1, 4):
        for text, got in zip(texts, shingle_sets(texts, width), strict=True):
            assert len(got) == len(brute_sets(text, width, 0) or ())
    assert [len(s) for s in gram_sets(["abcabc", "ab", ""], 3)] == [3, 0, 0]
    one, two = shingle_sets(["a b c d e", "x a b c d e"], 4)
    assert set(one.tolist()) < set(two.tolist())
    assert set_signature(one) != set_signature(two)


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_pairs_equal_brute_force(spark, threshold):
    rows = corpus()
    like = neardup.Likeness(threshold=threshold, width=4, least_tokens=20)
    pairs, members = neardup.verified_pairs(spark.createDataFrame(rows, "id long, body string"), like, "t")
    got = {(r["id_1"], r["id_2"]) for r in neardup.expand(pairs, members).collect()}
    sets = [(i, s) for i, t in rows if (s := brute_sets(t, 4, 20))]
    want = {(i, j) for a, (i, s) in enumerate(sets) for j, u in sets[a + 1 :] if len(s & u) >= threshold * len(s | u)}
    assert got == want and want


def test_hot_buckets_and_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "GROUP", 3)
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(i, base + f" tail{i}") for i in range(25)] + [(100 + i, base) for i in range(5)]
    pairs, members = neardup.verified_pairs(spark.createDataFrame(rows, "id long, body string"), neardup.Likeness(threshold=0.6, width=4), "t")
    assert neardup.expand(pairs, members).count() == 30 * 29 // 2
    found = neardup.classes(pairs, members).collect()
    assert {r["class_id"] for r in found} == {0} and {r["links"] for r in found} == {29}


def test_nulls_blanks_clashing_columns_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    chunks = spark.createDataFrame([(1, text, "x"), (2, text.upper(), "y"), (3, None, None), (4, "", None), (5, "short", None), (6, "!!! ... ", None)], "chunk_id long, text string, id string")
    log = spark.createDataFrame([(1, "a", " Same  title here, v1 ", False), (2, "b", "same TITLE here v1", False), (3, "b", "other", False), (4, "c", "  ", False), (5, "d", None, None), (6, "e", "same title here v1", True)], "log_seq long, asset_id string, asset_title string, deleted boolean")
    got = {tuple(r) for r in neardup.found(chunks, log).collect()}
    assert got == {("chunk", 1, 2), ("title", 1, 2)}
    assert neardup.found(chunks.where("false"), log.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "id_1 long, id_2 long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "id_1 long, id_2 long")).where(F.lit(True)).count() == 0


def test_every_chunk_has_a_class(spark):
    from corvane.llm import neardup

    found = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "id long, class_id long, links long")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(map(tuple, neardup.every_class(ids, found).collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
