import random

import pytest

from corvane.llm import packing, tokenize

TEXTS = ["", "plain words, don't WE'LL", "水泵台账" * 30, "a  b\n\n\nc \t d", "x" * 3000, "<|endoftext|> é🇽🇾👩‍🔧", " " * 500, "1234567 89.5% " * 200, "one two\n\n" * 300, "\u202eabc\u202c \ufeff"]


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize(("chunk", "overlap"), [(tokenize.CHUNK_CHARS, tokenize.OVERLAP_CHARS), (65_536, 4096), (200, 60), (64, 8)])
def test_ids_equal_the_tokenizer(spark, chunk, overlap):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None])]
    out = tokenize.token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids string"), chunk_chars=chunk, overlap_chars=overlap)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got == dict(enumerate(reference([*TEXTS, None])))
    back = {r["doc_id"]: r["text"] for r in tokenize.decode(out).collect()}
    assert back == dict(enumerate([*TEXTS, ""]))


def test_stitches_hold_for_any_text():
    rng, enc = random.Random(4), tokenize.encoder()
    long = 0
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "7", "'s", "水", "é", "!?", "x" * 90]) for _ in range(rng.randrange(0, 400)))
        for chunk, overlap in ((64, 8), (90, 30), (tokenize.CHUNK_CHARS, tokenize.OVERLAP_CHARS)):
            parts = tokenize.pieces(text, chunk, overlap)
            assert "".join(parts) == text
            assert [x for p in parts for x in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
            long += len(parts) > 1
    assert long > 600


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "word " * 100), (1, "word " * 100), (1, "other " * 90), (2, None)], "doc_id long, text string")
    got = tokenize.token_counts(df, text_col="text")
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(x) for x in reference(["word " * 100, "word " * 100, "other " * 90, None]))
    cut = tokenize.token_ids(df, chunk_chars=100, overlap_chars=20)
    assert sorted(len(r["ids"]) for r in cut.collect()) == sorted(r["n_tokens"] for r in got.collect())
    assert tokenize.token_ids(df.where("false")).count() == 0


def packed(spark, sizes, caps, parts=3, **kw):
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").repartition(parts)
    return packing.pack(items, spark.createDataFrame(caps, "pack_id int, capacity_tokens int"), **kw).collect()


def test_containers_hold_everything_once(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, None, 1, 30, 99, 100, 101, 250, rng.randrange(1, 120)]) for _ in range(400)]
    caps = [(1, 100), (2, 700)]
    rows = packed(spark, sizes, caps, open_windows=8, merge_group=5)
    for p, cap in caps:
        own = [r for r in rows if r["pack_id"] == p]
        fill: dict = {}
        for r in own:
            fill[r["container"]] = fill.get(r["container"], 0) + r["piece_tokens"]
        assert max(fill.values()) <= cap
        for i, size in enumerate(sizes):
            pieces = sorted((r["piece"], r["piece_tokens"]) for r in own if r["doc_id"] == i)
            assert sum(x for _, x in pieces) == (size or 0) and [k for k, _ in pieces] == list(range(len(pieces)))
            assert len(pieces) == 1 or ((size or 0) > cap and all(x == cap for _, x in pieces[:-1]))
        assert sum(fill.values()) >= 0.9 * cap * len(fill)


def test_packing_edges(spark):
    assert packed(spark, [5], [(1, 0), (2, None)]) == []
    assert [(r["pack_id"], r["piece_tokens"]) for r in packed(spark, [0], [(1, 4)])] == [(1, 0)]
    items = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(items, spark.createDataFrame([(1, 10)], "pack_id int, capacity_tokens int")).count() == 0


def test_long_texts_without_an_id(spark):
    df = spark.createDataFrame([(None, "word " * 100), (None, "word " * 100), (1, "other " * 90)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, len(r["ids"])) for r in tokenize.token_ids(df, chunk_chars=100, overlap_chars=20).collect())
    whole = sorted((r["doc_id"] or 0, len(r["ids"])) for r in tokenize.token_ids(df).collect())
    assert len(got) == 3 and got == whole
