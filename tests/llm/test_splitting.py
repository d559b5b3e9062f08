import random

import pytest

from corvane.llm import splitting


def rebuilt(text, limit, overlap):
    pieces = splitting.split(text, limit, overlap)
    assert all(hi - lo <= limit for lo, _, hi, _ in pieces)
    assert "".join(text[body:hi] for _, body, hi, _ in pieces) == text
    for (_, _, end, _), (lo, body, _, _) in zip(pieces, pieces[1:], strict=False):
        assert body == end and body - lo == min(overlap, limit // 2, body)
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "Satz. ", "一句话。", "\n\n", "\n", "x" * 40, "  ", "é!? "]) for _ in range(rng.randrange(1, 900)))
    rebuilt(text, rng.choice([50, 200, 1200]), rng.choice([0, 20, 90]))


def test_odd_texts():
    assert splitting.split("", 10, 2) == []
    rebuilt("x" * 100_000, 1200, 90)
    rebuilt("一" * 5000, 100, 90)
    rebuilt("a", 1, 5)


def test_boundaries():
    assert splitting.boundary("aaaa\n\nbbbb", 5) == "paragraph"
    assert splitting.boundary("aaaa\n \t\nbbbb", 5) == "paragraph"
    assert splitting.boundary("aaaa. bbbb", 6) == "sentence"
    assert splitting.boundary("aaaa\nbbbb", 5) == "sentence"
    assert splitting.boundary("一二三。四五六。", 4) == "sentence"
    assert splitting.boundary("3.1415 2.7182", 6) == "word"
    assert splitting.boundary("aaaaaaaaaa", 5) == "none"


def test_cuts_fall_into_the_valley_between_topics():
    one = "The pump valve pressure rises. " * 8
    two = "Vector index queries return documents. " * 8
    text = (one + two).strip()
    pieces = splitting.split(text, 400, 0)
    assert pieces[0][2] == len(one) - 1 and pieces[0][3] == "sentence"


def test_tables(spark):
    limits = spark.createDataFrame([("chunk", 20, 5), ("block", None, None)], "kind string, max_chars int, overlap_chars int")
    chunks = spark.createDataFrame([(1, "word " * 10, "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 20, "x"), (5, "word " * 10, "x")], "chunk_id long, text string, body string")
    blocks = spark.createDataFrame([(1, "b" * 5000)], "block_id long, text string")
    assert {tuple(r) for r in splitting.found(chunks, blocks, limits).collect()} == {("chunk", 1, "word"), ("chunk", 5, "word")}
    assert splitting.found(chunks.where("false"), blocks.where("false"), limits.where("false")).count() == 0


def planted(rng, topics=6):
    """(text, places where the topic changes): paragraphs also end inside topics, and some topics change inside a paragraph."""
    text, places = "", []
    for topic in range(topics):
        words = [f"{a}{b}{topic}" for a in ("kal", "mor", "tes", "vin", "zor") for b in ("ada", "eni", "ofi", "una")]
        while len(text) - (places[-1] if places else 0) < rng.randrange(500, 900):
            text += " ".join(rng.choice(words) for _ in range(rng.randrange(6, 14))).capitalize() + "." + rng.choice([" ", " ", "\n\n"])
        text = text.rstrip() + rng.choice([" ", "\n\n"])
        places.append(len(text))
    return text, places[:-1]


def test_most_cuts_fall_where_topics_change():
    rng = random.Random(8)
    hits = able = 0
    for _ in range(60):
        text, places = planted(rng)
        for start, begin, end, how in splitting.split(text, 1000, 100):
            window = range(begin + (start + 1000 - begin) // 3, start + 1001)
            if how != "end" and any(p in window for p in places):
                able += 1
                hits += any(abs(end - p) <= 2 for p in places)
    assert able > 200
    assert hits >= 0.9 * able, (hits, able)
