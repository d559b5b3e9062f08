import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import langid as L
from corvane.session import table


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    return [(r["lang"], r["text"]) for r in table(spark, sf_dir, "lang_samples").select("lang", "text").collect()]


def test_held_out_accuracy(samples):
    rng = random.Random(5)
    rows = list(samples)
    rng.shuffle(rows)
    right = 0
    for fold in range(5):
        scorer = L.Scorer(L.Model([r for i, r in enumerate(rows) if i % 5 != fold]))
        right += sum(L.verdicts([t], [False], scorer)[0][0][0] == lang for i, (lang, t) in enumerate(rows) if i % 5 == fold)
    assert right >= 0.98 * len(rows)


def test_mixed_texts_and_fragments(samples):
    scorer = L.Scorer(L.Model(samples))
    by = {lang: [t for x, t in samples if x == lang] for lang in L.LANGS}
    mixed = f"{by['en'][0]} {by['zh'][0]}{by['zh'][1]} {by['fr'][0]}"
    assert [x for x, _ in L.verdicts([mixed], [False], scorer)[0]] == ["en", "zh", "fr"]
    named = by["zh"][0] + "OCR metadata 图3。" + by["zh"][1]
    assert [x for x, _ in L.verdicts([named], [False], scorer)[0]] == ["zh"]
    assert [x for x, _ in L.verdicts(["哪份资料讲了旧版的维护手册 which report says that the chart is older than the map"], [True], scorer)[0]] == ["en", "zh"]


def test_defined_results(samples):
    scorer = L.Scorer(L.Model(samples))
    assert L.verdicts(["", "404", "abc", " \n "], [False] * 4, scorer) == [[], [], [], []]
    long = L.verdicts([samples[0][1] * 3000], [False], scorer)[0]
    assert [x for x, _ in long] == [samples[0][0]] and 0 < long[0][1] <= 1
    assert L.verdicts([], [], scorer) == []


def test_cache_is_emptied(samples, monkeypatch):
    monkeypatch.setattr(L, "_CACHE", 50)
    scorer = L.Scorer(L.Model(samples))
    for lang, text in samples[:60]:
        assert L.verdicts([text], [False], scorer)[0][0][0] == lang
    assert scorer.next < 50 + 5000


def test_labels(spark):
    labels = {"en": "en", "EN-us": "en", "English": "en", "zh_Hans": "zh", "中文": "zh", "zho": "zh", "deutsch": "de", "fra": "fr", "es-ES": "es", "日本語": "ja", "und": None, "": None, " ": None, None: None, "n/a": None}
    df = spark.createDataFrame([(k,) for k in labels], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", L.label_lang(F.col("x")).alias("y")).collect()} == labels


def test_tables(spark, samples):
    en, zh = (next(t for x, t in samples if x == lang) for lang in ("en", "zh"))
    s = spark.createDataFrame(samples, "lang string, text string")
    chunks = spark.createDataFrame([(1, en, "en", "k"), (2, en, "fr", "k"), (3, zh, None, "k"), (4, None, "en", "k"), (5, f"{en} {zh}", "en", "k"), (2, en, "fr", "k")], "chunk_id long, text string, lang string, kind string")
    queries = spark.createDataFrame([(7, "???", None)], "query_id long, raw string, lang string")
    docs = spark.createDataFrame([(8, en, "de"), (9, en, "de")], "doc_id long, text string, lang string")
    bad = spark.createDataFrame([(9,)], "id long")
    got = {tuple(r) for r in L.found(chunks, queries, docs, s, bad).collect()}
    assert got == {("chunk", 2, "en"), ("chunk", 3, "zh"), ("chunk", 5, "en"), ("chunk", 5, "zh"), ("document", 8, "en")}
    assert L.found(chunks.where("false"), queries.where("false"), docs.where("false"), s, bad).count() == 0
    segs = L.segments(L.records(chunks.where("chunk_id = 5"), queries.where("false"), docs.where("false")), L.fit(s)).orderBy("seg").collect()
    assert [r["lang"] for r in segs] == ["en", "zh"] and "".join(r["piece"] for r in segs) == f"{en} {zh}"


def test_labels_have_a_row_for_each_record(spark, samples):
    s = spark.createDataFrame([(t, lang) for lang, t in samples], "text string, lang string")
    chunks = spark.createDataFrame([(1, None, "en"), (2, "ab", None), (3, samples[0][1], None)], "chunk_id long, text string, lang string")
    queries = spark.createDataFrame([], "query_id long, raw string, lang string")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    got = {r["rec_id"]: (r["lang"], r["confidence"]) for r in L.labels(chunks, queries, docs, s).collect()}
    assert got[1] == got[2] == (None, 0.0) and got[3][0] == samples[0][0]
    residue = spark.createDataFrame([], "id long")
    assert not {r["rec_id"] for r in L.found(chunks, queries, docs, s, residue).collect()} & {1, 2}


def test_segments_of_mixed_texts_have_the_right_language(spark, samples):
    rng = random.Random(11)
    by = {lang: [t for x, t in samples if x == lang] for lang in L.LANGS}
    model = L.Model([s for i, s in enumerate(samples) if i % 4])
    held = {lang: [t for i, (x, t) in enumerate(samples) if x == lang and i % 4 == 0] for lang in L.LANGS}
    rows, truth = [], {}
    for k in range(60):
        text, spans = "", []
        for lang in rng.sample(L.LANGS, 3):
            part = "".join((" " if lang not in ("zh", "ja") else "") + t for t in rng.sample(held[lang], 2)).strip()
            text += "\n\n" * bool(text) + part
            spans.append((len(text) - len(part), len(text), lang))
        rows.append(("document", k, text, None))
        truth[k] = spans
    assert by and rows
    right = total = 0
    for r in L.segments(spark.createDataFrame(rows, "kind string, rec_id long, body string, named string"), model).collect():
        for lo, hi, lang in truth[r["rec_id"]]:
            both = max(0, min(hi, r["start"] + len(r["piece"])) - max(lo, r["start"]))
            total += both
            right += both * (lang == r["lang"])
    assert right >= 0.95 * total > 0, (right, total)
