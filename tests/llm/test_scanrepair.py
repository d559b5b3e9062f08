import random
from collections import Counter

import pytest

from corvane.llm import scanrepair as S

CLEAN = "the printed pages of the harbour map were read again by the team in winter and the older column holds entries"


@pytest.fixture(scope="module")
def lexicon():
    counts = Counter({w: 50 for w in CLEAN.split()})
    counts |= Counter({"cross-encoder": 9, "cross": 9, "encoder": 9, "图纸": 40, "的图": 30, "检修": 40, "日志": 40, "询日": 40})
    return S.Lexicon(dict(counts))


def test_hyphens_and_characters(lexicon):
    text, noise = S.decode("the prin-\nted pagcs of thc harb0ur rnap", lexicon)
    assert text == "the printed pages of the harbour map" and noise == {"hyphen", "char"}


@pytest.mark.parametrize(
    ("text", "want", "noise"),
    [
        ("theprinted pages", "the printed pages", {"joined"}),
        ("Theprinted pages", "The printed pages", {"joined"}),
        ("thcprinted pages", "the printed pages", {"joined", "char"}),
        ("the prin\nted pages", "the printed pages", {"break"}),
        ("the older co\nlurnn", "the older column", {"break", "char"}),
        (f"the prin-\n\n{S.GONE}\n\nted pages", "the printed pages", {"hyphen"}),
        ("the cross-\nencoder holds", "the cross-encoder holds", set()),
        ("the pages\nof the map", "the pages\nof the map", set()),
        ("the prin\n\nted pages", "the prin\n\nted pages", set()),
    ],
)
def test_the_cheapest_reading_wins(lexicon, text, want, noise):
    assert S.decode(text, lexicon) == (want, noise)


def test_words_broken_over_a_removed_line():
    lexicon = S.Lexicon({w: 50 for w in CLEAN.split()})
    assert S.repair_text("the prin-\n\n4\n\nted pages of the map", [], 3, lexicon) == ("the printed pages of the map", {"hyphen", "pageno"})


def test_real_compounds_and_numbers_stay(lexicon):
    assert S.decode("the cross-encoder holds 19 entries", lexicon) == ("the cross-encoder holds 19 entries", set())
    assert S.decode("mark Zor-\n16", lexicon)[1] == set()


def test_look_alikes_need_their_neighbours(lexicon):
    assert S.decode("褪色的囹纸", lexicon) == ("褪色的图纸", {"char"})
    assert S.decode("查询曰志", lexicon)[1] == {"char"}
    assert S.decode("囹圄", lexicon) == ("囹圄", set())


@pytest.mark.parametrize(("line", "page", "noise"), [("Page 4", 3, True), ("Page 4 / 74", 3, True), ("[4]", None, True), ("iv", 3, True), ("第 4 页", 3, True), ("- 4 -", 3, True), ("4", 7, False), ("49.8 41.6", None, False), ("mix", None, False)])
def test_page_numbers(line, page, noise):
    assert ("pageno" in S.find_headers(["text", line], [], page)[1]) == noise


def test_headers_whole_cut_and_numbered():
    keys = [S.line_key("Handwritten section heading of the Große site")]
    for line in ("Handwritten section heading of the Große site", "HANDWRITTEN SECTION HEADING OF THE GROSSE SITE", "— Handwritten  section heading of the Große site —", "Handwritten section hea"):
        assert S.find_headers(["x", line], keys, 1)[1] == {"header"}
    assert S.find_headers(["Handwritten section heading of the Große site   8"], keys, 7)[1] == {"header", "pageno"}
    assert S.find_headers(["Handwritten"], keys, 7)[1] == set()


def test_paragraphs_join_wrapped_lines(lexicon):
    lines = ["The older column holds", "entries.", "", "The map was read", None, "again in winter."]
    assert S.paragraphs(lines, lexicon) == "The older column holds entries.\n\nThe map was read again in winter."
    assert S.paragraphs(["稠密的查", "询日志。"], lexicon) == "稠密的查询日志。"
    assert S.paragraphs([None, ""], lexicon) == ""


def test_long_texts_and_skeletons(lexicon):
    assert S.repair_text("the pages " * 50_000, [], None, lexicon)[1] == set()
    assert S.skeleton("colurnn") == S.skeleton("column") and S.explains("colurnn", "column") and not S.explains("column", "colurnn")


CHUNK = "chunk_id long, text string, metadata struct<asset_id:string,asset_title:string,page:int>, body string"
BLOCK = "block_id long, asset_id string, page int, text string"


def test_tables(spark):
    body = (CLEAN + ". ") * 6
    head = "Plant operations manual reading copy"
    chunks = [(i, body, ("a", head, i), "x") for i in range(8)]
    chunks += [(10, f"{head}\n{CLEAN[:40]}\n{CLEAN[41:]}.", ("a", None, 3), "x"), (11, "the prin-\nted pages", (None, None, None), "x"), (12, None, None, None), (13, " ", ("a", head, 1), None), (11, "the prin-\nted pages", (None, None, None), "x")]
    blocks = [(1, "a", 2, f"the harb0ur map\n3\n{head}\nwas read"), (2, None, None, "")]
    log = spark.createDataFrame([("a", "Other title of the asset")], "asset_id string, asset_title string")
    got = {tuple(r) for r in S.found(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(blocks, BLOCK), log).collect()}
    assert got == {("chunk", 10, "header"), ("chunk", 11, "hyphen"), ("block", 1, "char"), ("block", 1, "pageno"), ("block", 1, "header")}
    assert S.found(spark.createDataFrame([], CHUNK), spark.createDataFrame([], BLOCK), log.where("false")).count() == 0


def test_no_term_is_cut(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"q{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:4]]
    rows = spark.createDataFrame([(" ".join(words),)] * 3 + [("zulu",)] * 2, "body string")
    counts = {r["term"]: r["n"] for r in S.lexicon_terms(rows).collect()}
    assert len(words) > 60_000 and counts == dict.fromkeys(words, 3)


@pytest.mark.parametrize("common", [0, 3, 12, 40])
def test_rare_terms_that_are_joined_give_the_same_repairs(spark, common):
    """With almost nothing of the lexicon at hand the results are those of the whole lexicon."""
    rng = random.Random(common)
    words = [f"{a}{b}{c}" for a in ("mar", "hol", "den", "clu") for b in ("ime", "oda", "urn", "ell") for c in ("s", "rk", "mb", "ting")]
    clean = [" ".join(rng.choice(words[: 8 + i]) for _ in range(60)) for i in range(40)]
    noisy = []
    for i, text in enumerate(clean):
        t = text.split(" ")
        t[3], t[9], t[20] = t[3].replace("m", "rn").replace("d", "cl"), t[9][:3] + "-\n" + t[9][3:], t[20] + t[21]
        t[30], t[40] = t[30][:4] + "\n" + t[30][4:], t[40].replace("l", "1").replace("o", "0")
        noisy.append(("chunk", i, None, None, " ".join(t)))
    rows = spark.createDataFrame([*noisy, *(("block", i, None, None, t) for i, t in enumerate(clean * 2))], "kind string, rec_id long, asset_id string, page int, body string")
    titles = spark.createDataFrame([], "asset_id string, title string")
    whole = sorted(map(str, S.repair(rows, titles).collect()))
    assert len(whole) >= 40
    assert sorted(map(str, S.repair(rows, titles, common=common).collect())) == whole


def test_the_header_of_a_chapter_counts_in_a_large_asset(spark):
    chapter = "Chapter of the turbine hall and its pumps"
    rows = [("block", p, "a", p, f"{chapter if 400 <= p < 420 else f'line of page number {p} alone'}\nand the text of page goes on here.") for p in range(3000)]
    rows += [("chunk", p, "a", None, f"{chapter} \nand a text without a page.") for p in range(2)]
    df = spark.createDataFrame(rows, "kind string, rec_id long, asset_id string, page int, body string")
    keys = {r["stretch"]: r["keys"] for r in S.header_keys(df, spark.createDataFrame([("a", "Title")], "asset_id string, title string")).collect()}
    assert {s for s, k in keys.items() if S.line_key(chapter) in k} == {-1, 6} and all("title" in k for k in keys.values()) and len(keys) == 48


@pytest.mark.parametrize(("text", "right"), [("read the man\nual now", "read the manual now"), ("open themanual now", "open the manual now"), ("theoperationmanual", "the operation manual"), ("the man-\nual", "the manual")])
def test_words_are_merged_and_split(text, right):
    lexicon = S.Lexicon({w: 400 for w in "read the open now of".split()} | {w: 60 for w in "manual operation turbine".split()})
    assert S.repair_text(text, [], None, lexicon)[0] == right


def test_a_word_asks_for_its_parts_only_where_they_fill_it():
    """every part of every uncommon word was joined; the parts matter only where words fill the whole of it."""
    held = {w: 400 for w in "read open operation turbine".split()}
    every = bytes([255]) * (S.FILTER_BITS // 8)
    needs = S.Needs(held, S.Lexicon(dict(held)), every, bytes(S.FILTER_BITS // 8), 9)
    assert needs.of("readturbine") == {S.skeleton(w) for w in ("readturbine", "read", "turbine")}
    assert needs.of("qzxkvoperationkqzxv" * 3) == {S.skeleton("qzxkvoperationkqzxv" * 3)}
    assert needs.of("read open turbine") == set()


@pytest.mark.parametrize("common", [0, 2, 6])
def test_rare_pairs_decide_on_look_alikes_too(spark, common):
    """pairs of characters below the count of the terms at hand were taken as never seen."""
    texts = ["图纸的检修日志"] * 12 + ["查询日志检查"] * 9 + ["囹纸的捡修曰志", "查询曰志捡查", "褪色的囹纸"] + ["的的的的 of the map of the"] * 40
    rows = spark.createDataFrame([("chunk", i, None, None, t) for i, t in enumerate(texts)], "kind string, rec_id long, asset_id string, page int, body string")
    titles = spark.createDataFrame([], "asset_id string, title string")
    whole = sorted(map(str, S.repair(rows, titles).collect()))
    assert len(whole) >= 2 and sorted(map(str, S.repair(rows, titles, common=common).collect())) == whole


def test_what_a_text_needs_costs_the_same_however_many_terms_are_held():
    """each text walked through all terms that the worker holds."""
    import time

    none = bytes(S.FILTER_BITS // 8)
    needs = S.Needs({f"w{i}": 9 for i in range(400_000)}, S.Lexicon({"pump": 50}), none, none, 10)
    began = time.process_time()
    for i in range(500):
        needs.of(f"the w{i} of the oil pump 日目{i}")
    assert time.process_time() - began < 0.5
