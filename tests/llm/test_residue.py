import pytest

from corvane.llm import residue as R

REAL = "In practice, the printed catalogue lists the harbour map on the last shift. Nobody at the site could say why the valve schedule was merged."
HINTED = R._hinted()


def by_form(text):
    """Whether the units trusted by their form outweigh the others."""
    r = R.read([text], HINTED)
    return r.sizes[r.trusted].sum() * 2 > r.totals[0]


@pytest.mark.parametrize("text", ["Lorem ipsum dolor sit amet. Felis ante lectus velit.", "Nulla facilisi. Pellentesque habitant morbi tristique senectus et netus.", "{{ title }}\n\nSection ${body} of <%= date %>", "404 Not Found", "status=503", "Please enable JavaScript to view this page.", "请启用 JavaScript 以查看本页。", "Heading placeholder test test test", "作者：【此处填写date】，日期：（请输入body）", 'Traceback (most recent call last):\n  File "/srv/x.py", line 8, in run\nValueError: empty page', "テストテスト。", "Qux here.\nQux here.\nQux here.", "We could not load your report. Refresh the page in a moment.", "Sorry, this document could not be rendered because the converter crashed.", "[Company tagline goes in this spot]", f"{REAL}\n" + "Lorem ipsum dolor sit amet velit porta. " * 9])
def test_trusted_by_form(text):
    assert by_form(text)


@pytest.mark.parametrize("text", [REAL, f"The template field {{{{ asset_title }}}} is filled when the card is printed. {REAL}", "A client that sees 404 Not Found asks for the asset again after 5 seconds.", "模板变量 {{ title }} 在打印目录时才会被替换。", "snake_case__x [MASK] <s> </s>", f"Lorem ipsum was removed from the page. {REAL}", "Use ${HOME}/assets as the root folder of the archive.", "The porta of the house is in the non-est corner.", "", " \n "])
def test_content(text):
    assert not by_form(text)


def test_copies_share_the_verdict_and_rows_pass(spark):
    rows = [(1, REAL, "k"), (2, "404 Not Found", "k"), (3, "404 not found", "k"), (4, None, "k"), (5, "", "k"), (6, "Error 500\nReference: 1-1", "k"), (7, "Error 503\nReference: 9-9", "k"), (2, "404 Not Found", "k"), (8, "x" * 200_000, "k"), (None, "502 Bad Gateway", "k"), (9, "Привет мир", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    assert {r["id"] for r in R.found(R.records(docs)).collect()} == {2, 3, 6, 7, None}
    assert sorted(r["doc_id"] or 0 for r in R.clean(docs).collect()) == [0, 1, 4, 5, 8, 9]
    assert R.found(R.records(docs.where("false"))).count() == 0


def test_labels_spread_through_shared_units(spark):
    texts = [
        "Error 503\nThe clerk is away.", "Error 500\nThe clerk is away.\nRing the bell.",  # the clerk and the bell stand beside trusted units
        "The clerk is away.\nRing the bell.", "Ring the bell.\nDoor closed.", "Door closed.",  # no trusted form: two and three links away
        f"Ring the bell. {REAL}", f"{REAL} Ring the harbour master at noon, he knows the tide tables by heart.",
        "Clerks of the archive keep the old ledgers.\nThe tide was low.", "The tide was low.\nThe ledgers were read again in the spring.",  # shared, but beside content
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = {r["id"]: r["how"] for r in R.verdicts(docs).collect()}
    assert got == {0: "units", 1: "units", 2: "units", 3: "units", 4: "units"}


def test_candidates_hold_nearly_all_pairs_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(3)
    met = 0
    for n in (45, 90, 180, 360):
        for _ in range(100):
            pool = rng.integers(0, 2**63, n + n // 9, dtype=np.int64).astype(np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n // 9 :])
            assert len(np.intersect1d(a, b)) >= R.SIMILARITY * len(np.union1d(a, b))
            met += bool(np.intersect1d(R.band_keys(a, R.BANDS, R.ROWS), R.band_keys(b, R.BANDS, R.ROWS)).size)
    assert met >= 399


def test_verified_links_carry_the_label(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so", "ti", "vu", "xa", "zo") for b in ("bar", "den", "fil", "gor", "hem", "jal", "kur")]
    # The second text is near the first, the third near the second alone; neither shows a trusted form.
    texts = [" ".join(words) + ".\n" + "404 Not Found\n" * 80, " ".join(words[:-1]) + ".", " ".join(words[:-12]) + ".", " ".join(words[:30]) + ".", REAL]
    assert [by_form(t) for t in texts] == [True, False, False, False, False]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    assert {r["id"]: r["how"] for r in R.verdicts(docs).collect()} == {0: "form", 1: "copy", 2: "copy"}
