import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import history

LOG = "log_seq long, asset_id string, sha256 string, deleted boolean, key string"
TASKS = "task_seq long, task_id string, origin_task_id string, uploaded_files array<string>, cls string"


def brute(rows):
    """The definition, row by row."""
    out = {}
    for s, a, h, gone, name in rows:
        if gone:
            continue
        for q, b, g, dead, other in rows:
            if q >= s or dead or any(t[1] == b and t[3] and q < t[0] < s for t in rows):
                continue
            if h and h == g:
                out[s] = "exact"
            elif name == other and out.get(s) != "exact":
                out[s] = "near"
    return out


@pytest.mark.parametrize(("seed", "block", "turns"), [(1, 4096, 1), (2, 4, 3), (3, 2, 6)])
def test_assets_equal_the_definition(spark, monkeypatch, seed, block, turns):
    monkeypatch.setattr(history, "BLOCK", block)
    rng = random.Random(seed)
    rows = [(i, f"name_{rng.randrange(6)}_abc", rng.choice([None, "", "H1", "H2", "H3", "H4"]), rng.random() < 0.25) for i in range(60)]
    log = spark.createDataFrame([(*r, "clash") for r in rows], LOG)
    got = {r["rec_id"]: r["how"] for r in history.found(log, spark.createDataFrame([], TASKS), turns).collect()}
    assert got == brute([(*r, r[1]) for r in rows])


def test_writings_of_names_and_hashes(spark):
    names = ["a_k1b2c3d_log_0a1b2c3d", "A-K1B2C3D-LOG", "A K1b2C3d Log", "a.k1b2c3d.log_ffffffff_0a1b2c3d", "a_k1b2c3d_log（副本）_0a1b2c3d", "a_k1b2c3d_log copy", "a_k1b2c3d_log (1)", "a_k1b2c3d_log_2"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0] for r in df.select(history.name_key(F.col("n"))).collect()} == {"a k1b2c3d log"}
    files = ["a_k_log.pdf", "upload/A-K-LOG.PDF", "C:\\scan\\a_k_log.pdf", "a%20k%20log.pdf", "a_k_log_0a1b2c3d.pdf", "a_k_log (2).pdf", "a_k_log%20copy.pdf"]
    df = spark.createDataFrame([(n,) for n in files], "n string")
    assert {r[0] for r in df.select(history.name_key(F.col("n"), path=True)).collect()} == {"a k log.pdf"}
    hashes = spark.createDataFrame([("AB",), ("sha256:ab",), (" ab ",), ("",), (None,)], "h string")
    assert [r[0] for r in hashes.select(history.hash_key(F.col("h"))).collect()] == ["ab", "ab", "ab", None, None]


@pytest.mark.parametrize("tau", [1, 2])
def test_segment_index_equals_brute_force(spark, tau):
    rng = random.Random(tau)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(120)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    old, new = words[::2], words[1::2]
    got = {(r["probe"], r["name"], r["distance"]) for r in history.lookup(spark.createDataFrame([(w,) for w in old] + [(None,), ("",)], "name string"), spark.createDataFrame([(w,) for w in new] + [(None,)], "name string"), tau=tau).collect()}
    assert got == {(a, b, k) for a in new for b in old if (k := distance(a, b)) <= tau}


def test_a_common_prefix_is_not_what_is_stored(spark):
    rng = random.Random(5)
    names = sorted({"annual report of the archive " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(300)})
    index = history.rarest(history.segments(spark.createDataFrame([(n,) for n in names], "name string")), None)
    assert index.groupBy("len", "seg", "piece").count().agg(F.max("count")).first()[0] <= 3
    assert index.count() == 2 * len(names)


def test_tasks(spark):
    rows = [(1, "t1", None, ["a_k_log.pdf", "b.pdf", "a_k_log.pdf", None, ""], "x"), (2, "t2", "t1", ["b.pdf"], "x"), (3, "t3", None, ["x/A-K-LOG.pdf", "c.pdf"], "x"), (4, "t3", None, ["c.pdf"], "x"), (5, "t5", None, None, "x"), (6, "t6", None, ["x/A-K-LOG.pdf", "%zz.pdf"], None)]
    for turns in (1, 2, 6):
        got = {tuple(r) for r in history.found(spark.createDataFrame([], LOG), spark.createDataFrame(rows, TASKS), turns).collect()}
        assert got == {("task", 1, 2, "exact"), ("task", 3, 0, "near"), ("task", 6, 0, "exact")}


def test_the_index_finds_writings_that_the_plain_form_keeps_apart(spark):
    rows = [(1, "a_k1b2_log", None, False, "x"), (2, "A-K1B2LOG", None, False, "x"), (3, "a_k1b2_lag", None, False, "x"), (4, "résumé_x7", None, False, "x"), (5, "resumé_x7", None, False, "x"), (6, "a_k1b2_log", None, True, "x"), (7, "a_k1b2_log", None, False, "x"), (8, None, None, False, "x")]
    for turns in (1, 4, 8):
        got = {tuple(r) for r in history.found(spark.createDataFrame(rows, LOG), spark.createDataFrame([], TASKS), turns).collect()}
        assert got == {("asset", 2, 0, "near"), ("asset", 5, 0, "near"), ("asset", 7, 0, "near")}


def test_a_batch_reads_only_the_parts_of_its_keys(spark, tmp_path):
    """The second batch gets the right answers though every part that its keys do not fall into is gone."""
    import shutil

    first = [(i, f"name_{i}_{'abcdefghij'[i % 10] * 5}", f"h{i}", False, "x") for i in range(200)]
    store = history.History(spark, str(tmp_path / "h"), parts=64)
    assert store.accept_assets(spark.createDataFrame(first, LOG)).where("how is not null").count() == 0
    batch = spark.createDataFrame([(900, "name-7-hhhhh", None, False, "x"), (901, "other", "SHA256:h9", False, "x")], LOG)
    names = batch.select(F.lit("asset").alias("kind"), history.name_key(F.col("asset_id")).alias("name"))
    keys = {"segments": history.probes(names, ("kind",)), "pieces": history.segments(names, ("kind",)), "counts": spark.createDataFrame([(2, "name 7 hhhhh"), (2, "other"), (1, "h9")], "rank int, val string"), "owned": spark.createDataFrame([], "asset_id string")}
    left = 0
    for name, wanted in keys.items():
        parts = {r[0] for r in store._part(wanted, name).select("part").distinct().collect()}
        for folder in (tmp_path / "h" / name / "turn=000000").glob("part=*"):
            if int(folder.name[5:]) in parts:
                left += 1
            else:
                shutil.rmtree(folder)
    assert left < 100
    reopened = history.History(spark, str(tmp_path / "h"), turn=1, parts=64)
    assert {tuple(r) for r in reopened.accept_assets(batch).collect()} == {(900, 0, "near"), (901, 0, "exact")}
    assert history.History(spark, str(tmp_path / "h"), turn=2, parts=64).accept_assets(batch.where("false")).count() == 0


def test_rows_without_an_asset_id_stay(spark):
    rows = [(1, None, "H1", False, "x"), (2, None, None, True, "x"), (3, None, "H1", False, "x"), (4, "a_k_log", "H1", False, "x"), (5, None, None, False, "x")]
    got = {tuple(r) for r in history.found(spark.createDataFrame(rows, LOG), spark.createDataFrame([], TASKS)).collect()}
    assert got == {("asset", 3, 0, "exact"), ("asset", 4, 0, "exact")}
