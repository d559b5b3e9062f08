"""Problem 4: checking new batches against everything accepted before, without working through the history again.

Method: a stored segment index for edit distance. Names are written plainly (letter case, folders, escapes, added hashes
and copy marks go, separators become one blank); every new name is cut into ``SEGMENTS`` pieces whose places depend on its
length alone, and its ``tau + 1`` rarest pieces are stored by (length, piece number, piece). ``tau`` edits cannot touch all of
them, so a batch probes the index with a few substrings of its own names, by length and position, and finds every stored
name within ``tau`` edits; candidates are verified with a bounded edit distance, and the exact check that follows keeps
those with the same letters and digits (accents and separators aside). New names append their pieces. Pieces that many
names share are not the ones stored, so a common prefix makes no hot key.

Beside the index :class:`History` keeps logs of counts: how many accepted rows with a hash or a name are still live, and what
each asset owns, so that a tombstone can take it back. All tables are appended to, turn by turn, in parts by the hash of
their key, and a batch reads only the parts its own keys fall into. Within a batch the order of arrival decides.

Defined results: null and empty strings are neither stored nor found. A null asset_id is no name and has no tombstone.
Repeated strings are stored once. Ties between earlier rows do not matter: a row is reported once, with the strongest
kind. A repeated log_seq counts once. Empty batches give no rows. Batches come in their order of arrival. Other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import materialize, shared_dir, together

TAU = 1
#: Pieces a name is cut into; any ``tau + 1`` of them would do, the rarest are stored.
SEGMENTS = 6
#: Rows of one key that are worked on together; a hot key becomes many blocks.
BLOCK = 4096
#: Parts of each stored table; a batch reads only the parts of its keys.
PARTS = 16
#: Turns in which :func:`found` replays the history.
TURNS = 2
_LATE = 2**62
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿœ", "aaaaaaceeeeiiiinooooouuuuyyo")

def name_key(name: Column, path: bool = False) -> Column:
    """The same value for every writing of one name."""
    text = name
    if path:
        text = F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)
        text = F.regexp_replace(text, r"^.*[/\\]", "")
    text = F.lower(F.trim(text))
    text = F.translate(text, "（）　－＿．", "() -_.")
    ext = F.when(F.lit(path), F.regexp_extract(text, r"(\.[a-z0-9]{1,5})$", 1)).otherwise(F.lit(""))
    stem = F.regexp_replace(text, r"\.[a-z0-9]{1,5}$", "") if path else text
    stem = F.regexp_replace(stem, r"^(?:copy of |kopie von |copie de |copia de )", "")
    stem = F.regexp_replace(stem, r"(?:[\s_.\-]+[0-9a-f]{8}|[\s_.\-]*\((?:副本|コピー|copy|kopie|copie|copia|\d{1,3})(?:\s*\d{1,3})?\)|[\s_.\-]*(?:副本|コピー)|[\s_.\-]+(?:copy|kopie|copie|copia)(?:[\s_.\-]*\d{1,3})?|[\s_.\-]+\d{1,2})+$", "")
    key = F.trim(F.regexp_replace(stem, r"[\s_.\-]+", " "))
    return F.when(key == "", None).otherwise(F.concat(key, ext))


def hash_key(sha: Column) -> Column:
    """A sha256 in its plain writing; null where it is blank."""
    text = F.regexp_replace(F.lower(F.trim(sha)), r"^sha-?256[:=\-]\s*|[\s:\-]", "")
    return F.when(text != "", text)


def letters(name: Column) -> Column:
    """Letters and digits alone, without accents: equal for writings of one name."""
    return F.regexp_replace(F.translate(F.lower(name), *_ACCENTS), r"[\s_.\-\u0300-\u036f]+", "")


def segments(strings: DataFrame, by: tuple[str, ...] = (), pieces: int = SEGMENTS) -> DataFrame:
    """``(*by, len, seg, piece, name)``: all pieces of the distinct strings (*by, name)."""
    s = strings.select(*by, "name").where("name is not null and name <> ''").distinct().withColumn("len", F.length("name"))
    s = s.withColumn("seg", F.explode_outer(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return s.select(*by, "len", "seg", F.expr(f"substring(name, {_begin('len', 'seg', pieces)} + 1, {_begin('len', 'seg + 1', pieces)} - {_begin('len', 'seg', pieces)})").alias("piece"), "name")


def rarest(parts: DataFrame, known: DataFrame | None, by: tuple[str, ...] = (), tau: int = TAU) -> DataFrame:
    """The ``tau + 1`` rarest of each name's pieces; ``known`` (*by, len, seg, piece, n) adds earlier counts.

    Empty pieces (of names shorter than the number of pieces) cannot be told from untouched ones, so they come last.
    """
    token = [*by, "len", "seg", "piece"]
    counts = parts.groupBy(*token).agg(F.count("*").alias("n"))
    if known is not None:
        counts = counts.unionByName(known.select(*token, "n")).groupBy(*token).agg(F.sum("n").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((F.col("piece") == "").alias("empty"), "n", "seg", "piece")))
    best = parts.join(counts, token).groupBy(*by, "name", "len").agg(F.slice(order, 1, tau + 1).alias("best"))
    return best.select(*by, "len", "name", F.explode_outer("best").alias("b")).select(*by, "len", "b.seg", "b.piece", "name")


def _begin(length: str, seg: str, parts: int) -> str:
    return f"cast(floor(({seg}) * {length} / {parts}) as int)"


def probes(strings: DataFrame, by: tuple[str, ...] = (), tau: int = TAU, pieces: int = SEGMENTS) -> DataFrame:
    """The substrings (*by, len, seg, piece, probe) with which each new string (*by, name) asks the index.

    A piece that stands ``d`` places further in the probe, which is ``gap`` characters longer, costs at least |d| edits before it
    and |gap - d| after it, so only shifts with |d| + |gap - d| <= tau are asked for.
    """
    s = strings.select(*by, F.col("name").alias("probe")).where("probe is not null and probe <> ''").distinct()
    ways = [(gap, d) for gap in range(-tau, tau + 1) for d in range(-tau, tau + 1) if abs(d) + abs(gap - d) <= tau]
    s = s.withColumn("way", F.explode_outer(F.expr("array(" + ", ".join(f"struct({g} as gap, {d} as d)" for g, d in ways) + ")")))
    s = s.withColumn("len", F.length("probe") - F.col("way.gap")).where("len > 0").withColumn("seg", F.explode_outer(F.sequence(F.lit(0), F.lit(pieces - 1))))
    start = f"({_begin('len', 'seg', pieces)} + way.d)"
    size = f"({_begin('len', 'seg + 1', pieces)} - {_begin('len', 'seg', pieces)})"
    s = s.where(f"{start} >= 0 and {start} + {size} <= length(probe)")
    return s.select(*by, "len", "seg", F.expr(f"substring(probe, {start} + 1, {size})").alias("piece"), "probe").distinct()


def verified(asked: DataFrame, index: DataFrame, by: tuple[str, ...] = (), tau: int = TAU) -> DataFrame:
    """``(*by, probe, name, distance)``: the stored names that share a piece with a probe and lie within ``tau`` edits."""
    met = asked.join(index, [*by, "len", "seg", "piece"]).select(*by, "probe", "name").distinct()
    return met.withColumn("distance", F.levenshtein("probe", "name", tau)).where("distance >= 0")


def lookup(names: DataFrame, strings: DataFrame, tau: int = TAU) -> DataFrame:
    """``(probe, name, distance)`` of every one of ``names`` (name) within ``tau`` edits of one of ``strings`` (name)."""
    pieces = max(SEGMENTS, tau + 1)
    parts = segments(names, pieces=pieces)
    return verified(probes(strings, tau=tau, pieces=pieces), rarest(parts, None, tau=tau), tau=tau)


def _blocks(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("blk", F.floor(F.col(order) / BLOCK))


def running_max_before(df: DataFrame, key: list[str], order: str, value: str, out: str) -> DataFrame:
    """``out`` = the largest ``value`` among rows of the same key with a smaller ``order``.

    Two levels, so that a key that holds a third of all rows is spread over blocks of ``order``: the running maximum
    inside each block, and the maximum of the blocks before, of which there is one row each.
    """
    rows = _blocks(df, key, order)
    per = rows.groupBy(*key, "blk").agg(F.max(value).alias("top"))
    before = per.withColumn("prior", F.max("top").over(Window.partitionBy(*key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    inside = Window.partitionBy(*key, "blk").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    # Null keys are a key like others; an inner join on equality would lose their rows.
    before = before.select(*(F.col(c).alias(f"{c}__b") for c in (*key, "blk")), "prior")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}__b")) for c in (*key, "blk")))
    joined = rows.withColumn("inner_top", F.max(value).over(inside)).join(before, same).drop(*(f"{c}__b" for c in (*key, "blk")))
    return joined.withColumn(out, F.greatest("inner_top", "prior")).drop("inner_top", "prior", "blk")


def dead_from(log: DataFrame) -> DataFrame:
    """Adds ``dead_at``: the next tombstone of the row's own asset after the row (a very late number if none).

    A row without an asset_id has no tombstone, and a tombstone without one ends no row.
    """
    flipped = log.withColumn("back", -F.col("log_seq")).withColumn("grave", F.when(F.col("deleted") & F.col("asset_id").isNotNull(), -F.col("log_seq")))
    found = running_max_before(flipped, ["asset_id"], "back", "grave", "next_grave")
    return found.withColumn("dead_at", F.coalesce(-F.col("next_grave"), F.lit(2**62))).drop("back", "grave", "next_grave")


_TABLES = {
    "segments": ("kind string, len int, seg int, piece string, name string", ("kind", "len", "seg", "piece")),
    "pieces": ("kind string, len int, seg int, piece string, n long", ("kind", "len", "seg", "piece")),
    "counts": ("rank int, val string, n long", ("rank", "val")),
    "owned": ("asset_id string, rank int, val string, n long", ("asset_id",)),
}


class History:
    """What has been accepted: stored tables in ``folder`` that each accepted batch adds a turn to.

    A turn is written to folders of its own, so a batch that failed half-way can be accepted again. Opened anew on a folder, it goes
    on after the last finished turn.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, turn: int = 0, parts: int = PARTS, tau: int = TAU) -> None:
        self.spark, self.turn, self.parts, self.tau = spark, turn, parts, tau
        self.folder = folder or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"

    def _part(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64(*_TABLES[name][1]), F.lit(self.parts)).cast("int"))

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table in the current turn."""
        rows = self._part(df.select(*(f.split()[0] for f in _TABLES[name][0].split(", "))), name).repartition("part")
        rows.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(f"{self.folder}/{name}/turn={self.turn:06d}")

    def stored(self, name: str, keys: DataFrame) -> DataFrame | None:
        """The rows of earlier turns in the parts that ``keys`` fall into; None in the first turn."""
        if not self.turn:
            return None
        wanted = [r[0] for r in self._part(keys, name).select("part").distinct().collect()]
        table = self.spark.read.schema(f"{_TABLES[name][0]}, turn int, part int").parquet(f"{self.folder}/{name}")
        return table.where((F.col("turn") < self.turn) & F.col("part").isin(wanted)).drop("turn", "part")

    def same_names(self, names: DataFrame) -> DataFrame:
        """``(kind, probe, name)``: for each of the batch's ``names`` (kind, name) the names, stored or of the batch, it may be.

        Names that are not stored yet are added to the index.
        """
        names = materialize(names.where("name is not null and name <> ''").distinct(), "history-names")
        asked = materialize(probes(names, ("kind",), self.tau), "history-probes")
        index = self.stored("segments", asked)
        before = None if index is None else materialize(verified(asked, index, ("kind",), self.tau), "history-met")
        fresh = names if before is None else names.join(before.where("distance = 0").select("kind", "name"), ["kind", "name"], "left_anti")
        parts = materialize(segments(fresh, ("kind",)), "history-pieces")
        known = self.stored("pieces", parts)
        if known is not None:
            known = known.join(parts.select("kind", "len", "seg", "piece").distinct(), ["kind", "len", "seg", "piece"], "left_semi")
        self.append("segments", rarest(parts, known, ("kind",), self.tau))
        self.append("pieces", parts.groupBy("kind", "len", "seg", "piece").agg(F.count("*").alias("n")))
        own = self.spark.read.schema(f"{_TABLES['segments'][0]}, part int").parquet(f"{self.folder}/segments/turn={self.turn:06d}").drop("part")
        met = verified(asked, own, ("kind",), self.tau)
        both = met if before is None else before.unionByName(met)
        return materialize(both.where(letters(F.col("probe")) == letters(F.col("name"))).select("kind", "probe", "name").distinct(), "history-same")

    def _witnesses(self, asks: DataFrame, graves: DataFrame | None) -> DataFrame | None:
        """``(rank, val, log_seq, dead_at)``: what earlier turns know of the batch's keys, as rows before all others.

        ``graves`` (asset_id, dead_at): the batch's first tombstone of each asset.
        """
        keys = asks.select("rank", "val").distinct()
        counts = self.stored("counts", keys)
        if counts is None:
            return None
        live = counts.join(keys, ["rank", "val"], "left_semi").groupBy("rank", "val").agg(F.sum("n").alias("n"))
        if graves is None:
            return live.where("n > 0").select("rank", "val", F.lit(-1).cast("long").alias("log_seq"), F.lit(_LATE).alias("dead_at"))
        ending = self.owned(graves).join(keys, ["rank", "val"], "left_semi")
        lost = ending.groupBy("rank", "val").agg(F.sum("n").alias("lost"), F.max("dead_at").alias("ends"))
        both = live.where("n > 0").join(lost, ["rank", "val"], "left")
        stays = F.col("n") > F.coalesce("lost", F.lit(0))
        return both.select("rank", "val", F.lit(-1).cast("long").alias("log_seq"), F.when(stays, F.lit(_LATE)).otherwise(F.col("ends")).alias("dead_at"))

    def owned(self, graves: DataFrame) -> DataFrame:
        """``(asset_id, rank, val, n, dead_at)``: the live keys of assets that end in the batch."""
        return self.stored("owned", graves).join(graves, "asset_id").groupBy("asset_id", "rank", "val", "dead_at").agg(F.sum("n").alias("n")).where("n > 0")

    def accept_assets(self, batch: DataFrame) -> DataFrame:
        """Arrivals ``(rec_id, item_ix, how)`` of rows of the log, which are accepted; ``how`` is null for what is new."""
        rows = batch.select("log_seq", "asset_id", F.coalesce("deleted", F.lit(False)).alias("deleted"), hash_key(F.col("sha256")).alias("sha"), name_key(F.col("asset_id")).alias("name")).dropDuplicates(["log_seq"])
        rows = materialize(dead_from(rows), "history-rows")
        graves = rows.where("deleted and asset_id is not null").groupBy("asset_id").agg(F.min("log_seq").alias("dead_at"))
        live = rows.where("not deleted")
        same = self.same_names(live.select(F.lit("asset").alias("kind"), "name"))
        facts = live.where("sha is not null").select("log_seq", "asset_id", F.lit(1).alias("rank"), F.col("sha").alias("val"), "dead_at")
        facts = materialize(facts.union(live.where("name is not null").select("log_seq", "asset_id", F.lit(2).alias("rank"), F.col("name").alias("val"), "dead_at")), "history-facts")
        other = same.where("probe <> name").select(F.col("probe").alias("val"), F.col("name").alias("as"))
        asks = facts.where("rank = 2").join(other, "val").select("rank", F.col("as").alias("val"), "log_seq", F.lit(None).cast("long").alias("dead_at"))
        asks = materialize(facts.select("rank", "val", "log_seq", "dead_at").union(asks), "history-asks")
        before = self._witnesses(asks, graves)
        best = running_max_before(asks if before is None else asks.union(before), ["rank", "val"], "log_seq", "dead_at", "best").where("log_seq >= 0")
        known = best.groupBy("log_seq").agg(F.min(F.when(F.col("best") > F.col("log_seq"), F.col("rank"))).alias("rank"))
        out = live.select("log_seq").join(known, "log_seq", "left")
        out = materialize(out.select(F.col("log_seq").alias("rec_id"), F.lit(0).alias("item_ix"), _how(1)), "history-arrivals")
        kept = facts.where(F.col("dead_at") == _LATE).groupBy("asset_id", "rank", "val").agg(F.count("*").alias("n"))
        gone = self.owned(graves).select("asset_id", "rank", "val", (-F.col("n")).alias("n")) if self.turn else None
        self._count(kept if gone is None else kept.unionByName(gone), owned=True)
        return out

    def accept_tasks(self, batch: DataFrame) -> DataFrame:
        """The same for the uploaded files of tasks, position by position; the rows of a batch come after all earlier ones."""
        first = batch.select("task_seq", "task_id", "origin_task_id", "uploaded_files").groupBy("task_id").agg(F.min_by(F.struct("task_seq", "origin_task_id", "uploaded_files"), "task_seq").alias("t")).select("task_id", "t.*")
        ids = first.where("task_id is not null").select(F.lit(5).alias("rank"), F.col("task_id").alias("val"))
        seen = self.stored("counts", ids)
        if seen is not None:
            first = first.join(seen.where("rank = 5").select(F.col("val").alias("task_id")).distinct(), "task_id", "left_anti")
        first = materialize(first, "history-tasks")
        files = first.where("origin_task_id is null").select("task_seq", F.posexplode("uploaded_files").alias("item_ix", "file")).where("file is not null and file <> ''")
        files = files.withColumn("ord", F.struct("task_seq", "item_ix")).withColumn("name", F.coalesce(name_key(F.col("file"), path=True), "file"))
        files = materialize(files, "history-files")
        same = self.same_names(files.select(F.lit("task").alias("kind"), "name"))
        facts = materialize(files.select(F.lit(3).alias("rank"), F.col("file").alias("val"), "ord").union(files.select(F.lit(4), "name", "ord")).groupBy("rank", "val").agg(F.min("ord").alias("first"), F.count("*").alias("n")), "history-facts")
        names = same.select("probe", F.lit(4).alias("rank"), F.col("name").alias("val"))
        asks = files.select(F.lit(3).alias("rank"), F.col("file").alias("val")).union(names.select("rank", "val")).distinct()
        before = self._witnesses(asks, None)
        known = facts.select("rank", "val", "first", F.lit(False).alias("stored"))
        if before is not None:
            known = known.unionByName(before.select("rank", "val", F.lit(None).cast("struct<task_seq:bigint,item_ix:int>").alias("first"), F.lit(True).alias("stored")))
        known = known.groupBy("rank", "val").agg(F.min("first").alias("first"), F.max("stored").alias("stored"))
        alike = names.join(known, ["rank", "val"]).groupBy("probe").agg(F.min("first").alias("first_alike"), F.max("stored").alias("stored_alike")).withColumnRenamed("probe", "name")
        exact = known.where("rank = 3").select(F.col("val").alias("file"), F.col("first").alias("first_same"), F.col("stored").alias("stored_same"))
        out = files.join(exact, "file", "left").join(alike, "name", "left")
        rank = F.when(F.col("stored_same") | (F.col("first_same") < F.col("ord")), 1).when(F.col("stored_alike") | (F.col("first_alike") < F.col("ord")), 2)
        out = materialize(out.withColumn("rank", rank).select(F.col("task_seq").alias("rec_id"), "item_ix", _how(1)), "history-arrivals")
        kept = facts.select("rank", "val", "n").unionByName(first.where("task_id is not null").select(F.lit(5).alias("rank"), F.col("task_id").alias("val"), F.lit(1).cast("long").alias("n")))
        self._count(kept, owned=False)
        return out

    def _count(self, rows: DataFrame, owned: bool) -> None:
        if owned:
            rows = materialize(rows, "history-kept")
            self.append("owned", rows.where("asset_id is not null"))
        self.append("counts", rows.groupBy("rank", "val").agg(F.sum("n").alias("n")))
        self.turn += 1


def _how(exact: int) -> Column:
    return F.when(F.col("rank") == exact, "exact").when(F.col("rank").isNotNull(), "near").alias("how")


def turns(df: DataFrame, order: str, n: int = TURNS) -> list[DataFrame]:
    """``df`` in ``n`` stretches of ``order``: the ends are a few numbers, not rows."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None:
        return []
    edges = sorted({lo + (hi - lo + 1) * k // n for k in range(n)} | {hi + 1})
    return [df.where((F.col(order) >= a) & (F.col(order) < b)) for a, b in zip(edges, edges[1:], strict=False)]


def found(log: DataFrame, tasks: DataFrame, n: int = TURNS) -> DataFrame:
    """p4_found: arrivals known exactly or nearly; the log is replayed in turns of whole batches, the tasks in turns of their order."""
    spark = log.sparkSession

    def replay(kind: str, rows: DataFrame, order: str, take: Callable) -> list[DataFrame]:
        history = History(spark)
        return [take(history, batch).withColumn("kind", F.lit(kind)) for batch in turns(rows, order, n)]

    # The two histories know nothing of each other.
    assets, files = together(lambda: replay("asset", log, "batch_id" if "batch_id" in log.columns else "log_seq", History.accept_assets), lambda: replay("task", tasks, "task_seq", History.accept_tasks))
    if not assets + files:
        return spark.createDataFrame([], "kind string, rec_id long, item_ix int, how string")
    whole = reduce(DataFrame.unionByName, assets + files)
    return whole.where("how is not null").select("kind", F.col("rec_id").cast("long").alias("rec_id"), F.col("item_ix").cast("int").alias("item_ix"), "how")
