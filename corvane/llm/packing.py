"""Problem 7: filling containers of fixed capacity with documents sized in tokens.

Method: bounded-space online packing. Every partition keeps a fixed number of open windows for each capacity and
places an item where it fits best; when it fits nowhere, the fullest window is emitted and a new one opened. The
windows left open at the end of the partitions are merged, again in bounded groups.

Defined results: an item above the capacity is cut into pieces of exactly the capacity and a rest, and only then.
Items of no tokens (null, empty) take no room and get a container like any other. Null sizes count as 0; null or
non-positive capacities get no containers. Repeated rows are items of their own. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import map_rows
from corvane.session import drop, materialize

OPEN_WINDOWS = 128
MERGE_GROUP = 4096


class Windows:
    """A fixed number of open windows of one capacity, sorted by the room that is left."""

    def __init__(self, capacity: int, limit: int, prefix: str) -> None:
        self.capacity, self.limit, self.prefix = capacity, limit, prefix
        self.open: list[tuple[int, int]] = []
        self.made = 0

    def place(self, size: int) -> tuple[str, str | None]:
        """The window for an item of ``size`` and the window that had to be emitted for it, if any."""
        at = bisect_left(self.open, (size, -1))
        closed = None
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) >= self.limit:
                closed = f"{self.prefix}{self.open.pop(0)[1]}"
            room, number = self.capacity, self.made
            self.made += 1
        insort(self.open, (room - size, number))
        return f"{self.prefix}{number}", closed


def pack(items: DataFrame, capacities: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", open_windows: int = OPEN_WINDOWS, merge_group: int = MERGE_GROUP) -> DataFrame:
    """``(pack_id, container, id_col, piece, piece_tokens)``: one row for each piece of each item and capacity.

    ``capacities`` (pack_id, capacity_tokens) is a small fixed table and becomes a part of the plan.
    """
    plans = sorted((r["pack_id"], r["capacity_tokens"]) for r in capacities.dropDuplicates(["pack_id"]).where("capacity_tokens > 0").collect())
    src = items.select(F.col(id_col).alias("rid"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    kind = src.schema["rid"].dataType.simpleString()

    def run(rows: Iterable[dict]) -> Iterable[tuple]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sets = {p: Windows(c, open_windows, f"{part}-") for p, c in plans}
        for r in rows:
            for p, c in plans:
                full, rest = divmod(r["size"], c)
                if r["size"] <= c:
                    full, rest = 0, r["size"]
                for k in range(full):
                    yield p, f"{part}-f{sets[p].made}", r["rid"], k, c, False
                    sets[p].made += 1
                if rest or not full:
                    window, _ = sets[p].place(rest)
                    yield p, window, r["rid"], full, rest, True

    placed = materialize(map_rows(src, run, f"pack_id int, container string, rid {kind}, piece int, piece_tokens long, shared boolean"), "packed")
    fills = placed.where("shared").groupBy("pack_id", "container").agg(F.sum("piece_tokens").alias("fill"))
    caps = dict(plans)
    fills = materialize(fills, "fills")
    # A window can be merged only if the emptiest one of its capacity would fit.
    least = fills.groupBy("pack_id").agg(F.min("fill").alias("least"))
    limit = F.lit(0).cast("long")
    for p, c in plans:
        limit = F.when(F.col("pack_id") == p, F.lit(c).cast("long")).otherwise(limit)
    loose = fills.join(least, "pack_id").where(F.col("fill") + F.col("least") <= limit).drop("least").withColumnRenamed("container", "part")
    mapping = merge_leftovers(loose, caps, merge_group)
    out = placed.join(mapping, (placed.pack_id == mapping.m_pack) & (placed.container == mapping.part), "left")
    return out.select(placed.pack_id, F.coalesce("target", "container").alias("container"), placed.rid.alias(id_col), "piece", "piece_tokens")


def merge_leftovers(loose: DataFrame, caps: dict[int, int], merge_group: int = MERGE_GROUP) -> DataFrame:
    """``(m_pack, part, target)``: the container that takes the content of each leftover window.

    Leftovers are dealt to groups of at most about ``merge_group``, packed best-fit from the fullest down. Rounds go
    on until one group holds all, or a round saves less than a hundredth; each round runs in parallel.
    """
    step = materialize(loose.select("pack_id", F.col("part"), F.col("part").alias("target"), "fill"), "leftover")
    before, turn = None, 0
    while True:
        level = step.groupBy("pack_id", "target").agg(F.first("fill").alias("fill"))
        n = level.count()
        groups = max(1, -(-n // merge_group))
        if n == 0 or (before is not None and n > 0.99 * before):
            break

        def fit(rows: Iterable[dict]) -> Iterable[tuple]:
            sets: dict[tuple, Windows] = {}
            for r in rows:
                key = (r["pack_id"], r["grp"])
                if key not in sets:
                    sets.clear()
                    sets[key] = Windows(caps[r["pack_id"]], 1 << 40, f"m{r['grp']}-")
                yield r["pack_id"], r["target"], sets[key].place(r["fill"])[0]

        dealt = level.withColumn("grp", F.pmod(F.hash("target"), F.lit(groups))).repartition("pack_id", "grp").sortWithinPartitions("pack_id", "grp", F.desc("fill"), "target")
        moved = map_rows(dealt, fit, "pack_id int, target string, next string")
        named = moved.withColumn("next", F.concat(F.lit(f"r{turn}"), "next"))
        fills = named.join(level, ["pack_id", "target"]).groupBy("pack_id", "next").agg(F.sum("fill").alias("next_fill"))
        last = step
        step = materialize(
            step.select("pack_id", "part", "target").join(named, ["pack_id", "target"]).join(fills, ["pack_id", "next"]).select("pack_id", "part", F.col("next").alias("target"), F.col("next_fill").alias("fill")),
            "leftover",
        )
        turn += 1
        before = n
        drop(last)
        if groups == 1:
            break
    return step.select(F.col("pack_id").alias("m_pack"), "part", "target")

