"""Problem 1: groups of near-duplicate records whose texts differ by small edits, insertions or reordering.

Method: token-group matrix. Records with equal token sets are one record. The others are partitioned into groups of
similar ones; the matrix says which group holds which token; a query's overlap with the union of a group bounds its
similarity with any member, and only groups whose bound reaches the threshold are opened and verified exactly.

The tokens of the stored matrix are the band keys of a record (each a hash of several minima of its shingles): single
shingles are far too common in large corpora to be joined on. The overlap of a record with the union of a group's keys bounds
that with each member, and it decides which groups are opened before any text moves. A pair that reaches the threshold
shares less than ``least_keys`` keys with a probability of under 0.0015 at the threshold itself and of under 0.0001 a
twentieth above it. In an opened group the union of whole shingles bounds once more, |Q and S| <= |Q and U|. Verification
uses the sets of all shingles of whole texts, and opened groups verify every member.

Hot keys: copies collapse first; a bucket meets groups, so records that are alike count once; the groups of one key are
spread over blocks of bounded size; groups above ``GROUP`` members are split, and queries go to each part. Nothing is
dropped or capped.

Defined results: null, empty and short texts (under the least number of tokens) have no class. Ties in leaders take the
least id. Repeated rows of one id count once. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import map_rows
from corvane.llm.graph import components
from corvane.llm.shingles import band_keys, gram_sets, set_signature, shingle_sets
from corvane.session import drop, materialize, spread

#: Members of a part of a group, and groups of a bucket's block, that are held together.
GROUP = 256
BLOCK = 512


@dataclass(frozen=True)
class Likeness:
    """What similarity means: the shingler, the threshold and the shape of the bands."""

    threshold: float = 0.8
    width: int = 5
    least_tokens: int = 0
    grams: bool = False
    bands: int = 64
    rows: int = 4
    least_keys: int = 2

    def sets(self, texts: list[str]) -> list[np.ndarray | None]:
        return gram_sets(texts, self.width) if self.grams else shingle_sets(texts, self.width, self.least_tokens)


CHUNKS = Likeness(threshold=0.6, width=4, least_tokens=20)
TITLES = Likeness(threshold=0.7, width=3, grams=True, bands=128, rows=7, least_keys=1)


def signatures(rows: DataFrame, like: Likeness) -> DataFrame:
    """``(id, n, sig, keys)`` of the rows (id, body) that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 500).columns)
                kept = [(i, s) for i, s in zip(ids, like.sets(texts), strict=True) if s is not None and len(s)]
                keys = np.concatenate([band_keys(s, like.bands, like.rows) for _, s in kept]).view(np.int64) if kept else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in kept], pa.int64()), pa.array([len(s) for _, s in kept], pa.int32()), pa.array([set_signature(s) for _, s in kept], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * like.bands, pa.int32()), pa.array(keys))],
                    names=["id", "n", "sig", "keys"],
                )

    return rows.mapInArrow(run, "id long, n int, sig long, keys array<long>")


def group_matrix(reps: DataFrame, like: Likeness, name: str) -> tuple[DataFrame, DataFrame]:
    """The groups ``(id, g)`` of the records that share a band key with another, and what is opened ``(id, g)``.

    A record joins the least record of the bucket that it shares most keys with, a quarter of all at least; else it is a group of
    its own. The matrix has the union of the keys of each group. A record that shares ``least_keys`` keys with a member shares as
    many with the union, so only groups whose overlap with the record reaches that are opened; of two groups the later
    record asks the earlier group. Buckets hold groups here, never pairs of records.
    """
    flat = reps.select("id", F.explode("keys").alias("key"))
    counted = flat.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("lead")).where("m > 1").select("key", "lead")
    # Keys of two or more rows are few; writing them keeps the next steps from repeating this join.
    shared = materialize(flat.join(counted, "key"), f"{name}-shared")
    near = shared.where("id > lead").groupBy("id", "lead").agg(F.count("*").alias("x")).where(F.col("x") * 4 >= like.bands)
    leader = near.groupBy("id").agg(F.max_by("lead", F.struct("x", -F.col("lead"))).alias("g"))
    group = materialize(shared.select("id").distinct().join(leader, "id", "left").select("id", F.coalesce("g", "id").alias("g")), f"{name}-groups")
    owned = materialize(shared.select("id", "key").join(group, "id"), f"{name}-owned")
    matrix = owned.select("key", "g").distinct()
    # A key of many groups is spread over blocks of them.
    blocks = matrix.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").select("key", "blocks")
    matrix = materialize(matrix.join(blocks, "key").withColumn("blk", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")), f"{name}-matrix")
    asked = owned.withColumnRenamed("g", "own").join(matrix.select("key", "blocks").distinct(), "key")
    asked = asked.select("key", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    met = asked.join(matrix.select("key", "blk", "g"), ["key", "blk"]).where("g < own")
    opens = met.groupBy("id", "g").agg(F.count("*").alias("x")).where(F.col("x") >= like.least_keys)
    opens = materialize(opens.select("id", "g"), f"{name}-opens")
    for table in (shared, owned, matrix):
        drop(table)
    return group, opens


def verified_pairs(records: DataFrame, like: Likeness, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives ``(a, b, similarity)`` and the membership ``(id, rep)`` of all records with shingles.

    ``records`` has one row (id, body) for each id.
    """
    sigs = materialize(signatures(spread(records), like), f"{name}-sigs")
    firsts = sigs.groupBy("sig", "n").agg(F.min("id").alias("rep"))
    members = materialize(sigs.select("id", "sig", "n").join(firsts, ["sig", "n"]).select("id", "rep"), f"{name}-members")
    # Copies leave before their keys are spread; the keys stay in the one table that holds them.
    reps = sigs.join(firsts.select(F.col("rep").alias("id")), "id", "left_semi")
    group, opens = group_matrix(reps, like, name)
    drop(sigs)
    sizes = group.groupBy("g").agg(F.count("*").alias("n"), F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    member = group.join(sizes, "g").select("g", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", F.lit(True).alias("own"), "parts", "n")
    asking = opens.join(sizes, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", F.lit(False).alias("own"))
    # Members of a group in several parts ask the later parts too.
    inner = member.where("part + 1 < parts").select("g", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), "id", F.lit(False).alias("own"))
    # A group of one that nobody opens has nothing to verify.
    alone = member.join(opens.select("g").distinct().withColumn("asked", F.lit(True)), "g", "left").where("n > 1 or asked").select("g", "part", "id", "own")
    matrix = materialize(alone.union(asking).union(inner), f"{name}-open")
    texts = records.join(matrix.select("id").distinct(), "id", "left_semi")
    opened = matrix.join(texts, "id").repartition("g", "part").sortWithinPartitions("g", "part", F.desc("own"), "id")
    found = map_rows(opened.select("g", "part", "own", "id", "body"), lambda rows: _open_groups(rows, like), "a long, b long, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), members


def _open_groups(rows: Iterable[dict], like: Likeness) -> Iterator[tuple]:
    """Members come first within each part of a group; then each query is bounded by the union and verified."""
    here = None
    union: set[int] = set()
    inside: list[tuple[int, frozenset]] = []
    t = like.threshold
    for chunk in _chunks(rows, 256):
        for r, s in zip(chunk, like.sets([r["body"] for r in chunk]), strict=True):
            if (r["g"], r["part"]) != here:
                here, union, inside = (r["g"], r["part"]), set(), []
            own = frozenset(s.tolist())
            if inside:
                most = len(own) if r["own"] else len(own & union)
                if most >= t / (1 + t) * (len(own) + min(len(x) for _, x in inside)) - 1e-9 or r["own"]:
                    for other, theirs in inside:
                        small, large = sorted((len(own), len(theirs)))
                        if small >= t * large - 1e-9:
                            both = len(own & theirs)
                            if both >= t * (small + large - both) - 1e-9 and other != r["id"]:
                                yield min(other, r["id"]), max(other, r["id"]), both / (small + large - both)
            if r["own"]:
                inside.append((r["id"], own))
                union |= own


def _chunks(rows: Iterable[dict], size: int) -> Iterator[list[dict]]:
    chunk: list[dict] = []
    for r in rows:
        chunk.append(r)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records (id_1 < id_2) from pairs of representatives and the membership of copies."""
    one, two = members.toDF("id_1", "a"), members.toDF("id_2", "b")
    across = pairs.select("a", "b").join(one, "a").join(two, "b").select("id_1", "id_2")
    copies = one.join(two.withColumnRenamed("b", "a"), "a").where("id_1 < id_2").select("id_1", "id_2")
    both = across.union(copies)
    return both.select(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2"))


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, class_id, links)``: one row for each record with shingles; links counts other texts and copies."""
    comp = components(pairs.select(F.col("a").alias("id_1"), F.col("b").alias("id_2")))
    size = members.groupBy("rep").agg(F.count("*").alias("copies"))
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(pairs.select(F.col("b"), F.col("a")))
    linked = ends.join(size.toDF("other", "n_other"), "other").groupBy("rep").agg(F.sum("n_other").alias("others"))
    out = members.join(comp.toDF("rep", "component"), "rep", "left").join(size, "rep").join(linked, "rep", "left")
    return out.select("id", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def every_class(ids: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of :func:`classes`, and for each other id one row with its own id as class and no links."""
    rest = ids.distinct().join(found.select(F.col("id").alias("seen")), F.col("id").eqNullSafe(F.col("seen")), "left_anti")
    return found.unionByName(rest.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def chunk_records(chunks: DataFrame) -> DataFrame:
    return chunks.where("text is not null and text <> ''").select(F.col("chunk_id").alias("id"), F.col("text").alias("body"))


def title_records(log: DataFrame) -> DataFrame:
    """The title of each asset's earliest live row, reduced to tokens and single blanks."""
    first = log.where(~F.coalesce("deleted", F.lit(False))).groupBy("asset_id").agg(F.min_by(F.struct("log_seq", "asset_title"), "log_seq").alias("t")).select("t.*")
    plain = F.trim(F.regexp_replace(F.lower("asset_title"), "[^a-z0-9ß-öø-ÿ぀-ヿ一-鿿]+", " "))
    return first.where("asset_title is not null").select(F.col("log_seq").alias("id"), plain.alias("body")).where("body <> ''")


def found(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """p1_found: every pair of similar chunks and of similar titles."""
    kinds = (("chunk", chunk_records(chunks), CHUNKS), ("title", title_records(log), TITLES))
    # One after the other: side by side both would need their disk at once.
    parts = [expand(*verified_pairs(records, like, f"p1-{kind}")).select(F.lit(kind).alias("kind"), "id_1", "id_2") for kind, records, like in kinds]
    return parts[0].unionByName(parts[1])
