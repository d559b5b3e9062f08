"""Stored collections and the text index: built, added to, searched, deleted from and rebuilt as tables of a folder."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from corvane.functions import ids
from corvane.functions import text as T
from corvane.operators import lexical, state
from corvane.session import drop, materialize, spread

POINT = "id string, chunk_id long, asset_id string, dl int"


def collection_name(base: str, dim: int) -> str:
    return f"{base}_{dim}d"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def collections(spark: SparkSession, folder: str, base: str) -> list[str]:
    """The collections of a base name, with or without a dimension; none if the folder is missing."""
    fs, path = _files(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in set(names) if re.fullmatch(re.escape(base) + r"(_\d+d)?", n))


def read_collection(spark: SparkSession, folder: str, name: str, schema: PT.StructType | str) -> DataFrame:
    """A collection; an empty table of its schema if it is missing."""
    fs, path = _files(spark, f"{folder}/{name}")
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if fs.exists(path) else spark.createDataFrame([], schema)


def append_collection(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("append").parquet(f"{folder}/{name}")


class TextIndex:
    """Points and postings of chunks in a folder, each build a run of its own.

    Postings hold counts alone; weights come from the statistics of what is stored when a search runs, so they are never
    stale. They lie with their points, in columns by buckets of the terms, so a build shuffles none of them, and a search
    reads the columns of the terms that are asked for and scores the points in place. A run that failed half-way is
    written again by the next build, since points are listed last; no search sees it before.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def points(self) -> DataFrame:
        """(id, chunk_id, asset_id, dl) of what is stored and not deleted."""
        return self._live(read_collection(self.spark, self.folder, "points", f"{POINT}, run string")).drop("run")

    def _has(self, name: str) -> bool:
        fs, path = _files(self.spark, f"{self.folder}/{name}")
        return fs.exists(path)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, run) that no later deletion has taken out."""
        if not self._has("deleted"):
            return rows
        gone = read_collection(self.spark, self.folder, "deleted", "id string, upto string").groupBy("id").agg(F.max("upto").alias("upto"))
        return rows.join(gone, "id", "left").where("upto is null or run > upto").drop("upto")

    def build(self, chunks: DataFrame, force: bool = False, cap: int | None = None) -> int:
        """Add the chunks (chunk_id, asset_id, page, text, context) that are not stored yet, or all anew with ``force``; how many.

        With ``cap`` only the best chunks of an asset by its title (column asset_title) are taken. Chunks of equal content are
        one point, under the least chunk_id. Deleted points come back if they are built again.
        """
        if force:
            fs, path = _files(self.spark, self.folder)
            fs.delete(path, True)
        if cap is not None:
            kept = lexical.cap_per_asset(chunks.select("chunk_id", "asset_id", "asset_title", "text"), cap).select("chunk_id")
            chunks = chunks.join(kept, "chunk_id", "left_semi")
        rows = spread(chunks).withColumn("id", ids.point_id(F.col("asset_id"), F.col("page"), F.col("text")))
        # Ids decide what is fresh; texts move only if some chunks are not.
        keys = materialize(rows.select("id", "chunk_id"), "index-keys")
        fresh = state.new_points(keys, self.points()).where("chunk_id is not null").groupBy("id", "chunk_id").agg(F.count("*").alias("n"))
        firsts = materialize(fresh.groupBy("id").agg(F.min(F.struct("chunk_id", "n")).alias("f")).select("id", "f.*"), "index-firsts")
        count, most = firsts.agg(F.count("*"), F.max("n")).first()
        if count < keys.count():
            rows = rows.join(firsts.select("id", "chunk_id"), ["id", "chunk_id"], "left_semi")
        if (most or 0) > 1:
            rows = rows.dropDuplicates(["id"])
        docs = rows.select("id", "chunk_id", "asset_id", T.zh_tokens(lexical.index_text(F.col("text"), F.col("context"))).alias("tokens"))
        run = f"{self._next():06d}"
        docs.mapInArrow(_postings(self.buckets), self._stored()).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/postings/run={run}")
        self.spark.read.schema(POINT).parquet(f"{self.folder}/postings/run={run}").write.mode("overwrite").parquet(f"{self.folder}/points/run={run}")
        drop(keys)
        drop(firsts)
        return count

    def _next(self) -> int:
        fs, path = _files(self.spark, f"{self.folder}/points")
        return len(fs.listStatus(path)) if fs.exists(path) else 0

    def _stored(self, buckets: Iterable[int] | None = None) -> str:
        """The columns of the postings: of each bucket its terms in a point, and how often."""
        return ", ".join([POINT, *[f"terms{b} array<string>, tfs{b} array<int>" for b in (range(self.buckets) if buckets is None else buckets)]])

    def _postings(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The postings of complete runs, of some buckets or all; deleted ones are still there."""
        stored = read_collection(self.spark, self.folder, "postings", f"{self._stored(buckets)}, run string")
        return stored.where(F.col("run") < f"{self._next():06d}")

    def idf(self) -> DataFrame:
        """(term, df, idf) of what is stored now."""
        stored = self._live(self._postings())
        terms = stored.select(F.explode(F.flatten(F.array(*[f"terms{b}" for b in range(self.buckets)]))).alias("term"))
        return lexical.idf_table(terms, lexical.corpus_stats(self.points()))

    def search(self, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, id, score, rank) of the queries (query_id, raw); none where nothing is stored."""
        if not self._has("points"):
            return self.spark.createDataFrame([], "query_id long, id string, score double, rank int")
        asked = queries.select("query_id", F.explode(T.zh_tokens(F.col("raw"))).alias("term")).distinct().withColumn("w", F.lit(1.0))
        return lexical.search(asked, self._kept_counts, n, 2).select("query_id", "id", "score", "rank")

    def _kept_counts(self, wanted: Broadcast, size: int) -> DataFrame:
        """(id, dls, terms, tfs) of the live points: their lengths and their counts of the wanted terms, as numbers."""
        buckets = sorted({_bucket(t, self.buckets) for t in wanted.value.to_pylist()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = wanted.value
            for batch in batches:
                keys, tfs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for at in range(3, batch.num_columns, 2):
                    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False))
                    place = pc.fill_null(pc.index_in(batch.column(at).flatten(), value_set=terms, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    keys.append(row[place >= 0] * max(size, 1) + place[place >= 0])
                    tfs.append(batch.column(at + 1).flatten().to_numpy(zero_copy_only=False)[place >= 0])
                key, tf = np.concatenate(keys), np.concatenate(tfs)
                order = np.argsort(key)
                ends = pa.array(np.searchsorted(key[order], np.arange(batch.num_rows + 1) * max(size, 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v[order].astype(np.int32))) for v in (key % max(size, 1), tf)]
                dls = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32)), batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dls, *lists], names=["id", "run", "dls", "terms", "tfs"])

        stored = self._postings(buckets).select("id", "run", "dl", *[f"{c}{b}" for b in buckets for c in ("terms", "tfs")])
        return materialize(self._live(stored.mapInArrow(run, "id string, run string, dls array<int>, terms array<int>, tfs array<int>")).drop("run"), "index-tf")

    def delete(self, assets: DataFrame, dry_run: bool = False) -> DataFrame:
        """(asset_id, points) that the deletion of ``assets`` (asset_id) removes; with ``dry_run`` nothing is changed."""
        hit = materialize(self.points().join(assets.select("asset_id").distinct(), "asset_id", "left_semi").select("asset_id", "id"), "index-deleted")
        if not dry_run:
            append_collection(hit.select("id", F.lit(f"{self._next() - 1:06d}").alias("upto")), self.folder, "deleted")
        return hit.groupBy("asset_id").agg(F.count("*").alias("points"))


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _postings(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, chunk_id, asset_id, tokens) the points with their length and, for each bucket, their distinct terms and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            length = pc.list_value_length(tokens)
            coded = tokens.flatten().dictionary_encode()
            words, size = coded.dictionary, max(len(coded.dictionary), 1)
            row = np.repeat(np.arange(batch.num_rows), length.to_numpy(zero_copy_only=False))
            key, tf = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, word = key // size, key % size
            bucket = np.array([_bucket(w, buckets) for w in words.to_pylist()], np.int64)[word]
            out, names = [*batch.columns[:3], length.cast(pa.int32())], ["id", "chunk_id", "asset_id", "dl"]
            for b in range(buckets):
                at = np.flatnonzero(bucket == b)
                ends = pa.array(np.searchsorted(row[at], np.arange(batch.num_rows + 1)).astype(np.int32))
                out += [pa.ListArray.from_arrays(ends, words.take(pa.array(word[at]))), pa.ListArray.from_arrays(ends, pa.array(tf[at].astype(np.int32)))]
                names += [f"terms{b}", f"tfs{b}"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run
