"""Embedders as column producers: the offline one, and the shape of real ones."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.engine import Registry
from corvane.session import materialize

DIM = 64
#: Texts are cut to this many characters before they are embedded.
MAX_CHARS = 8192

registry = Registry()


def bucket(term: str, dim: int = DIM) -> int:
    """The place of a term in a hashed vector: the first 32 bits of its MD5."""
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim


def hashed_vectors(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """``(id, vec ARRAY<DOUBLE>)`` of documents (id, tokens): counts of hashed terms, of length 1. No tokens, no vector.

    Terms are counted where their document is, and the counts written once; rows of one id, which are few, are added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
            coded = tokens.flatten().dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            place = np.array([bucket(w, dim) for w in coded.dictionary.to_pylist()], np.int64)
            counts = np.bincount(row[code >= 0] * dim + place[code[code >= 0]], minlength=batch.num_rows * dim).reshape(-1, dim)
            some = np.flatnonzero(counts.any(axis=1))
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * dim).astype(np.int32)), pa.array(counts[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists], names=["id", "n"])

    kind = docs.schema["id"].dataType.simpleString()
    counts = materialize(docs.select("id", "tokens").mapInArrow(run, f"id {kind}, n array<long>"), "hashed")
    again = counts.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("again"))
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("again"))
        sums = counts.join(again, same, "left_semi").groupBy("id").agg(F.array(*[F.sum(F.get("n", i)) for i in range(dim)]).alias("n"))
        counts = materialize(counts.join(again, same, "left_anti").unionByName(sums), "hashed")
    norm = F.sqrt(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x * x))
    return counts.withColumn("norm", norm).select("id", F.transform("n", lambda x: x / F.col("norm")).alias("vec"))


def model_vectors(docs: DataFrame, text_col: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 16) -> DataFrame:
    """All columns and ``vec`` from a model: ``load`` runs once in each worker and returns a function of a list of texts.

    Blank texts get no vector; long ones are cut first.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in texts:
            out: list = [None] * len(part)
            kept = [(i, t[:MAX_CHARS]) for i, t in enumerate(part) if isinstance(t, str) and t.strip()]
            for at in range(0, len(kept), batch):
                some = kept[at : at + batch]
                for (i, _), v in zip(some, encode([t for _, t in some]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return docs.withColumn("vec", embed(text_col))


registry.register("embedder", "hashed", hashed_vectors)
registry.register("embedder", "model", model_vectors)
