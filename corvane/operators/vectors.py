"""Exact vector search in blocks.

A block of queries of bounded size goes to the executors as one matrix; every batch of points is multiplied with it
and a task keeps only its own top k, so what is shuffled is k rows for each query and task, never all scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of one block of queries, which goes out to the executors, and of one matrix of scores there.
QUERY_BYTES, SCORE_BYTES = 16 << 20, 64 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def top_k(points: DataFrame, queries: DataFrame, k: int, parts: int = 0, digits: int = 5) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` points (id, vec) nearest to each query (query_id, vec) by cosine.

    With ``parts`` the vectors are sequences of that many token vectors, and the score is the sum, over the query's
    tokens, of the best dot product with a token of the point. Null vectors are left out; ties go to the lower id.
    """
    asked = queries.where("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), "vec")
    n, dim = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    blocks = max(1, -(-n * dim * 8 // QUERY_BYTES))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        part = _block(points, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), k, parts, digits)
        out = part if out is None else out.union(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best of each row, ties by the lower name: only what reaches the k-th score is sorted."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((names[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(scores.shape[0]))
    kept = np.arange(len(row)) - first[row] < k
    return row[kept], col[kept]


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], queries: int, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """The ``k`` best (row, name, score) of each query as one entry, and the score that others have to reach."""
    row, name, score = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((name, -score, row))
    row, name, score = row[order], name[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    least = np.full(queries, -np.inf)
    least[row[place == k - 1]] = score[place == k - 1]
    return [(row[place < k], name[place < k], score[place < k])], least


def _block(points: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int, parts: int, digits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        q = asked.reshape(len(ids), parts, -1) if parts else unit(asked)
        step = max(1, SCORE_BYTES // (8 * len(ids) * max(1, parts * parts)))
        least, held, size = np.full(len(ids), -np.inf), [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                names, m = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(1))
                if parts:
                    m = m.reshape(len(names), parts, -1)
                    scores = np.einsum("qad,nbd->qnab", q, m).max(axis=3).sum(axis=2)
                else:
                    scores = q @ unit(m).T
                np.round(scores, digits, out=scores)
                if size:
                    row, col = np.nonzero(scores >= least[:, None])
                else:
                    row, col = _best(scores, names, k)
                held.append((row, names[col], scores[row, col]))
                size += len(row)
                if size > 2 * k * len(ids) or len(held) == 1:
                    held, least = _merged(held, len(ids), k)
                    size = len(held[0][0])
        if size:
            row, name, score = _merged(held, len(ids), k)[0][0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(name), pa.array(score)], names=["query_id", "id", "score"])

    return points.where("vec is not null").select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "query_id long, id long, score double")


def above_floor(hits: DataFrame, floor: float) -> DataFrame:
    """Hits that reach the floor; 0 or less switches it off, null counts as 0."""
    return hits if floor <= 0 else hits.where(F.coalesce("score", F.lit(0.0)) >= floor)


def normalized(col: Column) -> Column:
    """A vector by its length, in the JVM; the zero vector stays."""
    wide = col.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def evidence(title: Column, section: Column, body: Column, most: int = 4000) -> Column:
    """Title and section in one line, then the text."""
    head = F.concat_ws(" | ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(section), F.lit("")))
    return F.concat_ws("\n\n", F.nullif(head, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, most))
