"""Small helpers shared by the Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_rows(df: DataFrame, fn: Callable[[Iterable[dict]], Iterable[tuple]], schema: str, flush: int = 2000) -> DataFrame:
    """Run ``fn`` over the rows of each partition and gather its tuples into Arrow batches.

    ``fn`` gets a lazy stream of rows (as dicts) of one partition, so memory is bounded by one batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                names = batch.schema.names
                columns = [c.to_pylist() for c in batch.columns]
                for values in zip(*columns, strict=True):
                    yield dict(zip(names, values, strict=True))

        out: list[tuple] = []
        for row in fn(rows()):
            out.append(row)
            if len(out) >= flush:
                yield _batch(out, target)
                out = []
        if out:
            yield _batch(out, target)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
