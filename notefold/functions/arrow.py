"""Arrow-batch plumbing for the few operators Spark's built-in expressions cannot state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def flat_map_batches(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: T.StructType | str) -> DataFrame:
    """Run ``fn(*columns)`` on every Arrow batch; it yields output tuples.

    ``fn`` gets one Python list per input column. Output follows ``schema``.
    An empty partition yields no rows.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = list(fn(*(c.to_pylist() for c in batch.columns)))
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def flat_map_partitions(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterable[tuple]], schema: T.StructType | str, chunk: int = 20_000) -> DataFrame:
    """As :func:`flat_map_batches`, but ``fn`` sees an iterator of batches of one partition."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        rows: list[tuple] = []
        for row in fn([c.to_pylist() for c in b.columns] for b in batches):
            rows.append(row)
            if len(rows) >= chunk:
                yield emit(rows)
                rows = []
        if rows:
            yield emit(rows)

    return df.mapInArrow(run, schema)
