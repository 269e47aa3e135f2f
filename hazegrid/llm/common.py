"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.session import materialize

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, lost executors cost nothing."""
    return materialize(df, name)


#: Rows and array elements (8 to 40 bytes each) up to which a side of a join is broadcast.
BROADCAST_ITEMS = 1_000_000


def small(df: DataFrame, items: str) -> DataFrame:
    """Broadcast a staged table with few elements in its array; a larger one is joined by a shuffle."""
    n = df.agg(F.sum(F.size(items) + 1)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_ITEMS else df


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind), True)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose tasks give unused memory back when they end.

    A Python worker serves many tasks, of different operators too; what one of them has
    freed would otherwise stay with the worker.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return df.mapInArrow(tidied, schema)


def add_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Sequence[list]]],
    fields: Sequence[tuple[str, str]],
) -> DataFrame:
    """Append columns made from each Arrow batch; a column of that name is replaced.

    ``make`` runs once in each task and returns the function that maps a batch to
    one list of values for each of ``fields``, so tables built for the work live
    as long as the task.
    """
    added = [field(*f) for f in fields]
    names = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + added)
    keep_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        per_batch = make()
        for batch in batches:
            for part in pieces(batch):
                made = per_batch(part)
                columns = [part.column(part.schema.get_field_index(n)) for n in keep_names]
                columns += [
                    v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, target.field(f.name).type)
                    for f, v in zip(added, made, strict=True)
                ]
                columns = [
                    c if c.type == target.field(i).type else c.cast(target.field(i).type)
                    for i, c in enumerate(columns)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return map_arrow(df, run, schema)


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in runs of few rows, so that what a task holds does not follow the batch size."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
