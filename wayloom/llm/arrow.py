"""Add columns to a DataFrame by a function over its Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is free, but still held by the allocators, back to the system.

    Python workers are used again for later tasks; without this every idle one keeps most of what its
    largest batch took, beside those at work.
    """
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over a stream of batches, with memory released after each of them and at the end."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                release()

        yield from run(read())
        release()

    return released


def lean_group(run: Callable[[pa.Table], pa.Table]):
    """``run`` over one group, with memory released after it."""

    def released(t: pa.Table) -> pa.Table:
        out = run(t)
        release()
        return out

    return released


def with_columns(
    df: DataFrame, fields: str, fn: Callable[[pa.RecordBatch], list], drop: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` with the columns named by the DDL ``fields``, which ``fn`` makes for each batch.

    Columns of ``df`` with these names are replaced; those in ``drop`` are read by ``fn`` but not returned.
    No shuffle; a lost task is simply run again.
    """
    new = T.StructType.fromDDL(fields)
    names = {f.name.lower() for f in new}
    df = df.drop(*[c for c in df.columns if c.lower() in names])
    kept = [f.name for f in df.schema if f.name not in drop]
    schema = T.StructType([df.schema[c] for c in kept] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *fn(b)], names=[f.name for f in schema])

    return df.mapInArrow(lean(run), schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
