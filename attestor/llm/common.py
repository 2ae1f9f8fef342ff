"""Helpers shared by the corpus operators: Arrow batch mapping and small sizing rules."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import Workspace  # noqa: F401

#: Rows handed to a batch function at once. Texts stay on the Arrow side until their slice is due.
SLICE_ROWS = 512
#: Output rows that are Python objects at once.
OUT_ROWS = 8192


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def as_struct(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on after a task, and others need the room."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int | None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows, and of no more than so many bytes of text unless it is one row."""
    if most_bytes is None:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        return
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield batch.slice(at, end - at)
        at = end


def map_columns(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str | T.StructType, slice_rows: int = SLICE_ROWS, slice_bytes: int | None = None) -> DataFrame:
    """Apply a batch function to Arrow slices of ``df``.

    ``make()`` runs once in each task and returns ``fn(*columns)``; the columns are Python lists in the order of
    ``df``; it yields output rows as tuples in the order of ``schema``. Only one slice of rows is turned into
    Python objects at a time, so memory follows the slice and not the partition.
    """
    struct = as_struct(schema)
    names = struct.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = arrow_schema(struct)
        fn = make()
        for batch in batches:
            for part in slices(batch, slice_rows, slice_bytes):
                found = iter(fn(*(c.to_pylist() for c in part.columns)))
                while rows := list(itertools.islice(found, OUT_ROWS)):
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=out_schema.field(k).type) for k, c in enumerate(cols)], names=names)
        fn = None
        release_memory()

    return df.mapInArrow(run, struct)


def filter_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list[bool]]], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The rows of ``df``, with all their columns, for which ``make()`` (once in each task) of their texts is true."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))
        keep = None
        release_memory()

    return df.mapInArrow(run, df.schema)


def replace_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[str | None], str | None]], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``make()`` (once in each task) applied to each text; the other columns stay as they are."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                field = part.schema.field(at)
                texts = pa.array([change(t) for t in part.column(at).to_pylist()], type=field.type)
                yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(part.columns)], schema=part.schema)
        change = None
        release_memory()

    return df.mapInArrow(run, df.schema)


def text_rows(df: DataFrame, id_col: str, text_col: str, null_as: str | None = "") -> DataFrame:
    """(doc_id long, text string) and nothing else, so that columns with clashing names cannot interfere."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(text, F.lit(null_as)) if null_as is not None else text).alias("text"))


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def few_rows(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than it must."""
    return df.limit(most + 1).count() <= most


def broadcast_if_few(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint only where the size was checked; otherwise the join shuffles."""
    return F.broadcast(df) if few_rows(df, most) else df
