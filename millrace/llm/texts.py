"""Running a function of many texts inside Spark, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.sources.tables import spread

#: Rows and characters that are decoded to Python objects at a time. This bounds a worker's memory; it leaves no row out.
SLICE_ROWS = 512
SLICE_CHARS = 4_000_000


def slices(batch: pa.RecordBatch, text_at: int, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> Iterator[tuple[list, ...]]:
    """The batch's columns as lists, a few rows at a time; a very long text comes in a slice of few rows."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_pylist()
    start = 0
    while start < batch.num_rows:
        end, held = start, 0
        while end < batch.num_rows and end - start < rows and (held == 0 or held + lengths[end] <= chars):
            held += lengths[end]
            end += 1
        part = batch.slice(start, end - start)
        yield tuple(part.column(k).to_pylist() for k in range(batch.num_columns))
        start = end


def map_texts(df: DataFrame, columns: list[str], text: str, out: T.StructType, make: Callable[[], Callable[..., list[list]]], rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> DataFrame:
    """``columns`` of ``df`` through a Python function, without a shuffle of a table that is spread already.

    ``make()`` is called once in each task and returns a function from the
    columns' lists to lists (or Arrow arrays) of ``out``'s columns. Only
    ``columns`` reach Python, whatever else the table holds or however its other
    columns are named.
    """
    schema = to_arrow_schema(out)
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  (pa.compute is a module of its own)

        act = make()
        for batch in batches:
            for lists in slices(batch, at, rows, chars):
                made = act(*lists)
                if len(made[0]):
                    yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, schema)], schema=schema)

    return spread(df.select(*[F.col(f"`{c}`") for c in columns])).mapInArrow(run, out)
