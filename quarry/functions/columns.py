"""Small helpers on Column expressions and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of texts that a task holds as Python objects at a time.
SLICE_BYTES = 1 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES, so that Python objects are made of one slice at a time; a larger row is a slice of its own."""
    for batch in batches:
        start, size = 0, max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        while start < batch.num_rows:
            yield batch.slice(start, size)
            start += size


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
