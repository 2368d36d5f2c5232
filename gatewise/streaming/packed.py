"""Rows in Arrow blobs, so that a keyed stream hands Python a few rows per key and not every row by itself.

A stateful call of Spark builds a Python object per row and a table per key, and answers with a batch per key; for
users of a few dozen logins that costs far more than their history. Rows travel packed instead: a blob holds rows
of one bucket of users as an Arrow stream, with all columns as they were.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes a task gathers before it deals them to buckets.
GATHER_ROWS, GATHER_BYTES = 100_000, 32 << 20
#: Rows of a blob at most.
BLOB_ROWS = 20_000


def blobs(table: pa.Table) -> Iterator[bytes]:
    """``table`` as Arrow streams of at most BLOB_ROWS rows."""
    for start in range(0, table.num_rows, BLOB_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.slice(start, BLOB_ROWS))
        yield sink.getvalue().to_pybytes()


def table_of(packed: Iterable[bytes]) -> pa.Table:
    """The rows of some blobs of one schema."""
    return pa.concat_tables([pa.ipc.open_stream(blob).read_all() for blob in packed]).combine_chunks()


def _dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row per blob: its bucket and the rows without the bucket."""
    table = pa.Table.from_batches(held).sort_by("bucket")
    ends = pc.run_end_encode(table["bucket"].combine_chunks())
    rows, keys, packed = table.drop_columns(["bucket"]).combine_chunks(), [], []
    start = 0
    for bucket, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
        for blob in blobs(rows.slice(start, end - start)):
            keys.append(bucket)
            packed.append(blob)
        start = end
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: rows with an int column ``bucket`` become (bucket, packed)."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GATHER_ROWS or size >= GATHER_BYTES:
            yield _dealt(held)
            held, rows, size = [], 0, 0
    if held:
        yield _dealt(held)


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: the rows of the blobs in the column ``packed``."""
    for batch in batches:
        for blob in batch.column("packed"):
            yield from pa.ipc.open_stream(blob.as_buffer()).read_all().to_batches()
