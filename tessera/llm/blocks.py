"""Blocks: a few megabytes of rows packed into one row, so that numpy works on many documents at once
and a later round can meet the same documents again without shuffling rows one by one."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import materialize

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 2000


def pack(df: DataFrame, label: str, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A stored table (block_id, n_rows, body): body holds rows of df, about block_bytes of them (a longer row is a block of its own). No shuffle."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        waiting, rows, size = [], 0, 0

        def flush():
            nonlocal waiting, rows, size, n
            out = pa.RecordBatch.from_pydict({"block_id": pa.array([(part << 32) | n]), "n_rows": pa.array([rows], pa.int32()), "body": pa.array([dump(pa.Table.from_batches(waiting))], pa.binary())})
            waiting, rows, size, n = [], 0, 0, n + 1
            return out

        for batch in batches:
            k = 0
            while k < batch.num_rows:
                take = min(64, batch.num_rows - k, block_rows - rows)
                piece = batch.slice(k, take)
                own = piece.nbytes
                if own > block_bytes and take > 1:
                    piece, take = batch.slice(k, 1), 1
                    own = piece.nbytes
                if rows and size + own > block_bytes:
                    yield flush()
                waiting.append(piece)
                rows, size, k = rows + take, size + own, k + take
                if rows >= block_rows:
                    yield flush()
        if rows:
            yield flush()

    return materialize(df.mapInArrow(run, "block_id long, n_rows int, body binary"), label)


def dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def load(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def bucket_count(blocks: DataFrame, per_bucket: int = 8) -> int:
    """Enough reducers' buckets that each holds the entries of about per_bucket blocks, at any size of the input."""
    return max(8, blocks.count() // per_bucket)
