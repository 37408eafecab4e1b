"""Best-fit packing into sequences of several permitted lengths.

A document's length is its number of words and one end; those longer than the largest length are cut into pieces of
that length and a rest. Each task packs the pieces of its own documents, ``window`` at a time so that memory is bounded,
longest first. A piece goes where the least room is left that it fits into, in an open bin of any size. If it fits
nowhere, a bin is opened, and the permitted sizes compete: each that holds the piece is filled in thought with the longest pieces that fit, of those still to be packed that
no open bin counts on, and the one wins whose contents cost least for each token: the smallest permitted length that holds them and a fixed
``overhead``. The bin then counts on these pieces. At the end, every bin shrinks to the
smallest permitted length that holds its contents. No shuffle, so no group of documents can be too large; which documents share a bin depends on how Spark deals rows.

Defined results: null, empty and blank texts have length 1. Rows with the same id are packed each. Pieces of equal length go by
their order in the task, sizes of equal cost by size. A very long text makes as many pieces as it needs. Extra columns, of any name, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SIZES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 16
WINDOW = 50_000


def open_size(length: int, free: list[int], there: int, sizes: tuple[int, ...], overhead: int) -> tuple[int, list[tuple[int, int]]]:
    """The size whose contents cost least for each token, and the contents: (length, number). free: how many pieces of each length no bin counts on; bit n of there: some have length n."""
    best = None
    for s in sizes:
        if s < length:
            continue
        room, open_, inside = s - length, there, []
        while room and (n := (open_ & ((2 << room) - 1)).bit_length() - 1) > 0:
            inside.append((n, min(free[n], room // n)))
            room -= n * inside[-1][1]
            open_ ^= 1 << n
        used = s - room
        cost = (min(x for x in sizes if x >= used) + overhead) / used
        if best is None or cost < best[0]:
            best = (cost, s, inside)
    return best[1:]


def pack_lengths(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """For each length (the largest size at most): its bin and its offset there; and the sizes of the bins."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # bins by the room they have left
    there = 0  # bit r: some bin has room r
    where, offset, opened, used = [0] * len(lengths), [0] * len(lengths), [], []
    free, counted = [0] * (sizes[-1] + 1), [0] * (sizes[-1] + 1)
    for n in lengths:
        free[n] += 1
    waiting = sum(1 << n for n, c in enumerate(free) if c)  # lengths with free pieces
    for i in order:
        n = lengths[i]
        fits = there >> n
        if counted[n] and (fits or not free[n]):
            counted[n] -= 1
        else:
            free[n] -= 1
            waiting ^= (not free[n]) << n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                there ^= 1 << r
        else:
            b = len(opened)
            r, inside = open_size(n, free, waiting, sizes, overhead)
            opened.append(r)
            used.append(0)
            for k, times in inside:
                free[k] -= times
                counted[k] += times
                waiting ^= (not free[k]) << k
        where[i], offset[i] = b, used[b]
        used[b] += n
        if r > n:
            room[r - n].append(b)
            there |= 1 << (r - n)
    return where, offset, [min(s for s in sizes if s >= u) for u in used]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, window: int = WINDOW) -> DataFrame:
    """A row for each piece: id, piece, first_token, n_tokens, bin_id, bin_size, bin_offset."""
    sizes = tuple(sorted(sizes))
    top = sizes[-1]

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        firsts: list[int] = []
        pieces: list[int] = []

        def settle():
            nonlocal made
            where, offset, bins = pack_lengths(lengths, sizes, overhead)
            out = pa.RecordBatch.from_pydict({
                id_col: pa.array(ids, pa.int64()), "piece": pa.array(pieces, pa.int32()), "first_token": pa.array(firsts, pa.int64()), "n_tokens": pa.array(lengths, pa.int32()),
                "bin_id": pa.array(np.array(where, np.int64) + ((part << 32) + made)), "bin_size": pa.array([bins[b] for b in where], pa.int32()), "bin_offset": pa.array(offset, pa.int32()),
            })
            made += len(bins)
            for x in (ids, lengths, firsts, pieces):
                x.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast("binary").to_pylist(), strict=True):
                n = (len(text.split()) if text is not None else 0) + 1
                cuts = [top] * (n // top) + [n % top] * (n % top > 0)
                for k, (size, stop) in enumerate(zip(cuts, accumulate(cuts), strict=True)):
                    ids.append(i)
                    pieces.append(k)
                    firsts.append(stop - size)
                    lengths.append(size)
                    if len(ids) >= window:
                        yield settle()
        if ids:
            yield settle()

    schema = f"{id_col} long, piece int, first_token long, n_tokens int, bin_id long, bin_size int, bin_offset int"
    return docs.selectExpr(f"cast({id_col} as long) {id_col}", text_col).mapInArrow(run, schema)
