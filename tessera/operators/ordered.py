"""Running sums over a whole order, and what is decided by them, without sorting everything in one task.

Rows are dealt into ranges of the order. Each range sums its own rows as they stream by; what the ranges before it hold is
known from one row a range, which the driver adds up. So a run over all rows, or one group that has most of them, is cut
into as many tasks as there are ranges.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import stored


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.or_(pc.fill_null(pc.not_equal(before, after), False), pc.xor(before.is_null(), after.is_null()))
    return np.asarray(differ.to_numpy(zero_copy_only=False), bool)


def _whole(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(pc.fill_null(batch.column(name), 0)).view(np.uint64)


def _scan(within: list[str], sums: list[str], kept: list[str]):
    """For the rows of one range in order: sums inside each group so far, whether the group is the range's first, and whether its last row is met (the range's last row can't know)."""

    def run(batches):
        group, held, first, n = None, None, True, 0
        carry = np.zeros(len(sums), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k) for k in within]
            here = tuple(k[0].as_py() for k in keys)
            new = np.zeros(batch.num_rows, bool)
            new[0] = group is not None and group != here
            for k in keys:
                new[1:] |= _changes(k)
            if held is not None:
                held[-1][-1] = new[0]
                yield emit(*held)
            if new[0]:
                first, carry = False, np.zeros(len(sums), np.uint64)
            starts = np.flatnonzero(new)
            segment = np.cumsum(new) - new[0]
            at = np.append(0, starts[starts > 0])
            totals = []
            for i, name in enumerate(sums):
                value = _whole(batch, name)
                total = np.cumsum(value, dtype=np.uint64)
                base = total[at] - value[at]
                base[:1] -= carry[i]
                totals.append(total - base[segment])
            carry = np.array([t[-1] for t in totals], np.uint64)
            opening = (segment == 0) & first
            first = first and len(at) == 1
            group = tuple(k[-1].as_py() for k in keys)
            held = (batch, totals, opening, np.arange(n, n + batch.num_rows), np.append(new[1:], False))
            n += batch.num_rows
        if held is not None:
            yield emit(*held)

    def emit(batch, totals, opening, n, last):
        columns = {k: batch.column(k) for k in kept}
        columns |= {s: pa.array(t.view(np.int64)) for s, t in zip(sums, totals, strict=True)}
        columns |= {f"_own_{s}": pc.fill_null(batch.column(s), 0) for s in sums}
        return pa.RecordBatch.from_pydict(columns | {"_part": batch.column("_part"), "_n": pa.array(n, pa.int64()), "_open": pa.array(opening), "_last": pa.array(last)})

    return run


def running(df: DataFrame, within: list[str], order: list[Column | str], sums: dict[str, Column], before: dict[str, str] | None = None, last: str | None = None, keep: list[str] | None = None, label: str = "running", upto: int | None = None) -> DataFrame:
    """Adds a column for each of sums: the sum of a whole number over the rows of the same group (within; none: all rows) up to this one, in an order that should be total.

    before names sums without the row itself; last, a column that is true on a group's last row; keep, the columns of df that come along.
    Sums are 64 bits wide and wrap, so they may add hashes up, too; null adds nothing. Columns in within are no nested ones. With upto, ranges that begin beyond that much of the
    first sum aren't read any more (sums that never fall). The ranged rows are stored: their bounds come from a sample, which another run may draw otherwise."""
    kept, names = list(df.columns if keep is None else keep), list(sums)
    by = [F.col(w).asc_nulls_first() for w in within] + [_column(c) for c in order] or [F.lit(0)]
    valued = df.withColumns({n: v.cast("long") for n, v in sums.items()})
    ranged = valued.repartitionByRange(*by).sortWithinPartitions(*by).select(*dict.fromkeys([*kept, *within]), *names, F.spark_partition_id().alias("_part"))
    kind = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    schema = ", ".join([*[f"`{k}` {kind[k]}" for k in dict.fromkeys([*kept, *within])], *[f"`{n}` long" for n in names], *[f"`_own_{n}` long" for n in names], "_part int, _n long, _open boolean, _last boolean"])
    rows = stored(ranged.mapInArrow(_scan(within, names, list(dict.fromkeys([*kept, *within]))), schema), label)
    ends = F.struct(*[F.col(w).alias(f"k{i}") for i, w in enumerate(within)], *[F.col(n).alias(f"s{i}") for i, n in enumerate(names)])
    parts = rows.groupBy("_part").agg(F.min_by(ends, "_n").alias("first"), F.max_by(ends, "_n").alias("final"), F.max("_n").alias("n")).collect()  # one row a range
    parts.sort(key=lambda r: r["_part"])
    width = len(within)
    starts: dict[int, list[int]] = {}
    group, carry = None, [0] * len(names)
    for r in parts:
        goes_on = group == tuple(r["first"][:width])
        starts[r["_part"]] = carry if goes_on else [0] * len(names)
        whole = goes_on and tuple(r["final"][:width]) == group
        group = tuple(r["final"][:width])
        carry = [(c + s if whole else s) & (2**64 - 1) for c, s in zip(starts[r["_part"]], r["final"][width:], strict=True)]
    closes = {a["_part"]: tuple(b["first"][:width]) != tuple(a["final"][:width]) for a, b in pairwise(parts)} | ({parts[-1]["_part"]: True} if parts else {})
    if upto is not None:
        reached = [p for p, s in starts.items() if s[0] <= upto]
        rows = rows.where(F.col("_part") <= (max(reached) if reached else -1))
    tails = {r["_part"]: r["n"] for r in parts}
    before = before or {}

    def settle(batches):
        for batch in batches:
            part, opening = np.asarray(batch.column("_part")), np.asarray(batch.column("_open").to_numpy(zero_copy_only=False), bool)
            known, place = np.unique(part, return_inverse=True)
            offsets = np.array([starts[int(p)] for p in known], object).reshape(len(known), len(names))
            columns = {k: batch.column(k) for k in kept}
            totals = {}
            for i, n in enumerate(names):
                add = np.array([int(x) for x in offsets[:, i]], np.uint64)
                totals[n] = np.asarray(batch.column(n)).view(np.uint64) + np.where(opening, add[place], np.uint64(0))
                columns[n] = pa.array(totals[n].view(np.int64))
            for b, n in before.items():
                columns[b] = pa.array((totals[n] - np.asarray(batch.column(f"_own_{n}")).view(np.uint64)).view(np.int64))
            if last:
                done = np.asarray(batch.column("_last").to_numpy(zero_copy_only=False), bool).copy()
                at_end = np.asarray(batch.column("_n")) == np.array([tails[int(p)] for p in known])[place]
                done |= at_end & np.array([closes[int(p)] for p in known])[place]
                columns[last] = pa.array(done)
            yield pa.RecordBatch.from_pydict(columns)

    out = ", ".join([*[f"`{k}` {kind[k]}" for k in kept], *[f"`{n}` long" for n in [*names, *before]], *([f"`{last}` boolean"] if last else [])])
    return rows.mapInArrow(settle, out)
