"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Candidates are dealt into cells of bounded size. A cell's index has a posting for each component that isn't zero: the row, the dimension and the value. Postings are
kept in segments of equal quantised impact, the magnitude's power of two, and by row inside a segment. Queries take the segments in
descending impact and add the exact contributions of each posting to their accumulators. What isn't taken yet is smaller
than the next segment's top, so the sum of the query's magnitudes over the dimensions that a row still lacks, times that
top, limits what the row can gain or lose. A query stops only when these limits prove all rows but a
few out of its k best; it takes no part in later segments, and those few are rescored exactly. Where nothing is proved, all segments are taken.

Queries are dealt into blocks of bounded size, too; each block meets each cell, k rows come back for each query and
cell, and the k best of those are kept. Nothing is broadcast; with more data there are more cells and blocks.

Memory: a task holds a cell's vectors and postings and the accumulators of a few queries; very long vectors make the cell larger, in proportion.

Defined results: vectors that are null or empty, hold null or non-finite components, or have a null id take no part, nor
do candidates of another length than the query's. Rows that share an id are candidates each, but not for queries of
that id (a row isn't its own neighbour); repeated query rows count once. Equal scores: the smaller id first. An
empty table gives an empty table. Scores beyond 64 bits are ranked exactly and given as the nearest 64-bit number; a component that
overflows a double when it is scaled counts as infinite. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 8192
BLOCK_ROWS = 2048
_STEP = 128  # queries whose accumulators are held at once
_ROWS = 64  # rows whose postings are taken at once
_EXACT = float(2**53)


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as doubles with integer values; null for a vector that takes no part."""
    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < F.lit(float(2**52)), F.floor(y).cast("double")).otherwise(y)  # larger doubles have no fraction

    wide = F.transform(vector, whole)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(F.lit(float(scale)) * x.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)), wide)


class Index:
    """Posting segments of a cell, by descending impact: (dimensions, values, rows, where each row begins)."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        row, dimension = np.nonzero(vectors)  # by row, then dimension
        value = vectors[row, dimension]
        impact = np.frexp(np.abs(value))[1]  # magnitudes from 2 ** (impact - 1) to below 2 ** impact
        order = np.argsort(-impact, kind="stable")
        row, dimension, value, impact = row[order], dimension[order], value[order], impact[order]
        self.segments, self.tops = [], []
        cuts = np.append(np.flatnonzero(np.diff(impact, prepend=-1)), len(impact))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            begin = np.flatnonzero(np.diff(row[lo:hi], prepend=-1))
            self.segments.append((dimension[lo:hi], value[lo:hi, None], row[lo:hi][begin], np.append(begin, hi - lo)))
            self.tops.append(float(2 ** int(impact[lo])))

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows that can be among its k best, with exact scores. own[q, row]: rows that are no candidates."""
        asked = np.arange(len(queries))
        weight, own = queries.T, own.T
        score = np.zeros((len(self.vectors), len(queries)))
        lacks = np.broadcast_to(np.abs(queries).sum(axis=1), score.shape).copy()
        enough, k = max(4 * k, len(self.vectors) // 64), min(k, len(self.vectors))
        found: list = [None] * len(queries)

        def settle(done: np.ndarray, possible: np.ndarray) -> None:
            for q in np.flatnonzero(done):
                at = np.flatnonzero(possible[:, q])
                found[asked[q]] = (at, self.vectors[at] @ queries[asked[q]])

        for s, (dimension, value, row, begin) in enumerate(self.segments):
            for at in range(0, len(row), _ROWS):
                rows = row[at : at + _ROWS]
                cuts = begin[at : at + len(rows)]
                part = slice(begin[at], begin[at + len(rows)])
                w = weight[dimension[part]]
                score[rows] += np.add.reduceat(w * value[part], cuts - cuts[0])
                lacks[rows] -= np.add.reduceat(np.abs(w, out=w), cuts - cuts[0])
            if s + 1 == len(self.segments):
                break
            slack = self.tops[s + 1] * lacks
            low = np.where(own, -np.inf, score - slack)
            bar = np.partition(low, -k, axis=0)[-k]
            possible = ~own & (score + slack >= bar)
            done = possible.sum(axis=0) <= enough
            if done.any():
                settle(done, possible)
                asked, weight, own, score, lacks = asked[~done], weight[:, ~done], own[:, ~done], score[:, ~done], lacks[:, ~done]
                if not len(asked):
                    return found
        low = np.where(own, -np.inf, score)
        settle(np.ones(len(asked), bool), ~own & (low >= np.partition(low, -k, axis=0)[-k]))
        return found


def _exact(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def search(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that is_query names."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), quantise(F.col(vector_col), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and vector is not null")
    counted = base.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    cells, blocks = max(1, -(-counted.n // CELL_ROWS)), max(1, -(-counted.q // BLOCK_ROWS))
    width = F.size("vector")
    candidates = base.select("id", "vector", width.alias("width"), F.pmod(F.xxhash64("id", "vector"), F.lit(cells).cast("long")).alias("cell")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = base.where("asks").select("id", "vector", width.alias("width")).distinct().withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    key = ["width", "cell", "block"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        query_id, vec_id, score, size, digits = [], [], [], [], []
        if left.num_rows and right.num_rows:
            own_ids, own, asked_ids, asked = np.asarray(left.column("id")), _exact(left), np.asarray(right.column("id")), _exact(right)
            own_top, asked_top = np.abs(own).max(axis=1), np.abs(asked).max(axis=1)
            bound = float(math.isqrt(int(_EXACT) // own.shape[1])) if float(own_top.max()) * float(asked_top.max()) * own.shape[1] >= _EXACT else np.inf
            found: list = [[] for _ in asked]
            plain, asks = np.flatnonzero(own_top < bound), np.flatnonzero(asked_top < bound)
            if len(plain) and len(asks):
                index = Index(own[plain])
                for at in range(0, len(asks), _STEP):
                    some = asks[at : at + _STEP]
                    for q, (rows_, s) in zip(some, index.best(asked[some], asked_ids[some][:, None] == own_ids[plain][None, :], k), strict=True):
                        rows_ = plain[rows_]
                        order = np.lexsort((own_ids[rows_], -s))[:k]
                        found[q] = [(int(own_ids[rows_[o]]), int(s[o])) for o in order]
            if bound < np.inf:  # pairs beyond what doubles add up exactly: plain integers, no index
                large = np.flatnonzero(own_top >= bound)
                for q in range(len(asked)):
                    values = [int(x) for x in asked[q]]
                    for r in large if asked_top[q] < bound else range(len(own)):
                        if own_ids[r] != asked_ids[q]:
                            found[q].append((int(own_ids[r]), sum(int(x) * y for x, y in zip(own[r], values, strict=True))))
                    found[q] = sorted(found[q], key=lambda x: (-x[1], x[0]))[:k]
            for q, f in enumerate(found):
                for i, s in f:
                    query_id.append(int(asked_ids[q]))
                    vec_id.append(i)
                    score.append(min(max(s, -(2**63)), 2**63 - 1))
                    size.append(s.bit_length() if s >= 0 else -s.bit_length())
                    digits.append("" if score[-1] == s else f"{s if s > 0 else (1 << s.bit_length()) - 1 + s:0{-(-s.bit_length() // 4)}x}")
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.int64()), "size": pa.array(size, pa.int32()), "digits": pa.array(digits, pa.string())})

    found = candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score long, size int, digits string")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), F.desc("digits"), "vec_id")  # scores beyond 64 bits are told apart by size and digits
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
