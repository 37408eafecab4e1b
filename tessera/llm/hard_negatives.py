"""Hard negatives by product quantisation with stored residual norms.

Vectors are cut into slices of ``SLICE`` components; each slice has a codebook, learned on a bounded sample, and every row is indexed by its nearest codewords and, for each slice, the norm of
what the codeword leaves over. An anchor's products with all codewords make a lookup table; the sum of a row's entries is its score but for the residuals, which can
add or take no more than the sum of the products of norms (Cauchy-Schwarz, slice by slice). Rows whose limits rule them out are filtered, all others get their exact integer score.

Positives: a row stays while its upper limit reaches the best lower limits or exact scores so far. Negatives: every positive opens a window of scores; rows that are surely inside it set the bar by
their lower limits, and all rows that may be inside it and reach the bar are rescored, so each window is complete.

Anchors are taken in blocks of ``BLOCK``; a block is broadcast and every task streams its share of the index past it, so a block is one scan and broadcasts have a fixed size. A task gives at most k rows for each
anchor, or window. The work grows with anchors times rows, as asked; memory holds ``_STEP`` rows times ``_SIDE`` anchors. The index is stored once for each length of vectors.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part, nor are vectors of another length than the anchor's its positives or
negatives. Rows that share an id are candidates each, but not for anchors of that id; repeated anchor rows count once, anchors of one id and different vectors
or labels are each an anchor. Equal scores: the smaller id first. Positives of no score above zero open windows with nothing above them: a negative score's window is empty. An empty table gives an empty one. Extra columns are
ignored. Scores beyond what doubles add up exactly are worked out in whole numbers, unfiltered; scores beyond 64 bits are ranked exactly and given as the nearest 64-bit number.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .impact_topk import quantise

SLICE = 2
WORDS = 256
SAMPLE = 4096
BLOCK = 4096
_STEP, _SIDE, _ROUNDS = 2048, 256, 6
_EXACT = float(2**53)


def _sliced(x: np.ndarray) -> np.ndarray:
    """Rows of vectors as (slice, row, component)."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % SLICE)))
    return np.ascontiguousarray(x.reshape(len(x), -1, SLICE).transpose(1, 0, 2))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (0.5 * (words**2).sum(axis=1)[None, :] - x @ words.T).argmin(axis=1)


def learn(sample: np.ndarray) -> np.ndarray:
    """Codebooks (slice, word, component) of the sample, by k-means from evenly spread rows."""
    books = []
    for x in _sliced(sample):
        x = x[np.lexsort(x.T[::-1])]
        words = x[np.linspace(0, len(x) - 1, WORDS).astype(int)].copy()
        for _ in range(_ROUNDS):
            near = _nearest(x, words)
            count = np.bincount(near, minlength=WORDS)
            total = np.stack([np.bincount(near, x[:, i], WORDS) for i in range(SLICE)], axis=1)
            words[count > 0] = total[count > 0] / count[count > 0, None]
        books.append(words)
    return np.array(books)


def encode(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slice) codewords, and upper limits of the norms of what they leave over."""
    codes = np.zeros((len(vectors), len(books)), np.uint8)
    norms = np.zeros((len(vectors), len(books)), np.float32)
    for m, (x, words) in enumerate(zip(_sliced(vectors), books, strict=True)):
        with np.errstate(over="ignore", invalid="ignore"):
            codes[:, m] = _nearest(x, words)
            left = np.sqrt(((x - words[codes[:, m]]) ** 2).sum(axis=1)) * (1 + 1e-12)
            norms[:, m] = np.nextafter(left.astype(np.float32), np.float32(np.inf))
    return codes, norms


class Anchors:
    """Some anchors with their lookup tables."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        slices = _sliced(vectors)
        self.table = np.matmul(books, slices.transpose(0, 2, 1))  # slice, word, anchor
        self.norms = np.sqrt((slices**2).sum(axis=2)) * (1 + 1e-12)  # slice, anchor
        self.slack = (np.abs(self.table).max(axis=1).sum(axis=0) + 1) * (len(books) + 4) * 2.0**-50  # what rounding can do to a sum of entries

    def limits(self, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) lower and upper limits of the exact score."""
        score = self.table[0][codes[:, 0]]
        for m in range(1, codes.shape[1]):
            score += self.table[m][codes[:, m]]
        error = norms.astype(np.float64) @ self.norms * (1 + 1e-9) + self.slack
        return score - error, score + error


def spell(score: int) -> bytes:
    """A whole number as bytes whose order is the numbers'."""
    body = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    size = len(body).to_bytes(2, "big")
    return b"\x01" + size + body if score >= 0 else b"\x00" + bytes(255 - b for b in size + body)


def value(spelled: bytes) -> int:
    return int.from_bytes(spelled[3:], "big") if spelled[0] else -int.from_bytes(bytes(255 - b for b in spelled[3:]), "big")


def _best(group: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: by score, then by the smaller id."""
    order = np.lexsort((row, -score, group))
    g = group[order]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < k]


def _scores(vectors: np.ndarray, anchors: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows))
    for at in range(0, len(rows), 8192):
        out[at : at + 8192] = np.einsum("ij,ij->i", vectors[rows[at : at + 8192]], anchors[columns[at : at + 8192]])
    return out


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _task(batches, block: dict, books: np.ndarray, k: int, windows: int):
    """Rows (window, id, spelled score) of the task's k best for each window. windows: 0 for positives, a window for each anchor, else the number of windows of an anchor, block["low"] and block["high"]."""
    ids, labels, vectors = block["id"], block["label"], block["vector"]
    n, per = len(ids), max(1, windows)
    held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in range(0, n, _SIDE)]  # window, score, id
    bars = np.full((n, per), -np.inf) if not windows else block["low"].copy()
    highs = np.full((n, per), np.inf) if not windows else block["high"]
    top = np.abs(vectors).max(axis=1) if n else np.zeros(0)
    schema = pa.schema([("window", pa.int64()), ("id", pa.int64()), ("exact", pa.binary())])

    def made(window, row, score):
        return pa.RecordBatch.from_arrays([pa.array(window, pa.int64()), pa.array(row, pa.int64()), pa.array([spell(int(s)) for s in score], pa.binary())], schema=schema)

    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            part = batch.slice(at, _STEP)
            row, label, body = np.asarray(part.column("id")), np.asarray(part.column("label")), _matrix(part.column("vector"))
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(row), -1)
            norms = np.frombuffer(b"".join(part.column("norms").to_pylist()), np.float32).reshape(len(row), -1)
            size = np.abs(body).max(axis=1)
            for s, lo in enumerate(range(0, n, _SIDE)):
                side = slice(lo, min(n, lo + _SIDE))
                limit = _EXACT / (max(1.0, float(top[side].max())) * body.shape[1])
                plain = size < limit if float(top[side].max()) < _EXACT else np.zeros(len(row), bool)
                if not plain.all():
                    yield from _wide(made, block, side, row[~plain], label[~plain], body[~plain], k, windows)
                if not plain.any():
                    continue
                r, b = row[plain], body[plain]
                anchors = Anchors(ids[side], labels[side], vectors[side], books)
                low, up = anchors.limits(codes[plain], norms[plain])
                fits = ((label[plain][:, None] == anchors.labels[None, :]) != bool(windows)) & (r[:, None] != anchors.ids[None, :])
                wanted = np.zeros(fits.shape, bool)
                for w in range(per):
                    high = highs[side, w]
                    bar = bars[side, w]
                    if len(r) >= k:
                        sure = np.where(fits & (up <= high), low, -np.inf)
                        bar = np.maximum(bar, np.partition(sure, -k, axis=0)[-k])
                    wanted |= (low <= high) & (up >= bar)
                at_row, at_anchor = np.nonzero(wanted & fits)
                score = _scores(b, anchors.vectors, at_row, at_anchor)
                window, kept_score, kept_id = held[s]
                for w in range(per):
                    ok = (score <= highs[side, w][at_anchor]) & (score >= bars[side, w][at_anchor])
                    window = np.concatenate([window, (lo + at_anchor[ok]) * per + w])
                    kept_score, kept_id = np.concatenate([kept_score, score[ok]]), np.concatenate([kept_id, r[at_row[ok]]])
                best = _best(window, kept_score, kept_id, k)
                window, kept_score, kept_id = held[s] = window[best], kept_score[best], kept_id[best]
                full = np.flatnonzero(np.bincount(window - lo * per, minlength=(side.stop - lo) * per) == k)
                if len(full):  # the bar of a full window is its last score
                    lasts = np.flatnonzero(np.diff(window, append=-1))
                    last = dict(zip((window[lasts] - lo * per).tolist(), kept_score[lasts].tolist(), strict=True))
                    for f in full.tolist():
                        bars[lo + f // per, f % per] = max(bars[lo + f // per, f % per], last[f])
    for window, score, row in held:
        yield made(window, row, score)


def _wide(made, block: dict, side: slice, row, label, body, k: int, windows: int):
    """The same for rows or anchors beyond what doubles add up: plain whole numbers, k best of each window."""
    numbers = [[int(x) for x in b] for b in body]
    for a in range(side.start, side.stop):
        values = [int(x) for x in block["vector"][a]]
        mine = [i for i in range(len(row)) if (label[i] == block["label"][a]) != bool(windows) and row[i] != block["id"][a]]
        scores = {i: sum(x * y for x, y in zip(numbers[i], values, strict=True)) for i in mine}
        for w in range(max(1, windows)):
            ok = [i for i in mine if not windows or block["least"][a][w] <= scores[i] <= block["most"][a][w]]
            ok = sorted(ok, key=lambda i: (-scores[i], row[i]))[:k]
            yield made([a * max(1, windows) + w] * len(ok), [int(row[i]) for i in ok], [scores[i] for i in ok])


def _clipped(numbers: list[int]) -> list[int]:
    return [min(max(x, -(2**63)), 2**63 - 1) for x in numbers]


def _near(x: int, up: bool) -> float:
    """A double not above (or below) a whole number."""
    if abs(x) >= 2**1023:
        return (np.inf if up else -2.0**1023) if x > 0 else (-(2.0**1023) if up else -np.inf)
    y = float(x)
    return float(np.nextafter(y, np.inf if up else -np.inf)) if (y < x if up else y > x) else y


def index(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (id, label, vector) with codewords and residual norms."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                codes, norms = encode(_matrix(part.column("vector")), books)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([x.tobytes() for x in norms], pa.binary())], names=[*part.schema.names, "codes", "norms"])

    return rows.mapInArrow(run, "id long, label long, vector array<double>, codes binary, norms binary")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's best rows of its label the best rows of other labels whose score is from least to most hundredths of the positive's."""
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantise(F.col(vector_col), scale).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    base = materialize(base.where("id is not null and label is not null and vector is not null"), "negatives-rows")
    found = []
    for (width,) in base.where("asks").select(F.size("vector")).distinct().collect():  # lengths of vectors: one, usually
        own = base.where(F.size("vector") == width)
        some = own.select("vector").sort(F.xxhash64("id", "vector")).limit(max(WORDS, min(sample, 2**21 // width))).collect()
        with np.errstate(over="ignore", invalid="ignore"):
            books = learn(np.nan_to_num(np.array([r[0] for r in some], float)))
        books = np.nan_to_num(books, posinf=0.0, neginf=0.0)
        indexed = materialize(index(own.select("id", "label", "vector"), books), "negatives-index")
        shared_books = spark.sparkContext.broadcast(books)
        asked = own.where("asks").select("id", "label", "vector").distinct()
        blocks = max(1, -(-asked.count() // block))
        asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks).cast("long"))), "negatives-anchors")
        for number in range(blocks):
            anchors = asked.where(F.col("block") == number).sort("id", "label", "vector").collect()  # about a block
            if anchors:
                found.append(_mined(spark, indexed, shared_books, anchors, positives, negatives, least, most))
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kinds)


def _mined(spark, indexed: DataFrame, books, anchors: list, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    shape = {"id": np.array([a["id"] for a in anchors], np.int64), "label": np.array([a["label"] for a in anchors], np.int64), "vector": np.array([a["vector"] for a in anchors], float)}

    def best(block: dict, k: int, windows: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            yield from _task(batches, shared.value, books.value, k, windows)

        order = Window.partitionBy("window").orderBy(F.desc("exact"), "id")
        hits = indexed.mapInArrow(run, "window long, id long, exact binary")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    pairs = best(shape, positives, 0).collect()  # positives times a block
    own: list[list[tuple[int, int]]] = [[] for _ in anchors]
    for r in sorted(pairs, key=lambda r: (r["window"], r["rank"])):
        own[r["window"]].append((r["id"], value(bytes(r["exact"]))))
    floor = lambda s: (-(-least * s // 100), most * s // 100)  # noqa: E731  whole scores from .. to
    bounds = [[floor(s) for _, s in o] + [(1, 0)] * (positives - len(o)) for o in own]
    block = shape | {
        "low": np.array([[_near(a, False) for a, _ in b] for b in bounds]), "high": np.array([[_near(z, True) for _, z in b] for b in bounds]),
        "least": [[a for a, _ in b] for b in bounds], "most": [[z for _, z in b] for b in bounds],
    }
    hits = materialize(best(block, negatives, positives), "negatives-found")
    named = [(a * positives + w, int(shape["id"][a]), i, *_clipped([s])) for a, o in enumerate(own) for w, (i, s) in enumerate(o)]
    names = spark.createDataFrame(named, "window long, anchor_id long, positive_id long, positive_score long")

    @F.arrow_udf("long")
    def number(exact: pa.Array) -> pa.Array:
        return pa.array(_clipped([value(x) for x in exact.to_pylist()]), pa.int64())

    return hits.join(F.broadcast(names), "window").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", number("exact").alias("negative_score"))
