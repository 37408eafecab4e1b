"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are split into normalised words alike. The automaton of all items' words holds every run of words of any item; a document is
streamed through it and at each word the longest run that ends there and stands in an item is known. Where it has a window's length, its words are hit, and the automaton's
state names the items. Words that no item has, or not next to each other, can't be part of a run of two, so whole batches are cut down to stretches of known neighbours
by hashes first; the automaton itself goes by the words.

Items are cut into pieces that overlap by a window less a word, and dealt into shards of about ``SHARD_WORDS`` words. A shard's automaton is built on the driver and broadcast:
that bounds its size, whatever the number of items. With one shard documents are read once; with more they are stored once with a number for each row,
every shard is a job that stores what it hits, and these meet again by row.

Defined results: null and empty texts, and such without a word, have no words and are clean; so are items. Items of fewer words than a window are one window. Repeated items and ids
count once in ``items``; items with a null id are matched, but not named. Repeated rows are judged each. Very long texts are streamed whole, in stretches. An empty table of items hits nothing, an empty table
of documents gives an empty one. Of docs' columns those named like a result are replaced, others of any name pass. Words over 64 bytes go by a 256-bit digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, free_names, materialize, mix, text_buffer, word_hashes

OUTPUTS = ["n_words", "n_hit", "longest", "spans", "items"]
SHARD_WORDS = 1 << 19
_PIECE_WORDS = 4096
_STRETCH = 1 << 22  # bytes whose words are held at once
_BITS = 20
_SPANS = "array<struct<start:bigint,stop:bigint>>"

#: What a byte becomes: a separator (any ASCII but digits and letters) a space, A-Z small.
_NORMAL = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
_INSIDE = np.array([b != 32 for b in range(256)])


def _word(raw: bytes) -> bytes:
    return raw if len(raw) <= 64 else hashlib.blake2b(raw, digest_size=32, person=b"long word").digest() + b" "


def item_words(text: str | None) -> list[bytes]:
    return [_word(w) for w in (text or "").encode().translate(_NORMAL).split()]


class Automaton:
    """A generalised suffix automaton over words, with the items of each window."""

    def __init__(self, pieces: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in pieces]
        self.size = max(1, len(self.ids))
        self.step: dict[int, int] = {}  # state * size + word: the next state
        self.link, self.length = [-1], [0]
        self._out: list[list[int]] = [[]]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        del self._out
        self._name(coded)
        self.shortest = min([window, *(len(w) for _, w in coded)])
        self._filters(coded)

    def _add(self, length: int, link: int, out: list[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append(out)
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        """The state of the run that last stands for, followed by w."""
        step, size = self.step, self.size
        known = step.get(last * size + w)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is None:
            new, p = self._add(self.length[last] + 1, 0, []), last
            while p >= 0 and p * size + w not in step:
                step[p * size + w] = new
                self._out[p].append(w)
                p = self.link[p]
            if p < 0:
                return new
            q = step[p * size + w]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
                return new
        else:
            new, p, q = -1, last, known
        clone = self._add(self.length[p] + 1, self.link[q], list(self._out[q]))
        for x in self._out[q]:
            step[clone * size + x] = step[q * size + x]
        while p >= 0 and step.get(p * size + w) == q:
            step[p * size + w] = clone
            p = self.link[p]
        self.link[q] = clone
        if new >= 0:
            self.link[new] = clone
            return new
        return clone

    def _name(self, coded: list[tuple[int | None, list[int]]]) -> None:
        """The state of each state's suffix of a window's length; and the items of windows, by state, and of shorter ones, by state and length."""
        self.windows: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.holder = [-1] * len(order)
        for v in order:
            if self.length[v] >= self.window:
                up = self.link[v]
                self.holder[v] = v if self.length[up] < self.window else self.holder[up]
        for item, words in coded:
            v = 0
            for n, w in enumerate(words, 1):
                v = self.step[v * self.size + w]  # the run from the piece's start: its state is at least so long
                if n >= self.window:
                    self.windows.setdefault(self.holder[v], set()).add(item)
            if len(words) < self.window:
                self.short.setdefault(v, {}).setdefault(len(words), set()).add(item)
        self.below = [False] * len(order)  # whether a state or one on its way to the root ends a short item
        for v in order:
            self.below[v] = v in self.short or (v > 0 and self.below[self.link[v]])

    def _filters(self, coded: list[tuple[int | None, list[int]]]) -> None:
        """Sorted hashes of words and of neighbours, for whole batches."""
        words = sorted(self.ids, key=self.ids.__getitem__)
        self.hashes = np.sort(_hashes_of(words)) if words else np.zeros(0, np.uint64)
        of = _hashes_of(words) if words else np.zeros(0, np.uint64)
        pairs = {(a, b) for _, w in coded for a, b in zip(w, w[1:], strict=False)}
        left, right = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.pairs = np.unique(_pair(of[left], of[right])) if pairs else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - _BITS)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Places of h that may be items' words."""
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - _BITS)])
        return at[_within(h[at], self.hashes)]

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _within(_pair(a, b), self.pairs)

    def stream(self, words: list[bytes]):
        """(first, last, items, length) for each place at which an item's window ends: the run of hit words up to it."""
        step, link, length, size, window = self.step, self.link, self.length, self.size, self.window
        v = run = 0
        for i, word in enumerate(words):
            w = self.ids.get(word)
            if w is None:
                v = run = 0
                continue
            to = step.get(v * size + w)
            while to is None and v:
                v = link[v]
                run = length[v]
                to = step.get(v * size + w)
            v, run = (to, run + 1) if to is not None else (0, 0)
            if run >= window:
                yield i - run + 1, i, self.windows[self.holder[v]], run
            if run and self.below[v]:
                u = v
                while u > 0 and self.below[u]:
                    for m, items in self.short.get(u, {}).items():
                        if m <= run:
                            yield i - m + 1, i, items, run
                    u = link[u]


def _hashes_of(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return word_hashes(raw, ends - [len(w) for w in words], ends)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _normal_buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(texts)
    return np.frombuffer(data.tobytes().translate(_NORMAL), np.uint8), offsets


def _stretches(data: np.ndarray):
    """Bounds of stretches that end after a separator."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + _STRETCH)
        while hi < len(data):
            gap = np.flatnonzero(data[hi : hi + _STRETCH] == 32)
            if len(gap):
                hi += int(gap[0]) + 1
                break
            hi = min(len(data), hi + _STRETCH)
        yield lo, hi
        lo = hi


def _spans(data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.zeros(hi - lo + 2, np.int8)
    edge[1:-1] = _INSIDE[data[lo:hi]]
    edge = np.diff(edge)
    return np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo


def _hits(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list]:
    """The number of words of each text; and for each text None, or its hit spans (merged), items and longest run."""
    n = len(offsets) - 1
    total, found = np.zeros(n, np.int64), [np.zeros((5, 0), np.int64)]
    hashes, before = [np.zeros(0, np.uint64)], 0
    for lo, hi in _stretches(data):
        starts, ends = _spans(data, lo, hi)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        total += np.bincount(doc, minlength=n)
        h = word_hashes(data, starts, ends)
        long = np.flatnonzero(ends - starts > 64)
        if len(long):
            h[long] = _hashes_of([_word(data[starts[i] : ends[i]].tobytes()) for i in long])
        at = auto.known(h)
        found.append(np.stack([at + before, doc[at], starts[at], ends[at], at * 0]))
        hashes.append(h[at])
        before += len(starts)
    place, doc, start, end, _ = np.concatenate(found, axis=1)
    h = np.concatenate(hashes)
    firsts = np.cumsum(total) - total  # the number of words before each text
    joined = np.zeros(len(place), bool)
    if len(place):
        joined[1:] = (np.diff(place) == 1) & (np.diff(doc) == 0)
        near = np.flatnonzero(joined)
        joined[near] = auto.neighbours(h[near - 1], h[near])
    begin = np.flatnonzero(~joined)
    stop = np.append(begin[1:], len(place))
    out: list = [None] * n
    raw = data.data
    for a, b in zip(begin[stop - begin >= auto.shortest].tolist(), stop[stop - begin >= auto.shortest].tolist(), strict=True):
        words = [_word(bytes(raw[s:e])) for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
        d = int(doc[a])
        zero = int(place[a] - firsts[d])
        for first, last, items, run in auto.stream(words):
            if out[d] is None:
                out[d] = ([], set(), 0)
            spans, names, longest = out[d]
            x, y = first + zero, last + zero + 1
            while spans and spans[-1][1] >= x:
                p = spans.pop()
                x, y = min(x, p[0]), max(y, p[1])
            spans.append((x, y))
            names |= items
            out[d] = (spans, names, max(longest, run))
    return total, out


def _pieces(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """item, words: each item with a word in overlapping pieces."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = item_words(text)
                size = max(_PIECE_WORDS, 2 * window)
                for at in range(0, max(1, len(words) - window + 1), size):
                    if words:
                        yield pa.RecordBatch.from_pydict({"item": pa.array([item], pa.string()), "words": pa.array([words[at : at + size + window - 1]], pa.list_(pa.binary()))})

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item string, words array<binary>")


def scan(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", shard_words: int = SHARD_WORDS, columns: list[str] | None = None) -> DataFrame:
    """Columns of docs (columns: which of them) with n_words, n_hit (words inside windows of items), longest (run of words that stands in an item, where one is hit), spans (of hit words, merged) and items (their sorted ids)."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if columns is None else columns) if c not in OUTPUTS]
    (body,) = free_names([*keep, *OUTPUTS], "text_")
    pieces = materialize(_pieces(items, window, id_col, item_text), "decontaminate-items")
    shards = max(1, -(-(pieces.agg(F.sum(F.size("words"))).first()[0] or 0) // shard_words))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards).cast("long")))

    def shard(k: int):
        rows = dealt.where(F.col("shard") == k).select("item", "words").sort("item", "words").collect()  # about shard_words words
        names = sorted({r["item"] for r in rows if r["item"] is not None})
        number = {name: i for i, name in enumerate(names)}
        return spark.sparkContext.broadcast((Automaton([(number.get(r["item"]), [bytes(w) for w in r["words"]]) for r in rows], window), names))

    def search(shared, kept: list[str]):
        def run(batches):
            auto, names = shared.value
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    total, found = _hits(auto, *_normal_buffer(part.column(body)))
                    spans = [[{"start": a, "stop": b} for a, b in f[0]] if f else [] for f in found]
                    columns = {c: part.column(c) for c in kept} | {
                        "n_words": pa.array(total),
                        "n_hit": pa.array([sum(s["stop"] - s["start"] for s in x) for x in spans], pa.int64()),
                        "longest": pa.array([f[2] if f else 0 for f in found], pa.int64()),
                        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        "items": pa.array([sorted(names[i] for i in f[1] if i is not None) if f else [] for f in found], pa.list_(pa.string())),
                    }
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return run

    results = T.StructType.fromDDL(f"n_words long, n_hit long, longest long, spans {_SPANS}, items array<string>").fields
    texts = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(body))
    if shards == 1:
        return texts.mapInArrow(search(shard(0), keep), T.StructType([docs.schema[c] for c in keep] + results))
    (row,) = free_names([*keep, *OUTPUTS, body], "row_")
    stored = materialize(texts.withColumn(row, F.monotonically_increasing_id()), "decontaminate-texts")
    every = None
    for k in range(shards):
        shared = shard(k)
        hits = stored.select(row, body).mapInArrow(search(shared, [row]), T.StructType([T.StructField(row, T.LongType()), *results]))
        hits = materialize(hits if k == 0 else hits.where("n_hit > 0"), f"decontaminate-{k}")  # the first has every row, for the number of words
        shared.unpersist()
        every = hits if every is None else every.unionByName(hits)
    met = every.groupBy(row).agg(F.max("n_words").alias("n_words"), F.max("longest").alias("longest"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    met = met.withColumn("spans", merged(F.col("spans"))).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]))
    return stored.drop(body).join(met, row).select(*keep, *OUTPUTS)


def merged(spans: Column) -> Column:
    """Sorted spans (start, stop) with those that meet made one."""

    def add(done: Column, s: Column) -> Column:
        final = F.element_at(done, -1)
        grown = F.struct(final["start"].alias("start"), F.greatest(final["stop"], s["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= s["start"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(_SPANS), add)


def without(scanned: DataFrame, text_col: str = "text", name: str = "clean_text") -> DataFrame:
    """Adds scanned texts without their hit spans, from each one's first word to its last."""
    keep = [c for c in scanned.columns if c != name]

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if text and spans:
                    raw = text.encode()
                    starts, ends = _spans(np.frombuffer(raw.translate(_NORMAL), np.uint8), 0, len(raw))
                    cuts = [(int(starts[s["start"]]), int(ends[s["stop"] - 1])) for s in spans]
                    text = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(raw)], strict=True)).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, name])

    return scanned.mapInArrow(run, T.StructType([*(scanned.schema[c] for c in keep), T.StructField(name, T.StringType())]))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """docs with what scan finds, kept (no more than the share most of the words is hit) and clean_text, the text without its hit spans."""
    found = scan(docs, items, window, text_col=text_col, **options)
    return without(found.withColumn("kept", F.col("n_hit") <= F.lit(most) * F.col("n_words")), text_col)
