"""Substring dedup by recompression.

Two rounds of recompression run over the words of every document. A round names runs and pairs: equal neighbours make a run, and a
coin that depends on a symbol's name alone calls it left or right, so that a run of a left symbol makes a pair with the run of a right
one that follows it. A new symbol's name is a 128-bit fingerprint of the names and numbers that it stands for. So executors give equal
substrings equal names with no dictionary to exchange, and whether a seam between two symbols is still there depends on the symbols next to it
only. Each seam carries the words on which it depends; those inside a window of 13 words are the same wherever the window stands, and so are all
symbols between them.

Interior symbols reveal repeats: the smallest name of two neighbouring symbols of the second round inside a window stands for it (of one symbol
where two don't fit, of one of the first round where none does, and of a word where runs leave nothing else). They verify them,
too: a window is spelled by the words before its first seam, the names of its symbols, and the words after its last seam. Spark rounds over blocks of documents:

1. every block sends each stand-in once to a bucket of its name; the buckets tell blocks which of them
   occur elsewhere, too. A window whose stand-in occurs in one document only repeats nowhere.
2. the windows left are verified: each block sends 128-bit fingerprints of their spellings, once, with the
   smallest document id it has for them, under numbers by their places; buckets answer those blocks that hold a larger id than the smallest, by the
   numbers. Where the numbers stand, and which windows the block itself covers, is a plan that the block gets back with the answers.
3. each block marks the words that such windows cover, by its plan: it makes no symbols and looks no window up again.

A block sends a stand-in or window once however many of its documents have it. Where there are more than ``fan`` blocks, those of a bucket are met
in groups first, and each group passes on one entry of what it has met, so a passage that is in every block never meets in
one task. Blocks and buckets are bounded in size at any scale.

Defined results: null text: no words. A null id: its words are kept, and it is no source for others. Rows
that share an id don't remove each other's words; repeated rows are alike. Texts under 13 words are kept whole. A very long text
is a block of its own, so it has to fit into a task. An
empty table gives an empty table. Extra columns pass through, but for those with the name of an output.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import absorb, materialize, mix, text_buffer, word_hashes, word_spans

WINDOW = 13
FAN = 4096
_RUN = np.uint64(0xA5A5F00D5EED1234)
_FAR = 1 << 60
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_KEY = np.uint64((1 << 39) - 1)


def _left(names: np.ndarray, salt: int) -> np.ndarray:
    return (mix(names ^ np.uint64(salt)) & np.uint64(1)).astype(bool)


def _named(names: np.ndarray, first: np.ndarray, end: np.ndarray, lead: np.ndarray, which: int) -> np.ndarray:
    """Names of the symbols that stand for names[first:end]: a run, or lead times one symbol and then a run of another."""
    out = names[first]
    size = end - first
    runs, pairs = np.flatnonzero((size > 1) & (lead == size)), np.flatnonzero(lead < size)
    out[runs] = absorb(mix(out[runs] ^ _RUN), size[runs].astype(np.uint64), which)
    one = absorb(out[pairs], lead[pairs].astype(np.uint64), which)
    out[pairs] = absorb(absorb(one, names[end[pairs] - 1], which), (size - lead)[pairs].astype(np.uint64), which)
    return out


class Symbols:
    """Two rounds over word names. Of each round: where its symbols start (and the end), the first and last words on which these seams depend, and the symbols' names."""

    def __init__(self, names: np.ndarray) -> None:
        n = len(names)
        self.grouped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        start, low, high = np.arange(n + 1), np.arange(n + 1), np.arange(n + 1) - 1
        for salt in (1, 2):
            if not len(names):
                self.rounds.append((start[:1], low[:1], high[:1], names))
                continue
            m = len(names)
            left, change = _left(names, salt), names[1:] != names[:-1]
            turn = np.flatnonzero(change)
            parted = ~left[turn] | left[turn + 1]
            first, turns = np.append(0, turn[parted] + 1), np.append(turn + 1, m)
            end = np.append(first[1:], m)
            lead = np.minimum(turns[np.append(0, np.flatnonzero(parted) + 1)], end) - first
            self.grouped.append((first, end, lead))
            seams = first[1:]  # what stands at the ends of a block depends on what is beyond
            low, high = np.concatenate([[-_FAR], low[seams - 1], [_FAR]]), np.concatenate([[-_FAR], high[seams + 1], [_FAR]])
            start, names = np.append(start[first], n), _named(names, first, end, lead, 0)
            self.rounds.append((start, low, high, names))

    def other_names(self, names: np.ndarray) -> np.ndarray:
        """Names of the last round's symbols in the second family, from word names of that family."""
        for first, end, lead in self.grouped:
            names = _named(names, first, end, lead, 1)
        return names


def _smallest(n: int, low: np.ndarray, high: np.ndarray, names: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """For each window (of those at at) the smallest of the names that depend on none but its words. high ascends strictly."""
    extent = high - low
    fits = extent < WINDOW
    extent, high, names = extent[fits].astype(np.uint8), high[fits], names[fits]
    order = np.argsort(extent, kind="stable")
    cuts = np.searchsorted(extent[order], np.arange(WINDOW + 1))
    open_ = np.full(n + WINDOW, _NONE)  # by the last word: names that need no more than so many words
    out = np.full(n if at is None else len(at), _NONE)
    for k in range(WINDOW):
        some = order[cuts[k] : cuts[k + 1]]
        open_[high[some]] = names[some]
        np.minimum(out, open_[k : k + n] if at is None else open_[at + k], out=out)
    return out


class Words:
    """Rows and words of a block."""

    def __init__(self, body: bytes, text_col: str) -> None:
        self.table, self.text_col = B.load(body), text_col
        self.data, self.offsets = text_buffer(self.table.column(text_col).combine_chunks())
        self.starts, self.ends = word_spans(self.data)
        self.doc_at = np.searchsorted(self.starts, self.offsets)  # first word of each document


class Windows(Words):
    """Words, symbols, windows and stand-ins of a block."""

    def __init__(self, body: bytes, id_col: str, text_col: str) -> None:
        super().__init__(body, text_col)
        self.ids = self.table.column(id_col).combine_chunks()
        self.hash = word_hashes(self.data, self.starts, self.ends)
        self.symbols = Symbols(self.hash)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.doc_at))
        n = len(self.hash)
        self.at = np.flatnonzero(self.doc[: n - WINDOW + 1] == self.doc[WINDOW - 1 :]) if n >= WINDOW else np.zeros(0, np.int64)
        self.known = np.array(self.ids.is_valid())
        self.id = np.array(pc.fill_null(self.ids.cast(pa.int64()), 0))

    def stand_ins(self) -> np.ndarray:
        """For each window: the smallest name of interior symbols."""
        n = len(self.hash)
        if not len(self.at):
            return np.zeros(0, np.uint64)
        (_, low1, high1, first), (_, low, high, names) = self.symbols.rounds
        two = absorb(mix(names[:-1]), names[1:])
        out = _smallest(n, low[: len(two)], high[2:], two)[self.at]
        for low_, high_, some in ((low[:-1], high[1:], names), (low1[:-1], high1[1:], first), (np.arange(n), np.arange(n), self.hash)):
            lacking = np.flatnonzero(out == _NONE)
            if not len(lacking):
                break
            out[lacking] = _smallest(n, low_, high_, some, self.at[lacking])
        return out

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for the spellings of the windows that start at words at: words outside the seams, names of symbols between them."""
        start, low, high, names = self.symbols.rounds[1]
        begin, stop = np.searchsorted(low, at, "left"), np.searchsorted(high, at + WINDOW - 1, "right") - 1
        core = stop > begin
        begin, stop = np.where(core, begin, 0), np.where(core, stop, 0)
        before = np.where(core, start[begin] - at, WINDOW)
        middle = before + stop - begin
        size = np.where(core, middle + at + WINDOW - start[stop], WINDOW)
        n, used = len(self.hash), np.zeros(len(self.hash) + 1, np.int32)
        used[at] += 1
        used[at + WINDOW] -= 1
        used = np.flatnonzero(np.cumsum(used[:-1]))
        other = np.zeros(n, np.uint64)  # the second family is asked for in these windows only
        other[used] = word_hashes(self.data, self.starts[used], self.ends[used], 1)
        values = np.concatenate([self.hash, names]), np.concatenate([other, self.symbols.other_names(other)])
        state = mix(np.where(core, 16 * before + start[stop] - at, 0).astype(np.uint64))
        states = [state, state.copy()]
        in_core, after = n + begin - before, start[stop] - middle
        live = np.arange(len(at))
        for k in range(WINDOW):
            live = live[size[live] > k] if k else live
            where = np.where(k < before[live], at[live], np.where(k < middle[live], in_core[live], after[live])) + k
            for which in (0, 1):
                states[which][live] = absorb(states[which][live], values[which][where], which)
        return states[0], states[1]


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, and for each place in it the number of its group."""
    order = np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    s = keys[0][order]
    new[1:] = s[1:] != s[:-1]
    more = np.zeros(len(order), bool)
    for k in keys[1:]:
        s = k[order]
        more[1:] |= s[1:] != s[:-1]
    if (more & ~new).any():  # the first key doesn't tell all apart
        order, new = np.lexsort(keys[::-1]), np.zeros(len(order), bool)
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _several(stand: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct stand-ins, whether more than one document of the block has each, and the place of each window's own among them."""
    new = np.ones(len(stand), bool)
    new[1:] = (stand[1:] != stand[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)  # windows side by side mostly have the same
    order, group = _grouped(stand[run])
    if not len(order):
        return stand, np.zeros(0, bool), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    docs, of = doc[run][order], np.empty(len(order), np.int64)
    of[order] = group
    return stand[run][order[first]], np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first), of[np.cumsum(new) - 1]


def _dealt(buckets: int, key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    where = (mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where.astype(np.uint16) if buckets <= 1 << 16 else where, kind="stable")
    first = np.flatnonzero(np.diff(where[order], prepend=-1))
    return [(int(where[part[0]]), part) for part in np.split(order, first[1:])] if len(order) else []


def _by_source(picked: np.ndarray, source: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Picked places by their source, which ascends with the place; places of a source ascend."""
    picked = np.sort(picked)
    first = np.flatnonzero(np.diff(source[picked], prepend=-1))
    return [(int(source[part[0]]), part) for part in np.split(picked, first[1:])] if len(picked) else []


def _steps(numbers: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as their differences, all lowest bytes first, so that the rest, which is mostly zero, compresses."""
    return np.diff(numbers.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_steps(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def _marked(n: int, at: np.ndarray) -> bytes:
    out = np.zeros(n, bool)
    out[at] = True
    return np.packbits(out).tobytes()


def _from_marked(x: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8)))


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _short(key: np.ndarray, known: np.ndarray) -> bytes:
    """Five bytes for each key: 39 bits, which tell the keys of a bucket apart but for a rare chance that sends a window to be verified in vain, and one for known."""
    return ((key & _KEY) | (known.astype(np.uint64) << np.uint64(39))).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_short(column) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for x in column.to_pylist():
        wide = np.zeros((len(x) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
        wide = wide.reshape(-1).view(np.uint64)
        out.append((wide & _KEY, wide > _KEY))
    return out


def _u64(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _cat(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: bool = False, fan: int = FAN) -> DataFrame:
    """Rows of docs with n_words, n_removed, kept_text and kept_sha256: every word goes that is covered by a window of 13 words which also
    starts in a row with a smaller id. kept_text has the kept words joined by one space; with layout, the text as it was, but for the words
    removed. kept_sha256 is always of the former."""
    outputs = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()), ("kept_sha256", T.StringType())]
    docs = docs.select(*[c for c in docs.columns if c not in dict(outputs)])
    blocks = B.pack(docs, "substring-blocks")
    buckets = B.bucket_count(blocks)

    def send_stand_ins(batches):
        for batch in batches:
            for block, body in zip(batch.column("block_id").to_pylist(), batch.column("body"), strict=True):
                w = Windows(body.as_py(), id_col, text_col)
                key, several, _ = _several(w.stand_ins(), w.doc[w.at])
                parts = _dealt(buckets, key)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in parts], pa.int32()), "block_id": pa.array([block] * len(parts), pa.int64()), "keys": pa.array([_short(key[p], several[p]) for _, p in parts], pa.binary())})

    def meet_stand_ins(last: bool):
        def meet(table: pa.Table) -> pa.Table:
            keys = _from_short(table.column("keys"))
            source = np.repeat(np.arange(len(keys)), [len(k) for k, _ in keys])
            key, several = _cat([k for k, _ in keys]), _cat([x for _, x in keys], bool)
            order, group = _grouped(key)
            shared = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
            news = order[shared & ~several[order]]  # a block knows of those that several of its own documents have
            rows = [(True, s, k) for s, k in _by_source(news, source)]
            if not last:  # one entry of each goes on
                on = order[np.flatnonzero(np.diff(group, prepend=-1))]
                known = np.zeros(len(key), bool)
                known[order] = shared
                several = several | known
                rows += [(False, s, k) for s, k in _by_source(on, source)]
            names, bucket = table.column("block_id").to_pylist(), table.column("bucket").to_pylist()
            return pa.table({"answer": pa.array([x for x, _, _ in rows], pa.bool_()), "bucket": pa.array([bucket[s] for _, s, _ in rows], pa.int32()), "block_id": pa.array([names[s] for _, s, _ in rows], pa.int64()), "keys": pa.array([_short(key[k], several[k]) for _, _, k in rows], pa.binary())})

        return meet

    def left_over(w: Windows, told: np.ndarray) -> np.ndarray:
        """First words of the windows that may repeat."""
        key, several, of = _several(w.stand_ins(), w.doc[w.at])
        return w.at[(several | np.isin(key & _KEY, told))[of]]

    kind = {"bucket": pa.int32(), "block_id": pa.int64(), "a": pa.binary(), "b": pa.binary(), "ids": pa.binary(), "numbers": pa.binary(), "plan": pa.binary()}

    def rows_of(rows: list[tuple], **more) -> pa.Table:
        return pa.table(more | {name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(kind.items())})

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        told = _cat([k for k, _ in _from_short(right.column("keys"))])
        for name, body in zip(left.column("block_id").to_pylist(), left.column("body"), strict=True):
            w = Windows(body.as_py(), id_col, text_col)
            at = left_over(w, told)
            at = at[w.known[w.doc[at]]]
            a, b = w.hashes(at)
            owner = w.id[w.doc[at]]
            order, group = _grouped(a, b)
            of = np.empty(len(at), np.int64)
            of[order] = group
            first = np.flatnonzero(np.diff(group, prepend=-1))
            smallest = np.minimum.reduceat(owner[order], first) if len(at) else owner
            covered = owner > smallest[of]
            left_at = np.flatnonzero(~covered)
            asked = np.full(len(first), len(at))
            np.minimum.at(asked, of[left_at], left_at)  # one window of each spelling stands for all of its id
            asked = np.sort(asked)
            number = np.empty(len(first), np.int64)
            number[of[asked]] = np.arange(len(asked))
            also = np.setdiff1d(left_at, asked, assume_unique=True)
            plan = {"asked": _marked(len(w.hash), at[asked]), "covered": _marked(len(w.hash), at[covered]), "also": _bytes(at[also]), "of": _bytes(number[of[also]])}
            rows.append((name % buckets, name, None, None, None, None, B.dump(pa.Table.from_pylist([plan]))))
            a, b, owner = a[asked], b[asked], owner[asked]
            rows += [(to, name, _bytes(a[p]), _bytes(b[p]), _bytes(owner[p]), _steps(p), None) for to, p in _dealt(buckets, a)]
        return rows_of(rows)

    def meet_windows(last: bool):
        def meet(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            plans = table.filter(pc.is_valid(table.column("plan")))
            rows = [(bucket, s, None, None, None, None, x.as_py()) for s, x in zip(plans.column("block_id").to_pylist(), plans.column("plan"), strict=True)]
            table = table.filter(pc.is_null(table.column("plan")))
            a, b = _u64(table.column("a")), _cat(_u64(table.column("b")))
            source = np.repeat(np.arange(len(a)), [len(x) for x in a])
            a = _cat(a)
            owner = _cat([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()], np.int64)
            number = _cat([_from_steps(x) for x in table.column("numbers").to_pylist()], np.int64)
            order, group = _grouped(a, b)
            smallest = np.minimum.reduceat(owner[order], np.flatnonzero(np.diff(group, prepend=-1))) if len(order) else owner
            larger = owner[order] > smallest[group]
            names = table.column("block_id").to_pylist()
            rows += [(bucket, names[s], None, None, None, _steps(number[r]), None) for s, r in _by_source(order[larger], source)]
            answers = len(rows)
            if not last:  # those of the smallest id go on
                rows += [(bucket, names[s], _bytes(a[r]), _bytes(b[r]), _bytes(owner[r]), _steps(number[r]), None) for s, r in _by_source(order[~larger], source)]
            return rows_of(rows, answer=pa.array(np.arange(len(rows)) < answers))

        return meet

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in outputs]])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        plans = right.column("plan").drop_null().to_pylist()
        numbers = _cat([_from_steps(x) for x in right.column("numbers").drop_null().to_pylist()], np.int64)
        for body, plan in zip(left.column("body"), plans, strict=True):
            w, plan = Words(body.as_py(), text_col), B.load(plan).to_pylist()[0]
            asked, also, of = _from_marked(plan["asked"]), np.frombuffer(plan["also"], np.int64), np.frombuffer(plan["of"], np.int64)
            hit = np.zeros(len(asked), bool)
            hit[numbers] = True
            covered = np.concatenate([_from_marked(plan["covered"]), asked[hit], also[hit[of]]])  # no window twice
            marks = np.zeros(len(w.starts) + 1, np.int32)
            marks[covered] += 1
            marks[covered + WINDOW] -= 1
            gone = np.cumsum(marks[:-1]) > 0
            out.append(_rows(w, gone, layout))
        return pa.concat_tables(out)

    sent = blocks.select("block_id", "body").mapInArrow(send_stand_ins, "bucket int, block_id long, keys binary")
    told = _met(sent, blocks.count(), fan, meet_stand_ins, "substring-stand-ins").select("block_id", "keys")
    windows = blocks.select("block_id", "body").groupBy("block_id").cogroup(told.groupBy("block_id")).applyInArrow(send_windows, "bucket int, block_id long, a binary, b binary, ids binary, numbers binary, plan binary")
    hits = _met(windows, blocks.count(), fan, meet_windows, "substring-windows")
    return blocks.select("block_id", "body").groupBy("block_id").cogroup(hits.select("block_id", "numbers", "plan").groupBy("block_id")).applyInArrow(finish, schema)


def _met(sent: DataFrame, n_blocks: int, fan: int, meet, label: str) -> DataFrame:
    """All answers of meet to what blocks have sent, stored. A task meets the entries of fan blocks, or of fan such groups, at most (but for chance)."""
    answers, groups = None, max(1, -(-n_blocks // fan))
    while True:
        group = F.pmod(F.xxhash64("block_id"), F.lit(groups)).alias("among")
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sent.schema.fields)
        out = materialize(sent.groupBy("bucket", group).applyInArrow(meet(groups == 1), f"answer boolean, {kind}"), label)
        mine = out.where("answer").drop("answer")
        answers = mine if answers is None else answers.unionByName(mine)
        if groups == 1:
            return answers
        sent, groups = out.where("not answer").drop("answer"), -(-groups // fan)


def _rows(w: Windows, gone: np.ndarray, layout: bool) -> pa.Table:
    removed = np.add.reduceat(np.append(gone, False), np.minimum(w.doc_at[:-1], len(gone))) if len(w.doc_at) > 1 else np.zeros(0, int)
    sizes = np.diff(w.doc_at)
    removed = np.where(sizes > 0, removed, 0).astype(np.int64)
    data = w.data.tobytes()
    texts, shas = [], []
    originals = w.table.column(w.text_col)
    for d in range(len(sizes)):
        lo, hi = int(w.doc_at[d]), int(w.doc_at[d + 1])
        raw = data[int(w.offsets[d]) : int(w.offsets[d + 1]) - 1]
        if not removed[d]:
            kept = b" ".join(raw.split())
            text = originals[d].as_py() if layout else kept.decode()
        else:
            keep = np.flatnonzero(~gone[lo:hi]) + lo
            breaks = np.flatnonzero(np.diff(keep) > 1)
            first = np.concatenate([keep[:1], keep[breaks + 1]]) if len(keep) else keep
            last = np.concatenate([keep[breaks], keep[-1:]]) if len(keep) else keep
            runs = [data[int(w.starts[a]) : int(w.ends[b])] for a, b in zip(first, last, strict=True)]
            kept = b" ".join(x for r in runs for x in r.split())
            text = (b" ".join(runs) if layout else kept).decode()
        texts.append(text)
        shas.append(hashlib.sha256(kept).hexdigest())
    table = w.table
    for name, values in (("n_words", pa.array(sizes.astype(np.int64))), ("n_removed", pa.array(removed)), ("kept_text", pa.array(texts, pa.string())), ("kept_sha256", pa.array(shas, pa.string()))):
        table = table.append_column(name, values)
    return table
