"""BPE encoding and decoding with a tokenization automaton.

The automaton's states are the tokens (the state is the token read last) and its arcs are labelled with
tokens. It starts as the universal automaton over the base symbols. Each merge, in rank order, adds a
gadget: a state for the merged token, reached over an arc that carries the merged label, while the pair
of arcs that would spell it out is removed. A gadget acts on the right edge of what stands before a
boundary and on the left edge of what comes after it, so the arcs that all gadgets together have removed
are described by two tables that grow with the gadgets: the chain of states down a token's right edge and
down its left edge, each with the rank of the gadget that ended it. An arc s -> t is there unless, while both
chains are climbed in rank order, some gadget joins the two symbols that face each other. One path only is
left for each word, and encoding finds it left to right by table-driven transitions: a trie proposes the
labels that fit at a position, the arc table says which of them the state has. Decoding emits arc labels.

Words are encoded once per process and memoised (up to about MEMO of them); transitions run over all new words of a batch in step.

Text rules: null is the empty text; an empty text has no token. Special-token strings in a text become
their ids, as the library does by default. Rows are independent, so repeated rows and ids don't matter;
extra columns are kept by ``encode`` unless they have the name of an output, which then wins.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_WORD = 48
MEMO = 500_000
#: Symbols are 0..511; what pads a word has no transition.
_PAD, _STRIDE = 512, 513
_NEVER = np.int32(1 << 30)


class Hashed:
    """A map from non-negative 64-bit keys to int32 by open addressing; lookups take arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 3 + 1))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            slots, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = keys[left[took]], values[left[took]]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _gather(rows: np.ndarray, starts: array, values: array) -> tuple[np.ndarray, np.ndarray]:
    """values[starts[r]:starts[r + 1]] for each r of rows, end to end, and where each begins (one more at the end)."""
    starts_, values_ = np.frombuffer(starts, np.int64), np.frombuffer(values, np.int32) if values else np.zeros(0, np.int32)
    size = starts_[rows + 1] - starts_[rows]
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return values_[np.arange(at[-1]) + np.repeat(starts_[rows] - at[:-1], size)], at


class Automaton:
    """Compiled from the vocabulary file of a word-level BPE with a byte alphabet and word ends."""

    def __init__(self, spec: str) -> None:
        raw = json.loads(spec)
        model = raw["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.specials = {x["content"]: x["id"] for x in raw["added_tokens"]}
        self.label = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.label[i] = s
        n = len(self.label)
        letters = byte_letters()
        # symbols 0..255 are bytes inside a word, 256..511 the same as a word's last
        self.base = np.array([vocab[c] for c in letters] + [vocab[c + end] for c in letters], np.int32)
        spelled: dict[int, tuple[int, ...]] = {int(t): (k,) for k, t in enumerate(self.base)}
        right: dict[int, list[tuple[int, int]]] = {t: [(t, -1)] for t in spelled}  # chains: (state, rank of its gadget)
        left: dict[int, list[tuple[int, int]]] = {t: [(t, -1)] for t in spelled}
        pairs, ranks = [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            spelled[t] = spelled[u] + spelled[v]
            right[t] = [*right[v], (t, rank)]
            left[t] = [*left[u], (t, rank)]
            pairs.append(u * n + v)
            ranks.append(rank)
        self.n = n
        self.gadget = Hashed(np.array(pairs, np.int64), np.array(ranks, np.int32))
        self.right, self.right_until = self._chains(right)
        self.left, self.left_until = self._chains(left)
        self.length = np.zeros(n, np.int32)
        nodes: dict[int, int] = {}
        ends: dict[int, int] = {}
        for t, s in spelled.items():
            self.length[t] = len(s)
            node = 0
            for k in s:
                node = nodes.setdefault(node * _STRIDE + k, len(nodes) + 1)
            ends[node] = t
        self.trie = Hashed(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.ends = np.full(len(nodes) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.nodes, self.longest = nodes, int(self.length.max())
        self.words = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.control = re.compile("[\x1c-\x1f]")
        self.clear()

    def _chains(self, chains: dict[int, list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        """For each token the states along an edge, innermost first, and the rank of the gadget that ends each."""
        deep = max(map(len, chains.values()))
        states, until = np.zeros((self.n, deep), np.int32), np.full((self.n, deep), _NEVER)
        for t, chain in chains.items():
            states[t, : len(chain)] = [s for s, _ in chain]
            until[t, : len(chain) - 1] = [r for _, r in chain[1:]]
        return states, until

    def clear(self) -> None:
        """Empties the memos: words with their ids and labels, and the words of what stands between white space."""
        self.word_row: dict[str, int] = {"\n": -1}
        self.ids, self.id_starts, self.spoken = array("i"), array("q", [0]), []
        self.chunk_row: dict[str, int] = {}
        self.rows, self.row_starts = array("i"), array("q", [0])

    def _keep(self, word: str, ids: list[int]) -> None:
        self.word_row[word] = len(self.spoken)
        self.ids.extend(ids)
        self.id_starts.append(len(self.ids))
        self.spoken.append(" ".join([self.label[i] for i in ids]))

    def arcs(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether state s has an arc labelled t: climb both edges in rank order; a gadget that joins the facing symbols first has removed it."""
        there = np.ones(len(s), bool)
        at, i, j = np.arange(len(s)), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        while len(at):
            a, b = s[at], t[at]
            ends_a, ends_b = self.right_until[a, i], self.left_until[b, j]
            rank = self.gadget.get(self.right[a, i].astype(np.int64) * self.n + self.left[b, j])
            gone = (rank >= 0) & (rank < ends_a) & (rank <= ends_b)
            there[at[gone]] = False
            on = ~gone & ((ends_a != _NEVER) | (ends_b != _NEVER))
            up = (ends_a <= ends_b)[on]
            at, i, j = at[on], i[on] + up, j[on] + ~up
        return there

    def encode_words(self, words: list[str]) -> None:
        """Encodes words that the memo lacks, those of similar length in step, the shorter ones padded by a symbol that no arc has."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw])
        order = np.argsort(size, kind="stable")
        lo = 0
        for top in (4, 6, 8, 10, 12, 16, 24, 32, LONG_WORD):
            hi = int(np.searchsorted(size[order], top, "right"))
            for k in range(lo, hi, max(1, 2_000_000 // top)):
                part = order[k : min(hi, k + max(1, 2_000_000 // top))]
                sym = np.frombuffer(b"".join([raw[i].ljust(top, b"\0") for i in part]), np.uint8).reshape(len(part), top).astype(np.int64)
                n = size[part]
                sym[np.arange(top) >= n[:, None]] = _PAD
                sym[np.arange(len(part)), n - 1] += 256
                for i, ids in zip(part.tolist(), self._paths(sym, n), strict=True):
                    self._keep(words[i], ids)
            lo = hi
        for i in order[lo:].tolist():
            sym = list(raw[i])
            sym[-1] += 256
            self._keep(words[i], self._long(sym))

    def _paths(self, sym: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        count, n = sym.shape
        state = np.full((count, n + 1), -1, np.int32)
        for j in range(n):
            at = np.flatnonzero(sizes > j)
            node = np.zeros(len(at), np.int64)
            for k in range(j, min(n, j + self.longest)):
                node = self.trie.get(node * _STRIDE + sym[at, k]).astype(np.int64)
                on = node >= 0
                at, node = at[on], node[on]
                if not len(at):
                    break
                token = self.ends[node]
                row = at[token >= 0]
                token = token[token >= 0]
                if j and len(row):
                    ok = self.arcs(state[row, j], token)
                    row, token = row[ok], token[ok]
                state[row, k + 1] = token
        flat = np.zeros((count, n), np.int32)
        fill, pos = np.full(count, n), sizes.copy()
        on = np.arange(count)
        while len(on):
            token = state[on, pos[on]]
            fill[on] -= 1
            flat[on, fill[on]] = token
            pos[on] -= self.length[token]
            on = on[pos[on] > 0]
        return [row[f:] for row, f in zip(flat.tolist(), fill.tolist(), strict=True)]

    def _long(self, sym: list[int]) -> list[int]:
        """One long word by the same transitions, position by position."""
        n = len(sym)
        state = [-1] * (n + 1)
        for j in range(n):
            node, labels, stops = 0, [], []
            for k in range(j, min(n, j + self.longest)):
                node = self.nodes.get(node * _STRIDE + sym[k], -1)
                if node < 0:
                    break
                if (t := int(self.ends[node])) >= 0:
                    labels.append(t)
                    stops.append(k + 1)
            if j:
                ok = self.arcs(np.full(len(labels), state[j], np.int32), np.array(labels, np.int32))
                labels, stops = [x for x, y in zip(labels, ok, strict=True) if y], [x for x, y in zip(stops, ok, strict=True) if y]
            for t, k in zip(labels, stops, strict=True):
                state[k] = t
        out, pos = [], n
        while pos:
            out.append(state[pos])
            pos -= int(self.length[out[-1]])
        return out[::-1]

    def chunks(self, text: str) -> list[str]:
        """White space ends every word, so a text may be cut there first; str.split takes four control characters for white space that the words don't."""
        return text.split() if self.control.search(text) is None else [c for c in regex.split(r"\s+", text) if c]

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def learn(self, fresh: list[str]) -> None:
        """Adds rows for pieces of text between white space, all in one pass over their words."""
        parts = self.special.split("\n".join(fresh)) if self.special else ["\n".join(fresh)]
        words: list[str] = []
        for k, part in enumerate(parts):  # the odd parts are special tokens
            if k % 2:
                words.append(special := "\0" + part)  # no word of a text is U+0000 and letters
                if special not in self.word_row:
                    self._keep(special, [self.specials[part]])
            else:
                words += self.words.findall(self.normal(part))
        self.encode_words([w for w in dict.fromkeys(words) if w not in self.word_row])
        row = self.word_row
        coded = np.array([row[w] for w in [*words, "\n"]], np.int32)
        breaks = np.flatnonzero(coded == -1)
        self.row_starts.extend((len(self.rows) + breaks - np.arange(len(breaks))).tolist())
        self.rows.frombytes(coded[coded != -1].tobytes())
        self.chunk_row.update(zip(fresh, range(len(self.chunk_row), len(self.chunk_row) + len(fresh)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Flat ids, offsets of the texts, and the decoded texts (labels joined by one space)."""
        if len(self.chunk_row) > MEMO:
            self.clear()
        split = [self.chunks(t) for t in texts]
        memo = self.chunk_row
        if fresh := [c for c in dict.fromkeys(chain.from_iterable(split)) if c not in memo]:
            self.learn(fresh)
        counts = np.cumsum([0, *map(len, split)])
        words, at = _gather(np.fromiter(map(memo.__getitem__, chain.from_iterable(split)), np.int64, counts[-1]), self.row_starts, self.rows)
        word_at = at[counts]
        ids, at = _gather(words, self.id_starts, self.ids)
        spoken, rows = self.spoken, words.tolist()
        decoded = [" ".join([spoken[i] for i in rows[a:b]]) for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True)]
        return ids, at[word_at], decoded

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.label[i] for i in ids])


@cache
def compiled(path: str) -> Automaton:
    """The automaton of a file, once in a process. The file comes with the installed vocabulary package, so every executor has it."""
    with open(path, encoding="utf-8") as f:
        return Automaton(f.read())


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ids (array<int>) and decoded (string: the labels that those ids emit). No shuffle."""
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches):
        machine = compiled(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = ["" if t is None else t for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                flat, offsets, spoken = machine.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(spoken, pa.string())], [*keep, ids, decoded])

    return docs.select(*keep).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode(docs.select("doc_id", "text"), vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
