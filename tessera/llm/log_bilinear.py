"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts come first: how often each token occurs in all training documents. Every task counts its own
documents, Spark adds the counts up, and the table of counts is stored. Words with a share of at least 1 in ``HEAD`` of all
training tokens go to every task; there can be HEAD of them at most, however large the corpus. All other words
meet their counts in a join.

The model predicts a token from the two before it. Every word that goes to every task has vectors of its own, as a predicted token
and as context; all other words are dealt by a hash into buckets of about ``BUCKET`` words, as many as the corpus
asks for and ``BUCKETS`` at most (then they get more words each, so the parameters that go to every task have a bound, some 150 MB), and each bucket has vectors too. Inside a bucket a word has the share (c + 1) / (sum of c + 1, and 1 for what was never seen).
Words and buckets by falling frequency are the symbols. The ``DIRECT`` first ones are predicted at once, the others in three levels: a group of
classes, a class in it, a symbol in the class; all have symbols of similar frequency, and their sizes grow with the cube root of the number of symbols. At
each level the score is the product of a vector with the predicted one, the sum of the context symbols' vectors each times a diagonal matrix of its
position, plus a bias.

Training documents are dealt by a hash of their ids into shards of about ``SHARD`` tokens, and shards into ``ROUNDS`` rounds, so what is learned doesn't
depend on how Spark deals rows. In a round each shard starts from the same parameters and makes one pass over its trigrams, weighted by their counts, by
noise-contrastive estimation: noise from the unigram distribution for a minibatch at the first level, and for the tokens of a group or class of the minibatch below it.
Then a symbol's parameters move by the mean of its changes, by its number of occurrences in the shards that saw it. Scoring works out the normalisers of all levels
in batched matrix products over all symbols of a level, so probabilities add up to 1.

One training document in ``ASIDE`` takes no part in the rounds. On these documents one weight is chosen with which the model is mixed with the smoothed counts of the base score: that of the
``WEIGHTS`` with the highest score. Both are normalised, so the mixture is; where the model has learned little, the counts keep their say.

Tokens are lower-cased words (A-Z only) and one end for each text. Null texts are empty: an end only. A null id
is held out. Repeated rows are counted and scored each; words of equal count go by their spelling. Very long texts count whole. Extra columns, of any
name, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize
from .language_mixture import held_out

HEAD = 1_800_000  # with BUCKETS below 2 ** 21, so three symbols have a number of 63 bits together
DIRECT = 128
BUCKET = 512
BUCKETS = 1 << 18
ASIDE = 16
WEIGHTS = np.append(np.arange(0, 0.99, 0.03), 0.995)
WIDTH = 8
NOISE = 64
MIDDLE, INSIDE = 10, 3  # noise of a group, of a class for its tokens in a minibatch
SHARD = 2_000_000
ROUNDS = 4
END = " "  # no word has a space
_FLUSH = 400_000
_SHARE = 8
_START = 0.01  # of the sums of squares
_PART = 256
_TEAM = 64
_SUMS = "part int, team long, sums binary, total binary"
_ROWS = 1024  # texts that are scored at once


def _tokens(text) -> list[bytes]:
    return [] if text is None else text.lower().split()


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs (text), stored; the end token is one space."""
    small = bytes.maketrans(UPPER.encode() + b"\t\n\x0b\x0c\r", LOWER.encode() + b"     ")

    def run(batches):
        held, rows, ends = [], 0, 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        def out(words: pa.Table):
            yield from words.set_column(0, "word", words.column("word").cast(pa.string())).to_batches()

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(k, 256).cast("binary").to_pylist()
                ends += len(texts)
                split = pc.split_pattern(pa.array([t.translate(small) for t in texts if t], pa.binary()), b" ")
                counted = pc.value_counts(split.flatten())
                words = pa.table({"word": counted.field("values"), "c": counted.field("counts")}).filter(pc.not_equal(counted.field("values"), b""))
                held.append(words)
                rows += len(words)
                if rows > 2 * _FLUSH:
                    held = [summed()]
                    rows = len(held[0])
                    if rows > _FLUSH:
                        yield from out(held[0])
                        held, rows = [], 0
        if ends:
            held.append(pa.table({"word": pa.array([b" "], pa.binary()), "c": pa.array([ends], pa.int64())}))
        if held:
            yield from out(summed())

    return materialize(docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


class Head:
    """The frequent tokens by falling count: places in the list are their numbers."""

    def __init__(self, words: list[bytes], counts: np.ndarray, buckets: int = 1) -> None:
        self.place = {w: i for i, w in enumerate(words)}
        self.size = len(words)  # numbers below are words, then come the buckets of all others, and what stands before a text
        self.buckets = buckets
        self.symbols = self.size + buckets
        self.end = self.place.get(b" ", -1)

    def numbers(self, texts: list) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Places of all tokens (-1 - bucket: not in the head) of the texts end to end, where each text begins, and the words."""
        words = [_tokens(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        places = np.full(at[-1], self.end, np.int64)
        mask = np.ones(at[-1], bool)
        mask[at[1:] - 1] = False
        every = list(chain.from_iterable(words))
        found = np.fromiter(map(self.place.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(found < 0)
        found[missing] = [-1 - zlib.crc32(every[i]) % self.buckets for i in missing.tolist()]
        places[mask] = found
        return places, at, words

    def trigrams(self, places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of tokens, and of their contexts as (before that) * (symbols + 1) + before."""
        return trigrams(np.where(places < 0, self.size - 1 - places, places), at, self.symbols)


def trigrams(token: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts that begin at at (and the end), and their contexts; before a text stands the symbol beyond the last."""
    one = np.empty_like(token)
    one[1:] = token[:-1]
    one[at[:-1]] = symbols
    two = np.empty_like(token)
    two[1:] = one[:-1]
    two[at[:-1]] = symbols
    return token, two * (symbols + 1) + one


class Level:
    """Vectors and biases of members in groups of size group, and their mass in the corpus."""

    def __init__(self, mass: np.ndarray, group: int, noise: int, rng: np.random.Generator) -> None:
        self.group, self.n, self.mass, self.noise = group, len(mass), mass, noise
        self.of_group = np.add.reduceat(mass, np.arange(0, len(mass), group)) if len(mass) else mass
        self.share = mass / np.repeat(self.of_group, group)[: len(mass)]
        self.v = rng.normal(0, 0.1, (len(mass), WIDTH)).astype(np.float32)
        self.b = np.log(self.share).astype(np.float32)

    def ready(self) -> None:
        """For training."""
        self.steps = np.append(0, np.cumsum(self.mass))
        self.noise_log = np.log(self.noise * self.share).astype(np.float32)
        self.sums = np.full(self.n, _START, np.float32)

    def pull(self, x: np.ndarray, guess: np.ndarray, weight: np.ndarray, rng: np.random.Generator, rate: float) -> np.ndarray:
        """One step for members x, ascending, in contexts guess; gives the gradients of guess."""
        of = x // self.group
        first = _starts(of)
        which = np.repeat(np.arange(len(first)), np.diff(first, append=len(of)))
        lo = of[first] * self.group
        hi = np.minimum(lo + self.group, self.n)
        drawn = self.steps[lo][:, None] + rng.random((len(lo), self.noise)) * (self.steps[hi] - self.steps[lo])[:, None]
        z = np.clip(np.searchsorted(self.steps, drawn, "right") - 1, lo[:, None], hi[:, None] - 1)
        own = self.v.take(x, 0)
        real = _dots(own, guess) + self.b[x] - self.noise_log[x]
        up = weight / (1 + np.exp(np.clip(real, -30, 30)))
        change = up[:, None] * own
        offset = self.b[z] - self.noise_log[z]
        moved, total = np.empty((len(lo), self.noise, WIDTH), np.float32), np.empty((len(lo), self.noise), np.float32)
        if len(x) > 8 * len(lo):  # many tokens in a group: its own product
            cuts = np.append(first, len(x)).tolist()
            each = [(slice(a, b), vectors) for a, b, vectors in zip(cuts[:-1], cuts[1:], self.v.take(z, 0), strict=True)]
            score, more = np.empty((len(x), self.noise), np.float32), np.empty_like(guess)
            for some, vectors in each:
                np.matmul(guess[some], vectors.T, out=score[some])
            score += offset.take(which, 0)
            down = _push(score, weight)
            for k, (some, vectors) in enumerate(each):
                np.matmul(down[some], vectors, out=more[some])
                np.matmul(down[some].T, guess[some], out=moved[k])
            change += more
            np.add.reduceat(down, first, out=total)
        else:
            noise = self.v.take(z.take(which, 0), 0)
            down = _push(np.einsum("ikd,id->ik", noise, guess) + offset.take(which, 0), weight)
            change += np.einsum("ik,ikd->id", down, noise)
            np.add.reduceat(down[:, :, None] * guess[:, None, :], first, out=moved)
            np.add.reduceat(down, first, out=total)
        new = _starts(x)
        self._move(x[new], _sums(up[:, None] * guess, new), np.add.reduceat(up, new), rate)
        rows, both = _gathered(z.ravel(), np.concatenate([moved.reshape(-1, WIDTH), total.reshape(-1, 1)], 1))
        self._move(rows, both[:, :WIDTH], both[:, WIDTH], rate)
        return change

    def _move(self, rows: np.ndarray, dv: np.ndarray, db: np.ndarray, rate: float) -> None:
        sums = self.sums[rows] + (_dots(dv, dv) + db * db) / (WIDTH + 1)
        self.sums[rows] = sums
        scale = rate / np.sqrt(sums)
        self.v[rows] = self.v.take(rows, 0) + dv * scale[:, None]
        self.b[rows] += db * scale

    def reach(self, guess: float) -> float:
        """What no score of a member exceeds for guesses of that norm."""
        if not self.n:
            return 0.0
        return guess * float((self.v * self.v).sum(1).max()) ** 0.5 + float(np.abs(self.b).max())

    def log_share(self, x: np.ndarray, guess: np.ndarray, small: bool = False) -> np.ndarray:
        """Natural logarithms of the shares of members x in their groups. small: no score is too large for exp."""
        by = np.argsort(x)
        of, g = x[by] // self.group, guess.take(by, 0)
        out = np.empty(len(x), np.float32)
        cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lo = int(of[a]) * self.group
            v, bias = self.v[lo : lo + self.group], self.b[lo : lo + self.group]
            for k in range(a, b, 4096):
                out[k : min(b, k + 4096)] = _log_sum(g[k : min(b, k + 4096)], v, bias, small)
        own = x[by]
        out = _dots(g, self.v.take(own, 0)) + self.b[own] - out
        back = np.empty_like(out)
        back[by] = out
        return back


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of rows."""
    return (a * b) @ np.ones(a.shape[1], a.dtype)


def _push(score: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The gradients of noise with these scores."""
    with np.errstate(over="ignore"):  # a score too low for exp moves nothing
        np.exp(np.negative(score, out=score), out=score)
    score += 1
    return np.divide(-weight[:, None], score, out=score)


def _gathered(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of their values."""
    both = np.sort(rows.astype(np.int64) << 32 | np.arange(len(rows)))
    rows = both >> 32
    new = _starts(rows)
    return rows[new], _sums(values.take(both & 0xFFFFFFFF, 0), new)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at begin; most runs have one row."""
    out = values.take(begin, 0)
    sizes = np.diff(begin, append=len(values))
    several = np.flatnonzero(sizes > 1)
    if len(several):
        inside = np.repeat(sizes > 1, sizes)
        cuts = np.cumsum(inside)[begin[several]] - 1
        out[several] = np.add.reduceat(values[inside], cuts, axis=0)
    return out


class Model:
    """top: the first symbols and the groups; mid: the classes in groups; leaf: the symbols in classes; q: vectors of context symbols; c: diagonals of the two positions."""

    def __init__(self, size: int, unigram: np.ndarray) -> None:
        rng = np.random.Generator(np.random.PCG64(4))
        n = size + 1
        self.symbols = n
        self.direct = min(n, DIRECT)
        span = max(1, math.ceil((n - self.direct) ** (1 / 3)))
        self.leaf = Level(unigram[self.direct :], span, INSIDE, rng)
        self.mid = Level(self.leaf.of_group, span, MIDDLE, rng)
        first = np.append(unigram[: self.direct], self.mid.of_group)
        self.top = Level(first, len(first), NOISE, rng)
        self.q = rng.normal(0, 0.1, (n + 1, WIDTH)).astype(np.float32)
        self.c = np.ones((2, WIDTH), np.float32)

    def _flat(self) -> list[np.ndarray]:
        return [self.top.v, self.top.b, self.mid.v, self.mid.b, self.c]

    def rows(self) -> np.ndarray:
        """All parameters as rows of 2 * WIDTH + 1: one for each symbol and for what stands before a text, then those of the upper levels."""
        own = np.zeros((self.symbols + 1, 2 * WIDTH + 1), np.float32)
        own[self.direct : self.symbols, :WIDTH], own[self.direct : self.symbols, WIDTH], own[:, WIDTH + 1 :] = self.leaf.v, self.leaf.b, self.q
        flat = np.concatenate([x.ravel() for x in self._flat()])
        return np.concatenate([own, np.resize(np.append(flat, np.zeros(-len(flat) % own.shape[1], np.float32)), (-(-len(flat) // own.shape[1]), own.shape[1]))])

    def load(self, rows: np.ndarray) -> Model:
        own, flat = rows[: self.symbols + 1].astype(np.float32), rows[self.symbols + 1 :].ravel().astype(np.float32)
        self.leaf.v, self.leaf.b, self.q = own[self.direct : self.symbols, :WIDTH].copy(), own[self.direct : self.symbols, WIDTH].copy(), own[:, WIDTH + 1 :].copy()
        at = 0
        parts = []
        for x in self._flat():
            parts.append(flat[at : at + x.size].reshape(x.shape).copy())
            at += x.size
        self.top.v, self.top.b, self.mid.v, self.mid.b, self.c = parts
        return self

    def guess(self, context: np.ndarray) -> np.ndarray:
        before = context // (self.symbols + 1)
        out = self.q.take(context - before * (self.symbols + 1), 0)
        out *= self.c[0]
        out += self.q.take(before, 0) * self.c[1]
        return out

    def first(self, token: np.ndarray) -> np.ndarray:
        """The places of tokens or of their groups in top."""
        return np.where(token < self.direct, token, self.direct + (token - self.direct) // (self.leaf.group * self.mid.group))

    def train(self, token: np.ndarray, context: np.ndarray, weight: np.ndarray, batch: int = 4096, rate: float = 0.1, seed: int = 0) -> None:
        """One pass of AdaGrad over weighted trigrams."""
        n, top = self.symbols, self.top
        rng = np.random.Generator(np.random.PCG64([seed, len(token)]))
        parts = -(-weight // _SHARE)  # a heavy trigram is met again and again, each time with a part of its weight
        order = rng.permutation(np.repeat(np.arange(len(token)), parts))
        weight = (weight / parts / _SHARE).astype(np.float32)
        before, last, token = (context // (n + 1)).astype(np.int32), (context % (n + 1)).astype(np.int32), token.astype(np.int32)
        for level in (self.top, self.mid, self.leaf):
            level.ready()
        noise_log, steps = top.noise_log, top.steps[1:]
        top_sums, c_sums, q_sums = np.ones((top.n, 1), np.float32), np.ones_like(self.c), np.full(len(self.q), _START, np.float32)
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            at = at[np.argsort(token[at])]
            symbol, one, two, m = token[at], last[at], before[at], weight[at]
            w = self.first(symbol)  # ascending, as symbols are
            q1, q2 = self.q.take(one, 0), self.q.take(two, 0)
            guess = q1 * self.c[0] + q2 * self.c[1]
            noise = np.minimum(np.searchsorted(steps, rng.random(top.noise) * steps[-1]), top.n - 1)
            own, other = top.v.take(w, 0), top.v.take(noise, 0)
            real = _dots(guess, own) + top.b[w] - noise_log[w]
            down = _push(guess @ other.T + (top.b[noise] - noise_log[noise]), m)
            up = m / (1 + np.exp(np.clip(real, -30, 30)))
            dg = up[:, None] * own + down @ other
            dv, db = np.zeros_like(top.v), np.bincount(w, up, top.n).astype(np.float32)
            new = _starts(w)
            dv[w[new]] = np.add.reduceat(up[:, None] * guess, new)
            np.add.at(dv, noise, down.T @ guess)
            np.add.at(db, noise, np.ones(len(down), np.float32) @ down)
            deep = int(np.searchsorted(symbol, self.direct))
            if deep < len(symbol):
                x, g, mass = symbol[deep:] - self.direct, guess[deep:], m[deep:]
                dg[deep:] += self.mid.pull(x // self.leaf.group, g, mass, rng, rate)
                dg[deep:] += self.leaf.pull(x, g, mass, rng, rate)
            dc = np.stack([(dg * q1).sum(0), (dg * q2).sum(0)])
            rows, dq = _gathered(np.concatenate([one, two]), np.concatenate([dg * self.c[0], dg * self.c[1]]))
            sums = q_sums[rows] + _dots(dq, dq) / WIDTH
            q_sums[rows] = sums
            self.q[rows] = self.q.take(rows, 0) + dq * (rate / np.sqrt(sums))[:, None]
            top_sums += ((dv * dv).sum(1) + db * db)[:, None] / (WIDTH + 1)
            top.v += rate * dv / np.sqrt(top_sums)
            top.b += rate * db / np.sqrt(top_sums[:, 0])
            c_sums += dc * dc
            self.c += rate * dc / np.sqrt(c_sums)


def _log_sum(guess: np.ndarray, vectors: np.ndarray, bias: np.ndarray, small: bool = False) -> np.ndarray:
    """Logarithms of the sums of exp(score) over all vectors. small: no score is too large for exp; else the largest is taken out first."""
    s = guess @ vectors.T
    s += bias
    ones = np.ones(len(vectors), np.float32)
    if small:
        return np.log(np.exp(s, out=s) @ ones)
    top = s.max(1)
    s -= top[:, None]
    return top + np.log(np.exp(s, out=s) @ ones)


class Scorer:
    """Log10 probabilities of tokens in their contexts, with normalisers over the first level, the token's group and its class."""

    def __init__(self, model: Model) -> None:
        self.m = model

    def log10(self, token: np.ndarray, context: np.ndarray) -> np.ndarray:
        m = self.m
        pairs, where = np.unique(context, return_inverse=True)
        guess = m.guess(pairs)
        norm = float((guess * guess).sum(1).max(initial=0)) ** 0.5
        small = [level.reach(norm) < 60 for level in (m.top, m.mid, m.leaf)]
        log_z = np.concatenate([_log_sum(guess[k : k + 1024], m.top.v, m.top.b, small[0]) for k in range(0, len(pairs), 1024)] or [np.zeros(0, np.float32)])
        w = m.first(token)
        guess = guess.take(where, 0)
        out = (_dots(guess, m.top.v.take(w, 0)) + m.top.b[w] - log_z[where]).astype(np.float64)
        deep = np.flatnonzero(token >= m.direct)
        if len(deep):
            x, g = token[deep] - m.direct, guess.take(deep, 0)
            out[deep] += m.mid.log_share(x // m.leaf.group, g, small[1])
            out[deep] += m.leaf.log_share(x, g, small[2])
        return out / math.log(10)


_HEADS: dict[str, Head] = {}


def _held(sent) -> Head:
    """The head of a broadcast, built once in a process."""
    key, words, counts, buckets = sent.value
    if key not in _HEADS:
        _HEADS.clear()
        _HEADS[key] = Head(words, counts, buckets)
    return _HEADS[key]


def _learner(sent):
    """Trains on one shard from the parameters sent, and gives the changes of the symbols that it has."""

    def learn(table: pa.Table) -> pa.Table:
        unigram, before = sent.value
        n = len(unigram)
        texts = sorted(zip(table.column("doc_id").to_pylist(), table.column("tokens").to_pylist(), strict=True))
        token = np.frombuffer(b"".join(t for _, t in texts), np.int32).astype(np.int64)
        at = np.append(0, np.cumsum([len(t) // 4 for _, t in texts]))
        met = np.append(np.bincount(token, minlength=n), len(texts))
        token, context = trigrams(token, at, n)
        own = Model(n - 1, unigram).load(before)
        keys, weight = np.unique(context * n + token, return_counts=True)
        token, context = keys % n, keys // n
        own.train(token, context, weight, seed=table.column("shard")[0].as_py())
        change = own.rows() - before
        weights = np.append(met, np.full(len(change) - n - 1, len(token)))
        parts = []
        for lo in range(0, len(change), _PART):
            rows = lo + np.flatnonzero(weights[lo : lo + _PART])
            if len(rows):
                parts.append((lo // _PART, (rows - lo).astype(np.uint8).tobytes(), weights[rows].astype(np.int64).tobytes(), change[rows].astype(np.float16).tobytes()))
        shard = table.column("shard")[0].as_py()
        return pa.table({"team": pa.array([shard] * len(parts), pa.int64())} | {name: pa.array([p[i] for p in parts], kind) for i, (name, kind) in enumerate([("part", pa.int32()), ("rows", pa.binary()), ("weights", pa.binary()), ("values", pa.binary())])})

    return learn


def train(encoded: DataFrame, unigram: np.ndarray, shards: int, rounds: int = ROUNDS) -> Model:
    """What the shards of encoded (doc_id, shard, tokens as 32-bit symbols) teach: one pass over all of them, in rounds that each end with an average."""
    n = len(unigram)
    model = Model(n - 1, unigram)
    if n < 2:
        return model

    def out(table: pa.Table, sums: np.ndarray, total: np.ndarray) -> pa.Table:
        return pa.table({"part": table.column("part")[:1], "team": pc.divide(table.column("team")[:1], _TEAM), "sums": pa.array([sums.tobytes()], pa.binary()), "total": pa.array([total.tobytes()], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        sums, total = np.zeros((_PART, 2 * WIDTH + 1)), np.zeros(_PART)
        for rows, weights, values in zip(*(table.column(c).to_pylist() for c in ("rows", "weights", "values")), strict=True):
            rows, weights = np.frombuffer(rows, np.uint8), np.frombuffer(weights, np.int64)
            sums[rows] += np.frombuffer(values, np.float16).reshape(len(rows), -1) * weights[:, None]
            total[rows] += weights
        return out(table, sums, total)

    def add(table: pa.Table) -> pa.Table:
        both = [sum(np.frombuffer(x) for x in table.column(c).to_pylist()) for c in ("sums", "total")]
        return out(table, *both)

    for turn in range(rounds):
        sent = encoded.sparkSession.sparkContext.broadcast((unigram, model.rows()))  # HEAD and BUCKETS bound its size
        learned = encoded.where(F.col("shard") % rounds == turn).select("doc_id", "shard", "tokens").groupBy("shard").applyInArrow(_learner(sent), "team long, part int, rows binary, weights binary, values binary")
        moved, teams = learned.groupBy("part", F.expr(f"team div {_TEAM}")).applyInArrow(gather, _SUMS), -(-shards // _TEAM)
        while teams > 1:  # sums of sums, so no task gathers all shards
            moved, teams = moved.groupBy("part", F.expr(f"team div {_TEAM}")).applyInArrow(add, _SUMS), -(-teams // _TEAM)
        mean = model.rows()
        for part, sums, total in zip(*(moved.toArrow().column(c).to_pylist() for c in ("part", "sums", "total")), strict=True):
            lo = part * _PART
            change = np.frombuffer(sums).reshape(_PART, -1) / np.maximum(np.frombuffer(total), 1)[:, None]
            mean[lo : lo + _PART] += change[: len(mean) - lo].astype(np.float32)
        model.load(mean)
        sent.unpersist()
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "text")
    training = docs.where("not held_out")
    counts = count_tokens(training)
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = counts.where(F.col("c") * HEAD >= sums.n).toArrow()  # HEAD rows at most
    words, c = frequent.column("word").cast("binary").to_pylist(), np.asarray(frequent.column("c"))
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    words, c = [words[i] for i in order], c[order] if len(order) else np.zeros(0, np.int64)
    buckets = min(BUCKETS, max(1, -(-int(sums.v - len(words)) // BUCKET)))
    of = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(buckets)).cast("int").alias("bucket")
    dealt = counts.where(F.col("c") * HEAD < sums.n).groupBy(of).agg(F.sum("c").alias("c"), F.sum(F.col("c") + 1).alias("smooth")).toArrow()
    places, rest, of_rest = np.asarray(dealt.column("bucket")), np.ones(buckets), np.ones(buckets)  # 1 for what was never seen
    rest[places] += np.asarray(dealt.column("c"))
    of_rest[places] += np.asarray(dealt.column("smooth"))
    of_rest = np.log10(of_rest)
    unigram = np.append(c, rest).astype(float)
    unigram /= unigram.sum()
    sent = spark.sparkContext.broadcast((f"{sums.n}:{sums.v}:{id(words)}", words, c, buckets))
    shards = max(ROUNDS, -(-int(sums.n) // SHARD))
    smoothed = math.log10(sums.n + sums.v + 1)

    def encode(batches):
        head = _held(sent)
        log = np.append(np.log10(sent.value[2] + 1.0), 0.0)  # the last stands for what the head lacks
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                places, at, words = head.numbers(part.column("text").cast("binary").to_pylist())
                first = at[:-1]
                token = np.where(places < 0, head.size - 1 - places, places).astype(np.int32).tobytes()
                lists: list = [[] for _ in range(part.num_rows)]
                times: list = [[] for _ in range(part.num_rows)]
                for d in np.flatnonzero(np.add.reduceat(places < 0, first)).tolist():
                    lo, hi = int(at[d]), int(at[d + 1]) - 1
                    tail = Counter(words[d][i] for i in np.flatnonzero(places[lo:hi] < 0).tolist())
                    lists[d], times[d] = list(tail), list(tail.values())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "shard": part.column("shard"), "n_tokens": pa.array(np.diff(at)),
                    "known": pa.array(np.add.reduceat((places >= 0).astype(np.int64), first)), "gain": pa.array(np.add.reduceat(log[np.maximum(places, -1)], first)),
                    "tokens": pa.array([token[4 * x : 4 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                    "words": pa.array(lists, pa.list_(pa.binary())).cast(pa.list_(pa.string())), "times": pa.array(times, pa.list_(pa.int64())),
                })

    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(ASIDE)) == 0
    shard = F.when(aside, -1).otherwise(F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards))).cast("int").alias("shard")
    kind = "doc_id long, held_out boolean, shard int, n_tokens long, known long, gain double, tokens binary, words array<string>, times array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", shard, "text").mapInArrow(encode, kind).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "lm-rows")
    model = spark.sparkContext.broadcast(train(rows.where("not held_out and shard >= 0"), unigram, shards))
    plain = np.append(np.log10(c + 1.0), np.zeros(buckets)) - smoothed  # of a word in a bucket without its own c + 1, which both sides have

    def compared(scorer: Scorer, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probabilities of all tokens of the texts by the model and by counts, and where each text begins."""
        n = scorer.m.symbols
        at = np.append(0, np.cumsum([len(t) // 4 for t in texts]))
        token, context = trigrams(np.frombuffer(b"".join(texts), np.int32).astype(np.int64), at, n)
        sure = scorer.log10(token, context)
        other = np.flatnonzero(token >= n - buckets)
        sure[other] -= of_rest[token[other] - (n - buckets)]
        return sure, plain[token], at

    def weigh(batches):
        scorer, gained = Scorer(model.value), np.zeros(len(WEIGHTS))
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                sure, known, _ = compared(scorer, batch.column("tokens").slice(k, _ROWS).to_pylist())
                gained += [np.log1p(w * np.expm1((sure - known) * math.log(10))).sum() for w in WEIGHTS]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(WEIGHTS)), pa.int32()), pa.array(gained)], ["w", "gain"])

    gains = rows.where("not held_out and shard < 0").select("tokens").mapInArrow(weigh, "w int, gain double").groupBy("w").agg(F.sum("gain").alias("gain")).collect()
    best = max(gains, key=lambda r: (r.gain, -r.w), default=None)  # a row for each of WEIGHTS
    mixed = math.log(WEIGHTS[best.w]) if best is not None and WEIGHTS[best.w] > 0 else -math.inf
    left = math.log1p(-math.exp(mixed)) / math.log(10)
    mixed /= math.log(10)

    def score(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                sure, known, at = compared(scorer, part.column("tokens").to_pylist())
                both = np.logaddexp((sure + mixed) * math.log(10), (known + left) * math.log(10)) / math.log(10)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.add.reduceat(both, at[:-1]))], ["row", "sure"])

    sure = rows.select("row", "tokens").mapInArrow(score, "row long, sure double")
    tail = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = tail.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("met"))
    out = rows.drop("words", "times", "tokens").join(sure, "row").join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).cast("long").alias("n_known"), F.lit(int(sums.n)).cast("long").alias("train_tokens"),
        (F.col("gain") + more - F.col("n_tokens") * F.lit(smoothed)).alias("base_score"), (F.col("sure") + more).alias("score"),
    )
