"""Prefix tries, decontamination and hard negatives against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, hard_negatives, prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- prefix trie ---------------------------------------------------------------------------------------


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    for v in own.values():
        v.sort()
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = [x[2:] for x in own.get(c - (abs(c) % 100 if c >= 0 else -(-c % 100)), [])[:h]] + [x[2:] for x in own[c][h:]]
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    ended = {k: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], sha(ended[k])) for k, m in members.items())


def conversations(seed, n, longest, heads=()):
    rng, rows = random.Random(seed), []
    for c in [rng.randint(0, 900) for _ in range(n)] + [-5, -100, -230, 0, 100, *heads]:
        if any(r[0] == c for r in rows):
            continue
        first = rng.randint(0, 3)
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ü", "", None, "long text " * 3])) for t in range(first, first + rng.randint(1, longest))]
    return rows


def nodes_of(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).withColumn("k1", F.lit("clash")).withColumn("depth", F.lit(7)).repartition(5)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(frame))).collect()
    return got, sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def test_prefix_trie(spark):
    rows = conversations(3, 60, 7) + [(None, 1, "user", "x"), (7, None, "user", "first"), (8, 1, None, None), (800, 0, "u", "z" * 50_000)]
    got, nodes = nodes_of(spark, rows)
    assert nodes == plain_trie(rows)
    places = sorted((r.place, r.end_place, r.depth) for r in got)
    assert [p[0] for p in places] == list(range(1, len(got) + 1))  # a total order
    for place, end, depth in places:  # a subtree is a run of places, and what follows isn't deeper
        assert all(d > depth for p, _, d in places if place < p <= end)
        assert end == len(places) or places[end][2] <= depth


def test_prefix_trie_of_copies_and_of_one_long_conversation(spark):
    rng = random.Random(5)
    rows = [(c, t, "user", f"same {t}") for c in range(100, 400) for t in range(4)] + [(1000, t, "user", rng.choice("abc")) for t in range(3000)]
    rows += [(c, t, "user", "x" if t < c % 40 else f"own {c}") for c in range(500, 540) for t in range(45)]  # a comb: a long path with a branch at each node
    assert nodes_of(spark, rows)[1] == plain_trie(rows)


def test_prefix_trie_of_repeated_rows_and_of_nothing(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "a"), (2, 1, "user", "a"), (2, 2, "user", "a")]
    assert nodes_of(spark, rows)[1] == plain_trie(rows)
    assert nodes_of(spark, [])[1] == []


# --- decontamination -----------------------------------------------------------------------------------

DOCS, ITEMS = "doc_id long, text string, items string, row_ string", "item_id long, text string"


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items, window):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((-1 if doc is None else doc, len(w), len(hit), tuple(sorted(str(x) for x in names if x is not None)), tuple(sorted(hit))))
    return sorted(out)


def found_hits(spark, docs, items, **options):
    frame = spark.createDataFrame([(*d, "clash", "r") for d in docs], DOCS).repartition(3)
    found = decontaminate.scan(frame, spark.createDataFrame(items, ITEMS), **options)
    assert found.columns == ["doc_id", "text", "row_", *decontaminate.OUTPUTS]
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(p for s in r.spans for p in range(s.start, s.stop))) for r in found.collect())


def item_rows(rng, n, letters="abcd"):
    text = lambda size: " ".join(rng.choice(letters) for _ in range(size))
    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 30]) if i % 3 else rng.randint(8, 40))) for i in range(n)]
    return [*items, items[0], (None, text(15)), (77, None), (78, ""), (79, "!? --")]


@pytest.mark.parametrize(("window", "shard"), [(10, 1 << 19), (4, 1 << 19), (4, 60)])
def test_decontaminate(spark, window, shard):
    rng = random.Random(window)
    items = [r for r in item_rows(rng, 25, "abcdefgh") if len(plain_words(r[1])) not in (1, 2)]
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"Before, {text.upper() if text else ''}! and-after {text}") for i, (_, text) in enumerate(items)]
    docs += [(None, items[3][1]), (200, None), (201, ""), (202, " \n"), (100, docs[40][1]), (203, "ÄÖ " + (items[0][1] + "\x1f") * 3)]
    assert found_hits(spark, docs, items, window=window, shard_words=shard) == plain_hits(docs, items, window)


def test_decontaminate_short_items_and_long_words(spark):
    rng = random.Random(9)
    items = [*item_rows(rng, 12), (500, "w" * 90 + " " + "v" * 70 + " b"), (501, "W" * 91)]
    docs = [(i, " ".join(rng.choice("abcdxyz") for _ in range(50))) for i in range(10)] + [(11, "x " + "W" * 90 + "-" + "v" * 70 + ".b a"), (12, "w" * 91 + " " + "w" * 92)]
    assert found_hits(spark, docs, items, window=6) == plain_hits(docs, items, 6)


def test_decontaminate_long_text_in_stretches(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(14))) for i in range(5)]
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x"]) if rng.random() < 0.99 else items[rng.randint(0, 4)][1] for _ in range(3000))
    auto = decontaminate.Automaton([(i, decontaminate.item_words(t)) for i, t in items], 10)
    whole = decontaminate._hits(auto, *decontaminate._normal_buffer(__import__("pyarrow").array([text, "", text])))
    monkeypatch.setattr(decontaminate, "_STRETCH", 64)
    cut = decontaminate._hits(auto, *decontaminate._normal_buffer(__import__("pyarrow").array([text, "", text])))
    assert whole[0].tolist() == cut[0].tolist() and whole[1] == cut[1] and whole[1][1] is None
    assert sum(b - a for a, b in whole[1][0][0]) == plain_hits([(0, text)], items, 10)[0][2]


def test_decontaminate_nothing_and_removal(spark):
    items = [(1, "one two three four five"), (2, "six seven eight nine ten")]
    docs = [(1, "Well, One two-three four FIVE; then six"), (2, "one two three four five six seven eight nine ten x"), (3, "clean text"), (4, None)]
    assert found_hits(spark, [], items) == []
    assert found_hits(spark, docs, []) == plain_hits(docs, [], 10)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.clean_text) for r in decontaminate.decontaminate(frame, spark.createDataFrame(items, ITEMS), window=5, most=0.8).collect()}
    assert got == {1: (True, "Well, ; then six"), 2: (False, " x"), 3: (True, "clean text"), 4: (True, None)}


# --- hard negatives ------------------------------------------------------------------------------------

ROWS = "vec_id long, embedding array<double>, label int, rank string"


def plain_negatives(rows, k, m, least, most, every):
    good = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if i is not None and v and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, v, y in {(i, tuple(v), y) for i, v, y in good if i % every == 0}:
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, w, z in good if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == y][:k]:
            hits = [(i, -t) for t, i, z in scored if z != y and -least * s <= -100 * t <= -most * s][:m]
            out += [(a, p, n, i, -s, t) for n, (i, t) in enumerate(hits, 1)]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    return sorted((a, p, n, i, clip(s), clip(t)) for a, p, n, i, s, t in out)


def vectors(seed, n, width, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(size=width) * spread], int(rng.integers(0, 4))) for i in range(n)]


def found_negatives(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], ROWS).repartition(3)
    got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, **options)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives(spark):
    rows = vectors(1, 300, 7)
    rows += [rows[4], rows[10], (10, rows[11][1], 2), (400, None, 1), (401, [1.0, None] + [0.0] * 5, 1), (402, [float("nan")] + [0.0] * 5, 1), (403, rows[3][1], None), (None, rows[3][1], 1), (404, [], 1)]
    rows += [(500 + i, [0.5] * 7, i % 3) for i in range(30)]  # ties
    rows += vectors(2, 40, 3)  # other lengths
    assert found_negatives(spark, rows) == plain_negatives(rows, 5, 10, 30, 90, 10)


def test_hard_negatives_in_blocks_with_few_rows_and_large_numbers(spark):
    rows = vectors(3, 120, 4)
    assert found_negatives(spark, rows, positives=2, negatives=3, block=5) == plain_negatives(rows, 2, 3, 30, 90, 10)
    rows = vectors(4, 60, 4) + [(100 + i, [x * 2.0**k for x in v], y) for i, ((_, v, y), k) in enumerate(zip(vectors(5, 20, 4), [20, 30, 45, 60, 300] * 4, strict=True))]
    assert found_negatives(spark, rows) == plain_negatives(rows, 5, 10, 30, 90, 10)
    assert found_negatives(spark, []) == [] and found_negatives(spark, rows[:1]) == []


def test_limits_hold_and_filter():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(3000, 9)))
    books = hard_negatives.learn(x[:1000])
    codes, norms = hard_negatives.encode(x, books)
    low, up = hard_negatives.Anchors(np.arange(50), np.zeros(50), x[:50], books).limits(codes, norms)
    exact = x @ x[:50].T
    assert (low <= exact).all() and (exact <= up).all()
    assert (up - low).mean() < 0.5 * exact.std()
    for s in (0, 1, -1, 255, -256, 2**70, -(2**70)):
        assert hard_negatives.value(hard_negatives.spell(s)) == s
    numbers = [-(2**70), -300, -2, 0, 5, 256, 2**64, 2**70 + 1]
    assert sorted(numbers) == sorted(numbers, key=hard_negatives.spell)


def test_queries_are_registered():
    for name in ("op11_prefix_trie", "op12_decontaminate", "op13_hard_negatives"):
        assert name in queries.QUERIES and name in queries.ORACLES
