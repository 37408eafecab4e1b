"""Near and ranked lookups against comparisons of all pairs."""

import collections
import difflib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import compare as P
from tessera.operators import prepare, reference, retrieve, search, similarity
from tessera.plans import fixtures


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        kind, at = rng.randint(0, 2), rng.randint(0, len(out))
        if kind == 0 or not out:
            out.insert(at, rng.choice("abcé漢"))
        elif kind == 1:
            del out[min(at, len(out) - 1)]
        else:
            out[min(at, len(out) - 1)] = rng.choice("abc")
    return "".join(out)


def key_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefé漢") for _ in range(rng.choice([0, 1, 3, 6, 8, 12, 13, 20, 25, 40]))) for _ in range(50)]
    return base + [changed(rng, b, rng.randint(0, 3)) for b in base], [changed(rng, b, rng.randint(0, 4)) for b in base for _ in range(2)]


@pytest.mark.parametrize(("percent", "longer", "part"), [(8, 3, 4096), (8, 3, 2), (15, 1, 4096)])
def test_near_pairs(spark, percent, longer, part):
    left, right = key_rows(percent)
    frame = lambda keys: spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "key string")
    got = [tuple(r) for r in similarity.near_pairs(frame(left), frame(right), percent, longer, part=part).collect()]
    want = {(a, b): distance(a, b) for a in set(left) for b in set(right) if abs(len(a) - len(b)) <= longer and 100 * distance(a, b) <= percent * (len(a) + len(b))}
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want
    assert sum(d > 0 for d in want.values()) > 20


def test_near_pairs_hold_all_of_the_ratio(spark):
    left, right = key_rows(1)
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r.left_key, r.right_key) for r in similarity.near_pairs(frame(left), frame(right)).collect()}
    close = {(a, b) for a in set(left) for b in set(right) if abs(len(a) - len(b)) <= 3 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92}
    assert close <= got
    rows = spark.createDataFrame([(a, b, [a], [b]) for a, b in sorted(got)], "a string, b string, x array<string>, y array<string>")
    similar = P.with_similar(rows, ("x", "y")).select("a", "b", P.keys_match(F.col("x"), F.col("y"), 0).alias("similar"))
    assert {(r.a, r.b) for r in similar.collect() if r.similar} == close


def test_near_pairs_of_one_popular_piece(spark):
    keys = [f"thesamelongbeginningofall{i:03d}" for i in range(150)]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {tuple(r) for r in similarity.near_pairs(frame, frame, part=16).collect()}
    assert got == {(a, b, distance(a, b)) for a in keys for b in keys if 100 * distance(a, b) <= 8 * 56}
    assert similarity.near_pairs(frame.limit(0), frame).count() == 0


def catalogue(spark):
    s = spark.createDataFrame([(1, "Night Train Home", ["A"], "", 1), (2, "Night Trane Home", ["A"], "", 1), (3, "Night Trane Home", ["A"], "", 1), (4, "Elsewhere", ["A"], "", 1)], fixtures.SOURCE)
    c = spark.createDataFrame([(0, 1, 1, f"t{i}", t, ["A"], "", 1, "") for i, t in enumerate(["Night Train Home", "Night Trains Home", "Night Train Home!", "Elsewhere Else"])], fixtures.CANDIDATE).drop("source_id", "query_index", "rank")
    return prepare.sources(s), prepare.candidates(c).withColumn("c_order", F.substring("candidate_id", 2, 9).cast("long"))


def test_near_retrieval(spark):
    s, c = catalogue(spark)
    first = retrieve.strict(s, c, False, 1)
    assert {r.source_id for r in first.collect()} == {1}
    failed = spark.createDataFrame([(3,)], "source_id long")
    got = sorted((r.source_id, r.rank, r.candidate_id, r.distance) for r in retrieve.near(s, c, first, failed).collect())
    assert got == [(2, 1, "t0", 2), (2, 2, "t1", 2), (2, 3, "t2", 2)]  # a failed query is not an empty one


def plain_ranks(queries, records, k):
    having = collections.Counter(t for _, ts in records for t in set(ts or ()) - {None})
    out = set()
    for q, ts in queries:
        scored = [(-sum((len(records) // having[t]).bit_length() for t in set(ts or ()) & set(d or ()) - {None}), i) for i, d in records]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)}
    return out


@pytest.mark.parametrize(("common", "k"), [(1000, 10), (25, 10), (0, 3)])
def test_ranked(spark, common, k):
    rng = random.Random(common)
    pick = lambda n: [f"w{min(59, int(rng.expovariate(0.12)))}" for _ in range(n)]
    records = [(i, pick(rng.randint(0, 6))) for i in range(200)] + [(900, None), (901, ["w0", None, "w0"])]
    queries = [(i, pick(rng.randint(0, 4))) for i in range(60)] + [(500, None), (501, ["unknown"]), (502, ["w1", "w1"]), (503, [None])]
    got = search.ranked(spark.createDataFrame(queries, "query_id long, terms array<string>"), spark.createDataFrame(records, "record_id long, terms array<string>"), k, common)
    assert {tuple(r) for r in got.collect()} == plain_ranks(queries, records, k)


def test_ranked_of_nothing(spark):
    some, none = spark.createDataFrame([(1, ["a"])], "id long, terms array<string>"), spark.createDataFrame([], "id long, terms array<string>")
    for q, r in ((some, none), (none, some)):
        assert search.ranked(q, r, query_id="id", record_id="id").count() == 0


def test_lookup_takes_exact_artists_of_the_first_five(spark):
    rows = [(f"m{i}", "Common Name", None, []) for i in range(7)] + [("n1", "Other", "Singer, Sea", ["ＳＥＡ ｓｉｎｇｅｒ"]), ("n2", "Sea Singers", None, None), ("n3", "Sea", None, None), ("n4", None, None, ["Sea-Singer"])]
    artists = spark.createDataFrame(rows, fixtures.ARTIST)
    names = spark.createDataFrame([("common name",), ("Sea Singer",), ("Sea",), ("Nobody",), (None,), ("",), ("Sea Singer",)], "name string")
    got = sorted(tuple(r) for r in reference.lookup(names, artists).collect())
    assert got == [("Sea", 3, "n3"), ("Sea Singer", 1, "n1"), ("Sea Singer", 2, "n4"), *[("common name", i + 1, f"m{i}") for i in range(5)]]


def test_free_artist_text_ranks_and_excludes_nothing(spark):
    s = prepare.sources(spark.createDataFrame([(1, "Song", ["歌手", "Blue Band"], "", 1), (2, "Song", ["歌手"], "", 1), (3, "Song", ["Blue Band"], "", 1)], fixtures.SOURCE))
    c = spark.createDataFrame([(0, 1, 1, f"t{i}", t, a, al, 1, "") for i, (t, a, al) in enumerate([("Song", ["Red"], ""), ("Song", ["Band"], "Blue"), ("Song", ["Blue"], ""), ("Other", ["Blue Band"], "")])], fixtures.CANDIDATE).drop("source_id", "query_index", "rank")
    c = prepare.candidates(c).withColumn("c_order", F.substring("candidate_id", 2, 9).cast("long"))
    none = s.select("source_id").limit(0)
    got = sorted((r.source_id, r.rank, r.candidate_id) for r in retrieve.relaxed(s, c, none, none).collect())
    assert got == [(1, 1, "t1"), (1, 2, "t2"), (1, 3, "t0"), (2, 1, "t0"), (2, 2, "t1"), (2, 3, "t2")]
