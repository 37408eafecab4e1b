"""Converters between scripts, last titles, spellings, first artists and what is registered."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.convert import Phrases, converted
from tessera.operators import alias, decide, prepare, retrieve
from tessera.plans import fixtures, registry


def plain_convert(phrases, text):
    out, i = "", 0
    while i < len(text):
        best = max((p for p in phrases if p and text.startswith(p, i)), key=len, default=None)
        out, i = out + (phrases[best] if best else text[i]), i + (len(best) if best else 1)
    return out


def test_phrases_take_the_longest_match():
    rng = random.Random(1)
    for _ in range(200):
        phrases = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 4))): rng.choice(["x", "yy", ""]) for _ in range(6)}
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 20)))
        assert Phrases(phrases)(text) == plain_convert(phrases, text)


def test_converter_that_fails_makes_nothing_equivalent(spark):
    def convert(text):
        if "坏" in text:
            raise ValueError(text)
        return text.replace("汉", "漢")

    rows = [(1, "汉A", "漢A"), (2, "汉坏", "漢坏"), (3, None, "漢")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert [r.x for r in df.select("i", converted(F.col("a"), convert).alias("x")).sort("i").collect()] == ["漢a", None, ""]
    s = prepare.sources(spark.createDataFrame([(i, a, ["X"], "", 1) for i, a, _ in rows], fixtures.SOURCE), converter=convert)
    c = prepare.candidates(spark.createDataFrame([(i, 1, 1, f"t{i}", b, ["X"], "", 1, "") for i, _, b in rows], fixtures.CANDIDATE), converter=convert)
    got = {r.source_id: r.title2 for r in decide.decide(decide.signals(c.join(s, "source_id"))).collect()}
    assert got == {1: True, 2: False, 3: False}
    without = prepare.candidates(spark.createDataFrame([(1, 1, 1, "t1", "漢A", ["X"], "", 1, "")], fixtures.CANDIDATE)).join(prepare.sources(spark.createDataFrame([(1, "汉A", ["X"], "", 1)], fixtures.SOURCE)), "source_id")
    assert not decide.decide(decide.signals(without)).first().title2


def test_alias_is_the_last_title_of_its_key(spark):
    songs, artists, recordings, _ = fixtures.alias_tables(spark)
    releases = spark.createDataFrame([
        (2, "JP", "Official", [("CD", [("night train", "r7")])]), (1, "JP", "Official", [("CD", [("NIGHT TRAIN", "r7"), ("Night Train", "r7")])]),
    ], f"place int, {fixtures.RELEASE}")
    got = {r.song_id: (r.alias, r.evidence_count) for r in alias.discover(songs, artists, recordings, releases).collect()}
    assert got[1] == ("night train", 3)


def test_overrides_must_agree(spark):
    songs = spark.createDataFrame([(1, "One"), (2, "ONE"), (3, "Two")], "song_id long, title string")
    same = spark.createDataFrame([(1, "Uno"), (2, "Uno"), (3, None)], "song_id long, alias string")
    assert [tuple(r) for r in alias.overrides(songs, same).collect()] == [("one", "Uno")]
    other = spark.createDataFrame([(1, "Uno"), (2, "Un")], "song_id long, alias string")
    with pytest.raises(Exception, match="several aliases"):
        alias.overrides(songs, other).collect()


def test_overridden_titles_are_asked_under_the_first_artist(spark):
    s = prepare.sources(spark.createDataFrame([(1, "X", ["A", "B"], "", 1), (2, "X", ["B", "A"], "", 1)], fixtures.SOURCE))
    c = prepare.candidates(spark.createDataFrame([(0, 1, 1, "t1", "Other", ["A"], "", 1, "")], fixtures.CANDIDATE).drop("source_id", "query_index", "rank")).withColumn("c_order", F.lit(1).cast("long"))
    keys = spark.createDataFrame([(1, "other"), (2, "other")], "source_id long, title_key string")
    assert [r.source_id for r in retrieve.titled(s, c, keys, s.select("source_id").limit(0)).collect()] == [1]


def test_spelled(spark):
    rows = spark.createDataFrame([(1, "coc*ine  Diana", ["Olver  Cheatham", "B"]), (2, None, None), (3, "Title", ["C"])], "source_id long, title string, artists array<string>")
    assert [(r.q_title, r.q_artist) for r in retrieve.spelled(rows).sort("source_id").collect()] == [("Cocaine Diana", "Oliver Cheatham"), ("", ""), ("Title", "C")]


def test_baseline_document(spark, tmp_path):
    from tessera.operators import report
    from tessera.sources import readers

    (tmp_path / "b.json").write_text('{\n "reference_total": 140,\n "baseline_accepted": 97,\n "policy": {"x": true}\n}', encoding="utf-8")
    row = readers.baseline(spark, str(tmp_path / "b.json"))
    assert tuple(row.first()) == (140, 97, 0, 0)
    one = spark.createDataFrame([(99,)], "accepted int")
    assert report.with_baseline(one, row, 140, "reference_total", "baseline_accepted").first().delta == 2


def test_registry():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert {"near_title_pairs", "total_budget", "converted_titles", "match_exact_top1"} <= set(registry.ORACLES)
