"""Normalisation against plain Python, on awkward strings."""

import unicodedata

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.convert import converted

STRINGS = ["", "  Straße  ", "Ｆｕｌｌ ＆ Half", "间奏", "Σίσυφος", "A  B　C", 'say "hi" * now', "!!!", "Ünïcödé (feat. X) - 2011 Remaster", "Song (with Someone) [From Film]", 'Tune - From "Film"', "Name (Part 1)"]


def rows(spark, *columns):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)], "i int, s string")
    return df.select("s", *columns).orderBy("i").collect()


def test_keys_match_python(spark):
    def plain(s):
        s = unicodedata.normalize("NFKC", s).casefold().replace("&", "and").replace("间", "間")
        return "".join(c for c in s if c.isalnum())

    for r in rows(spark, X.key(X.fold("s")).alias("k"), X.basic_key(X.fold("s")).alias("b")):
        assert r.k == plain(r.s)
        assert r.b == "".join(c for c in unicodedata.normalize("NFKC", r.s).casefold() if c.isalnum())


def test_query_value(spark):
    for r in rows(spark, X.query_value(F.col("s")).alias("q")):
        assert r.q == " ".join(r.s.replace('"', " ").replace("*", " ").split())


def test_title_core(spark):
    got = {r.s: (r.c, r.k) for r in rows(spark, X.title_core(X.fold("s")).alias("c"), X.title_keys(X.title_core(X.fold("s"))).alias("k"))}
    assert got["Ünïcödé (feat. X) - 2011 Remaster"][0] == "ünïcödé"
    assert got["Song (with Someone) [From Film]"][0] == "song"
    assert got['Tune - From "Film"'][0] == "tune"
    assert got["Name (Part 1)"] == ("name (part 1)", ["namepart1", "name"])
    assert got["!!!"][1] == []


def test_version_terms_respect_words(spark):
    df = spark.createDataFrame([("oliver",), ("song - live",), ("remixed radio-edit",), ("alive",)], "s string")
    got = [sorted(r[0]) for r in df.select(X.version_terms(F.col("s"))).collect()]
    assert got == [[], ["live"], ["radioedit", "remix", "remixed"], []]


def test_natural_order_and_lines(spark):
    df = spark.createDataFrame([("Hisaishi, Joe",), ("Plain",), ("a, b, c",), ("久石, 譲",), (", x",)], "s string")
    assert [r[0] for r in df.select(X.natural_order(F.col("s"))).collect()] == ["Joe Hisaishi", "Plain", None, None, None]
    lines = spark.createDataFrame([("a - b - c",), ("no separator",), (" - x",), ("t - ",)], "s string")
    title, artist = X.split_line(F.col("s"))
    assert [tuple(r) for r in lines.select(title, artist).collect()] == [("a - b", "c"), (None, None), (None, None), (None, None)]


def test_cjk_status(spark):
    df = spark.createDataFrame([("间奏曲", "間奏曲"), ("a间", "b間"), ("same", "same")], "a string, b string")
    table = {"间": "間"}
    with_table = X.cjk_title_status(F.col("a"), F.col("b"), converted(F.col("a"), table), converted(F.col("b"), table), F.lit(False))
    without = X.cjk_title_status(F.col("a"), F.col("b"), None, None, F.lit(False))
    assert [tuple(r) for r in df.select(with_table, without).collect()] == [("CJK_EQUIVALENT", "NO_MATCH"), ("NO_MATCH", "NO_MATCH"), ("EXACT", "EXACT")]


def test_patterns_are_tried_only_where_their_marks_stand(spark):
    """Marks rule out no text that a pattern takes: the terms and cores are those of the patterns alone."""
    titles = ["", "  plain title ", "deluxe - edition", "re_release", "covers", "tributes", "re-mixes", "(remixes)", "dj mixed", "speed-up", "radioedit", "a (feat. b)", "a - [from c]", 'a - from "c"', "a - 2011 remastered", "a (2011 remaster)", "live from here", "(with b)", " [x] ", "discover olive", "　a(with b)　"]
    df = spark.createDataFrame([(t,) for t in [*titles, *X.V.ALL_TERMS]], "s string")
    out = X.strip(F.col("s"))
    for pattern in X.CORE_CUTS:
        out = F.regexp_replace(out, pattern, "")
    plain = F.array_compact(F.array(*[F.when(X.has("(?U)" + X.term_regex(t), F.col("s")), F.lit(t)) for t in X.V.ALL_TERMS]))
    rows = df.select("s", X.version_terms(F.col("s")).alias("terms"), plain.alias("plain"), X.title_core(F.col("s")).alias("core"), X.strip(out).alias("whole")).collect()
    assert all(r.terms == r.plain and r.core == r.whole for r in rows) and sum(bool(r.terms) for r in rows) > 20
    assert all(X.term_mark(t) for t in X.V.ALL_TERMS) and X.term_mark("cover") == "cover"
