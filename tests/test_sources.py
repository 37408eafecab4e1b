"""Readers, sinks and small operators on hand-made inputs."""

import json

from pyspark.sql import functions as F

from tessera.functions import compare as P
from tessera.functions import text as X
from tessera.operators import alias, decide, prepare, reference, retrieve, select
from tessera.plans import fixtures
from tessera.sources import readers, sinks


def test_lines_are_numbered_without_gaps(spark, tmp_path):
    path = tmp_path / "songs.txt"
    path.write_text("\ufeffOne - A\n\nno artist\nTwo - B\n - \nThree - Part - C\n", encoding="utf-8")
    got = [tuple(r) for r in readers.song_lines(spark, str(path)).orderBy("input_index").collect()]
    assert got == [(0, "One", "A"), (1, "Two", "B"), (2, "Three - Part", "C")]
    assert {r.line for r in readers.line_keys(spark, str(path)).collect()} == {"One - A", "no artist", "Two - B", "-", "Three - Part - C"}


def test_saved_candidates_keep_the_first_place_and_the_last_values(spark, tmp_path):
    c = lambda i, title: {"rank": 1, "spotify_track_id": i, "title": title, "artists": ["A"], "album": "X", "isrc": "I"}
    path = tmp_path / "saved.json"
    path.write_text(json.dumps({"tracks": [{"input_index": 4, "source_title": "T", "source_artist": "A", "strategies": {"one": {"candidates": [c("a", "old"), c("b", "B")]}, "two": {"candidates": [c("a", "new")]}}}]}))
    got = {r.candidate_id: (r.title, tuple(r.position)) for r in readers.saved_candidates(spark, str(path)).collect()}
    assert got == {"a": ("new", (0, 0)), "b": ("B", (0, 1))}


def test_title_aliases(spark, tmp_path):
    path = tmp_path / "aliases.json"
    path.write_text(json.dumps([{"source_title": "夜汽車", "artist": "A", "spotify_title": "Night Train"}, {"source_title": "夜汽車", "artist": "A", "spotify_title": "Night Train II"}]))
    assert [r.alias for r in readers.title_aliases(spark, str(path)).collect()] == ["Night Train II"]


def test_documents_batches_and_increments(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id long, t string")
    assert {r.document for r in sinks.as_json(df).collect()} == {'{"id":1,"t":"é"}', '{"id":2,"t":null}'}
    sinks.append_batches(df, str(tmp_path / "b"), ["id"], 1)
    assert {(r.id, r.position, r.batch) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {(1, 0, 0), (2, 1, 1)}
    for _ in range(2):  # written again, it replaces itself
        sinks.write_increment(df, str(tmp_path / "i"), "id", 2)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "i")).collect()] == [2]


def test_titles_for_retrieval(spark):
    row = spark.range(1).select(
        X.retrieval_title(F.lit("song (part one)"), F.lit("raw")).alias("a"), X.retrieval_title(F.lit("(all)"), F.lit("raw")).alias("b"), X.retrieval_title(F.lit(""), F.lit("raw")).alias("c"),
        X.romanised_retrieval_title(F.lit("Wo Bocci world")).alias("d"), retrieve.query_text(F.lit('A "b"'), F.lit("C*"), F.lit("")).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("song", "(all)", "raw", "o botchi world", 'track:"A b" artist:"C"')


def test_second_query_with_another_title(spark):
    s = prepare.sources(spark.createDataFrame([(1, "夜汽車", ["A"], "", None), (2, "Lake", ["A"], "", None)], fixtures.SOURCE))
    c = prepare.candidates(spark.createDataFrame([(0, 0, 0, "t1", "Night Train", ["A"], "", None, ""), (0, 0, 0, "t2", "Lake", ["A"], "", None, "")], fixtures.CANDIDATE).drop("source_id", "query_index", "rank")).withColumn("c_order", F.col("candidate_id"))
    overrides = spark.createDataFrame([(1, "nighttrain"), (2, "nighttrain")], "source_id long, title_key string")
    first = retrieve.strict(s, c, False, 1)
    assert [(r.source_id, r.candidate_id) for r in retrieve.titled(s, c, overrides, first).collect()] == [(1, "t1")]


def test_names_by_which_artists_are_asked_for(spark):
    artists = fixtures.reference_tables(spark)[0]
    s = prepare.sources(spark.createDataFrame([(1, "x", ["森の楽団"], "", None), (2, "x", ["海の歌手"], "", None), (3, "x", ["River"], "", None)], fixtures.SOURCE))
    assert {(r.source_id, r.alternate) for r in alias.alternate_name(artists, s).collect()} == {(1, "Mori Band")}
    assert {(r.source_id, r.alias) for r in reference.latin_alias(s, artists).collect()} == {(1, "Forest Band"), (2, "Sea Singer")}
    placed = artists.withColumn("place", F.when(F.col("mbid") == "a3", 0).otherwise(1))
    assert {(r.source_id, r.alias) for r in reference.latin_alias(s, placed).collect()} == {(1, "Forest Band"), (2, "Sea Singer")}


def test_explanations_and_first_rejected(spark):
    signalled = fixtures.pairs(spark)
    d = decide.decide(signalled)
    from tessera.operators import report

    rows = {(r.source_id, r.candidate_id): r for r in report.explanation(d).collect()}
    assert rows[(1, "t1")].signals.artist == 35 and rows[(1, "t1")].signals.gate and not rows[(1, "t1")].accepted
    assert {(r.source_id, r.candidate_id) for r in select.first_rejected(d).collect()} == {(1, "t1"), (2, "t2"), (3, "t3"), (4, "t5"), (5, "t6")}


def test_popular_keys_are_cut_before_the_join(spark):
    s = prepare.sources(spark.range(50).select(F.col("id").alias("source_id"), F.lit("Song").alias("title"), F.array(F.lit("A"), F.lit("B")).alias("artists"), F.lit("").alias("album"), F.lit(None).cast("long").alias("duration_ms")))
    c = prepare.candidates(spark.range(200).select(F.col("id").cast("string").alias("candidate_id"), F.lit("Song").alias("title"), F.array(F.when(F.col("id") % 2 == 0, "A").otherwise("B")).alias("artists"), F.lit("").alias("album"), F.lit(None).cast("long").alias("duration_ms"))).withColumn("c_order", F.col("candidate_id").cast("long"))
    got = retrieve.strict(s, c, False, 1, k=3, offset=2).where("source_id = 7").orderBy("rank").collect()
    assert [(r.candidate_id, r.rank) for r in got] == [("2", 3), ("3", 4), ("4", 5)]


def test_similar_keys_are_those_of_the_exact_ratio(spark):
    import difflib

    words = ["abcdefghijklmnop", "abcdefghijklmnoq", "abcdefghijklmno", "bcdefghijklmnop", "abcdefgh", "abcdefgi", "", "zzzzzzzzzzzzzzzzzzzzzzzz", "zzzzzzzzzzzzzzzzzzzzzzzzz"]
    df = spark.createDataFrame([([a], [b]) for a in words for b in words], "x array<string>, y array<string>")
    for r in P.with_similar(df, ("x", "y")).select("x", "y", P.keys_match(F.col("x"), F.col("y"), 0).alias("m")).collect():
        a, b = r.x[0], r.y[0]
        assert r.m == (a == b or abs(len(a) - len(b)) <= 3 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92), (a, b)
