"""Small hand-made inputs for operators whose tables /root/testdata doesn't have: reference catalogues, responses and pages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import decide, prepare, reference, retrieve

SOURCE = "source_id long, title string, artists array<string>, album string, duration_ms long"
CANDIDATE = "source_id long, query_index int, rank int, candidate_id string, title string, artists array<string>, album string, duration_ms long, isrc string"
ARTIST = "mbid string, name string, sort_name string, aliases array<string>"
RECORDING = "mbid string, title string, length long, disambiguation string, credits array<struct<name:string,artist_mbid:string>>"
ISRC = "isrc string, mbid string"
RELEASE = "country string, status string, media array<struct<format:string,tracks:array<struct<title:string,recording_mbid:string>>>>"


def reference_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    artists = spark.createDataFrame([
        ("a1", "森の楽団", "Forest Band", ["Mori Band"]),
        ("a2", "海の歌手", "Singer, Sea", []),
        ("a3", "Sea Singer", "Sea Singer", ["海の歌手"]),
        ("a4", "River", "River", None),
    ], ARTIST)
    recordings = spark.createDataFrame([
        ("r1", "Night Train", 200_000, "", [("Forest Band", "a1")]),
        ("r2", "Morning", 180_000, "live", [("Sea Singer", "a3")]),
        ("r3", "Evening", 240_000, None, [("Sea Singer", "a3")]),
        ("r4", "Evening", None, "", [("Sea Singer", "a3")]),
    ], RECORDING)
    isrcs = spark.createDataFrame([("I1", "r1"), ("I2", "r2"), ("I3", "r3"), ("I4", "r4")], ISRC)
    return artists, recordings, isrcs


def pairs(spark: SparkSession) -> DataFrame:
    """Signalled pairs: confirmed by a recording, refused for a live one, for a far duration, and without a code."""
    s = spark.createDataFrame([
        (1, "Night Train", ["森の楽団"], "", 200_000), (2, "Morning", ["海の歌手"], "", 180_000), (3, "Evening", ["海の歌手"], "", 240_000),
        (4, "Evening", ["海の歌手"], "Dusk", 240_000), (5, "Lake", ["知らない人"], "", None),
    ], SOURCE)
    c = spark.createDataFrame([
        (1, 1, 1, "t1", "Night Train", ["Forest Band"], "", 201_000, "I1"), (2, 1, 1, "t2", "Morning", ["Sea Singer"], "", 180_000, "I2"), (3, 1, 1, "t3", "Evening", ["Sea Singer"], "", 300_000, "I3"),
        (3, 1, 2, "t4", "Evening", ["Sea Singer"], "", 300_000, "I4"), (4, 1, 1, "t5", "Evening", ["Sea Singer"], "Other", 241_000, ""), (5, 1, 1, "t6", "Lake", ["River"], "", None, "I9"),
    ], CANDIDATE)
    return decide.signals(prepare.candidates(c).join(prepare.sources(s), "source_id"))


def verification(spark: SparkSession) -> DataFrame:
    signalled = pairs(spark)
    gated = decide.decide(signalled).where("gate")
    verified = reference.verify(gated, *reference_tables(spark))
    done = decide.decide(signalled, verified)
    return done.select("source_id", "candidate_id", "gate", "identity", "accepted", F.array_join(F.array_sort("reasons"), "|").alias("reasons"))


def alias_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    artists, recordings, _ = reference_tables(spark)
    more = spark.createDataFrame([("r7", "夜汽車", 200_000, "", [("森の楽団", "a1")]), ("r8", "朝", 100_000, "", [("海の歌手", "a2")]), ("r9", "朝", 100_000, "", [("海の歌手", "a3")]), ("r10", "川", 1, "", [("River", "a4")]), ("r11", "波", 1, "", [("River", "a4")])], RECORDING)
    releases = spark.createDataFrame([
        ("XW", "Official", [("Digital Media", [("Night Train", "r7"), ("Other", "r1")])]),
        ("JP", "Official", [("CD", [("夜汽車", "r7"), ("Night Train", "r7"), ("川 (Live)", "r10")])]),
        ("JP", "Official", [("CD", [("Wave", "r11"), ("Waves", "r11")])]),
    ], RELEASE)
    songs = spark.createDataFrame([(1, "夜汽車", "森の楽団"), (2, "朝", "海の歌手"), (3, "川", "River"), (4, "波", "River"), (5, "夢", "River"), (6, "夢", "Nobody")], "song_id long, title string, artist string")
    return songs, artists, recordings.unionByName(more), releases


def romanised(spark: SparkSession) -> DataFrame:
    """What the second query finds under a Latin alias, for sources in Asian script whose first one came back empty."""
    s = prepare.sources(spark.createDataFrame([(1, "Night Train", ["森の楽団"], "", None), (2, "Night Train", ["River"], "", None), (3, "Night Train", ["海の歌手"], "", None)], SOURCE))
    c = prepare.candidates(spark.createDataFrame([(0, 0, 0, "t1", "Night Train", ["Forest Band"], "", None, ""), (0, 0, 0, "t2", "Night Train", ["Sea Singer"], "", None, "")], CANDIDATE).drop("source_id", "query_index", "rank")).withColumn("c_order", F.col("candidate_id"))
    artists, _, _ = reference_tables(spark)
    first = retrieve.strict(s, c, False, 1)
    failed = spark.createDataFrame([(3,)], "source_id long")
    return retrieve.romanised(s, c, reference.latin_alias(s, artists), first, failed)


def consensus(spark: SparkSession) -> DataFrame:
    ranked = pairs(spark).where("rank = 1")
    confirmed = reference_tables(spark)[2].select("isrc")
    matched = spark.createDataFrame([(1,)], "source_id long")
    return reference.rank_consensus(ranked, ranked, confirmed, matched).select("source_id", "candidate_id", F.col("c_isrc").alias("isrc"))


def responses(spark: SparkSession) -> DataFrame:
    songs = [
        {"name": "One", "ar": [{"name": "A"}, {"name": ""}, {}], "al": {"name": ""}, "album": {"name": "Album"}, "dt": 1000},
        {"name": "Two", "ar": [], "artists": [{"name": "B"}], "al": {"name": "X"}, "dt": 0, "duration_ms": 2000},
        {"name": None, "artist": [{"name": "C"}], "duration": "abc"},
    ]
    good = json.dumps({"code": 200, "data": {"dailySongs": songs}})
    rows = [(1, 200, good), (2, 401, good), (3, 500, good), (4, 200, "<html>"), (5, 200, '{"code": 301}'), (6, 200, '{"code": 500}'), (7, 200, '{"code": 200, "data": {}}'), (8, 200, '{"code": 200, "data": {"dailySongs": []}}')]
    return spark.createDataFrame(rows, "response_id long, http int, body string")


def pages(spark: SparkSession) -> DataFrame:
    item = {"id": "t1", "name": "One", "artists": [{"name": "A"}], "album": {"name": "X"}, "duration_ms": 5, "external_ids": {"isrc": "I"}}
    rows = [(1, 1, json.dumps({"tracks": {"items": [item, {"id": "t2"}]}})), (1, 2, '{"tracks": {"items": []}}'), (2, 1, '{"tracks": 5}'), (2, 2, None)]
    return spark.createDataFrame(rows, "source_id long, query_index int, body string")


__all__ = ["alias_tables", "consensus", "pages", "pairs", "reference_tables", "responses", "romanised", "verification"]
