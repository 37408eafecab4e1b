"""Whole decisions, from cases that accept and near misses that don't."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import decide, prepare, select
from tessera.plans import fixtures

CASES = [
    # source title, artists, album, ms; candidate title, artists, album, ms; accepted
    ("Song (with Guest)", ["A"], "", 1000, "Song", ["A", "Guest"], "", 1000, True),
    ("Song", ["A"], "First", None, "Song", ["A"], "Second", None, True),
    ("Song", ["A"], "", None, "Song - Live", ["A"], "", None, False),
    ("Song", ["A"], "", None, "Oliver", ["A"], "", None, False),
    ("Song", ["A"], "Live at X", None, "Song - Live", ["A"], "Live in Y", None, True),
    ("Song", ["A"], "", None, "Song", ["A"], "A Tribute", None, False),
    ("Song", ["久石譲"], "", None, "Song", ["Joe Hisaishi"], "", None, True),
    ("Song", ["未知"], "Album", None, "Song", ["Unknown"], "Album", None, True),
    ("Song", ["未知"], "Album", None, "Song", ["Unknown"], "Else", None, False),
    ("Song", ["Olver Cheatham"], "", 200_000, "Song", ["Oliver Cheatham"], "", 201_000, True),
    ("Song", ["Olver Cheatham"], "", 200_000, "Song", ["Oliver Cheatham"], "", 260_000, False),
    ("Tune", ["Band"], "", None, "Tune", ["Other", "Band"], "Other plays Band", None, False),
    ("Song feat. Guest", ["A"], "", None, "Song", ["A", "Guest"], "", None, True),
    ("abcdefghijklmnop", ["A"], "", None, "abcdefghijklmnoq", ["A"], "", None, True),
    ("abcdef", ["A"], "", None, "abcdeg", ["A"], "", None, False),
    ("Song", ["A"], "", None, "Song", ["B"], "", None, False),
]


@pytest.fixture(scope="module")
def decided(spark):
    s = spark.createDataFrame([(i, c[0], c[1], c[2], c[3]) for i, c in enumerate(CASES)], fixtures.SOURCE)
    c = spark.createDataFrame([(i, 1, 1, f"t{i}", c[4], c[5], c[6], c[7], "") for i, c in enumerate(CASES)], fixtures.CANDIDATE)
    out = decide.decide(decide.signals(prepare.candidates(c).join(prepare.sources(s), "source_id")))
    return {r.source_id: r for r in out.select("source_id", "accepted", "reasons", "category", "score").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(decided, i):
    assert decided[i].accepted == CASES[i][-1], decided[i]


def test_missing_fields_are_empty(spark):
    s = spark.createDataFrame([(1, None, None, None, None)], fixtures.SOURCE)
    c = spark.createDataFrame([(1, 1, 1, None, None, None, None, None, None)], fixtures.CANDIDATE)
    r = decide.decide(decide.signals(prepare.candidates(c).join(prepare.sources(s), "source_id"))).first()
    assert not r.accepted and "missing id" in r.reasons


def test_winner_ties_go_by_rank_and_order_does_not_matter(spark):
    rows = [(1, 1, k, f"t{k}", True, 700) for k in (3, 1, 2)] + [(2, 2, 1, "x", True, 10), (2, 1, 1, "y", False, 900)]
    schema = "source_id long, query_index int, rank int, candidate_id string, accepted boolean, score int"
    for data in (rows, rows[::-1]):
        got = {r.source_id: r.candidate_id for r in select.winners(spark.createDataFrame(data, schema).repartition(3)).collect()}
        assert got == {1: "t1", 2: "x"}


def test_batches_of_many_range_partitions_number_each_row_once(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(400_000).select("id", F.xxhash64("id").alias("k"))
        got = select.global_batches(df, ["k", "id"]).agg(F.count_distinct("position").alias("n"), F.min("position").alias("low"), F.max("position").alias("high")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(got) == (400_000, 0, 399_999)


def test_repeated_requests(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", "x"), (4, "b", None), (5, "a", None)]
    got = {r.event_id: r.cache_hit for r in select.repeated_requests(spark.createDataFrame(rows, "event_id long, user string, props string"), ["user", "props"], ["event_id"]).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_batches_number_all_rows(spark):
    df = spark.range(1050).withColumn("k", F.xxhash64("id"))
    rows = select.global_batches(df, ["k", "id"]).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1050)) and [r.batch for r in rows] == [i // 100 for i in range(1050)]
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_verification_confirms_and_refuses(spark):
    got = {(r.source_id, r.candidate_id): r.accepted for r in fixtures.verification(spark).collect()}
    assert got == {(1, "t1"): True, (2, "t2"): False, (3, "t3"): False, (3, "t4"): True, (4, "t5"): True, (5, "t6"): False}


def test_alias_reasons(spark):
    from tessera.operators import alias

    got = {r.song_id: (r.reason, r.alias) for r in alias.discover(*fixtures.alias_tables(spark)).collect()}
    assert got[1] == ("UNIQUE_RELEASE_TITLE", "Night Train")
    assert got[2][0] == "RECORDING_IDENTITY_NOT_UNIQUE"
    assert got[3][0] == "NO_ALTERNATE_RELEASE_TITLE"
    assert got[4][0] == "ALTERNATE_TITLE_AMBIGUOUS"
    assert got[5][0] == "RECORDING_NOT_FOUND"
    assert got[6][0] == "ARTIST_IDENTITY_NOT_FOUND"


def test_alias_discovery_sends_no_table_to_the_driver(spark, tmp_path):
    import __spark_entry__

    parts = spark.range(1, 61).selectExpr("id AS p_partkey", "concat('name ', id) AS p_name", "concat('Brand#', id % 3) AS p_brand", "'T' AS p_type", "cast(id % 2 + 1 AS int) AS p_size")
    parts.write.parquet(str(tmp_path / "part.parquet"))  # so small that Spark would broadcast each side
    found = __spark_entry__.queries()["title_alias_discovery"](spark, str(tmp_path))
    got = {r.song_id: (r.reason, r.alias, r.evidence_count) for r in found.collect()}
    reasons = ["UNIQUE_RELEASE_TITLE", "RECORDING_IDENTITY_NOT_UNIQUE", "ALTERNATE_TITLE_AMBIGUOUS", "NO_ALTERNATE_RELEASE_TITLE", "RECORDING_NOT_FOUND", "ARTIST_IDENTITY_NOT_FOUND"]
    assert got == {i: (reasons[i % 6], *((f"name {i}", 1) if i % 6 == 0 else (None, None))) for i in range(1, 61)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_sources_and_pages(spark):
    from tessera.sources import readers

    songs = readers.daily_songs(fixtures.responses(spark)).orderBy("source_id").collect()
    assert [(s.title, s.artists, s.album, s.duration_ms) for s in songs] == [("One", ["A"], "Album", 1000), ("Two", ["B"], "X", 2000), ("", ["C"], "", None)]
    pages = readers.candidate_pages(fixtures.pages(spark)).orderBy("source_id", "query_index", "rank").collect()
    assert [(p.status, p.rank, p.candidate_id) for p in pages] == [("ok", 1, "t1"), ("ok", 2, "t2"), ("empty", None, None), ("failed", None, None), ("failed", None, None)]


def test_sinks_and_stream(spark, tmp_path):
    from tessera.sources import sinks
    from tessera.streaming.increments import decide_stream

    df = spark.range(5)
    sinks.replace(df, str(tmp_path / "out"), "id")
    with pytest.raises(sinks.NothingToWrite):
        sinks.replace(df.limit(0), str(tmp_path / "out"), "id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "out"))
    decide_stream(stream, lambda b: b.where("id > 2"), str(tmp_path / "res"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "res")).count() == 2


def test_small_reports(spark):
    from tessera.operators import report

    df = spark.createDataFrame([([["a", "b"], ["a"], ["b", "c"], ["c"]],)], "x array<array<string>>")
    assert df.select(report.first_unseen(F.col("x"))).first()[0] == ["a", None, "b", "c"]
    rows = spark.createDataFrame([(1, 2, 1, "late"), (1, 1, 2, "second"), (1, 1, 1, "first")], "g int, a int, r int, v string")
    assert report.first_detail(rows, "g", "a", "r").first().v == "first"
    one = spark.createDataFrame([(99, 140)], "accepted int, n int")
    base = spark.createDataFrame([(140, 97)], "reference_success_total int, accepted int")
    assert report.with_baseline(one, base, 140).first().delta == 2 and report.with_baseline(one, base, 5).first().delta is None
    verdict = report.code_verdict(F.array(F.lit("A")), F.lit("A"))
    assert spark.range(1).select(report.overall_verdict(F.lit(True), verdict)).first()[0] == "SAME"


def test_replay_and_failures(spark):
    from tessera.operators import report

    entries = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "input_index long, n_candidates int")
    chosen = spark.createDataFrame([(1, "x"), (3, "y")], "input_index long, candidate_id string")
    got = report.replay_report(entries, chosen, spark.createDataFrame([(1,)], "input_index long")).first()
    assert (got.total, got.with_candidates, got.accepted, got.newly_accepted, got.lost, got.rate_with_candidates) == (3, 2, 2, 1, 0, 1.0)
    failed = spark.createDataFrame([(1, "a"), (2, "b")], "input_index long, line string")
    missing = spark.createDataFrame([("b",)], "line string")
    got = report.failure_report(failed, missing, chosen.limit(0), chosen).first()
    assert (got.failed, got.accepted_before, got.accepted_now, got.candidate_ids) == (1, 0, 1, 1)


def test_text_files(spark, tmp_path):
    from tessera.sources import readers

    (tmp_path / "songs.txt").write_text("\ufeffOne - Two - A\n\nbad\nThree - B\n", encoding="utf-8")
    assert [(r.title, r.artist) for r in readers.song_lines(spark, str(tmp_path / "songs.txt")).orderBy("input_index").collect()] == [("One - Two", "A"), ("Three", "B")]
    (tmp_path / "alias.json").write_text('[{"source_title": "One", "artist": "A", "spotify_title": "Uno"}, {"source_title": "ONE", "artist": "a", "spotify_title": "Un"}]', encoding="utf-8")
    assert [tuple(r) for r in readers.title_aliases(spark, str(tmp_path / "alias.json")).collect()] == [("one", "a", "Un")]


def test_classes_of_records(spark):
    from tessera.operators import prepare

    rows = [(1, "A", ["x"]), (2, "A", ["x"]), (3, "A", None), (4, None, None), (5, "", None), (6, "A", ["x", None]), (7, None, None), (8, "A", [])]
    once, members = prepare.classes(spark.createDataFrame(rows, "source_id long, title string, artists array<string>").repartition(3))
    assert {r["source_id"] for r in once.collect()} == {1, 3, 4, 5, 6, 8}
    assert {r["source_id"]: r["class"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 4, 8: 8}
    assert {tuple(r) for r in prepare.of_members(once.select("source_id", "title"), members).select("source_id", "title").collect()} == {r[:2] for r in rows}


def test_foremost_of_equal_candidates(spark):
    from tessera.operators import prepare

    frame = spark.range(50).selectExpr("id AS candidate_id", "concat('t', id % 2) AS title", "array('a') AS artists", "'' AS album", "id AS duration_ms")
    assert sorted(r["candidate_id"] for r in prepare.foremost(frame, 3).collect()) == [0, 1, 2, 3, 4, 5]


def test_credit_identity_of_a_name_that_many_are_credited_as(spark):
    from tessera.operators import reference

    n = 3000  # each of n pairs with each of n artists of that name would be nine million rows
    pairs = spark.range(n).selectExpr("id AS source_id", "concat('c', id) AS candidate_id", "array('other', 'many') AS s_artist_keys", "array('one') AS c_artist_keys", "concat('I', id) AS c_isrc")
    credited = spark.range(n).selectExpr("concat('r', id) AS recording_mbid", "concat('a', id) AS artist_mbid", "explode(array('many', 'one')) AS name_key").where("name_key = 'one' or recording_mbid <> 'r7'")
    isrcs = spark.range(n).selectExpr("concat('I', id) AS isrc", "concat('r', id) AS mbid")
    names = spark.createDataFrame([("a0", "other")], "mbid string, name_key string")
    found = reference.credit_identity(pairs, names, credited, isrcs)
    assert {(r["source_id"], r["artist_mbid"]) for r in found.collect()} == {(i, f"a{i}") for i in range(n) if i != 7}
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert not any("Inner" in line and "isrc" not in line and "mbid" not in line for line in joins)  # no join on names alone


#: Queries that decide once for all sources of equal content.
BY_CONTENT = ["replay_of_candidates", "rank_consensus", "reject_category_hist", "replay_of_failures", "guarded_sync", "replay_first_accept", "decision_reasons", "free_artist_lookup", "cascade_two_stage", "match_report", "match_exact_top1"]


@pytest.mark.parametrize("name", BY_CONTENT)
def test_copies_are_decided_once(spark, tmp_path, monkeypatch, name):
    import __spark_entry__
    from tessera.operators import prepare

    parts = spark.range(1, 401).selectExpr("id AS p_partkey", "concat('name', id div 2 % 2) AS p_name", "'Brand#11' AS p_brand", "'T' AS p_type", "cast(id % 2 + 1 AS int) AS p_size")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    seen, real = [], prepare.sources

    def counted(df, *more, **options):
        seen.append(df.count())
        return real(df, *more, **options)

    monkeypatch.setattr(prepare, "sources", counted)
    __spark_entry__.queries()[name](spark, str(tmp_path))
    assert seen and max(seen) <= 8  # of 200 or 400 records with eight contents at most
