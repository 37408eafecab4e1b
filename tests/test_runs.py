"""Whole runs: running sums, budgets, serial choice, arriving winners, the memo, counters and guarded writes."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import choice, counters, ordered, select
from tessera.sources import sinks
from tessera.streaming import memo
from tessera.streaming.winners import Winners, best_of, follow

MASK = 2**64 - 1


def plain_running(rows):
    """rows: (group, order, value) -> with the sum so far, before, and whether the group ends."""
    out, sums = [], {}
    ordered_rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for i, (g, o, v) in enumerate(ordered_rows):
        before = sums.get(g, 0)
        sums[g] = (before + (v or 0)) & MASK
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        out.append((g, o, signed(sums[g]), signed(before), i + 1 == len(rows) or ordered_rows[i + 1][0] != g))
    return out


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_running(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", "c", None, "long"]) if i % 3 else "long", i, rng.choice([None, 5, -7, 2**62, 2**63 - 1])) for i in range(400)]
    frame = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.running(frame, ["g"], ["o"], {"s": F.col("v")}, {"b": "s"}, last="end", keep=["g", "o"]).collect()
        every = ordered.running(frame, [], ["o"], {"n": F.lit(1)}, keep=["o"]).collect()
        few = ordered.running(frame, [], ["o"], {"n": F.lit(1)}, keep=["o"], upto=10).where("n <= 10").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    assert sorted(map(tuple, got), key=key) == plain_running(rows)
    assert sorted((r.o, r.n) for r in every) == [(i, i + 1) for i in range(400)]
    assert sorted(r.o for r in few) == list(range(10))
    assert ordered.running(frame.limit(0), ["g"], ["o"], {"s": F.col("v")}, last="end").count() == 0


def test_total_budget(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 50), rng.choice([None, 0, 1, 3, 10])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, ts long, cost long").repartition(6)
    for budget in (0, 57, 400, 10**6, -1):
        spent, want = 0, []
        for i, _, cost in sorted(rows, key=lambda r: (r[1], r[0])):
            spent += cost or 0
            if spent > budget:
                break
            want.append((i, spent))
        got = select.within_total_budget(frame, ["ts", "id"], F.col("cost"), budget)
        assert sorted((r.id, r.spent) for r in got.collect()) == sorted(want)
    with pytest.raises(Exception, match="below zero"):
        select.within_total_budget(frame, ["ts", "id"], F.lit(-1), 5).collect()


def test_total_budget_of_equal_rows(spark):
    frame = spark.createDataFrame([(1,)] * 200 + [(0,)] * 3, "x long").repartition(5)
    assert select.within_total_budget(frame, ["x"], F.lit(1), 120).groupBy("x").count().collect() in ([(0, 3), (1, 117)], [(1, 117), (0, 3)])


def test_budget_report(spark):
    rows = [(s, i) for s in range(6) for i in range(2)]
    frame = spark.createDataFrame(rows, "song long, i long")
    report = lambda budget: tuple(select.budget_report(frame, "song", ["song", "i"], F.lit(1), budget).first())
    assert report(5) == (6, 2, 5, True, "SEARCH_BUDGET_EXHAUSTED")
    assert report(12) == (6, 6, 12, False, None)
    assert tuple(select.budget_report(frame.limit(0), "song", ["song", "i"], F.lit(1), 3).first()) == (0, 0, 0, False, None)


def serial(rows):
    lists, taken, out = {}, set(), set()
    for n, p, c in sorted(r for r in rows if None not in r):
        lists.setdefault(n, []).append(c)
    for n in sorted(lists):
        pick = next((c for c in lists[n] if c not in taken), None)
        if pick is not None:
            taken.add(pick)
            out.add((n, pick))
    return out


def test_serial_choice(spark):
    rng = random.Random(4)
    rows = [(n, p, rng.randint(0, 25)) for n in range(60) for p in range(rng.randint(1, 5))] + [(100 + i, 0, 500 + i) for i in range(12)] + [(101 + i, -1, 500 + i) for i in range(11)]  # and a chain
    rows += [(None, 1, 3), (5, None, 900), (6, 1, None), rows[0], (rows[0][0], 9, rows[0][2])]
    frame = spark.createDataFrame(rows, "name long, place long, candidate long").repartition(3)
    assert {tuple(r) for r in choice.first_free(frame).collect()} == serial(rows)
    assert choice.first_free(frame.limit(0)).count() == 0


WINS = "source_id long, query_index int, rank int, candidate_id string, score int, input_index long"


def win_rows(seed=2):
    rng = random.Random(seed)
    return [(rng.randint(0, 20), rng.randint(1, 2), rng.randint(1, 10), f"t{rng.randint(0, 30)}", rng.randint(0, 4), i) for i in range(300)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_winners_of_any_split_are_those_of_all(spark, tmp_path, seed):
    rng, rows = random.Random(seed), win_rows()
    want = {}
    for r in sorted(rows, key=lambda r: (r[1], -r[4], r[2], r[3])):
        want.setdefault(r[0], r[:5])
    winners = Winners(spark, str(tmp_path / "w"), ["source_id"])
    with pytest.raises(FileNotFoundError):
        winners.read()
    assert winners.next_index("input_index") == 0
    part = [rng.randint(0, 4) for _ in rows]
    for number in range(5):
        mine = spark.createDataFrame([r for r, p in zip(rows, part, strict=True) if p == number], WINS)
        winners.add(mine, number)
        if rng.random() < 0.4:
            winners.compact()
        winners.add(mine, number)  # again, after a failure, say
    assert {tuple(r)[:5] for r in winners.read().collect()} == set(want.values())
    winners.compact()
    winners.compact()
    assert {tuple(r)[:5] for r in winners.read().collect()} == set(want.values())
    assert winners.next_index("input_index") == max(r[5] for r in winners.read().collect()) + 1


def test_winners_of_a_stream(spark, tmp_path):
    rows = win_rows()
    winners = Winners(spark, str(tmp_path / "w"), ["source_id"])
    for k in (1, 0):  # the second query's first
        spark.createDataFrame([r for r in rows if (r[1] == 1) == (k == 0)], WINS).write.parquet(str(tmp_path / "in"), mode="append")
        stream = spark.readStream.schema(WINS).parquet(str(tmp_path / "in"))
        follow(stream, lambda batch: batch, winners, str(tmp_path / "progress")).awaitTermination()
    whole = best_of(spark.createDataFrame(rows, WINS), ["source_id"], winners.order)
    assert {tuple(r)[:5] for r in winners.read().collect()} == {tuple(r)[:5] for r in whole.collect()}


def test_memo_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted((1_700_000_000 + t * 400, rng.choice(["a", "b", None]), t) for t in range(60))
    at = lambda r: (r[2], r[1], r[0])
    asked, want = set(), {}
    for s, q, i in rows:
        key = (q, s // 3600)
        want[i] = key in asked
        asked.add(key)
    for k in range(3):
        some = spark.createDataFrame([at(r) for r in rows[k * 20 : k * 20 + 20]], "id long, q string, s long").select("id", "q", F.timestamp_seconds("s").alias("ts"))
        some.repartition(2).write.parquet(str(tmp_path / "in"), mode="append")
        stream = spark.readStream.schema("id long, q string, ts timestamp").parquet(str(tmp_path / "in"))
        hits = memo.remembered(stream, memo.request_key(F.col("q")), "ts", ["ts", "id"], "1 hour", "2 hours")
        hits.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert {r.id: r.cache_hit for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_counters_by_increment(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 3), rng.choice("xy"), rng.randint(0, 900), rng.random() < 0.3) for _ in range(5000)]
    frame = spark.createDataFrame(rows, "part int, g string, k long, hit boolean")
    count = lambda by: counters.tallied(frame, by, {"n": F.lit(1), "hits": F.col("hit")}, {"keys": F.col("k")})
    merged = counters.together(counters.together(count(["part", "g"]), ["part", "g"]).drop("part"), ["g"])
    got = {r.g: r for r in counters.estimates(merged).collect()}
    whole = {r.g: r for r in counters.estimates(count(["g"])).collect()}
    for g in "xy":
        mine = [r for r in rows if r[1] == g]
        exact = len({r[2] for r in mine})
        assert (got[g].n, got[g].hits) == (len(mine), sum(r[3] for r in mine))
        assert abs(got[g]["keys"] - exact) <= 4 * counters.SPREAD * exact + 1 and abs(got[g]["keys"] - whole[g]["keys"]) <= 2


def test_replace_keeps_the_old_unless_all_is_there(spark, tmp_path):
    path = str(tmp_path / "list")
    rows = lambda *x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "position long, v string")
    read = lambda: [r.v for r in spark.read.parquet(path).sort("position").collect()]
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        runs.add(1)
        return v

    assert sinks.replace(rows("a", "b").withColumn("v", counted("v")), path, "position") == 2
    assert read() == ["a", "b"] and runs.value == 2  # the plan ran once
    with pytest.raises(sinks.NothingToWrite):
        sinks.replace(rows("a").where("v = 'z'"), path, "position")
    with pytest.raises(Exception, match="broken"):
        sinks.replace(rows("c", "d").withColumn("v", F.when(F.col("v") == "d", F.raise_error(F.lit("broken"))).otherwise(F.col("v"))), path, "position")
    assert read() == ["a", "b"]
    assert sinks.replace(rows("e"), path, "position") == 1 and read() == ["e"]
    assert [p.name for p in tmp_path.iterdir()] == ["list"]


def test_memo_asks_state_by_bucket_and_not_by_request(spark, tmp_path, monkeypatch):
    rng = random.Random(16)
    rows = [(i, rng.choice([None, "", *map(str, range(700))]), 1_700_000_000 + rng.randint(0, 7200)) for i in range(4000)]
    frame = spark.createDataFrame(rows, "id long, q string, s long").select("id", "q", F.timestamp_seconds("s").alias("ts"))
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    for buckets, most in ((1, 50_000), (8, 3)):
        monkeypatch.setattr(memo, "MOST_WAITING", most)
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        hits = memo.remembered(stream, memo.request_key(F.col("q")), "ts", ["ts", "id"], "1 hour", buckets=buckets)
        out = str(tmp_path / f"out{buckets}")
        query = hits.writeStream.format("parquet").option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start(out)
        query.awaitTermination()
        states = sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"])
        asked, want = set(), {}
        for i, q, s in sorted(rows, key=lambda r: (r[2], r[0])):
            want[i] = (q, s // 3600) in asked
            asked.add((q, s // 3600))
        assert {r.id: r.cache_hit for r in spark.read.parquet(out).collect()} == want
        assert states <= 20 * 3 * buckets  # of 1,900 requests in three periods
