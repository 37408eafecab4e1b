"""Queries of whole runs: budgets, serial choice, arriving candidates, memos, counters and the guarded overwrite."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import choice, counters, prepare, report, select
from tessera.plans.catalog import _WON, _decided_classes
from tessera.session import shared_folder, stored, table
from tessera.sources import sinks
from tessera.streaming import memo
from tessera.streaming.winners import Winners, accepted

BUDGET = 12_345
_COST = "1 + event_id % 3"


def total_budget(spark, sf):
    """Events in the order of time until the run's budget is spent."""
    rows = table(spark, sf, "events").select("event_id", "ts")
    return select.within_total_budget(rows, ["ts", "event_id"], F.expr(_COST), BUDGET).select("event_id", "spent")


def budget_report(spark, sf):
    """The same run by hours: how many ended before the budget did."""
    rows = table(spark, sf, "events").select("event_id", "ts", F.date_trunc("hour", "ts").alias("hour"))
    return select.budget_report(rows, "hour", ["ts", "event_id"], F.expr(_COST), BUDGET)


def serial_choice(spark, sf):
    """Orders take, one after the other, the first part of their lines that no earlier order has."""
    chosen = choice.first_free(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    return chosen.select(F.col("name").alias("l_orderkey"), F.col("candidate").alias("l_partkey"))


def arriving_winners(spark, sf):
    """The two-stage cascade from candidates that arrive in three increments, the second query's first."""
    members, _, decided = _decided_classes(spark, sf)
    decided = stored(accepted(decided), "decided")
    winners = Winners(spark, f"{shared_folder(spark)}/winners-{uuid.uuid4().hex}", ["source_id"])
    late = F.col("query_index") == 1
    for number, part in enumerate((~late, late & (F.col("source_id") % 4 == 0), late & (F.col("source_id") % 4 != 0))):
        winners.add(decided.where(part), number)
        if number == 1:
            winners.compact()
    return prepare.of_members(winners.read(), members).select("source_id", "query_index", F.col("candidate_id").cast("long").alias("candidate_id"), "score")


def request_memo(spark, sf):
    """Requests of a stream that a memo of an hour answers, by kind."""
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").option("recursiveFileLookup", True).parquet(sf)
    answered = memo.remembered(stream, memo.request_key(F.col("user_id"), F.col("event_type")), "ts", ["ts", "event_id"], "1 hour")
    out = f"{shared_folder(spark)}/memo-{uuid.uuid4().hex}"
    query = answered.writeStream.format("parquet").option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start(out)
    query.awaitTermination()
    hits = spark.read.parquet(out)
    return hits.groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if("cache_hit").alias("cache_hits"))


def counters_by_day(spark, sf):
    """Counters of events kept by day and put together by kind: sums, exact numbers of users and keys, and whether the sketches' estimates agree."""
    events = table(spark, sf, "events")
    key = F.concat_ws("|", "user_id", "props")
    daily = counters.tallied(events.withColumn("day", F.to_date("ts")), ["day", "event_type"], {"requests": F.lit(1), "large": F.col("value") > 10}, {"users": F.col("user_id"), "keys": key})
    merged = counters.estimates(counters.together(stored(daily, "tallies").drop("day"), ["event_type"]))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct(key).alias("n_keys"))
    good = counters.within(F.col("users"), F.col("n_users")) & counters.within(F.col("keys"), F.col("n_keys"))
    return merged.join(exact, "event_type").select("event_type", "requests", "large", "n_users", "n_keys", good.alias("agree"))


def guarded_sync(spark, sf):
    """From sources to a stored list: matched, each candidate once in the sources' order, and put in the place of what was there."""
    _, _, decided = _decided_classes(spark, sf)  # a class goes by its smallest source, which is its first
    won = select.winners(decided).select("source_id", F.col("candidate_id").cast("long").alias("candidate_id"))
    chosen = won.groupBy("candidate_id").agg(F.min("source_id").alias("source_id"))
    listed = select.global_batches(chosen, ["source_id", "candidate_id"]).select(F.col("position").cast("long").alias("position"), "candidate_id")
    path = f"{shared_folder(spark)}/playlist-{uuid.uuid4().hex}"
    sinks.replace(listed, path, "position")
    return spark.read.parquet(path)


def alias_counters(spark, sf):
    """How alias queries went, by status, from three increments."""
    from tessera.plans.catalog import alias_strategies

    each = alias_strategies(spark, sf).withColumn("part", F.col("source_id") % 3)
    kinds = ["NOT_NEEDED", "SKIPPED_AMBIGUOUS", "SKIPPED_NO_ALIAS", "ATTEMPTED"]
    tallies = counters.tallied(each, ["part"], {k.lower(): F.col("status") == k for k in kinds})
    out = counters.together(stored(tallies, "tallies").drop("part"), [])
    return out.withColumn("attempt_rate", report.ratio(F.col("attempted"), sum((F.col(k.lower()) for k in kinds[1:]), F.lit(0))))


QUERIES = {f.__name__: f for f in (total_budget, budget_report, serial_choice, arriving_winners, request_memo, counters_by_day, guarded_sync, alias_counters)}

ORACLES = {
    "total_budget": f"SELECT event_id, spent FROM (SELECT event_id, sum({_COST}) OVER (ORDER BY ts, event_id)::BIGINT AS spent FROM events) WHERE spent <= {BUDGET}",
    "budget_report": f"""
WITH s AS (SELECT date_trunc('hour', ts) AS h, sum({_COST}) OVER (ORDER BY ts, event_id)::BIGINT AS spent FROM events),
g AS (SELECT h, count(*) AS n, count(*) FILTER (spent <= {BUDGET}) AS done, max(spent) FILTER (spent <= {BUDGET}) AS spent FROM s GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (n = done) AS completed, max(spent) AS spent, sum(done) < sum(n) AS stopped_early, CASE WHEN sum(done) < sum(n) THEN 'SEARCH_BUDGET_EXHAUSTED' END AS stop_reason FROM g""",
    "serial_choice": """
WITH RECURSIVE w AS (SELECT l_orderkey AS n, l_partkey AS c, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2),
r AS (
  SELECT 0 AS t, n, c, p FROM w
  UNION ALL
  SELECT t + 1, n, c, p FROM (
    SELECT *, bool_or(h < n) OVER () AS goes_on
    FROM (SELECT *, min(CASE WHEN k = 1 THEN n END) OVER (PARTITION BY c) AS h FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY p, c) AS k FROM r))
  ) WHERE goes_on AND NOT coalesce(h < n, false)
)
SELECT n AS l_orderkey, c AS l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY p, c) AS k FROM r WHERE t = (SELECT max(t) FROM r)) WHERE k = 1""",
    "arriving_winners": f"WITH {_WON} SELECT source_id, query_index, candidate_id, score FROM won",
    "request_memo": "SELECT event_type, count(*) AS requests, count(*) FILTER (n > 1) AS cache_hits FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, epoch_ms(ts) // 3600000 ORDER BY ts, event_id) AS n FROM events) GROUP BY 1",
    "counters_by_day": "SELECT event_type, count(*) AS requests, count(*) FILTER (value > 10) AS large, count(DISTINCT user_id) AS n_users, count(DISTINCT concat_ws('|', user_id, props)) AS n_keys, true AS agree FROM events GROUP BY 1",
    "guarded_sync": f"""WITH {_WON}, c AS (SELECT candidate_id, min(source_id) AS source_id FROM won GROUP BY 1)
SELECT row_number() OVER (ORDER BY source_id, candidate_id) - 1 AS position, candidate_id FROM c""",
    "alias_counters": """
WITH a AS (SELECT CASE WHEN p_size <= 10 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 WHEN p_size % 2 = 1 THEN 2 ELSE 3 END AS k FROM part)
SELECT count(*) FILTER (k = 0) AS not_needed, count(*) FILTER (k = 1) AS skipped_ambiguous, count(*) FILTER (k = 2) AS skipped_no_alias, count(*) FILTER (k = 3) AS attempted, count(*) FILTER (k = 3) / count(*) FILTER (k > 0)::DOUBLE AS attempt_rate FROM a""",
}
