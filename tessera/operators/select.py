"""Choosing rows: winners, cascades, first occurrences, budgets and ties.

All windows partition by a record's key, and take the place in retrieval as the last word on ties, so results don't
depend on how rows are spread. Ranks that are only compared with a constant let Spark cut partitions early.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import running
from tessera.session import stored


def top(df: DataFrame, by: list[str], order: list[Column], k: int = 1, offset: int = 0, name: str = "place") -> DataFrame:
    """Rows offset + 1 to offset + k of each group, with their place."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where((F.col(name) <= offset + k) & (F.col(name) > offset))


def cascade(accepted: DataFrame) -> DataFrame:
    """Rows of the first query of each source that has any."""
    first = F.min("query_index").over(Window.partitionBy("source_id"))
    return accepted.withColumn("_first", first).where("query_index = _first").drop("_first")


def winners(decided: DataFrame) -> DataFrame:
    """The accepted candidate with the best score of each source, the earliest retrieved of equals."""
    return top(cascade(decided.where("accepted")), ["source_id"], [F.desc("score"), F.asc("rank"), F.asc("candidate_id")]).drop("place")


def first_accepted(decided: DataFrame) -> DataFrame:
    """The replay's choice: the first accepted candidate of each source in order, whatever its score."""
    return top(decided.where("accepted"), ["source_id"], [F.asc("query_index"), F.asc("rank"), F.asc("candidate_id")]).drop("place")


def first_rejected(decided: DataFrame) -> DataFrame:
    return top(decided.where("not accepted"), ["source_id"], [F.asc("query_index"), F.asc("rank"), F.asc("candidate_id")]).drop("place")


def ordered_distinct(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return top(df, key, order, name="_place").drop("_place")


def unique_best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The best row of each group, if no other is as good; ambiguous groups have none."""
    w = Window.partitionBy(*by).orderBy(*order)
    best = df.withColumn("_rank", F.rank().over(w)).where("_rank = 1")
    return best.withColumn("_ties", F.count("*").over(Window.partitionBy(*by))).where("_ties = 1").drop("_rank", "_ties")


def best_with_ties(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def within_budget(df: DataFrame, by: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows of each group as long as their running cost stays in the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def within_total_budget(df: DataFrame, order: list[str], cost: Column, budget: int) -> DataFrame:
    """Rows of the whole order as long as their running cost (whole numbers, none below zero) stays in the budget, with spent: the run stops before the first row that would exceed it.

    Running costs are worked out in ranges of the order; ranges that begin beyond the budget aren't read again. Equal rows in the order go by all their columns."""
    everything = F.xxhash64(*df.columns)
    checked = F.coalesce(cost, F.lit(0)).cast("long")
    summed = running(df, [], [*order, everything, F.monotonically_increasing_id()], {"spent": F.when(checked >= 0, checked).otherwise(F.raise_error(F.lit("a cost below zero")))}, keep=df.columns, label="budget", upto=budget)
    return summed.where(F.col("spent") <= budget)


def budget_report(df: DataFrame, task: str, order: list[str], cost: Column, budget: int) -> DataFrame:
    """One row on a run of tasks under a budget for all: tasks, completed ones (all of whose rows are in the budget), what was spent, and whether and why it stopped early.

    A task is one that the run began and ended before it stopped; tasks begin in the order of their first rows."""
    inside = within_total_budget(df, order, cost, budget)
    done = inside.groupBy(task).agg(F.count("*").alias("_in"), F.max("spent").alias("_spent"))
    every = df.groupBy(task).agg(F.count("*").alias("_all"))
    met = every.join(done, task, "left").select(F.coalesce("_in", F.lit(0)).alias("_in"), "_all", "_spent")
    n, stopped = F.count("*"), F.coalesce(F.sum("_in"), F.lit(0)) < F.coalesce(F.sum("_all"), F.lit(0))
    return met.agg(
        n.alias("total"), F.count_if(F.col("_in") == F.col("_all")).alias("completed"), F.coalesce(F.max("_spent"), F.lit(0)).alias("spent"),
        stopped.alias("stopped_early"), F.when(stopped, "SEARCH_BUDGET_EXHAUSTED").alias("stop_reason"),
    )


def repeated_requests(df: DataFrame, request: list[str], order: list[str]) -> DataFrame:
    """Adds cache_hit: whether an equal request came before. The first place of each request is an aggregate, so a request of very many rows is in no single task."""
    place = F.struct(*order)
    first = df.groupBy(*request).agg(F.min(place).alias("_first"))
    both = df.alias("l").join(first.alias("r"), reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in request]))
    return both.select("l.*", (F.struct(*[F.col(f"l.{c}") for c in order]) != F.col("r._first")).alias("cache_hit"))


def global_batches(df: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """Adds position (0-based, over the whole order) and batch, without sorting everything in one task: rows are numbered inside range
    partitions, and the partitions' sizes, one number each, give the offsets. The ranged rows are stored first: their bounds come from a sample, which another run may draw otherwise."""
    spark = df.sparkSession
    ranged = stored(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), "batches")
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part int, _start long")  # a row for each range partition
    placed = numbered.join(F.broadcast(offsets), "_part").withColumn("position", F.col("_start") + F.col("_n") - 1)
    return placed.withColumn("batch", F.floor(F.col("position") / size)).drop("_part", "_n", "_start")
