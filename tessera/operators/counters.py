"""Counters that can be kept by increment and put together later: sums, and sketches of distinct values.

A sketch is a few kilobytes whatever it has seen, so the different keys of any stretch of increments are counted from what was stored with them,
without their rows. Its estimate is off by about ``SPREAD`` of the exact number; where that matters, exact counts stand beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_SIZE = 12
SPREAD = 1.04 / 2 ** (LOG_SIZE / 2)


def tallied(rows: DataFrame, by: list[str], sums: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """An increment's counters: a sum for each of sums (whole numbers or tests), and a sketch for each of distinct."""
    totals = [F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(n) for n, v in sums.items()]
    return rows.groupBy(*by).agg(*totals, *[F.hll_sketch_agg(v, F.lit(LOG_SIZE)).alias(f"{n}_sketch") for n, v in (distinct or {}).items()])


def together(tallies: DataFrame, by: list[str]) -> DataFrame:
    """Counters of several increments as one; the same columns, so it can be done again."""
    numbers = [c for c in tallies.columns if c not in by and not c.endswith("_sketch")]
    sketches = [c for c in tallies.columns if c.endswith("_sketch")]
    return tallies.groupBy(*by).agg(*[F.sum(c).alias(c) for c in numbers], *[F.hll_union_agg(c).alias(c) for c in sketches])


def estimates(tallies: DataFrame) -> DataFrame:
    """Counters with estimates in place of sketches."""
    return tallies.select(*[F.hll_sketch_estimate(c).alias(c.removesuffix("_sketch")) if c.endswith("_sketch") else F.col(c) for c in tallies.columns])


def within(estimate: Column, exact: Column, deviations: float = 4.0) -> Column:
    """Whether an estimate is as near as sketches are, but for one case in some ten thousand."""
    return F.abs(estimate - exact) <= F.ceil(deviations * SPREAD * exact)
