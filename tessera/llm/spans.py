"""Spans of regular-expression matches in texts, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def match_spans(text: Column, pattern: str, kind: int, holds=None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans in code points (stop exclusive). holds: a test of group's text; failing matches are dropped.

    What split leaves between matches and the matches themselves alternate, so their lengths add up to the places."""
    regex = F.lit(pattern)

    def of(gaps: Column) -> Column:
        def with_matches(found: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

            def step(acc: Column, i: Column) -> Column:
                begin = acc["at"] + F.char_length(F.get(gaps, i))
                stop = begin + F.char_length(F.get(found, i))
                return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))).alias("out"))

            placed = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])
            if holds is None:
                return placed
            tested = F.regexp_extract_all(text, regex, F.lit(group)) if group else found
            return let(tested, lambda t: F.filter(placed, lambda s, i: holds(F.get(t, i))))

        return let(F.regexp_extract_all(text, regex, F.lit(0)), with_matches)

    return F.when(F.regexp_like(text, regex), let(F.split(text, pattern, -1), of)).otherwise(no_spans())


def in_order(spans: Column) -> Column:
    """Sorted by start, then kind."""
    return F.array_sort(spans)


def spelled(spans: Column, kinds: list[str]) -> Column:
    """kind:start:stop, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def of_kinds(spans: Column, below: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] < below)
