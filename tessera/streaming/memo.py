"""A memo of requests across micro-batches: the first of each kind of request in a period is asked, equal ones are answered from memory.

Requests of a period are dealt into buckets by a hash; keyed state holds the requests that a bucket was asked for, and a timer forgets them once the watermark
has passed the period's end. Periods are fixed stretches of event time, so what is a hit doesn't depend on how arrivals in order are cut into batches. A batch reads
and adds to a bucket's state once, not once a request, as each such step goes to the JVM and back. Of a request's rows in a batch one is held back, and up to
MOST_WAITING others of its bucket, so a popular request needs no room. Without a period an answer is kept for good.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a bucket that wait to be compared, unless more requests are held back; and parts of a bucket's state that are put together.
MOST_WAITING, MOST_PARTS = 50_000, 32


def request_key(*parts: Column) -> Column:
    """One text for a request; null and empty parts differ, and no parts run into each other."""
    return F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"})


class _Memo(StatefulProcessor):
    """A bucket of one period's requests: whole frames are compared with the requests that it was asked for, which are read once a batch and added to in one step."""

    def __init__(self, columns: list[str], order: list[str], period_ms: int | None, lateness_ms: int) -> None:
        self.columns, self.order, self.period, self.lateness = columns, order, period_ms, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getListState("asked", "requests string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [json.loads(r) for (r,) in self.asked.get()] if self.asked.exists() else []
        asked = {request for part in kept for request in part}
        firsts, waiting, n = None, [], 0
        for frame in rows:
            frame.columns = [*self.columns, "memo_key", "memo_ts", "memo_period", "memo_bucket"]  # by place: names that begin with a line come under others
            known = frame["memo_key"].isin(asked)
            if known.any():
                yield self._answered(frame[known], True)
                frame = frame[~known]
            waiting.append(frame)
            n += len(frame)
            if n > max(MOST_WAITING, 0 if firsts is None else len(firsts)):
                firsts, others = self._first(firsts, waiting)
                waiting, n = [], 0
                yield self._answered(others, True)
        firsts, others = self._first(firsts, waiting)
        if len(others):
            yield self._answered(others, True)
        if len(firsts):
            fresh = firsts["memo_key"].tolist()
            if len(kept) >= MOST_PARTS:
                self.asked.put([(json.dumps([*asked, *fresh]),)])
            else:
                self.asked.appendValue((json.dumps(fresh),))
            if self.period is not None and not kept:
                self.handle.registerTimer((int(key[0]) + 1) * self.period + self.lateness)
            yield self._answered(firsts, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.asked.clear()
        return iter([])

    def close(self) -> None:
        pass

    def _first(self, firsts: pd.DataFrame | None, waiting: list[pd.DataFrame]) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The earliest row of each request, and the others."""
        every = pd.concat([*([] if firsts is None else [firsts]), *waiting]) if firsts is not None or len(waiting) != 1 else waiting[0]
        every = every.sort_values(self.order, kind="stable")
        again = every["memo_key"].duplicated()
        return every[~again], every[again]

    def _answered(self, frame: pd.DataFrame, hit: bool) -> pd.DataFrame:
        return frame[self.columns].assign(cache_hit=hit)


def remembered(requests: DataFrame, key: Column, ts: str, order: list[str], period: str | None = None, lateness: str = "1 day", buckets: int | None = None) -> DataFrame:
    """A stream with cache_hit: whether an equal request came before in its period (a length such as '1 hour'; none: ever). order tells rows of a batch apart, the earliest is asked.

    buckets: parts of a period, each of which a batch with rows of it reads whole and one task answers; with many, fewer requests are read, but more groups are begun. 16 of a period and, as answers
    are then kept for good, 65,536 without one. Rows without a time, and rows that come later than lateness behind the latest, are dropped, as watermarks do. The session needs the state store STORE."""
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    length = None if period is None else ms(period)
    columns = requests.columns
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    keyed = requests.where(F.col(ts).isNotNull()).withColumns({"memo_key": text, "memo_ts": F.col(ts).cast("timestamp"), "memo_period": F.lit(0).cast("long") if length is None else F.floor(at / length).cast("long")})
    keyed = keyed.withColumn("memo_bucket", F.pmod(F.xxhash64("memo_key"), F.lit(buckets or (65_536 if length is None else 16))))
    marked = keyed.withWatermark("memo_ts", lateness)
    out = T.StructType([*requests.schema.fields, T.StructField("cache_hit", T.BooleanType())])
    processor = _Memo(columns, order, length, 0 if length is None else ms(lateness))
    return marked.groupBy("memo_period", "memo_bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None" if length is None else "EventTime")
