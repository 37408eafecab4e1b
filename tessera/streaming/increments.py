"""The same plans over arriving records: each micro-batch is decided and written under its own number, so a batch that is tried again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def decide_stream(records: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs plan on every micro-batch of a stream; with once, on what is there now."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_of_day(attempts: DataFrame, zone: str = "Asia/Shanghai", hour: int = 6, minute: int = 10) -> DataFrame:
    """Attempts (ts in UTC) after the daily time, the first of each local date: a watermark bounds the dates that are remembered."""
    from pyspark.sql import functions as F

    local = F.from_utc_timestamp("ts", zone)
    due = attempts.withColumn("local_date", F.to_date(local)).where((F.hour(local) * 60 + F.minute(local)) >= hour * 60 + minute)
    if due.isStreaming:
        return due.withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["local_date"])
    from pyspark.sql import Window

    w = Window.partitionBy("local_date").orderBy("ts")
    return due.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
