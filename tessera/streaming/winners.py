"""The best row of each record under arriving candidates, without working earlier ones out again.

Every increment stores its own best rows under its number; the best of all is the best of these, whatever way candidates were dealt into increments.
An increment that is written again replaces itself. Compaction folds increments up to a number into one base table; a base
counts only once it is complete, and then increments up to its number don't, so a run that breaks off anywhere leaves a readable state.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A source's candidates from the best on: an earlier query displaces a later one, then score and place decide.
WINNER = ["query_index", "-score", "rank", "candidate_id"]


def best_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group by an order of expressions: an aggregate, so a group of very many rows is in no single task."""
    whole = F.struct(*rows.columns)
    best = rows.groupBy(*[F.col(b).alias(f"_by_{b}") for b in by]).agg(F.min_by(whole, F.struct(*[F.expr(o).alias(f"o{i}") for i, o in enumerate(order)])).alias("_best"))
    return best.select("_best.*")


class Winners:
    """Stored best rows in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], order: list[str] = WINNER) -> None:
        self.spark, self.path, self.by, self.order = spark, path.rstrip("/"), by, order

    def _folders(self, kind: str) -> dict[int, str]:
        """Complete tables of a kind by number."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return {}
        listed = [str(s.getPath().getName()) for s in files.listStatus(hadoop)]
        numbers = {int(n.partition("=")[2]): f"{self.path}/{n}" for n in listed if n.startswith(f"{kind}=")}
        return {k: p for k, p in numbers.items() if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))}

    def add(self, rows: DataFrame, number: int) -> None:
        """Stores the best rows of an increment; numbers of compacted increments are done and stay so."""
        if number > max(self._folders("base"), default=-1):
            best_of(rows, self.by, self.order).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame:
        """The best rows of all increments so far."""
        bases, batches = self._folders("base"), self._folders("batch")
        base = max(bases, default=-1)
        paths = [*([bases[base]] if bases else []), *(p for n, p in sorted(batches.items()) if n > base)]
        if not paths:
            raise FileNotFoundError(f"no increment in {self.path}")
        return best_of(reduce(DataFrame.unionByName, map(self.spark.read.parquet, paths)), self.by, self.order)

    def compact(self) -> None:
        """Makes one table of all increments."""
        batches, bases = self._folders("batch"), self._folders("base")
        if batches and max(batches) > max(bases, default=-1):
            self.read().write.mode("overwrite").parquet(f"{self.path}/base={max(batches)}")
        done = max(self._folders("base"), default=-1)
        for old in [p for n, p in batches.items() if n <= done] + [p for n, p in bases.items() if n < done]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def next_index(self, index: str) -> int:
        """Where a run that reads its input by an index goes on."""
        if not self._folders("base") and not self._folders("batch"):
            return 0
        last = self.read().agg(F.max(index)).first()[0]
        return 0 if last is None else last + 1


def follow(candidates: DataFrame, plan: Callable[[DataFrame], DataFrame], winners: Winners, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Feeds every micro-batch of a stream, decided by plan, to winners."""
    writer = candidates.writeStream.foreachBatch(lambda batch, number: winners.add(plan(batch), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def accepted(decided: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Accepted rows with what their order asks for."""
    return decided.where(F.col("accepted")).select(*(keep or ["source_id", "query_index", "rank", "candidate_id", "score"]))

