"""Serial choice: each name takes the first of its candidates that no earlier name has taken; names without one get none.

The choice of a name depends on all names before it, yet no loop over names is needed. In each round all names that hold nothing propose
their first candidate that no earlier name holds; a candidate keeps the earliest proposer, and a name that loses its candidate proposes
again. A candidate's holder only ever becomes an earlier name, so a candidate that is out of reach stays so, and the rounds end with the serial result. Each round joins the
proposers' remaining candidates with the holders and stores both; proposers get fewer from round to round, and so does what is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import released, stored


def first_free(proposals: DataFrame, name: str = "name", place: str = "place", candidate: str = "candidate") -> DataFrame:
    """(name, candidate) from (name, place, candidate): names choose in their own order, each its candidates by place.

    Names are orderable and unique to who chooses; rows with a null count for nothing; of a candidate's several places the first counts. Names without a free candidate have no row."""
    spark = proposals.sparkSession
    wishes = proposals.select(F.col(name).alias("name"), F.col(place).alias("place"), F.col(candidate).alias("candidate")).where("name is not null and place is not null and candidate is not null")
    wishes = stored(wishes.groupBy("name", "candidate").agg(F.min("place").alias("place")), "choice-wishes")
    held = spark.createDataFrame([], wishes.select("candidate", F.col("name").alias("holder")).schema)
    open_ = wishes
    while True:
        # Candidates that an earlier name holds, or the name itself, are behind it; of the rest the first is proposed to.
        reach = open_.join(held, "candidate", "left").where("holder is null or holder > name").select("name", "place", "candidate")
        reach = stored(reach, "choice-open")
        if open_ is not wishes:
            released(open_)
        asks = reach.groupBy("name").agg(F.min_by("candidate", F.struct("place", "candidate")).alias("candidate"))
        best = held.select("candidate", F.col("holder").alias("name")).unionByName(asks.select("candidate", "name")).groupBy("candidate").agg(F.min("name").alias("holder"))
        before, held = held, stored(best, "choice-held")
        losers = stored(asks.join(held, "candidate").where("holder <> name").select("name").unionByName(before.join(held.select("candidate", F.col("holder").alias("now")), "candidate").where("holder <> now").select(F.col("holder").alias("name"))).distinct(), "choice-losers")
        if before.columns and before.inputFiles():
            released(before)
        if not losers.limit(1).count():
            released(losers, reach)
            return held.select(F.col("holder").alias("name"), "candidate")
        # A displaced name had left its further candidates behind: they are its wishes again.
        open_ = stored(wishes.join(losers, "name", "left_semi"), "choice-next")
        released(losers, reach)
