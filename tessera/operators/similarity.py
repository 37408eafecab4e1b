"""A similarity join of keys by edit distance, without comparing all pairs.

Two keys are near if their edit distance is at most a share of their lengths together. The keys of one side are cut into
one segment more than the distance allows, so at least one of them stands unchanged in a near key, and no farther from its
own place than the edits before and behind it can move it. Segments meet those pieces of the other side's keys in an
equi-join on a hash of length, segment and text; letters are compared as bits before the distance itself, with a bound, is worked out.

Equal keys are one row before anything is cut, so copies don't multiply. A piece that very many different keys share is
dealt into parts of ``PART`` keys: the pieces of the other side go to each part, so no task holds such a piece alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 4096


def allowed(total: Column, percent: int) -> Column:
    """The distance that two keys of so many characters together may have."""
    return F.floor(total * percent / 100).cast("int")


def near(a: Column, b: Column, percent: int, longer: int) -> Column:
    """The test that the join decides by: distance within the share, lengths within the limit."""
    return (F.abs(F.length(a) - F.length(b)) <= longer) & (100 * F.levenshtein(a, b) <= percent * (F.length(a) + F.length(b)))


def _letters(key: Column) -> Column:
    """Which letters a key has, by their code modulo 63: an edit changes two bits at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(63)))
    return F.aggregate(F.split(key, ""), F.lit(0).cast("long"), lambda bits, c: F.when(c == "", bits).otherwise(bits.bitwiseOR(bit(c))))


def _cut(length: Column, edits: Column) -> Column:
    """(number, start from 0, size) of edits + 1 segments, as even as can be, the longer ones last."""
    n = edits + 1
    short = F.floor(length / n).cast("int")
    longer = (length - short * n).cast("int")

    def segment(i: Column) -> Column:
        before = F.greatest(i - (n - longer), F.lit(0))
        return F.struct(i.cast("int").alias("i"), (i * short + before).cast("int").alias("at"), (short + F.when(i >= n - longer, 1).otherwise(0)).cast("int").alias("size"))

    return F.transform(F.sequence(F.lit(0), edits), segment)


def _piece(length: Column, number: Column, text: Column) -> Column:
    return F.xxhash64(length, number, text)


def near_pairs(left: DataFrame, right: DataFrame, percent: int = 8, longer: int = 3, key: str = "key", part: int = PART) -> DataFrame:
    """(left_key, right_key, distance) of all near pairs of different keys and of equal ones; left and right: (key). Null keys are near none."""
    column = F.col(key)
    # The distance is bounded for every key that a key of this length may be near to.
    edits = lambda length: allowed(2 * length + longer, percent)
    r = right.select(column.alias("right_key")).where("right_key is not null").distinct().withColumn("n", F.length("right_key"))
    r = r.select("right_key", "n", _letters(F.col("right_key")).alias("r_letters"), F.explode(_cut(F.col("n"), edits(F.col("n")))).alias("s"))
    r = r.select("right_key", "r_letters", _piece(F.col("n"), F.col("s.i"), F.substring(F.col("right_key"), F.col("s.at") + 1, F.col("s.size"))).alias("piece"))

    other = left.select(column.alias("left_key")).where("left_key is not null").distinct().withColumn("m", F.length("left_key"))
    other = other.select("left_key", "m", _letters(F.col("left_key")).alias("l_letters"), F.explode(F.sequence(F.greatest(F.col("m") - longer, F.lit(0)), F.col("m") + longer)).alias("n"))
    other = other.select("left_key", "m", "l_letters", "n", edits(F.col("n")).alias("k")).select("*", F.explode(_cut(F.col("n"), F.col("k"))).alias("s"))
    shift = F.col("m") - F.col("n")
    first = F.greatest(F.col("s.at") - F.col("s.i"), F.col("s.at") + shift - (F.col("k") - F.col("s.i")), F.lit(0))
    last = F.least(F.col("s.at") + F.col("s.i"), F.col("s.at") + shift + (F.col("k") - F.col("s.i")), F.col("m") - F.col("s.size"))
    other = other.withColumn("at", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    other = other.select("left_key", "l_letters", _piece(F.col("n"), F.col("s.i"), F.substring(F.col("left_key"), F.col("at") + 1, F.col("s.size"))).alias("piece")).distinct()

    # Pieces of many keys are dealt into parts; which these are is an aggregate, and they are few: a piece of so many keys for each part at most.
    popular = r.groupBy("piece").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
    r = r.join(popular, "piece", "left").withColumn("deal", F.pmod(F.xxhash64("right_key"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    other = other.join(popular, "piece", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    room = allowed(F.length("left_key") + F.length("right_key"), percent)
    met = other.join(r, ["piece", "deal"]).where((F.bit_count(F.col("l_letters").bitwiseXOR(F.col("r_letters"))) <= 2 * room) & (F.abs(F.length("left_key") - F.length("right_key")) <= F.least(F.lit(longer), room)))
    tested = met.select("left_key", "right_key", room.alias("room")).withColumn("distance", F.expr("levenshtein(left_key, right_key, room)")).where("distance >= 0")
    return tested.groupBy("left_key", "right_key").agg(F.min("distance").alias("distance"))
