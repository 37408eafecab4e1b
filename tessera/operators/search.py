"""Ranked lookup of free text: a token inverted index with weights, the k best of each query, equals in order of their ids.

A record's score is the sum of the weights of the query's words that it has; a word's weight is the number of binary digits of
how many records there are for each that has it. Two kinds of words are met in two ways. A word of at most ``COMMON`` records has a
posting for each of them. A word of more has none: records are grouped by which common words they have, of each such
group only the first k can matter, and queries meet groups instead of records. So no posting list is long, and nothing
is cut: a record that shares common words alone scores as its group does, and k records of the group come before all others of it.

Queries with equal sets of words are one, and so are their sets of common words; a popular query costs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.select import top
from tessera.session import stored

COMMON = 1000


def words(folded: Column) -> Column:
    """The different words of a folded text."""
    return F.array_distinct(F.filter(F.split(X.query_shape(folded), " "), lambda w: w != ""))


def weight(total: Column, having: Column) -> Column:
    return F.length(F.bin(F.floor(total / having))).cast("long")


def _terms(rows: DataFrame, terms: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.withColumn("_terms", F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(terms), none), lambda t: t.isNotNull()))))


def ranked(queries: DataFrame, catalogue: DataFrame, k: int = 10, common: int = COMMON, query_id: str = "query_id", record_id: str = "record_id", terms: str = "terms") -> DataFrame:
    """(query_id, rank, record_id, score): the k records of the highest score above zero for each query. queries and catalogue: an id and an array of terms; ids are unique."""
    asked = _terms(queries, terms).select(F.col(query_id).alias("query_id"), "_terms").where(F.size("_terms") > 0)
    asked = asked.join(asked.groupBy("_terms").agg(F.min("query_id").alias("one")), "_terms")
    asked = stored(asked.select("query_id", "one", "_terms"), "search-queries")
    classes = asked.where("query_id = one").select("one", "_terms")
    records = stored(_terms(catalogue, terms).select(F.col(record_id).alias("record_id"), "_terms"), "search-records")
    total = F.lit(records.count())
    having = records.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count("*").alias("having"))
    weighed = stored(having.select("term", weight(total, F.col("having")).alias("weight"), (F.col("having") > common).alias("common")), "search-words")

    # Records and classes with their common words; the other words of a record are postings.
    posted = stored(records.select("record_id", F.explode("_terms").alias("term")).join(weighed, "term"), "search-postings")
    groups = posted.where("common").groupBy("record_id").agg(F.array_sort(F.collect_list("term")).alias("has"))
    groups = stored(groups, "search-groups")
    wanted = stored(classes.select("one", F.explode("_terms").alias("term")).join(weighed, "term"), "search-wanted")
    usual = wanted.where("common").groupBy("one").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("usual"))
    usual = stored(usual, "search-usual")

    # By rare words: a row for each record that shares one, then what it shares of the common ones.
    rare = wanted.where("not common").select("one", "term", "weight").join(posted.where("not common").select("term", "record_id"), "term")
    rare = rare.groupBy("one", "record_id").agg(F.sum("weight").alias("score"))
    both = rare.join(usual, "one", "left").join(groups, "record_id", "left")
    more = F.aggregate(F.filter("usual", lambda u: F.array_contains("has", u["term"])), F.lit(0).cast("long"), lambda s, u: s + u["weight"])
    by_rare = both.select("one", "record_id", (F.col("score") + F.coalesce(more, F.lit(0).cast("long"))).alias("score"))

    # By common words: groups of records against sets of words.
    firsts = stored(top(groups, ["has"], [F.asc("record_id")], k, name="_n").drop("_n"), "search-firsts")
    group = firsts.groupBy("has").agg(F.min("record_id").alias("group"))
    sets = usual.groupBy("usual").agg(F.min("one").alias("set"))
    met = sets.select("set", F.explode("usual").alias("u")).select("set", "u.term", "u.weight").join(group.select("group", F.explode("has").alias("term")), "term")
    best = top(met.groupBy("set", "group").agg(F.sum("weight").alias("score")), ["set"], [F.desc("score"), F.asc("group")], k, name="_n").drop("_n")  # each of k groups before another has a record before its records
    members = firsts.join(group, "has").select("group", "record_id")
    by_set = top(best.join(members, "group"), ["set"], [F.desc("score"), F.asc("record_id")], k, name="_n").select("set", "record_id", "score")
    by_common = usual.join(sets, "usual").select("one", "set").join(by_set, "set").select("one", "record_id", "score")

    every = by_rare.unionByName(by_common).groupBy("one", "record_id").agg(F.max("score").alias("score"))
    found = top(every, ["one"], [F.desc("score"), F.asc("record_id")], k, name="rank")
    return asked.select("query_id", "one").join(found, "one").select("query_id", "rank", "record_id", "score")
