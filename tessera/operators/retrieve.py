"""Retrieval stages as keyed joins against a catalogue, and the cascade over them.

A remote search becomes an equi-join on keys, with at most ten candidates of each source and query in catalogue order.
A stage that runs only where an earlier one found nothing is an anti-join against what that one returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import search, similarity
from tessera.operators.select import top
from tessera.sources import vocabulary as V

LIMIT = 10


def _first_of_keys(sources: DataFrame, candidates: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(source_id, candidate_id, c_order) by equal keys. A source needs no more than the first of each key, so others are cut before the join, and a popular key doesn't multiply."""
    best = top(candidates.select(*keys, "candidate_id", "c_order").distinct(), keys, [F.asc("c_order"), F.asc("candidate_id")], most, name="_n").drop("_n")
    return sources.select("source_id", *keys).join(best, keys).select("source_id", "candidate_id", "c_order").distinct()


def strict(sources: DataFrame, catalogue: DataFrame, with_album: bool, query_index: int, k: int = LIMIT, offset: int = 0) -> DataFrame:
    """Candidates by equal title and artist keys, and album keys in the first query, in order of their ids: (source_id, query_index, rank, candidate columns).

    Only keys and ids are joined and ranked, so a popular key moves no wide rows; a source with more artists is met
    through each of them."""
    s = sources.select("source_id", F.col("s_core_key").alias("k1"), F.explode(F.array_distinct("s_artist_keys")).alias("k2"), F.col("s_album_key").alias("k3"))
    c = catalogue.select("candidate_id", "c_order", F.explode("c_title_keys").alias("k1"), "c_artist_keys", F.col("c_album_key").alias("k3"))
    c = c.select("candidate_id", "c_order", "k1", F.explode("c_artist_keys").alias("k2"), "k3")
    met = _first_of_keys(s, c, ["k1", "k2", "k3"] if with_album else ["k1", "k2"], k + offset)
    ranked = top(met, ["source_id"], [F.asc("c_order"), F.asc("candidate_id")], k, offset, "rank").withColumn("query_index", F.lit(query_index))
    return ranked.select("source_id", "candidate_id", "query_index", "rank")


def romanised(sources: DataFrame, catalogue: DataFrame, aliases: DataFrame, first: DataFrame, failed: DataFrame | None = None, query_index: int = 2, k: int = LIMIT) -> DataFrame:
    """The second query of sources in Asian script whose first one came back empty: by title key and the artist's Latin alias.

    aliases: (source_id, alias_key). failed: sources whose first query failed, which is not the same as empty and widens nothing."""
    s = _unanswered(sources.where("s_asian"), first, failed).join(aliases, "source_id").select("source_id", F.col("s_core_key").alias("k1"), F.col("alias_key").alias("k2"))
    c = catalogue.select("candidate_id", "c_order", F.explode("c_title_keys").alias("k1"), "c_artist_keys").select("candidate_id", "c_order", "k1", F.explode("c_artist_keys").alias("k2"))
    met = _first_of_keys(s, c, ["k1", "k2"], k)
    return top(met, ["source_id"], [F.asc("c_order"), F.asc("candidate_id")], k, name="rank").select("source_id", "candidate_id", F.lit(query_index).alias("query_index"), "rank")


def _unanswered(sources: DataFrame, first: DataFrame, failed: DataFrame | None) -> DataFrame:
    """Sources whose first query came back empty; one that failed is not empty."""
    empty = sources.join(first.select("source_id").distinct(), "source_id", "left_anti")
    return empty if failed is None else empty.join(failed.select("source_id").distinct(), "source_id", "left_anti")


def relaxed(sources: DataFrame, catalogue: DataFrame, aliases: DataFrame, first: DataFrame, failed: DataFrame | None = None, query_index: int = 2, k: int = LIMIT, common: int = search.COMMON) -> DataFrame:
    """The second query of sources in Asian script whose first one came back empty and whose artist has no Latin alias: by title key, with the artists as free text.

    No word of the artists has to match, but candidates that have them in artists or album come first, by the words' weights among candidates of that title; equals in the catalogue's order."""
    asked = _unanswered(sources.where("s_asian"), first, failed).join(aliases.select("source_id").distinct(), "source_id", "left_anti")
    within = lambda key, words: F.concat(F.array(key), F.transform(words, lambda w: F.concat(key, F.lit(" "), w)))
    queries = asked.where("s_core_key <> ''").select(F.col("source_id").alias("query_id"), within(F.col("s_core_key"), "s_artist_words").alias("terms"))
    records = catalogue.select(F.struct("c_order", "candidate_id").alias("record_id"), F.flatten(F.transform("c_title_keys", lambda key: within(key, "c_words"))).alias("terms"))
    found = search.ranked(queries, records, k, common)
    return found.select(F.col("query_id").alias("source_id"), F.col("record_id.candidate_id").alias("candidate_id"), F.lit(query_index).alias("query_index"), "rank")


def near(sources: DataFrame, catalogue: DataFrame, first: DataFrame, failed: DataFrame | None = None, query_index: int = 2, k: int = LIMIT) -> DataFrame:
    """A further query of sources whose first one came back empty: candidates whose title is near by edit distance, the nearest first. The decision then asks for the exact ratio."""
    s = _unanswered(sources, first, failed).select("source_id", F.explode("s_title_keys").alias("left_key"))
    c = catalogue.select("candidate_id", "c_order", F.explode("c_title_keys").alias("right_key"))
    met = similarity.near_pairs(s.withColumnRenamed("left_key", "key"), c.withColumnRenamed("right_key", "key"))
    order = [F.asc("distance"), F.asc("c_order"), F.asc("candidate_id")]
    listed = met.join(top(c, ["right_key"], [F.asc("c_order"), F.asc("candidate_id")], k, name="_n").drop("_n"), "right_key")
    once = listed.groupBy("left_key", "candidate_id", "c_order").agg(F.min("distance").alias("distance"))
    of_key = top(once, ["left_key"], order, k, name="_n").drop("_n")  # a title's nearest serve every source of that title
    of_source = s.join(of_key, "left_key").groupBy("source_id", "candidate_id", "c_order").agg(F.min("distance").alias("distance"))
    return top(of_source, ["source_id"], order, k, name="rank").select("source_id", "candidate_id", F.lit(query_index).alias("query_index"), "rank", "distance")


def titled(sources: DataFrame, catalogue: DataFrame, overrides: DataFrame, first: DataFrame, query_index: int = 2, k: int = LIMIT) -> DataFrame:
    """The second query with an overridden title (source_id, title_key), for sources whose first one came back empty; under the first artist."""
    empty = _unanswered(sources, first, None).join(overrides, "source_id")
    s = empty.select("source_id", F.col("title_key").alias("k1"), F.get("s_artist_keys", F.lit(0)).alias("k2"))
    c = catalogue.select("candidate_id", "c_order", F.explode("c_title_keys").alias("k1"), "c_artist_keys").select("candidate_id", "c_order", "k1", F.explode("c_artist_keys").alias("k2"))
    met = _first_of_keys(s, c, ["k1", "k2"], k)
    return top(met, ["source_id"], [F.asc("c_order"), F.asc("candidate_id")], k, name="rank").select("source_id", "candidate_id", F.lit(query_index).alias("query_index"), "rank")


def query_text(title: Column, artist: Column, album: Column | None = None) -> Column:
    """The field query of a stage as text, for a connector."""
    parts = [F.concat(F.lit('track:"'), X.query_value(title), F.lit('"')), F.concat(F.lit('artist:"'), X.query_value(artist), F.lit('"'))]
    if album is not None:
        parts.append(F.when(X.query_value(album) != "", F.concat(F.lit('album:"'), X.query_value(album), F.lit('"'))))
    return F.concat_ws(" ", *parts)


def pairs(sources: DataFrame, catalogue: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Retrieved ids with the prepared columns of both sides."""
    return retrieved.join(sources, "source_id").join(catalogue.drop("c_order"), "candidate_id")


def corrected(value: Column, key: Column, spellings: dict[str, str]) -> Column:
    """The spelling to search for, where the key has one; spellings are a handful of fixed values."""
    out = value
    for k, v in spellings.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def spelled(records: DataFrame) -> DataFrame:
    """(source_id, q_title, q_artist): what a query asks for: the title and the first artist of (source_id, title, artists), or the spellings under which these are known to be listed."""
    title, artist = X.text("title"), X.text(F.get("artists", F.lit(0)))
    keyed = records.select("source_id", title.alias("title"), artist.alias("artist"), title_lookup_key(X.fold(title)).alias("k1"), X.key(X.fold(artist)).alias("k2"))
    return keyed.select("source_id", corrected(F.col("title"), F.col("k1"), V.TITLE_QUERY_SPELLINGS).alias("q_title"), corrected(F.col("artist"), F.col("k2"), V.ARTIST_QUERY_SPELLINGS).alias("q_artist"))


def title_lookup_key(folded: Column) -> Column:
    """How titles are looked up for a correction: folded, single spaces."""
    return X.strip(F.regexp_replace(folded, "(?U)\\s+", " "))


def strategies(records: DataFrame, id_col: str = "source_id") -> DataFrame:
    """(id, strategy, query, offset) from (id, title, artist): fields at two offsets, a simplified title, and the title alone."""
    title, artist = X.query_value(X.text("title")), X.query_value(X.text("artist"))
    simple = X.query_value(X.simplified_title(X.text("title")))
    field = lambda t: F.concat(F.lit('track:"'), t, F.lit('" artist:"'), artist, F.lit('"'))
    row = lambda name, query, offset: F.struct(F.lit(name).alias("strategy"), query.alias("query"), F.lit(offset).alias("offset"))
    every = F.array(row("structured_p0", field(title), 0), row("structured_p10", field(title), 10), row("simplified_title", field(simple), 0), row("track_only", F.concat(F.lit('track:"'), title, F.lit('"')), 0))
    return records.select(id_col, F.explode(every).alias("s")).select(id_col, "s.strategy", "s.query", "s.offset")


def alias_strategy(records: DataFrame, first_counts: DataFrame, aliases: DataFrame, id_col: str = "source_id") -> DataFrame:
    """The further strategy by alias: where the first came back empty and the artist names one act; attempted or skipped, and why."""
    met = records.join(first_counts, id_col, "left").join(aliases, id_col, "left")
    status = F.when(F.coalesce("n", F.lit(0)) > 0, "NOT_NEEDED").when(X.ambiguous_artist(X.text("artist")), "SKIPPED_AMBIGUOUS").when(F.col("alias").isNull(), "SKIPPED_NO_ALIAS").otherwise("ATTEMPTED")
    return met.select(id_col, status.alias("status"), F.when(status == "ATTEMPTED", F.concat(F.lit('track:"'), X.query_value(X.text("title")), F.lit('" artist:"'), X.query_value(F.col("alias")), F.lit('"'))).alias("query"))
