"""Discovery of an alternate release title: one, uniquely supported, or the reason why there is none.

songs: (song_id, title, artist); artists and recordings as in operators.reference; releases: (country, status, media
array<struct<format, tracks array<struct<title, recording_mbid>>>>). Every step is a join or an aggregate over all songs at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import compare as P
from tessera.functions import text as X
from tessera.operators.reference import artist_names, credits
from tessera.operators.select import best_with_ties, top

LEAST_SCORE = 95


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of sorted shuffles. Spark guesses a side's size from packed files and fixed lengths of texts, so a side as large as the input can look small enough to be sent whole to the driver and all executors."""
    return left.join(right.hint("merge"), on, how)


def recordings_of(songs: DataFrame, artists: DataFrame, recordings: DataFrame) -> DataFrame:
    """(song_id, artist_mbid, recording_mbid): recordings credited to an artist of exactly that name, with the best score of at least 95.

    The score stands in for a search service's: 100 for a variant's very title, 95 for its key."""
    keyed = songs.select("song_id", X.key(X.fold("artist")).alias("name_key"), F.explode(X.recording_variants(X.nfkc("title"), F.col("artist"))).alias("variant")).withColumn("title_key", X.key(X.fold("variant")))
    named = _joined(keyed, artist_names(artists), "name_key").select("song_id", F.col("mbid").alias("artist_mbid"), "variant", "title_key")  # texts are made ready before songs meet in few names
    credited = credits(recordings).select("recording_mbid", "artist_mbid").distinct()
    titled = recordings.select(F.col("mbid").alias("recording_mbid"), F.col("title").alias("r_title"), X.key(X.fold("title")).alias("title_key"))
    met = _joined(named, _joined(titled, credited, "recording_mbid"), ["artist_mbid", "title_key"]).withColumn("score", F.when(F.col("variant") == F.col("r_title"), 100).otherwise(95)).where(F.col("score") >= LEAST_SCORE)
    return best_with_ties(met, ["song_id"], [F.desc("score")]).select("song_id", "artist_mbid", "recording_mbid").distinct()


def track_titles(releases: DataFrame) -> DataFrame:
    """(recording_mbid, track_title, evidence, at): the ranks of a release's form, comparable as they stand, and where the track stands; releases are in the order of their place, if they have one."""
    place = F.col("place") if "place" in releases.columns else F.lit(0)
    each = releases.select(place.alias("place"), F.upper(X.text("country")).alias("country"), (F.lower(X.text("status")) == "official").alias("official"), F.posexplode("media").alias("m_at", "m"))
    each = each.select("place", "m_at", "country", "official", (F.lower(F.coalesce("m.format", F.lit(""))) == "digital media").alias("digital"), F.posexplode("m.tracks").alias("t_at", "t"))
    flag = lambda x: x.cast("int")
    world = F.col("country") == "XW"
    evidence = F.struct(flag(F.col("digital") & world).alias("a"), flag(F.col("digital")).alias("b"), flag(world).alias("c"), flag(F.col("official")).alias("d"))
    return each.select(F.col("t.recording_mbid").alias("recording_mbid"), X.strip(F.coalesce("t.title", F.lit(""))).alias("track_title"), evidence.alias("evidence"), F.struct("place", "m_at", "t_at").alias("at")).where("track_title <> ''")


def discover(songs: DataFrame, artists: DataFrame, recordings: DataFrame, releases: DataFrame) -> DataFrame:
    """(song_id, alias, reason, evidence_count)."""
    keyed = songs.select("song_id", X.key(X.fold("artist")).alias("name_key"))
    with_artist = _joined(keyed, artist_names(artists), "name_key").select("song_id").distinct()
    found = recordings_of(songs, artists, recordings)
    counted = found.groupBy("song_id").agg(F.count_distinct("recording_mbid").alias("n"), F.min("recording_mbid").alias("recording_mbid"))
    one = _joined(_joined(counted.where("n = 1"), songs, "song_id"), track_titles(releases), "recording_mbid")
    variants = X.base_title_variants(X.nfkc("title"))
    one = one.select("song_id", "track_title", "evidence", "at", X.fold("title").alias("_title"), variants.alias("_variants"), X.bracket_contents(X.nfkc("title")).alias("_brackets"), X.fold("track_title").alias("_track"))
    one = one.withColumns({"_folded": X.fold_all("_variants"), "_bracket_folded": X.fold_all("_brackets"), "key": X.key(F.col("_track"))})
    same = (F.col("key") == X.key(F.col("_title"))) | F.array_contains(F.transform("_folded", X.key), F.col("key"))
    styled = F.array_contains(F.transform("_folded", X.query_shape), X.query_shape(F.col("_track")))
    conflict = F.size(P.version_reasons(X.version_terms(F.col("_title")), X.version_terms(F.col("_track")))) > 0
    kept = one.where((F.col("key") != "") & ~(same & styled) & ~conflict).withColumn("translated", F.array_contains(F.transform("_bracket_folded", X.key), F.col("key")))
    grouped = kept.groupBy("song_id", "key").agg(F.max("evidence").alias("evidence"), F.count("*").alias("n"), F.max_by("track_title", F.struct("at", "track_title")).alias("alias"), F.max("translated").alias("translated"))
    order = [F.asc("translated"), F.desc("evidence"), F.desc("n")]
    tied = best_with_ties(grouped, ["song_id"], order).groupBy("song_id").agg(F.count("*").alias("ties"), F.max("alias").alias("alias"), F.max("n").alias("evidence_count"))
    out = songs.select("song_id")
    for known in (with_artist.withColumn("_a", F.lit(True)), counted.select("song_id", "n"), tied):
        out = _joined(out, known, "song_id", "left")
    # fixed values: the names of the reasons
    reason = (
        F.when(F.col("_a").isNull(), "ARTIST_IDENTITY_NOT_FOUND")
        .when(F.col("n").isNull(), "RECORDING_NOT_FOUND")
        .when(F.col("n") != 1, "RECORDING_IDENTITY_NOT_UNIQUE")
        .when(F.col("ties").isNull(), "NO_ALTERNATE_RELEASE_TITLE")
        .when(F.col("ties") != 1, "ALTERNATE_TITLE_AMBIGUOUS")
        .otherwise("UNIQUE_RELEASE_TITLE")
    )
    chosen = reason == "UNIQUE_RELEASE_TITLE"
    return out.select("song_id", F.when(chosen, F.col("alias")).alias("alias"), reason.alias("reason"), F.when(chosen, F.col("evidence_count")).alias("evidence_count"))


def overrides(songs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(title_key, alias) for retrieval; a title key with different aliases is an error."""
    keyed = songs.join(aliases.where("alias is not null"), "song_id").select(X.key(X.fold("title")).alias("title_key"), "alias").distinct()
    checked = keyed.groupBy("title_key").agg(F.min("alias").alias("alias"), F.count("*").alias("n"))
    return checked.withColumn("_ok", F.assert_true(F.col("n") == 1, F.concat(F.lit("several aliases for "), F.col("title_key")))).where("_ok is null").select("title_key", "alias")


def alternate_name(artists: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, alternate): where exactly one artist has the name, its first ASCII alternate name, else its first."""
    names = artist_names(artists)
    keyed = sources.select("source_id", F.get("s_artist_keys", F.lit(0)).alias("name_key"))
    single = keyed.join(names, "name_key").groupBy("source_id", "name_key").agg(F.min("mbid").alias("mbid"), F.count_distinct("mbid").alias("n")).where("n = 1")
    listed = F.concat(F.array(X.text("name")), F.coalesce("aliases", F.array().cast("array<string>")))
    options = artists.select("mbid", F.posexplode(listed).alias("pos", "alternate")).where("alternate <> ''").withColumn("key", X.key(X.fold("alternate")))
    met = single.join(options, "mbid").where("key <> name_key").withColumn("foreign", X.has("[^\\x00-\\x7F]", F.col("alternate")))
    return top(met, ["source_id"], [F.asc("foreign"), F.asc("pos")]).select("source_id", "alternate")
