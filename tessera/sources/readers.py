"""Reading records from JSON, text and candidate pages, with explicit schemas and defined fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import compare as P
from tessera.functions import text as X
from tessera.operators.select import global_batches

NAMED = "struct<name:string>"
SONG = f"struct<name:string,ar:array<{NAMED}>,artists:array<{NAMED}>,artist:array<{NAMED}>,al:{NAMED},album:{NAMED},dt:string,duration_ms:string,duration:string>"
RESPONSE = f"struct<code:int,data:struct<dailySongs:array<{SONG}>>>"
CANDIDATE = f"struct<id:string,name:string,artists:array<{NAMED}>,album:{NAMED},duration_ms:bigint,external_ids:struct<isrc:string>>"
PAGE = f"struct<tracks:struct<items:array<{CANDIDATE}>>>"


def artist_names(song: Column) -> Column:
    """Names of the first list of artists that isn't empty; nameless entries don't count."""
    filled = lambda f: F.when(F.size(song[f]) > 0, song[f])
    first = F.coalesce(filled("ar"), filled("artists"), filled("artist"), F.array().cast(f"array<{NAMED}>"))
    return F.filter(F.transform(first, lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")


def duration(song: Column) -> Column:
    """Milliseconds from the first duration field that isn't empty or zero."""
    filled = lambda f: F.when(~F.coalesce(song[f], F.lit("")).isin("", "0"), song[f])
    return P.valid_duration(F.coalesce(filled("dt"), filled("duration_ms"), filled("duration")))


def album(song: Column) -> Column:
    return F.coalesce(F.when(song["al"]["name"] != "", song["al"]["name"]), song["album"]["name"], F.lit(""))


def response_status(http: Column, body: Column, parsed: Column) -> Column:
    """What a daily response is: ok, or the class of its failure."""
    songs = parsed["data"]["dailySongs"]
    return (
        F.when(http.isin(401, 403), "authentication")
        .when((http < 200) | (http >= 300), "http")
        .when(~F.regexp_like(F.coalesce(body, F.lit("")), F.lit("^\\s*[{]")) | parsed.isNull(), "response")
        .when(parsed["code"] == 301, "authentication")
        .when(parsed["code"].isNull() | (parsed["code"] != 200), "api")
        .when(songs.isNull(), "response")
        .when(F.size(songs) == 0, "empty")
        .otherwise("ok")
    )


def daily_songs(responses: DataFrame) -> DataFrame:
    """(response_id, source_id, title, artists, album, duration_ms) from (response_id, http, body); only good responses have songs."""
    parsed = responses.withColumn("_p", F.from_json("body", RESPONSE))
    good = parsed.where(response_status(F.col("http"), F.col("body"), F.col("_p")) == "ok")
    each = good.select("response_id", F.posexplode("_p.data.dailySongs").alias("source_id", "s"))
    s = F.col("s")
    return each.select("response_id", F.col("source_id").cast("long").alias("source_id"), X.text(s["name"]).alias("title"), artist_names(s).alias("artists"), album(s).alias("album"), duration(s).alias("duration_ms"))


def candidate_pages(pages: DataFrame) -> DataFrame:
    """Candidates of (source_id, query_index, body): the place on the page is the rank. A body that doesn't parse has status 'failed', which isn't an empty page."""
    parsed = pages.withColumn("_p", F.from_json("body", PAGE))
    items = F.col("_p.tracks.items")
    status = F.when(items.isNull(), "failed").when(F.size(items) == 0, "empty").otherwise("ok")
    each = parsed.select("source_id", "query_index", status.alias("status"), F.posexplode_outer(items).alias("pos", "c"))
    c = F.col("c")
    return each.select("source_id", "query_index", "status", (F.col("pos") + 1).alias("rank"), c["id"].alias("candidate_id"), c["name"].alias("title"), F.transform(c["artists"], lambda a: a["name"]).alias("artists"), c["album"]["name"].alias("album"), c["duration_ms"].alias("duration_ms"), c["external_ids"]["isrc"].alias("isrc"))


def song_lines(spark: SparkSession, path: str) -> DataFrame:
    """(input_index, title, artist) from 'title - artist' lines: lines of that form are numbered from 0 in the order of a file's lines, others don't count."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_n"), F.regexp_replace("value", "^\\x{feff}", "").alias("line"))
    title, artist = X.split_line(F.col("line"))
    kept = lines.select("_n", title.alias("title"), artist.alias("artist")).where("title is not null")
    return global_batches(kept, ["_n"]).select(F.col("position").alias("input_index"), "title", "artist")


def line_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct raw lines, without a byte-order mark or blanks around."""
    return spark.read.text(path).select(X.strip(F.regexp_replace("value", "^\\x{feff}", "")).alias("line")).where("line <> ''").distinct()


def title_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(title_key, artist_key, alias) from a JSON list of source_title, artist, spotify_title; all three are needed, the last of a key counts."""
    raw = spark.read.schema("source_title string, artist string, spotify_title string").option("multiLine", True).json(path).withColumn("_n", F.monotonically_increasing_id())
    missing = F.coalesce(F.col("source_title"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("artist"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("spotify_title"), F.lit("")).eqNullSafe("")
    checked = raw.withColumn("_ok", F.assert_true(~missing, "an alias needs source_title, artist and spotify_title")).where("_ok is null")
    keyed = checked.select(X.key(X.fold("source_title")).alias("title_key"), X.key(X.fold("artist")).alias("artist_key"), F.struct("_n", F.col("spotify_title").alias("alias")).alias("x"))
    return keyed.groupBy("title_key", "artist_key").agg(F.max("x").alias("x")).select("title_key", "artist_key", F.col("x.alias").alias("alias"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """One row on an earlier run, from its JSON document; numbers that it lacks are zero."""
    names = ["reference_total", "baseline_accepted", "retrieval_failures_without_saved_candidates", "matcher_failures_with_saved_candidates"]  # fixed values: the document's fields
    raw = spark.read.schema(", ".join(f"{n} long" for n in names)).option("multiLine", True).json(path)
    return raw.select(*[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])


def saved_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(input_index, source_title, source_artist, candidate columns, position) from a saved report: strategies in order, the first place of an id counts, its last values do."""
    saved = "struct<candidates:array<struct<rank:int,spotify_track_id:string,title:string,artists:array<string>,album:string,isrc:string>>>"
    tracks = spark.read.schema(f"tracks array<struct<input_index:bigint,source_title:string,source_artist:string,strategies:map<string,{saved}>>>").option("multiLine", True).json(path)
    each = tracks.select(F.explode("tracks").alias("t")).select("t.input_index", "t.source_title", "t.source_artist", F.posexplode(F.map_values("t.strategies")).alias("s_pos", "s"))
    rows = each.select("input_index", "source_title", "source_artist", "s_pos", F.posexplode("s.candidates").alias("c_pos", "c")).withColumn("at", F.struct("s_pos", "c_pos"))
    return rows.groupBy("input_index", "source_title", "source_artist", F.col("c.spotify_track_id").alias("candidate_id")).agg(F.min("at").alias("position"), F.max_by("c", "at").alias("c")).select(
        "input_index", "source_title", "source_artist", "candidate_id", "position", "c.title", "c.artists", "c.album", "c.isrc"
    )
