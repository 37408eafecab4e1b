"""Corroboration of uncertain pairs against reference tables of artists and recordings.

Only pairs behind the decision's gate come here. Names become keys once; a lookup by name is a join on the key, a lookup
by code two joins; "some recording qualifies" and "the least difference" are aggregates of the joined rows. With empty
tables nothing is confirmed, so a missing reference never turns an accepted pair into a rejected one.

artists: (mbid, name, sort_name, aliases array<string>); recordings: (mbid, title, length, disambiguation, credits
array<struct<name, artist_mbid>>); isrcs: (isrc, mbid).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import compare as P
from tessera.functions import text as X
from tessera.operators import search
from tessera.operators.select import top
from tessera.session import stored

PAIR = ["source_id", "candidate_id"]
MAX_DIFFERENCE = 30_000


def artist_names(artists: DataFrame) -> DataFrame:
    """(mbid, name_key): the canonical name, the sort name and the aliases."""
    names = F.array_union(F.array("name", "sort_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    named = artists.select("mbid", F.explode(names).alias("name")).where("name is not null and name <> ''")
    return named.select("mbid", X.key(X.fold("name")).alias("name_key")).distinct()


def lookup(names: DataFrame, artists: DataFrame, k: int = 5, common: int = search.COMMON) -> DataFrame:
    """(name, rank, mbid): of the k artists that a search for a name ranks first, those that have exactly that name, in the search's order.

    Artists that have all words of the name come before those that have some, so an exact one is left out only for k others of as high a score."""
    asked = names.select("name").where("name is not null and name <> ''").distinct().withColumn("folded", X.fold("name"))
    every = F.concat(F.array(X.text("name"), X.text("sort_name")), F.coalesce("aliases", F.array().cast("array<string>")))
    records = artists.select(F.col("mbid").alias("record_id"), search.words(X.fold(F.array_join(every, " "))).alias("terms"))
    found = search.ranked(asked.select(F.col("name").alias("query_id"), search.words(F.col("folded")).alias("terms")), records, k, common)
    exact = artist_names(artists).withColumnRenamed("mbid", "record_id")
    keyed = asked.select(F.col("name").alias("query_id"), X.key(F.col("folded")).alias("name_key"))
    return found.join(keyed, "query_id").join(exact, ["record_id", "name_key"]).select(F.col("query_id").alias("name"), "rank", F.col("record_id").alias("mbid"))


def credits(recordings: DataFrame) -> DataFrame:
    """(recording_mbid, artist_mbid, name_key)."""
    each = recordings.select(F.col("mbid").alias("recording_mbid"), F.explode("credits").alias("c"))
    return each.select("recording_mbid", F.col("c.artist_mbid").alias("artist_mbid"), X.key(X.fold(F.col("c.name"))).alias("name_key")).where("artist_mbid is not null")


def artist_identity(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(pair, artist_mbid): artists that both the first source artist and a candidate's artist are names of."""
    keyed = pairs.select(*PAIR, F.get("s_artist_keys", F.lit(0)).alias("s_key"), F.explode("c_artist_keys").alias("c_key")).where("s_key is not null")
    both = keyed.select("s_key", "c_key").distinct()  # names are met once, not once a pair
    both = both.join(names.withColumnRenamed("name_key", "s_key"), "s_key").join(names.withColumnRenamed("name_key", "c_key"), ["c_key", "mbid"], "left_semi")
    return keyed.join(both, ["s_key", "c_key"]).select(*PAIR, F.col("mbid").alias("artist_mbid")).distinct()


def credit_identity(pairs: DataFrame, names: DataFrame, credited: DataFrame, isrcs: DataFrame) -> DataFrame:
    """(pair, artist_mbid): artists whom any source artist names or is credited as, and whom a recording of the candidate's code credits as the candidate does."""
    known = names.select("name_key", F.col("mbid").alias("artist_mbid")).unionByName(credited.select("name_key", "artist_mbid")).distinct()
    by_code = pairs.where("c_isrc <> ''").select(*PAIR, "s_artist_keys", F.col("c_isrc").alias("isrc"), F.explode("c_artist_keys").alias("name_key")).join(isrcs, "isrc")
    c = by_code.join(credited, (by_code["mbid"] == credited["recording_mbid"]) & (by_code["name_key"] == credited["name_key"])).select(*PAIR, "s_artist_keys", "artist_mbid")
    s = c.select(*PAIR, "artist_mbid", F.explode("s_artist_keys").alias("name_key"))  # a name that very many are credited as is asked for the few of the code, not listed
    return s.join(known, ["name_key", "artist_mbid"], "left_semi").select(*PAIR, "artist_mbid").distinct()


def identities(pairs: DataFrame, artists: DataFrame, recordings: DataFrame, isrcs: DataFrame) -> DataFrame:
    """(pair, artist_mbid, route): by artist where that confirms any, else by credit."""
    names, credited = stored(artist_names(artists), "names"), stored(credits(recordings), "credits")  # folded once, met three times
    direct = artist_identity(pairs, names).withColumn("route", F.lit("artist"))
    other = credit_identity(pairs, names, credited, isrcs).join(direct.select(*PAIR).distinct(), PAIR, "left_anti").withColumn("route", F.lit("artist-credit"))
    return direct.unionByName(other)


def recording_evidence(pairs: DataFrame, found: DataFrame, recordings: DataFrame, isrcs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """A row for each pair with an identity: what its recordings say."""
    ids = found.groupBy(*PAIR).agg(F.collect_set("artist_mbid").alias("ids"), F.first("route").alias("route"))
    details = isrcs.join(recordings, "mbid").select(
        "isrc", F.col("title").alias("r_title"), P.valid_duration(F.col("length")).alias("r_length"), X.text("disambiguation").alias("r_note"),
        F.filter(F.transform("credits", lambda c: c["artist_mbid"]), lambda m: m.isNotNull()).alias("r_ids"),
        X.title_keys(X.title_core(X.fold("title"))).alias("r_keys"), X.fold("disambiguation").alias("r_folded"),
    )
    base = pairs.join(ids, PAIR).drop("near", "similar").withColumn("_isrc", F.col("c_isrc"))
    met = base.join(details, base["_isrc"] == details["isrc"], "left")
    if fuzzy:
        met = P.with_similar(met, ("s_title_keys", "r_keys"))
    count = F.count("isrc").over(Window.partitionBy(*PAIR))
    met = met.withColumns({
        "n_recordings": count,
        "r_artist": F.coalesce(F.arrays_overlap("ids", "r_ids"), F.lit(False)),
        "r_match": F.coalesce(P.keys_match(F.col("s_title_keys"), F.col("r_keys"), 0 if fuzzy else None), F.lit(False)),
        "r_conflict": (F.size(P.version_reasons(F.col("s_terms"), X.version_terms(F.coalesce("r_folded", F.lit(""))))) > 0) | F.contains(X.key(F.coalesce("r_folded", F.lit(""))), F.lit("djmix")),
        "r_diff": F.abs(F.col("r_length") - F.col("c_duration")),
    })
    scripts_differ = F.col("s_title_asian") != X.is_asian(F.coalesce("r_title", F.lit("")))
    rescue = (F.col("n_recordings") == 1) & ~F.col("r_match") & ~F.col("rescue") & scripts_differ & (F.col("route") == "artist") & F.col("r_artist") & (F.col("r_diff") <= MAX_DIFFERENCE) & ~F.col("r_conflict")
    good = F.col("isrc").isNotNull() & F.col("r_artist") & (F.col("r_match") | F.coalesce(rescue, F.lit(False))) & ~F.col("r_conflict")
    return met.withColumn("qualifies", good).groupBy(*PAIR).agg(
        F.first("route").alias("route"), F.first("rescue").alias("rescue"), F.max("n_recordings").alias("n_recordings"),
        F.max("qualifies").alias("qualifies"), F.max(F.col("qualifies") & ~F.col("r_match")).alias("by_other_script"), F.min(F.when(F.col("qualifies"), F.col("r_diff"))).alias("best_diff"), F.max("r_artist").alias("any_artist"),
    )


def verify(gated: DataFrame, artists: DataFrame, recordings: DataFrame, isrcs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(source_id, candidate_id, identity, n_recordings, best_diff, predicates): for pairs behind the gate.

    With a code: the titles match or may be of different scripts, nothing conflicts, the artist is the same, and a recording
    of that code confirms it; with no recording of it, the identity by artist is enough for titles of one script. Without a
    code: an exact title with a close album or duration."""
    found = stored(identities(gated, artists, recordings, isrcs), "identities")
    evidence = recording_evidence(gated, found, recordings, isrcs, fuzzy)
    e = gated.select(*PAIR, "rescue", "title_plain", "conflict", "reliable", "title_exact", "album", "duration", "c_isrc").join(evidence.drop("rescue"), PAIR, "left")
    c = F.col
    coded = c("c_isrc") != ""
    n = F.coalesce("n_recordings", F.lit(0))
    known = c("route").isNotNull()
    by_recording = c("qualifies") & ((c("best_diff") <= MAX_DIFFERENCE) | (c("best_diff").isNull() & ~c("rescue")))
    confirmed = (c("rescue") | c("title_plain")) & ~c("conflict") & known & F.when(n == 0, ~c("rescue") & (c("route") == "artist")).otherwise(F.coalesce(by_recording, F.lit(False)))
    plain = c("title_exact") & ((c("album") >= 45) | (c("duration") >= 40))
    identity = (c("reliable") | known) & F.when(coded, confirmed).otherwise(plain)
    word = lambda test: F.when(test, "PASS").otherwise("FAIL")
    titled, unconflicted = c("rescue") | c("title_plain"), (c("rescue") | c("title_plain")) & ~c("conflict")
    reached = unconflicted & known  # each predicate counts only if those before it pass
    duration = F.when(c("best_diff").isNull(), "UNKNOWN").otherwise(word(c("best_diff") <= MAX_DIFFERENCE))
    judged = {
        "title_identity": word(titled),
        "version_conflict": F.when(titled, word(~c("conflict"))),
        "artist_identity": F.when(unconflicted, word(known)),
        "recording_title": F.when(reached, F.when(n == 0, "UNKNOWN").when(F.coalesce("by_other_script", F.lit(False)), "UNKNOWN_CROSS_SCRIPT").otherwise(word(F.coalesce("qualifies", F.lit(False))))),
        "recording_artist": F.when(reached, F.when(n == 0, "UNKNOWN").otherwise(word(F.coalesce("any_artist", F.lit(False))))),
        "duration": F.when(reached, duration),
        "isrc_uniqueness": F.when(reached, F.when(n == 0, "NOT_FOUND").when(n == 1, "PASS").otherwise("MULTIPLE")),
    }
    predicates = F.map_filter(F.create_map(*[x for k, v in judged.items() for x in (F.lit(k), F.when(coded, v))]), lambda k, v: v.isNotNull())
    failing = F.filter(F.array(*[F.when(v.isin("FAIL", "UNKNOWN", "NOT_FOUND"), k) for k, v in judged.items()]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    failures = F.when(~coded | F.coalesce(confirmed, F.lit(False)), none).when(reached & (n == 0), F.array(F.lit("recording_evidence"))).otherwise(failing)
    return e.select(*PAIR, F.coalesce(identity, F.lit(False)).alias("identity"), n.alias("n_recordings"), "best_diff", "route", predicates.alias("predicates"), failures.alias("failure_predicates"))


def _latin_options(artists: DataFrame) -> DataFrame:
    """(mbid, kind, pos, alias): an artist's Latin names: the natural sort name, the canonical name, the aliases in order."""
    none = F.array().cast("array<string>")
    sort, name = X.natural_order(X.nfkc("sort_name")), F.when(X.is_latin_name(X.nfkc("name")), X.text("name"))
    fixed = artists.select("mbid", F.explode(F.array(F.struct(F.lit(0).alias("kind"), sort.alias("alias")), F.struct(F.lit(1).alias("kind"), name.alias("alias")))).alias("f"))
    fixed = fixed.select("mbid", "f.kind", F.lit(0).alias("pos"), "f.alias")
    listed = artists.select("mbid", F.posexplode(F.coalesce("aliases", none)).alias("pos", "raw"))
    aliased = listed.select("mbid", F.lit(2).alias("kind"), "pos", F.when(X.is_latin_name(X.nfkc("raw")), F.coalesce(X.natural_order(X.nfkc("raw")), F.col("raw"))).alias("alias"))
    return fixed.unionByName(aliased).where("alias is not null")


def latin_alias(sources: DataFrame, artists: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(source_id, alias): a Latin name of the first artist, if that is in Asian script and named exactly: the natural sort name, else the canonical name, else the first
    alias, else the same of the artist's details, if there are any. Of several artists the first by place counts, if there is such a column, else by mbid; those with no Latin name are passed over."""
    names = artist_names(artists)
    place = F.col("place") if "place" in artists.columns else F.lit(0)
    keyed = sources.where(X.is_asian(F.coalesce(F.get("s_artists", F.lit(0)), F.lit("")))).select("source_id", F.get("s_artist_keys", F.lit(0)).alias("name_key"))
    every = _latin_options(artists)
    if details is not None:
        every = every.unionByName(_latin_options(details).withColumn("kind", F.col("kind") + 3))
    every = every.withColumn("alias_key", X.key(X.fold("alias")))
    met = keyed.join(names, "name_key").join(every, "mbid").join(artists.select("mbid", place.alias("place")), "mbid").where("alias_key <> name_key")
    return top(met, ["source_id"], [F.asc("place"), F.asc("mbid"), F.asc("kind"), F.asc("pos")]).select("source_id", "alias", "alias_key")


def rank_consensus(first: DataFrame, second: DataFrame, confirmed: DataFrame, matched: DataFrame) -> DataFrame:
    """Where nothing matched: the leading candidate of both queries, if they agree on a code that has recordings and the candidate is eligible.

    first, second: signalled pairs of rank 1; confirmed: (isrc); matched: (source_id)."""
    c = F.col
    able = (c("candidate_id") != "") & (c("c_isrc") != "") & c("title_exact") & ~c("conflict") & (c("artist") == 35) & c("s_asian") & ~c("c_asian") & ~c("rendition")
    other = second.select("source_id", F.col("c_isrc").alias("_isrc"))
    both = first.join(other, "source_id").where("c_isrc = _isrc").drop("_isrc").where(able)
    return both.join(confirmed.select(F.col("isrc").alias("c_isrc")).distinct(), "c_isrc", "left_semi").join(matched.select("source_id").distinct(), "source_id", "left_anti")
