"""Registered queries over the record-linkage operators, with their SQL equivalents.

``part`` plays both catalogues: even keys are source records, odd keys are candidates, with the name as title, the brand
as artist, the type as album and the size in seconds as duration. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import compare as P
from tessera.functions import text as X
from tessera.operators import decide, prepare, reference, report, retrieve, select
from tessera.session import stored, table
from tessera.sources import readers
from tessera.sources import vocabulary as V

#: Suffixes that make candidates other versions, by key modulo 10.
_SUFFIX = {1: " (Live)", 3: " - 2011 Remaster", 5: " (feat. Somebody)"}


def _suffixed(key: str) -> Column:
    out = F.lit("")
    for k, s in _SUFFIX.items():
        out = F.when(F.col(key) % 10 == k, s).otherwise(out)
    return out


def _records(parts: DataFrame, id_name: str, title: Column) -> DataFrame:
    return parts.select(
        F.col("p_partkey").alias(id_name), title.alias("title"), F.array("p_brand").alias("artists"), F.col("p_type").alias("album"),
        (F.col("p_size") * 1000).cast("long").alias("duration_ms"), F.lit("").alias("isrc"),
    )


def _prepared(s: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    s, c = prepare.sources(s), prepare.candidates(c)
    return stored(s, "sources"), stored(c.withColumn("c_order", F.col("candidate_id").cast("long")), "candidates")  # every stage reads both, and their keys are made once


def _catalogues(spark: SparkSession, sf: str, versions: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of both sides. Queries here are by keys, so of equal candidates the first LIMIT are all that any can return."""
    parts = table(spark, sf, "part")
    title = F.concat("p_name", _suffixed("p_partkey")) if versions else F.col("p_name")
    c = _records(parts.where("p_partkey % 2 = 1"), "candidate_id", title)
    return _records(parts.where("p_partkey % 2 = 0"), "source_id", F.col("p_name")), prepare.foremost(c, retrieve.LIMIT)


def _sides(spark: SparkSession, sf: str, versions: bool = False) -> tuple[DataFrame, DataFrame]:
    return _prepared(*_catalogues(spark, sf, versions))


def _class_sides(spark: SparkSession, sf: str, versions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sources, candidates): sources of equal content are one, whatever is found and decided for it goes for its members."""
    s, c = _catalogues(spark, sf, versions)
    once, members = prepare.classes(s)
    return members, *_prepared(once, c)


def _stages(s: DataFrame, c: DataFrame) -> DataFrame:
    return retrieve.strict(s, c, True, 1).unionByName(retrieve.strict(s, c, False, 2))


def _by_title(s: DataFrame, c: DataFrame) -> DataFrame:
    """Ten candidates of each source by title alone."""
    keyed = c.select("candidate_id", "c_order", F.explode("c_title_keys").alias("k"))
    best = select.top(keyed, ["k"], [F.asc("c_order")], retrieve.LIMIT, name="rank")  # a title's first ten serve every source of that title
    return s.select("source_id", F.col("s_core_key").alias("k")).join(best, "k").select("source_id", "candidate_id", F.lit(1).alias("query_index"), "rank")


def _decided_classes(spark: SparkSession, sf: str, by_title: bool = False, versions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sources, decisions): of classes of sources."""
    members, s, c = _class_sides(spark, sf, versions)
    found = _by_title(s, c) if by_title else _stages(s, c)
    return members, s, decide.decide(decide.signals(retrieve.pairs(s, c, found)))


def _by_class(members: DataFrame) -> DataFrame:
    """Members as rows under their class, for reports that join by source_id, with their own id as own_id."""
    return members.select(F.col("class").alias("source_id"), F.col("source_id").alias("own_id"))


def normalize_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.key(X.fold("p_name")).alias("name_key"), X.key(X.fold("p_brand")).alias("brand_key"))


def query_value_sanitize(spark, sf):
    return table(spark, sf, "events").select("event_id", X.query_value(X.text("props")).alias("query_value"))


def _variant(key: str, name: str) -> Column:
    k, n = F.col(key) % 7, F.col(name)
    return (
        F.when(k == 1, F.concat(n, F.lit(" (feat. Some One)"))).when(k == 2, F.concat(n, F.lit(" [From Album X]"))).when(k == 3, F.concat(n, F.lit(" - 2011 Remastered")))
        .when(k == 4, F.concat(n, F.lit(" (Remaster)"))).when(k == 5, F.concat(n, F.lit(" (Part One)"))).when(k == 6, F.concat(n, F.lit(' - From "Film"'))).otherwise(n)
    )


def title_core_keys(spark, sf):
    core = X.title_core(X.fold(_variant("p_partkey", "p_name")))
    return table(spark, sf, "part").select("p_partkey", core.alias("core"), F.array_join(F.array_sort(X.title_keys(core)), "|").alias("title_keys"))


def _versioned(key: str, name: str) -> Column:
    k, n = F.col(key) % 8, F.col(name)
    return (
        F.when(k == 1, F.concat(n, F.lit(" (Live)"))).when(k == 2, F.concat(n, F.lit(" - Remix"))).when(k == 3, F.concat(n, F.lit(" Acoustic Demo"))).when(k == 4, F.concat(n, F.lit(" Oliver")))
        .when(k == 5, F.concat(n, F.lit(" radio-edit"))).when(k == 6, F.concat(n, F.lit(" Karaoke Cover"))).when(k == 7, F.concat(n, F.lit(" (Deluxe Edition)"))).otherwise(n)
    )


def version_terms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(X.version_terms(X.fold(_versioned("p_partkey", "p_name")))), "|").alias("terms"))


def version_conflict(spark, sf):
    terms = X.version_terms(X.fold(_versioned("p_partkey", "p_name")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(P.version_reasons(X.version_terms(X.fold("p_name")), terms)), "|").alias("reasons"))


def _scripted() -> Column:
    k = F.col("doc_id") % 5
    return F.concat(X.text("text"), F.when(k == 1, "漢字").when(k == 2, "カナ").when(k == 3, "㐀").when(k == 4, "豈").otherwise(""))


def script_flags(spark, sf):
    t = F.col("t")
    docs = table(spark, sf, "documents").select("doc_id", _scripted().alias("t"))
    return docs.select("doc_id", X.has(X.HAN, t).alias("han"), X.has(X.KANA, t).alias("kana"), X.is_cjk_wide(t).alias("cjk_wide"), X.is_japanese(t).alias("japanese"))


def sort_name_naturalize(spark, sf):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat("c_mktsegment", F.lit(", "), "c_name")).when(k == 1, F.col("c_name")).when(k == 2, F.concat("c_name", F.lit(","))).otherwise(F.lit("a, b, c"))
    return table(spark, sf, "customer").select("c_custkey", X.natural_order(X.nfkc(name)).alias("natural_name"))


def title_artist_split(spark, sf):
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat_ws(" - ", "p_name", "p_brand")).when(k == 1, F.concat_ws(" - ", "p_name", F.lit("extra"), "p_brand")).otherwise(F.concat("p_name", F.lit(" -")))
    title, artist = X.split_line(line)
    return table(spark, sf, "part").select("p_partkey", title.alias("title"), artist.alias("artist"))


def coalesce_json_source(spark, sf):
    k = F.from_json("props", "struct<dt:string,k:string>")
    song = F.struct(k["dt"].alias("dt"), F.lit("").alias("duration_ms"), k["k"].alias("duration"))
    return table(spark, sf, "events").select("event_id", readers.duration(song).alias("duration_ms"))


def pair_scores(spark, sf):
    members, s, c = _class_sides(spark, sf)
    d = decide.signals(retrieve.pairs(s, c, _by_title(s, c))).select("source_id", "candidate_id", "artist", "album", "duration")
    return prepare.of_members(d, members).select("source_id", F.col("candidate_id").cast("long").alias("candidate_id"), "artist", "album", "duration")


def match_exact_top1(spark, sf):
    members, _, decided = _decided_classes(spark, sf)
    return prepare.of_members(select.winners(decided.where("query_index = 2")), members).select("source_id", F.col("candidate_id").cast("long").alias("candidate_id"), "score")


def cascade_two_stage(spark, sf):
    members, _, decided = _decided_classes(spark, sf)
    return prepare.of_members(select.winners(decided), members).select("source_id", "query_index", F.col("candidate_id").cast("long").alias("candidate_id"), "score")


def decision_reasons(spark, sf):
    members, _, d = _decided_classes(spark, sf, True, True)
    out = d.select("source_id", F.col("candidate_id").cast("long").alias("candidate_id"), F.array_join(F.array_sort("reasons"), "|").alias("reasons"), "accepted", "category", "score")
    return prepare.of_members(out, members).select(*out.columns)


def reject_category_hist(spark, sf):
    members, _, d = _decided_classes(spark, sf, True, True)
    return report.source_category(_by_class(members), d).groupBy("category").agg(F.count("*").alias("n"))


def ordered_dedup(spark, sf):
    return select.ordered_distinct(table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], [F.asc("event_id")])


def topk_per_source(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    return select.top(rows, ["l_partkey"], [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey")], 10, 2, "rank")


def match_report(spark, sf):
    members, _, d = _decided_classes(spark, sf)
    return report.match_report(_by_class(members), select.winners(d), F.col("own_id") % 3 == 0)


def match_rate_by_group(spark, sf):
    members, s, d = _decided_classes(spark, sf)
    return report.rate_by(_by_class(members).join(s.select("source_id", F.get("s_artists", F.lit(0)).alias("brand")), "source_id"), select.winners(d), "brand")


def signal_histogram(spark, sf):
    signals = F.array_distinct(F.array("event_type", F.when(F.col("value") > 10, "HIGH").otherwise("LOW")))
    return report.histogram(table(spark, sf, "events"), signals, "signal")


def reference_exclusion(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_anti")


def failed_not_missing(spark, sf):
    failed = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    missing = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(failed, "o_custkey", "left_semi").join(missing, "o_custkey", "left_anti")


def alias_left_join(spark, sf):
    aliases = table(spark, sf, "region").where("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("alias"))
    return table(spark, sf, "nation").join(aliases, "n_regionkey", "left").select("n_nationkey", "n_name", F.coalesce("alias", "n_name").alias("query_name"))


def entity_id_intersection(spark, sf):
    rows = table(spark, sf, "lineitem")
    side = lambda flag: rows.where(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey").distinct()
    return side("A").join(side("R"), ["l_partkey", "l_suppkey"], "left_semi")


def recording_min_diff(spark, sf):
    met = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    diff = F.abs(F.col("l_quantity") - F.col("p_size"))
    good = F.col("l_returnflag") == "N"
    n = F.count("*")
    uniqueness = F.when(n == 1, "PASS").otherwise("MULTIPLE")
    return met.groupBy("l_orderkey").agg(F.min(F.when(good, diff)).alias("best_diff"), F.max(good).alias("matched"), n.alias("recordings"), uniqueness.alias("uniqueness"))


def rank1_consensus(spark, sf):
    s, c = _sides(spark, sf)
    one = retrieve.strict(s, c, True, 1).where("rank = 1").select("source_id", "candidate_id")
    two = retrieve.strict(s, c, False, 2).where("rank = 1").select("source_id", "candidate_id")
    return one.join(two, ["source_id", "candidate_id"], "left_semi").select("source_id", F.col("candidate_id").cast("long").alias("candidate_id"))


def unique_best_or_ambiguous(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return select.unique_best(rows, ["l_partkey"], [F.desc("l_quantity")])


def max_score_with_ties(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority")).where("priority <= 3")
    return select.best_with_ties(rows, ["o_custkey"], [F.asc("priority")])


def request_cache_hits(spark, sf):
    hits = select.repeated_requests(table(spark, sf, "events"), ["user_id", "event_type", "props"], ["event_id"])
    return hits.groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if("cache_hit").alias("cache_hits"))


def budgeted_prefix(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return select.within_budget(rows, ["user_id"], [F.asc("ts"), F.asc("event_id")], F.lit(1), 10).select("event_id", "user_id", F.col("spent").cast("long").alias("spent"))


def replay_first_accept(spark, sf):
    members, _, d = _decided_classes(spark, sf, True, True)
    return prepare.of_members(select.first_accepted(d), members).select("source_id", F.col("candidate_id").cast("long").alias("candidate_id"))


def isrc_verdict(spark, sf):
    codes = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.collect_set((F.col("l_suppkey") % 10).cast("string")).alias("codes"))
    code = F.when(F.col("p_size") % 11 == 0, "").otherwise((F.col("p_size") % 10).cast("string"))
    met = table(spark, sf, "part").join(codes, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("verdict", report.code_verdict(F.col("codes"), code))
    return met.select("p_partkey", "verdict", report.overall_verdict(F.col("p_size") % 2 == 0, F.col("verdict")).alias("overall"))


def batch_of_100(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return select.global_batches(rows, ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("position").cast("long").alias("position"), F.col("batch").cast("long").alias("batch"))


def fuzzy_title_prefilter(spark, sf):
    """Keys of a name and of the same with a letter dropped in the middle, by the edit-distance condition."""
    a = X.key(X.fold(F.concat("p_name", "p_type", "p_brand")))
    rows = table(spark, sf, "part").select("p_partkey", a.alias("a")).withColumn("b", F.concat(F.expr("left(a, length(a) - 3)"), F.expr("right(a, cast(p_partkey % 4 as int))")))
    return rows.select("p_partkey", "b", (F.size(P.near_keys(F.array("a"), F.array("b"))) > 0).alias("near"))


def fuzzy_title_match(spark, sf):
    """As before, by the exact ratio."""
    a = X.key(F.lower(F.concat("p_name", "p_type", "p_brand")))
    rows = table(spark, sf, "part").select("p_partkey", a.alias("a")).withColumn("b", F.concat(F.expr("left(a, length(a) - 3)"), F.expr("right(a, cast(p_partkey % 4 as int))")))
    rows = P.with_similar(rows.withColumns({"x": F.array("a"), "y": F.array("b")}), ("x", "y"))
    return rows.select("p_partkey", "b", P.keys_match(F.col("x"), F.col("y"), 0).alias("similar"))


def simplified_titles(spark, sf):
    k = F.col("p_partkey") % 3
    title = F.concat("p_name", F.when(k == 0, " (Album Version)").when(k == 1, " - single version").otherwise(""))
    artist = F.concat("p_brand", F.when(k == 0, " feat. X").when(k == 1, ", Y").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", X.simplified_title(title).alias("title"), X.ambiguous_artist(artist).alias("ambiguous"), X.escape_query(F.concat(F.lit('"'), "p_name", F.lit("\\"))).alias("escaped"))


def strategy_queries(spark, sf):
    k = F.col("p_partkey") % 3
    title = F.concat("p_name", F.when(k == 0, " (Album Version)").when(k == 1, ' "x"').otherwise(""))
    return retrieve.strategies(table(spark, sf, "part").select("p_partkey", title.alias("title"), F.col("p_brand").alias("artist")), "p_partkey")


def query_corrections(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", retrieve.corrected(name, retrieve.title_lookup_key(X.fold("p_name")), {"small ring": "Small Rings", "red bolt": "Red Bolts"}).alias("query_title"))


def alias_strategies(spark, sf):
    parts = table(spark, sf, "part")
    k = F.col("p_partkey") % 3
    rows = parts.select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title"), F.when(k == 0, F.concat("p_brand", F.lit(", Other"))).otherwise(F.col("p_brand")).alias("artist"))
    counts = parts.where("p_size <= 10").select(F.col("p_partkey").alias("source_id"), F.lit(1).alias("n"))
    aliases = parts.where("p_size % 2 = 0").select(F.col("p_partkey").alias("source_id"), F.col("p_type").alias("alias"))
    return retrieve.alias_strategy(rows, counts, aliases)


def production_report(spark, sf):
    members, _, d = _decided_classes(spark, sf)
    first = d.where("query_index = 1").groupBy("source_id").agg(F.count("*").alias("first_count"))
    won = select.winners(d).select("source_id", F.lit(True).alias("won"))
    queried = _by_class(members).join(first, "source_id", "left").join(won, "source_id", "left")
    rows = queried.select("source_id", (F.col("own_id") % 5 != 0).alias("in_reference"), F.coalesce("first_count", F.lit(0)).alias("first_count"), F.when(F.col("first_count") > 0, 1).otherwise(2).alias("n_queries"), F.coalesce("won", F.lit(False)).alias("accepted"))
    return report.production_report(rows, 100)


def scope_errors(spark, sf):
    return report.scope_errors(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").where("lang = 'en'"), ["doc_id"])


def script_report(spark, sf):
    """Match rates over all source records and those with a wide-script title, from titles with characters added."""
    members, s, d = _decided_classes(spark, sf)
    flagged = _by_class(members).join(s.select("source_id", "s_title"), "source_id").withColumn("flag", X.is_japanese(F.concat("s_title", F.when(F.col("own_id") % 4 == 0, "曲").otherwise(""))))
    return report.match_report(flagged, select.winners(d), F.col("flag")).select("flagged_total", "flagged_matched", "flagged_match_rate")


def due_attempts(spark, sf):
    from tessera.streaming.increments import first_of_day

    return first_of_day(table(spark, sf, "events").select("event_id", "ts")).select("event_id", F.col("local_date").cast("string").alias("local_date"))


def _number(brand: str) -> Column:
    return F.regexp_extract(brand, "[0-9]+", 0)


def _scripted_records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sources under a name in Asian script, candidates under the brand and with a code, no albums."""
    parts = table(spark, sf, "part")
    base = [F.col("p_name").alias("title"), F.lit("").alias("album"), (F.col("p_size") * 1000).cast("long").alias("duration_ms")]
    s = parts.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("source_id"), *base, F.array(F.concat(F.lit("歌手"), _number("p_brand"))).alias("artists"))
    code = F.when(F.col("p_partkey") % 15 == 0, "").otherwise(F.concat(F.lit("I"), F.col("p_partkey").cast("string")))
    c = parts.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("candidate_id"), *base, F.array("p_brand").alias("artists"), code.alias("isrc"))
    return s, c


def _scripted_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s, c = _scripted_records(spark, sf)
    return _prepared(s, c)


def _reference_of_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artists of four brands in five under both names; up to three recordings of each odd part: the title, another one, one of a version; some unknown, long or credited otherwise."""
    parts, k = table(spark, sf, "part"), F.col("p_partkey")
    name, none = F.concat(F.lit("歌手"), _number("p_brand")), F.array().cast("array<string>")
    artists = parts.select("p_brand").distinct().where(_number("p_brand").cast("int") % 5 != 0).select(F.concat(F.lit("a"), "p_brand").alias("mbid"), name.alias("name"), F.col("p_brand").alias("sort_name"), none.alias("aliases"))
    each = parts.where("p_partkey % 2 = 1").select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).where("j < p_partkey div 2 % 4")
    credit = lambda name, mbid: F.struct(name.alias("name"), mbid.alias("artist_mbid"))
    shared = F.concat(F.lit("c"), k.cast("string"))
    credits = F.when(k % 17 == 0, F.array(credit(F.col("p_brand"), shared), credit(name, shared))).when(k % 13 == 0, F.array(credit(F.col("p_brand"), F.lit("z")))).otherwise(F.array(credit(F.col("p_brand"), F.concat(F.lit("a"), "p_brand"))))
    title = F.when(F.col("j") == 1, F.concat(F.lit("Other Things "), "p_name")).when((k % 19 == 0) & (F.col("j") == 0), "曲").otherwise(F.col("p_name"))
    length = F.when(k % 9 == 0, 0).otherwise(F.col("p_size") * 1000 + F.col("j") * 9000 + F.when(k % 5 == 0, 31_000).otherwise(0)).cast("long")
    mbid = F.concat_ws("-", F.lit("r"), k.cast("string"), F.col("j").cast("string"))
    made = each.select(mbid.alias("mbid"), F.concat(F.lit("I"), k.cast("string")).alias("isrc"), title.alias("title"), length.alias("length"), F.when((F.col("j") == 2) | (k % 11 == 0), "live").otherwise("").alias("disambiguation"), credits.alias("credits"))
    return artists, made.drop("isrc"), made.select("isrc", "mbid")


def verification_of_parts(spark, sf):
    """Decisions on candidates of the same title under another script, before and after the reference tables are asked."""
    s, c = _scripted_records(spark, sf)
    once, members = prepare.classes(s)
    s, c = _prepared(once, prepare.foremost(c, retrieve.LIMIT))
    signalled = stored(decide.signals(retrieve.pairs(s, c, _by_title(s, c))), "signalled")  # the verification looks at the pairs from several sides
    verified = stored(reference.verify(decide.decide(signalled).where("gate"), *_reference_of_parts(spark, sf)), "verified")
    done = decide.decide(signalled, verified).select("source_id", "candidate_id", "gate", "accepted", F.array_join("reasons", "|").alias("reasons"))
    out = prepare.of_members(done.join(verified, ["source_id", "candidate_id"]), members)
    word = lambda name: F.coalesce(F.try_element_at("predicates", F.lit(name)), F.lit("-")).alias(name)
    return out.select(
        "source_id", F.col("candidate_id").cast("long").alias("candidate_id"), "gate", "identity", "accepted", "reasons", F.col("n_recordings").cast("long").alias("n_recordings"), "best_diff", "route",
        *map(word, ("artist_identity", "recording_title", "recording_artist", "duration", "isrc_uniqueness")), F.array_join("failure_predicates", "|").alias("failures"),
    )


def decisions_of_variants(spark, sf):
    """Each part against a changed copy of itself, in twelve ways: guests, renditions, live albums, scripts, several artists, soundtracks, spellings."""
    parts, k = table(spark, sf, "part"), F.col("p_partkey") % 12
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")

    def by(default: Column, **cases: Column) -> Column:
        out = default
        for n, value in cases.items():
            out = F.when(k == int(n[1:]), value).otherwise(out)
        return out

    text = F.lit
    ms = (F.col("p_size") * 1000).cast("long")
    s = parts.select(
        F.col("p_partkey").alias("source_id"), by(name, k1=F.concat(name, text(" (with Guest)")), k9=F.concat(name, text(" feat. Guest"))).alias("title"),
        by(F.array(brand), k5=F.array(text("歌手")), k6=F.array(text("歌手")), k8=F.array(brand, text("Other")), k11=F.array(text("Olver Cheatham"))).alias("artists"),
        by(kind, k4=text("Live at Home")).alias("album"), ms.alias("duration_ms"),
    )
    c = parts.select(
        F.col("p_partkey").alias("source_id"), F.lit(1).alias("query_index"), F.lit(1).alias("rank"), F.col("p_partkey").cast("string").alias("candidate_id"),
        by(name, k4=F.concat(name, text(" - Live")), k10=F.concat(name, text(' - from "Film" Soundtrack'))).alias("title"),
        by(F.array(brand), k1=F.array(brand, text("Guest")), k2=F.array(brand, text("Else")), k3=F.array(text("Else"), brand), k7=F.array(F.concat(brand, text(" Band"))), k8=F.array(text("Other"), brand), k9=F.array(brand, text("Guest")), k11=F.array(text("Oliver Cheatham"))).alias("artists"),
        by(kind, k2=text("Zzz"), k3=F.concat(text("Else plays "), brand), k4=text("Live in Town"), k6=text("Zzz")).alias("album"),
        by(ms, k11=ms + F.when(F.col("p_size") % 2 == 0, 0).otherwise(60_000)).alias("duration_ms"), F.lit("").alias("isrc"),
    )
    d = decide.decide(decide.signals(prepare.candidates(c).join(prepare.sources(s), "source_id")))
    return d.select("source_id", "accepted", "category", F.array_join(F.array_sort("reasons"), "|").alias("reasons"), "artist", "artist_common", "album", "duration", "title_exact", "score")


def second_queries(spark, sf):
    """What the second query finds for sources in Asian script whose first one came back empty: under the artist's Latin name, else by title with the artist as free text."""
    s, c = _scripted_sides(spark, sf)
    artists = _reference_of_parts(spark, sf)[0]
    first, aliases = stored(retrieve.strict(s, c, False, 1), "first"), stored(reference.latin_alias(s, artists), "aliases")
    named = retrieve.romanised(s, c, aliases, first).withColumn("mode", F.lit("romanised"))
    free = retrieve.relaxed(s, c, aliases, first).withColumn("mode", F.lit("free"))
    return named.unionByName(free).select("source_id", F.col("candidate_id").cast("long").alias("candidate_id"), "rank", "mode")


# --- SQL ----------------------------------------------------------------------------------------------

_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_NAMES = "k AS (SELECT p_partkey AS id, {n} AS nk, {b} AS bk, {a} AS ak, p_brand AS brand, p_type AS type, p_size AS size FROM part)".format(n=_KEY.format("p_name"), b=_KEY.format("p_brand"), a=_KEY.format("p_type"))
_STRICT = f"""{_NAMES},
r AS (
  SELECT s.id AS source_id, c.id AS candidate_id, q.q AS query_index, s.size AS ss, c.size AS cs, s.ak AS sa, c.ak AS ca,
         row_number() OVER (PARTITION BY s.id, q.q ORDER BY c.id) AS rank
  FROM k s JOIN k c ON s.id % 2 = 0 AND c.id % 2 = 1 AND s.nk = c.nk AND s.bk = c.bk
  JOIN (SELECT unnest([1, 2]) AS q) q ON q.q = 2 OR s.ak = c.ak
),
top AS (SELECT * FROM r WHERE rank <= 10)"""
_DURATION = "CASE WHEN abs({0} - {1}) <= 3 THEN 50 WHEN abs({0} - {1}) <= 8 THEN 40 WHEN abs({0} - {1}) <= 15 THEN 25 WHEN abs({0} - {1}) <= 30 THEN 10 ELSE 0 END"
_ALBUM = "CASE WHEN {0} = {1} THEN 60 WHEN contains({0}, {1}) OR contains({1}, {0}) THEN 45 ELSE 10 END"
_SCORED = f"""{_STRICT},
scored AS (SELECT *, (300 + 500 + {_ALBUM.format("sa", "ca")} + {_DURATION.format("ss", "cs")} + 100)::INT AS score FROM top)"""
_WON = f"""{_SCORED},
first_q AS (SELECT source_id, min(query_index) AS q FROM scored GROUP BY 1),
won AS (
  SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.source_id ORDER BY score DESC, s.rank) AS w
  FROM scored s JOIN first_q f ON s.source_id = f.source_id AND s.query_index = f.q) WHERE w = 1
)"""
_TITLED = f"""{_NAMES},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY id) AS rank FROM k WHERE id % 2 = 1) WHERE rank <= 10),
m AS (
  SELECT s.id AS source_id, c.id AS candidate_id, c.rank,
         CASE WHEN s.bk = c.bk THEN 100 WHEN contains(s.bk, c.bk) OR contains(c.bk, s.bk) THEN 80 ELSE 0 END AS artist,
         {_ALBUM.format("s.ak", "c.ak")} AS album, {_DURATION.format("s.size", "c.size")} AS duration
  FROM k s JOIN best c ON s.nk = c.nk AND s.id % 2 = 0
)"""
_REASONED = f"""{_TITLED},
d AS (
  SELECT *, list_sort(list_filter([CASE WHEN artist = 0 THEN 'artist mismatch' END, CASE WHEN candidate_id % 10 = 1 THEN 'live version mismatch' END], lambda x: x IS NOT NULL)) AS reasons
  FROM m
),
e AS (
  SELECT *, len(reasons) = 0 AS accepted, CASE WHEN len(reasons) = 0 THEN NULL WHEN candidate_id % 10 = 1 THEN 'VERSION_CONFLICT' ELSE 'ARTIST_CONFLICT' END AS category,
         (300 + 5 * artist + album + duration + 100)::INT AS score
  FROM d
)"""


def _term_sql(x: str) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches({x}, '(^|[^a-z0-9])({V.TERM_PATTERNS.get(t, t)})([^a-z0-9]|$)') THEN '{t}' END" for t in V.ALL_TERMS)
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


_CASE7 = """CASE p_partkey % 7 WHEN 1 THEN p_name || ' (feat. Some One)' WHEN 2 THEN p_name || ' [From Album X]' WHEN 3 THEN p_name || ' - 2011 Remastered'
 WHEN 4 THEN p_name || ' (Remaster)' WHEN 5 THEN p_name || ' (Part One)' WHEN 6 THEN p_name || ' - From "Film"' ELSE p_name END"""
_CASE8 = """CASE p_partkey % 8 WHEN 1 THEN p_name || ' (Live)' WHEN 2 THEN p_name || ' - Remix' WHEN 3 THEN p_name || ' Acoustic Demo' WHEN 4 THEN p_name || ' Oliver'
 WHEN 5 THEN p_name || ' radio-edit' WHEN 6 THEN p_name || ' Karaoke Cover' WHEN 7 THEN p_name || ' (Deluxe Edition)' ELSE p_name END"""
_HARD = "[" + ", ".join(f"'{t}'" for t in V.HARD_TERMS) + "]"
_INVALID = "[" + ", ".join(f"'{t}'" for t in V.INVALID_TERMS) + "]"

QUERIES = {f.__name__: f for f in (
    normalize_key, query_value_sanitize, title_core_keys, version_terms, version_conflict, script_flags, sort_name_naturalize, title_artist_split, coalesce_json_source,
    pair_scores, match_exact_top1, cascade_two_stage, decision_reasons, reject_category_hist, ordered_dedup, topk_per_source, match_report, match_rate_by_group, signal_histogram,
    reference_exclusion, failed_not_missing, alias_left_join, entity_id_intersection, recording_min_diff, rank1_consensus, unique_best_or_ambiguous, max_score_with_ties,
    request_cache_hits, budgeted_prefix, replay_first_accept, isrc_verdict, batch_of_100, fuzzy_title_prefilter, fuzzy_title_match, simplified_titles, production_report, scope_errors,
    script_report, due_attempts, strategy_queries, query_corrections, alias_strategies, verification_of_parts, second_queries, decisions_of_variants,
)}

ORACLES: dict[str, str] = {
    "normalize_key": f"SELECT p_partkey, {_KEY.format('p_name')} AS name_key, {_KEY.format('p_brand')} AS brand_key FROM part",
    "query_value_sanitize": """SELECT event_id, trim(regexp_replace(translate(coalesce(props, ''), '"*', '  '), '\\s+', ' ', 'g')) AS query_value FROM events""",
    "title_core_keys": f"""
WITH f AS (SELECT p_partkey, trim(lower({_CASE7})) AS t FROM part),
a AS (SELECT p_partkey, regexp_replace(t, '\\s*\\((?:with|feat\\.?|featuring)\\b[^)]*\\)', '', 'g') AS t FROM f),
b AS (SELECT p_partkey, regexp_replace(t, '\\s*-?\\s*\\[(?:from)\\s+[^\\]]+\\]\\s*$', '') AS t FROM a),
c AS (SELECT p_partkey, regexp_replace(t, '\\s*-\\s*from\\s+["“”][^"“”]+["“”]\\s*$', '') AS t FROM b),
d AS (SELECT p_partkey, regexp_replace(t, '\\s*-\\s*(?:\\d{{4}}\\s+)?remaster(?:ed)?\\s*$', '') AS t FROM c),
e AS (SELECT p_partkey, trim(regexp_replace(t, '\\s*\\((?:\\d{{4}}\\s+)?remaster(?:ed)?\\)\\s*$', '')) AS core FROM d)
SELECT p_partkey, core, array_to_string(list_sort(list_distinct(list_filter([{_KEY.format("core")}, {_KEY.format("regexp_replace(core, '\\s*\\([^)]*\\)\\s*$', '')")}], lambda x: x <> ''))), '|') AS title_keys FROM e""",
    "version_terms": f"SELECT p_partkey, array_to_string(list_sort({_term_sql('t')}), '|') AS terms FROM (SELECT p_partkey, lower({_CASE8}) AS t FROM part)",
    "version_conflict": f"""
WITH v AS (SELECT p_partkey, {_term_sql('lower(p_name)')} AS s, {_term_sql(f'lower({_CASE8})')} AS c FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN list_has_any(c, {_INVALID}) THEN 'tribute/cover/karaoke release' END], lambda x: x IS NOT NULL)
  || [t || ' version mismatch' for t in {_HARD} if list_contains(s, t) <> list_contains(c, t)]), '|') AS reasons FROM v""",
    "script_flags": """
WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 5 WHEN 1 THEN '漢字' WHEN 2 THEN 'カナ' WHEN 3 THEN '㐀' WHEN 4 THEN '豈' ELSE '' END AS t FROM documents)
SELECT doc_id, regexp_matches(t, '[\\x{4e00}-\\x{9fff}]') AS han, regexp_matches(t, '[\\x{3040}-\\x{30ff}]') AS kana,
  regexp_matches(t, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]') AS cjk_wide, regexp_matches(t, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]') AS japanese FROM d""",
    "sort_name_naturalize": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' ' || c_mktsegment WHEN 1 THEN c_name END AS natural_name FROM customer",
    "title_artist_split": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' - extra' END AS title, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS artist FROM part",
    "coalesce_json_source": "SELECT event_id, CASE WHEN try_cast(json_extract_string(props, '$.k') AS BIGINT) > 0 THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS duration_ms FROM events",
    "pair_scores": f"WITH {_TITLED} SELECT source_id, candidate_id, artist, album, duration FROM m",
    "match_exact_top1": f"WITH {_SCORED} SELECT source_id, candidate_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, rank) AS w FROM scored WHERE query_index = 2) WHERE w = 1",
    "cascade_two_stage": f"WITH {_WON} SELECT source_id, query_index, candidate_id, score FROM won",
    "decision_reasons": f"WITH {_REASONED} SELECT source_id, candidate_id, array_to_string(reasons, '|') AS reasons, accepted, category, score FROM e",
    "reject_category_hist": f"""WITH {_REASONED},
g AS (SELECT k.id, bool_or(accepted) AS hit, min(category) AS category FROM k LEFT JOIN e ON e.source_id = k.id WHERE k.id % 2 = 0 GROUP BY k.id)
SELECT coalesce(category, 'NO_CANDIDATES_RETURNED') AS category, count(*) AS n FROM g WHERE NOT coalesce(hit, false) GROUP BY 1""",
    "ordered_dedup": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1",
    "topk_per_source": "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rank FROM lineitem) WHERE rank BETWEEN 3 AND 12",
    "match_report": f"""WITH {_WON}, j AS (SELECT k.id, w.source_id IS NOT NULL AS hit FROM k LEFT JOIN won w ON w.source_id = k.id WHERE k.id % 2 = 0)
SELECT count(*) AS total, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) AS unmatched, count(*) FILTER (hit) / count(*)::DOUBLE AS match_rate,
  count(*) FILTER (id % 3 = 0) AS flagged_total, count(*) FILTER (hit AND id % 3 = 0) AS flagged_matched, count(*) FILTER (hit AND id % 3 = 0) / count(*) FILTER (id % 3 = 0)::DOUBLE AS flagged_match_rate FROM j""",
    "match_rate_by_group": f"""WITH {_WON}, j AS (SELECT k.brand, w.source_id IS NOT NULL AS hit FROM k LEFT JOIN won w ON w.source_id = k.id WHERE k.id % 2 = 0)
SELECT brand, count(*) AS total, count(*) FILTER (hit) AS matched, count(*) FILTER (hit) / count(*)::DOUBLE AS match_rate FROM j GROUP BY 1""",
    "signal_histogram": "SELECT signal, count(*) AS n FROM (SELECT unnest(list_distinct([event_type, CASE WHEN value > 10 THEN 'HIGH' ELSE 'LOW' END])) AS signal FROM events) GROUP BY 1",
    "reference_exclusion": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "failed_not_missing": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "alias_left_join": "SELECT n_nationkey, n_name, coalesce(r_name, n_name) AS query_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey % 2 = 0",
    "entity_id_intersection": "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'",
    "recording_min_diff": """SELECT l_orderkey, min(CASE WHEN l_returnflag = 'N' THEN abs(l_quantity - p_size) END) AS best_diff, bool_or(l_returnflag = 'N') AS matched, count(*) AS recordings,
  CASE WHEN count(*) = 1 THEN 'PASS' ELSE 'MULTIPLE' END AS uniqueness FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "rank1_consensus": f"WITH {_STRICT} SELECT a.source_id, a.candidate_id FROM top a JOIN top b ON a.source_id = b.source_id AND a.candidate_id = b.candidate_id AND a.query_index = 1 AND b.query_index = 2 AND a.rank = 1 AND b.rank = 1",
    "unique_best_or_ambiguous": """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS r, count(*) OVER (PARTITION BY l_partkey, l_quantity) AS n FROM lineitem) WHERE r = 1 AND n = 1""",
    "max_score_with_ties": """SELECT o_custkey, o_orderkey, priority FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY priority) AS r FROM (SELECT o_custkey, o_orderkey, substr(o_orderpriority, 1, 1)::INT AS priority FROM orders) WHERE priority <= 3) WHERE r = 1""",
    "request_cache_hits": "SELECT event_type, count(*) AS requests, count(*) FILTER (n > 1) AS cache_hits FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events) GROUP BY 1",
    "budgeted_prefix": "SELECT event_id, user_id, spent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events) WHERE spent <= 10",
    "replay_first_accept": f"WITH {_REASONED} SELECT source_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rank) AS w FROM e WHERE accepted) WHERE w = 1",
    "isrc_verdict": """
WITH c AS (SELECT l_partkey, list(DISTINCT (l_suppkey % 10)::VARCHAR) AS codes FROM lineitem GROUP BY 1),
v AS (SELECT p_partkey, p_size, CASE WHEN p_size % 11 = 0 OR codes IS NULL THEN 'UNKNOWN' WHEN list_contains(codes, (p_size % 10)::VARCHAR) THEN 'MATCH' ELSE 'DIFFERENT' END AS verdict FROM part LEFT JOIN c ON p_partkey = l_partkey)
SELECT p_partkey, verdict, CASE WHEN p_size % 2 = 0 AND verdict = 'MATCH' THEN 'SAME' WHEN p_size % 2 = 0 OR verdict = 'MATCH' THEN 'LIKELY' ELSE 'UNCERTAIN' END AS overall FROM v""",
    "batch_of_100": "SELECT o_orderkey, n - 1 AS position, (n - 1) // 100 AS batch FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)",
    "fuzzy_title_prefilter": f"""
WITH a AS (SELECT p_partkey, {_KEY.format("p_name || p_type || p_brand")} AS a FROM part),
b AS (SELECT p_partkey, a, a[1:length(a) - 3] || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE right(a, (p_partkey % 4)::INT) END AS b FROM a)
SELECT p_partkey, b, abs(length(a) - length(b)) <= 3 AND 25 * levenshtein(a, b) <= 2 * (length(a) + length(b)) AS near FROM b""",
    "strategy_queries": """
WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' (Album Version)' WHEN 1 THEN ' x' ELSE '' END AS t, p_name || CASE p_partkey % 3 WHEN 1 THEN ' x' ELSE '' END AS u, p_brand AS a FROM part),
s AS (SELECT *, unnest([1, 2, 3, 4]) AS k FROM t)
SELECT p_partkey, CASE k WHEN 1 THEN 'structured_p0' WHEN 2 THEN 'structured_p10' WHEN 3 THEN 'simplified_title' ELSE 'track_only' END AS strategy,
  'track:"' || CASE k WHEN 3 THEN u ELSE t END || CASE k WHEN 4 THEN '"' ELSE '" artist:"' || a || '"' END AS query, CASE k WHEN 2 THEN 10 ELSE 0 END AS "offset" FROM s""",
    "query_corrections": "SELECT p_partkey, CASE lower(p_name) WHEN 'small ring' THEN 'Small Rings' WHEN 'red bolt' THEN 'Red Bolts' ELSE p_name END AS query_title FROM part",
    "alias_strategies": """
WITH a AS (SELECT p_partkey AS source_id, CASE WHEN p_size <= 10 THEN 'NOT_NEEDED' WHEN p_partkey % 3 = 0 THEN 'SKIPPED_AMBIGUOUS' WHEN p_size % 2 = 1 THEN 'SKIPPED_NO_ALIAS' ELSE 'ATTEMPTED' END AS status, p_name, p_type FROM part)
SELECT source_id, status, CASE WHEN status = 'ATTEMPTED' THEN 'track:"' || p_name || '" artist:"' || p_type || '"' END AS query FROM a""",
    "verification_of_parts": f"""
WITH p AS (SELECT p_partkey AS k, {_KEY.format("p_name")} AS nk, p_brand AS brand, regexp_extract(p_brand, '[0-9]+')::INT % 5 <> 0 AS listed, p_size * 1000 AS ms FROM part),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY k) AS w FROM p WHERE k % 2 = 1) WHERE w <= 10),
pairs AS (SELECT s.k AS source_id, c.k AS candidate_id, c.k % 15 <> 0 AS coded, s.brand = c.brand AS same, s.listed AS s_listed, abs(s.ms - c.ms) AS gap, c.ms AS ms FROM p s JOIN best c ON s.nk = c.nk AND s.k % 2 = 0),
rec AS (
  SELECT k, j, k % 17 = 0 AS shared, k % 13 = 0 AS odd, j = 1 OR (k % 19 = 0 AND j = 0) AS other, k % 19 = 0 AND j = 0 AS asian, j = 2 OR k % 11 = 0 AS live,
         CASE WHEN k % 9 = 0 THEN NULL ELSE j * 9000 + CASE WHEN k % 5 = 0 THEN 31000 ELSE 0 END END AS diff, k // 2 % 4 AS n
  FROM (SELECT k, unnest([0, 1, 2]) AS j FROM p WHERE k % 2 = 1) WHERE j < k // 2 % 4
),
known AS (SELECT *, CASE WHEN same AND s_listed THEN 'artist' WHEN same AND coded AND candidate_id % 17 = 0 AND candidate_id // 2 % 4 > 0 THEN 'artist-credit' END AS route FROM pairs),
met AS (
  SELECT known.*, r.k IS NOT NULL AS found, r.diff,
         coalesce(CASE route WHEN 'artist' THEN NOT shared AND NOT odd WHEN 'artist-credit' THEN shared END, false) AS r_artist,
         coalesce(NOT other, false) AS r_match, coalesce(live, false) AS r_live, coalesce(asian, false) AND n = 1 AND route = 'artist' AS crossing
  FROM known LEFT JOIN rec r ON r.k = candidate_id AND coded AND route IS NOT NULL
),
q AS (SELECT *, r_artist AND NOT r_live AND (r_match OR (crossing AND coalesce(diff <= 30000, false))) AS good FROM met),
g AS (
  SELECT source_id, candidate_id, any_value(coded) AS coded, any_value(route) AS route, any_value(gap) AS gap, count(*) FILTER (found) AS n_recordings, bool_or(good) AS good,
         min(diff) FILTER (good) AS best_diff, bool_or(good AND NOT r_match) AS crossed, bool_or(r_artist) AS any_artist
  FROM q GROUP BY 1, 2
),
i AS (
  SELECT *, route IS NOT NULL AS known,
    coded AND route IS NOT NULL AND CASE WHEN n_recordings = 0 THEN route = 'artist' ELSE good AND (best_diff IS NULL OR best_diff <= 30000) END AS confirmed
  FROM g
),
w AS (
  SELECT *, CASE WHEN coded THEN confirmed ELSE known AND gap <= 8000 END AS identity,
    CASE WHEN NOT coded THEN '-' WHEN known THEN 'PASS' ELSE 'FAIL' END AS artist_identity,
    CASE WHEN NOT coded OR NOT known THEN '-' WHEN n_recordings = 0 THEN 'UNKNOWN' WHEN crossed THEN 'UNKNOWN_CROSS_SCRIPT' WHEN good THEN 'PASS' ELSE 'FAIL' END AS recording_title,
    CASE WHEN NOT coded OR NOT known THEN '-' WHEN n_recordings = 0 THEN 'UNKNOWN' WHEN any_artist THEN 'PASS' ELSE 'FAIL' END AS recording_artist,
    CASE WHEN NOT coded OR NOT known THEN '-' WHEN best_diff IS NULL THEN 'UNKNOWN' WHEN best_diff <= 30000 THEN 'PASS' ELSE 'FAIL' END AS duration,
    CASE WHEN NOT coded OR NOT known THEN '-' WHEN n_recordings = 0 THEN 'NOT_FOUND' WHEN n_recordings = 1 THEN 'PASS' ELSE 'MULTIPLE' END AS isrc_uniqueness
  FROM i
)
SELECT source_id, candidate_id, true AS gate, identity, identity AS accepted, CASE WHEN identity THEN '' ELSE 'artist not sufficiently corroborated' END AS reasons, n_recordings, best_diff::BIGINT AS best_diff, route,
  artist_identity, recording_title, recording_artist, duration, isrc_uniqueness,
  CASE WHEN NOT coded OR confirmed THEN '' WHEN NOT known THEN 'artist_identity' WHEN n_recordings = 0 THEN 'recording_evidence'
    ELSE array_to_string(list_filter([CASE WHEN recording_title = 'FAIL' THEN 'recording_title' END, CASE WHEN recording_artist = 'FAIL' THEN 'recording_artist' END, CASE WHEN duration IN ('FAIL', 'UNKNOWN') THEN 'duration' END], lambda x: x IS NOT NULL), '|') END AS failures
FROM w""",
    "decisions_of_variants": """
WITH p AS (SELECT p_partkey, p_partkey % 12 AS k, p_size % 2 = 0 AS near, p_type FROM part),
s AS (
  SELECT p_partkey AS source_id, k, near,
    CASE k WHEN 3 THEN 'likely rendition project' WHEN 6 THEN 'artist not sufficiently corroborated' WHEN 11 THEN CASE WHEN near THEN '' ELSE 'artist spelling correction lacks duration corroboration' END ELSE '' END AS reasons,
    CASE WHEN k IN (5, 6) THEN 35 WHEN k = 7 THEN 80 ELSE 100 END AS artist, CASE WHEN k IN (5, 6) THEN 0 WHEN k = 8 THEN 2 ELSE 1 END AS artist_common,
    CASE WHEN k IN (2, 3, 4, 6) THEN 10 ELSE 60 END AS album, CASE WHEN k = 11 AND NOT near THEN 0 ELSE 50 END AS duration, k NOT IN (4, 9, 10) AS title_exact
  FROM p
)
SELECT source_id, reasons = '' AS accepted, CASE k WHEN 6 THEN 'ARTIST_CONFLICT' WHEN 3 THEN 'INSUFFICIENT_EVIDENCE' WHEN 11 THEN CASE WHEN NOT near THEN 'INSUFFICIENT_EVIDENCE' END END AS category, reasons,
  artist, artist_common, album, duration, title_exact, (CASE WHEN title_exact THEN 300 ELSE 276 END + 5 * artist + album + duration + 100 - CASE WHEN k IN (2, 3) THEN 100 ELSE 0 END)::INT AS score
FROM s""",
    "second_queries": f"""
WITH p AS (SELECT p_partkey AS k, {_KEY.format("p_name")} AS nk, p_brand AS brand, regexp_extract(p_brand, '[0-9]+')::INT % 5 <> 0 AS listed FROM part),
m AS (
  SELECT s.k AS source_id, c.k AS candidate_id, CASE WHEN s.listed THEN 'romanised' ELSE 'free' END AS mode, row_number() OVER (PARTITION BY s.k ORDER BY c.k) AS rank
  FROM p s JOIN p c ON s.k % 2 = 0 AND c.k % 2 = 1 AND s.nk = c.nk AND (NOT s.listed OR s.brand = c.brand)
)
SELECT source_id, candidate_id, rank::INT AS rank, mode FROM m WHERE rank <= 10""",
    "simplified_titles": """SELECT p_partkey, p_name AS title, p_partkey % 3 < 2 AS ambiguous, '\\"' || p_name || '\\\\' AS escaped FROM part""",
    "production_report": f"""WITH {_WON}, f AS (SELECT source_id, count(*) AS n FROM top WHERE query_index = 1 GROUP BY 1),
j AS (SELECT k.id, coalesce(f.n, 0) AS n, w.source_id IS NOT NULL AS hit, k.id % 5 <> 0 AS ref FROM k LEFT JOIN f ON f.source_id = k.id LEFT JOIN won w ON w.source_id = k.id WHERE k.id % 2 = 0)
SELECT count(*) AS total, count(*) FILTER (ref) AS reference_total, count(*) FILTER (NOT ref) AS missing_total, count(*) FILTER (n = 0) AS first_search_zero, count(*) FILTER (n = 0) AS second_search,
  count(*) FILTER (hit) AS accepted_all, count(*) FILTER (hit AND ref) AS accepted_reference, count(*) FILTER (hit) / count(*)::DOUBLE AS rate_all,
  count(*) FILTER (hit AND ref) / count(*) FILTER (ref)::DOUBLE AS rate_reference, count(*) FILTER (hit AND ref) - 100 AS delta FROM j""",
    "scope_errors": "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY doc_id LIMIT 3",
    "script_report": f"""WITH {_WON}, j AS (SELECT k.id, w.source_id IS NOT NULL AS hit FROM k LEFT JOIN won w ON w.source_id = k.id WHERE k.id % 4 = 0)
SELECT count(*) AS flagged_total, count(*) FILTER (hit) AS flagged_matched, count(*) FILTER (hit) / count(*)::DOUBLE AS flagged_match_rate FROM j""",
    "due_attempts": """
WITH l AS (SELECT event_id, ts, ts + INTERVAL 8 HOUR AS local FROM events)
SELECT event_id, local::DATE::VARCHAR AS local_date FROM (SELECT *, row_number() OVER (PARTITION BY local::DATE ORDER BY ts) AS n FROM l WHERE hour(local) * 60 + minute(local) >= 370) WHERE n = 1""",
}
