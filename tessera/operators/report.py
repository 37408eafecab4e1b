"""Reports over decisions: one aggregate each, ratios guarded against zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def match_report(sources: DataFrame, winners: DataFrame, flag: Column | None = None) -> DataFrame:
    """total, matched, unmatched, match_rate, and the same for the rows that flag names. sources: (source_id, ...)."""
    found = winners.select("source_id", F.lit(1).alias("_hit")).distinct()
    joined = sources.join(found, "source_id", "left")
    hit = F.col("_hit").isNotNull()
    total, matched = F.count("*"), F.count_if(hit)
    out = [total.alias("total"), matched.alias("matched"), (total - matched).alias("unmatched"), ratio(matched, total).alias("match_rate")]
    if flag is not None:
        t, m = F.count_if(flag), F.count_if(flag & hit)
        out += [t.alias("flagged_total"), m.alias("flagged_matched"), ratio(m, t).alias("flagged_match_rate")]
    return joined.agg(*out)


def rate_by(sources: DataFrame, winners: DataFrame, group: str) -> DataFrame:
    found = winners.select("source_id", F.lit(1).alias("_hit")).distinct()
    hit = F.count_if(F.col("_hit").isNotNull())
    return sources.join(found, "source_id", "left").groupBy(group).agg(F.count("*").alias("total"), hit.alias("matched"), ratio(hit, F.count("*")).alias("match_rate"))


def source_category(sources: DataFrame, decided: DataFrame) -> DataFrame:
    """(source_id, category) of sources with no accepted candidate: the first category by name, or that nothing came back."""
    worst = decided.groupBy("source_id").agg(F.max("accepted").alias("_any"), F.min("category").alias("category"))
    joined = sources.select("source_id").join(worst, "source_id", "left").where("not coalesce(_any, false)")
    return joined.select("source_id", F.coalesce("category", F.when(F.col("_any").isNull(), F.lit("NO_CANDIDATES_RETURNED")).otherwise(F.lit("OTHER"))).alias("category"))


def histogram(df: DataFrame, values: Column, name: str) -> DataFrame:
    """How often each value of an array column occurs."""
    return df.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def production_report(results: DataFrame, baseline: int | None = None) -> DataFrame:
    """From (source_id, in_reference, first_count, n_queries, accepted): the split by reference, empty first searches, second searches, rates, and the change against a baseline."""
    ref, ok = F.col("in_reference"), F.col("accepted")
    total, n_ref, a, a_ref = F.count("*"), F.count_if(ref), F.count_if(ok), F.count_if(ok & ref)
    return results.agg(
        total.alias("total"), n_ref.alias("reference_total"), (total - n_ref).alias("missing_total"),
        F.count_if(F.col("first_count") == 0).alias("first_search_zero"), F.count_if(F.col("n_queries") > 1).alias("second_search"),
        a.alias("accepted_all"), a_ref.alias("accepted_reference"), ratio(a, total).alias("rate_all"), ratio(a_ref, n_ref).alias("rate_reference"),
        (a_ref - F.lit(baseline) if baseline is not None else F.lit(None)).cast("long").alias("delta"),
    )


def replay_report(entries: DataFrame, chosen: DataFrame, before: DataFrame) -> DataFrame:
    """entries: (input_index, n_candidates); chosen: (input_index, candidate_id) of the replay; before: (input_index) accepted earlier."""
    joined = entries.join(chosen.select("input_index", F.lit(True).alias("_now")), "input_index", "left").join(before.select("input_index", F.lit(True).alias("_was")), "input_index", "left")
    now, was = F.col("_now").isNotNull(), F.col("_was").isNotNull()
    having = F.count_if(F.col("n_candidates") > 0)
    return joined.agg(
        F.count("*").alias("total"), having.alias("with_candidates"), F.count_if(now).alias("accepted"), ratio(F.count_if(now), F.count("*")).alias("rate"), ratio(F.count_if(now), having).alias("rate_with_candidates"),
        F.count_if(now & ~was).alias("newly_accepted"), F.count_if(was & ~now).alias("lost"),
    )


def failure_report(failed: DataFrame, missing: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """failed, old, new: (input_index, line[, candidate_id]); rows that are known to be missing don't count."""
    real = failed.join(missing, "line", "left_anti")
    hits = lambda x: x.join(real.select("input_index"), "input_index", "left_semi")
    both = hits(old).select("candidate_id").unionByName(hits(new).select("candidate_id"))
    counts = [x.agg(F.count_distinct(c).alias(n)) for x, c, n in ((real, "input_index", "failed"), (hits(old), "input_index", "accepted_before"), (hits(new), "input_index", "accepted_now"), (both, "candidate_id", "candidate_ids"))]
    out = counts[0].withColumn("_k", F.lit(1))
    for c in counts[1:]:
        out = out.join(c.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def code_verdict(codes: Column, code: Column) -> Column:
    """MATCH, DIFFERENT or UNKNOWN of a candidate's code against a recording's codes."""
    return F.when(code.isNull() | (code == "") | codes.isNull() | (F.size(codes) == 0), "UNKNOWN").when(F.array_contains(codes, code), "MATCH").otherwise("DIFFERENT")


def overall_verdict(artist_same: Column, code: Column) -> Column:
    return F.when(artist_same & (code == "MATCH"), "SAME").when(artist_same | (code == "MATCH"), "LIKELY").otherwise("UNCERTAIN")


def scope_errors(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Up to three rows that aren't allowed; empty if all are."""
    return rows.join(allowed.select(*keys).distinct(), keys, "left_anti").sort(*keys).limit(3)


def with_baseline(report: DataFrame, baseline: DataFrame, sample_size: int, total: str = "reference_success_total", accepted: str = "accepted") -> DataFrame:
    """A one-row report beside a one-row baseline; a comparison only if the sample is the whole reference set."""
    b = baseline.select(F.col(total).alias("baseline_total"), F.col(accepted).alias("baseline_accepted"), F.lit(1).alias("_k"))
    both = report.withColumn("_k", F.lit(1)).join(b, "_k").drop("_k")
    full = F.col("baseline_total") == sample_size
    return both.withColumns({"is_full_run": full, "delta": F.when(full, F.col("accepted") - F.col("baseline_accepted"))})


def first_unseen(candidates: Column) -> Column:
    """For an array of arrays in order: the first element of each that no earlier array took; null where all are taken."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        pick = F.get(F.filter(row, lambda x: ~F.array_contains(acc["seen"], x)), F.lit(0))
        return F.struct(F.when(pick.isNotNull(), F.array_append(acc["seen"], pick)).otherwise(acc["seen"]).alias("seen"), F.array_append(acc["out"], pick).alias("out"))

    return F.aggregate(candidates, start, step, lambda acc: acc["out"])


def first_detail(rows: DataFrame, by: str, artist_pos: str, recording_pos: str) -> DataFrame:
    """The first recording of the first artist that has any, for each group."""
    order = F.struct(artist_pos, recording_pos)
    value = F.struct(*[c for c in rows.columns if c != by])
    return rows.groupBy(by).agg(F.min_by(value, order).alias("first")).select(by, "first.*")


def explanation(decided: DataFrame) -> DataFrame:
    """All signals of a pair in one struct, for a person to read."""
    signals = ["title_exact", "title_plain", "title0", "title2", "rendition", "rescue", "artist", "artist_common", "reliable", "album", "duration", "bound", "conflict", "baseline", "gate", "identity"]
    return decided.select("source_id", "candidate_id", "accepted", "category", "score", "reasons", F.struct(*signals).alias("signals"))
