"""The decision on a pair as one declarative rule: signal columns, then reasons; a pair without a reason is accepted.

Signals are added in groups of columns, so each is worked out once. The similarity of titles leaves the JVM only for rows
without equal keys whose edit distance allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import compare as P
from tessera.functions import text as X


def signals(pairs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Adds what the two prepared sides of a pair say about each other; titles are compared across scripts if both sides were prepared with a converter."""
    c = F.col
    points, common = P.artist_points(c("s_artist_keys"), c("s_alias_keys"), c("c_artist_keys"), c("s_asian"), c("c_asian"))
    compared = {"title_plain": ("s_title_keys", "c_title_keys"), "title_unlive": ("s_title_keys", "c_unlive_keys"), "title_featured": ("s_featured_keys", "c_title_keys"), "title_track": ("s_title_keys", "c_track_keys")}
    if fuzzy:
        pairs = P.with_similar(pairs, *compared.values())
    matches = {name: P.keys_match(c(a), c(b), i if fuzzy else None) for i, (name, (a, b)) in enumerate(compared.items())}
    df = pairs.withColumns({
        "artist": points,
        "artist_common": common,
        "album": P.album_points(c("s_album"), c("c_album"), c("s_album_key"), c("c_album_key")),
        "duration": P.duration_points(c("s_duration"), c("c_duration")),
        "title_exact": F.array_contains("c_title_keys", c("s_core_key")),
        "version_reasons": P.version_reasons(c("s_terms"), c("c_terms")),
        "bound": F.arrays_overlap("c_artist_keys", "s_bound_keys"),
        **matches,
    })
    df = df.withColumns({
        "title0": c("title_plain") | (c("s_album_live") & c("c_album_live") & c("title_unlive")),
        "conflict": F.size("version_reasons") > 0,
        "reliable": c("artist") >= 80,
    })
    alone = (F.size("s_artists") == 1) & (c("c_n_artists") > 1) & c("title0") & (c("album") < 45)
    df = df.withColumn("rendition", alone & F.when(alone, P.plays_artist(c("s_first_artist"), c("c_context"))).otherwise(False))
    converted = [c(x) if {"s_converted", "c_converted"} <= set(pairs.columns) else None for x in ("s_converted", "c_converted")]
    cjk = X.cjk_title_status(c("s_folded"), c("c_folded"), *converted, c("conflict")) == "CJK_EQUIVALENT"
    featured = F.arrays_overlap("s_credit_keys", "c_artist_keys") & c("title_featured")
    by_other_means = ~c("conflict") & (featured | c("title_track") | cjk)
    return df.withColumns({
        "title2": (c("title0") & ~c("rendition")) | by_other_means,
        "rescue": ~c("title_plain") & c("s_title_han") & ~c("c_title_han") & ~c("c_title_kana") & ~c("conflict"),
    })


def decide(signalled: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Adds baseline, gate, reasons, category, accepted and score. verified: (source_id, candidate_id, identity) from reference tables, for gated pairs."""
    c = F.col
    enough = (c("artist") > 0) & (c("reliable") | (c("title_exact") & (c("album") >= 45)))
    df = signalled.withColumn("baseline", c("title2") & ~c("conflict") & enough & (~c("bound") | (c("duration") >= 40)))
    weak = (c("artist") == 35) & ~c("reliable")
    plain = ~c("baseline") & weak & c("title2") & ~c("conflict")
    crossed = c("rescue") & ~c("baseline") & (weak | ((c("artist") > 0) & c("reliable")))
    df = df.withColumn("gate", plain | crossed)
    if verified is not None:
        df = df.join(verified.select("source_id", "candidate_id", "identity"), ["source_id", "candidate_id"], "left")
    identity = F.coalesce("identity", F.lit(False)) if verified is not None else F.lit(False)
    df = df.withColumn("identity", c("gate") & identity)
    reason = lambda test, name: F.when(test, F.lit(name))
    listed = F.array(
        reason(c("candidate_id") == "", "missing id"),
        reason(~c("title0") & ~(c("title2") | (c("identity") & c("rescue"))), "title mismatch"),
        reason(c("rendition"), "likely rendition project"),
        reason(c("bound") & (c("duration") < 40), "artist spelling correction lacks duration corroboration"),
        reason(c("artist") == 0, "artist mismatch"),
        reason((c("artist") > 0) & ~c("reliable") & ~c("identity") & ~(c("title_exact") & (c("album") >= 45)), "artist not sufficiently corroborated"),
    )
    df = df.withColumn("reasons", F.concat(F.filter(listed, lambda r: r.isNotNull()), "version_reasons"))
    penalty = P.extra_artist_penalty(F.size("s_artists"), c("c_n_artists"), c("album"))
    return df.withColumns({
        "accepted": F.size("reasons") == 0,
        "category": F.when(F.size("reasons") > 0, P.category(c("reasons"))),
        "score": P.total_points(c("title_exact"), c("artist"), c("album"), c("duration"), penalty),
    })
