"""Signals of a pair: column expressions over the prepared sides (see operators.prepare)."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import vocabulary as V


def _close(x: str, y: str) -> bool:
    """Whether a source key and a candidate key have a matching ratio of 0.92. The order matters."""
    m = difflib.SequenceMatcher(None, x, y)
    return m.real_quick_ratio() >= 0.92 and m.quick_ratio() >= 0.92 and m.ratio() >= 0.92


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _similar(lists: pa.Array) -> pa.Array:
    """For each list of pairs of keys whether one of them is close."""
    inner = lists.values
    pairs, offsets = inner.values, inner.offsets.to_pylist()
    close = [_close(x, y) for x, y in zip(pairs.field("s").to_pylist(), pairs.field("c").to_pylist(), strict=True)]
    return pa.ListArray.from_arrays(lists.offsets, pa.array([any(close[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.bool_()))


def near_keys(source_keys: Column, candidate_keys: Column) -> Column:
    """Pairs of keys that can have the ratio: a ratio of 0.92 means that at most 8 in 100 characters of both are edited,
    so the edit distance, which Spark has, rules all others out."""

    def of(s: Column) -> Column:
        close = F.filter(candidate_keys, lambda c: (F.abs(F.length(s) - F.length(c)) <= 3) & (25 * F.levenshtein(s, c) <= 2 * (F.length(s) + F.length(c))))
        return F.transform(close, lambda c: F.struct(s.alias("s"), c.alias("c")))

    return F.flatten(F.transform(source_keys, of))


def _equal(source_keys: Column, candidate_keys: Column) -> Column:
    return F.coalesce(F.arrays_overlap(source_keys, candidate_keys), F.lit(False))


def with_similar(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Adds near: for each (source keys, candidate keys) the keys that aren't equal, but whose edit distance allows the ratio; and similar: whether one of
    them has it. Only near keys go to Python, which are few, and all of a row at once."""
    none = F.array().cast("array<struct<s:string,c:string>>")
    listed = [F.when(_equal(F.col(s), F.col(c)), none).otherwise(F.coalesce(near_keys(F.col(s), F.col(c)), none)) for s, c in pairs]
    return df.withColumn("near", F.array(*listed)).withColumn("similar", _similar("near"))


def keys_match(source_keys: Column, candidate_keys: Column, at: int | None = None) -> Column:
    """Equal keys, or similar ones by the columns of with_similar, where these are place at of the pairs."""
    equal = _equal(source_keys, candidate_keys)
    return equal if at is None else equal | ((F.size(F.get("near", F.lit(at))) > 0) & F.get("similar", F.lit(at)))


def artist_points(source_keys: Column, source_alias_keys: Column, candidate_keys: Column, source_asian: Column, candidate_asian: Column) -> tuple[Column, Column]:
    """(points, common): 100 for a common key, aliases included; 80 for one that holds another; 35 if a side is in Asian script; else 0.

    Points of 80 and more are reliable. An empty key is common with an empty key, and part of any."""
    known = F.array_union(source_keys, source_alias_keys)
    common = F.size(F.array_intersect(known, candidate_keys))
    inside = F.exists(source_keys, lambda s: (s != "") & F.exists(candidate_keys, lambda c: F.contains(c, s) | F.contains(s, c)))
    points = F.when(common > 0, 100).when(inside, 80).when(source_asian | candidate_asian, 35).otherwise(0)
    return points, F.when(common > 0, common).when(inside, 1).otherwise(0)


def duration_points(a: Column, b: Column) -> Column:
    diff = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), 0).when(diff <= 3000, 50).when(diff <= 8000, 40).when(diff <= 15000, 25).when(diff <= 30000, 10).otherwise(0)


def valid_duration(c: Column) -> Column:
    """Whole milliseconds above zero, else null."""
    d = c.try_cast("bigint")
    return F.when(d > 0, d)


def album_points(source: Column, candidate: Column, source_key: Column, candidate_key: Column) -> Column:
    """60 equal, 45 one in the other, 30 a common run of letters and digits, else 10; 0 if a side has no album."""
    runs = lambda k: F.regexp_extract_all(k, F.lit("[a-z0-9]+"), F.lit(0))
    return (
        F.when((source == "") | (candidate == ""), 0)
        .when(source_key == candidate_key, 60)
        .when(F.contains(source_key, candidate_key) | F.contains(candidate_key, source_key), 45)
        .when(F.arrays_overlap(runs(source_key), runs(candidate_key)), 30)
        .otherwise(10)
    )


def version_reasons(source_terms: Column, candidate_terms: Column) -> Column:
    """Reasons against a candidate of another version: what only one side has, and releases by others."""
    hard = F.array(*[F.lit(t) for t in V.HARD_TERMS])
    invalid = F.array(*[F.lit(t) for t in V.INVALID_TERMS])
    one_sided = F.array_union(F.array_except(source_terms, candidate_terms), F.array_except(candidate_terms, source_terms))
    mismatched = F.transform(F.array_intersect(hard, one_sided), lambda t: F.concat(t, F.lit(" version mismatch")))
    by_others = F.when(F.size(F.array_intersect(candidate_terms, invalid)) > 0, F.array(F.lit("tribute/cover/karaoke release"))).otherwise(F.array().cast("array<string>"))
    return F.concat(by_others, mismatched)


def extra_artist_penalty(n_source: Column, n_candidate: Column, album: Column) -> Column:
    return F.when((n_source == 1) & (n_candidate > 1) & (album < 45), 100).otherwise(0)


def total_points(title_exact: Column, artist: Column, album: Column, duration: Column, penalty: Column) -> Column:
    """Title 300 or 276, artist 5 for each of its points, album, duration, 100 for the version, less the penalty."""
    return F.when(title_exact, 300).otherwise(276) + 5 * artist + album + duration + 100 - penalty


def plays_artist(artist_folded: Column, context_folded: Column) -> Column:
    """Whether the context says that somebody plays the artist."""
    escaped = F.regexp_replace(artist_folded, "([^\\p{L}\\p{N}_ ])", "\\\\$1")
    return F.regexp_like(context_folded, F.concat(F.lit("(?U)(?:^|[^\\w])plays\\W+"), F.replace(escaped, F.lit(" "), F.lit("\\W+")), F.lit("(?:$|[^\\w])")))


def category(reasons: Column) -> Column:
    """What a rejected candidate failed in."""
    title = F.array_contains(reasons, "title mismatch")
    artist = F.array_contains(reasons, "artist mismatch") | F.array_contains(reasons, "artist not sufficiently corroborated")
    version = F.exists(reasons, lambda r: F.contains(r, F.lit("version mismatch")))
    return (
        F.when(version, "VERSION_CONFLICT")
        .when(title & artist, "TITLE_AND_ARTIST_CONFLICT")
        .when(title, "TITLE_CONFLICT")
        .when(artist, "ARTIST_CONFLICT")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )
