"""Queries of near and of free text: the similarity join and the ranked index over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import prepare, reference, retrieve, search, similarity
from tessera.plans.catalog import _KEY, _number
from tessera.session import stored, table


def _long_titles(spark, sf):
    """Parts under their name, type and brand together: source and candidate records."""
    title = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    kept = [title.alias("title"), F.array("p_brand").alias("artists"), F.lit("").alias("album"), (F.col("p_size") * 1000).cast("long").alias("duration_ms")]
    parts = table(spark, sf, "part")
    s = parts.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("source_id"), *kept)
    c = parts.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("candidate_id"), *kept, F.lit("").alias("isrc"))
    return stored(prepare.sources(s), "sources"), stored(prepare.candidates(c).withColumn("c_order", F.col("candidate_id").cast("long")), "candidates")


def near_title_pairs(spark, sf):
    """Different titles of the two catalogues that are near, with their distance and how many records have them."""
    keyed = table(spark, sf, "part").select((F.col("p_partkey") % 2).alias("side"), X.key(X.fold(F.concat("p_name", "p_type", "p_brand"))).alias("key"))
    counts = stored(keyed.groupBy("side", "key").agg(F.count("*").alias("n")), "titles")
    left, right = counts.where("side = 0"), counts.where("side = 1")
    met = similarity.near_pairs(left, right)
    return met.join(left.select(F.col("key").alias("left_key"), F.col("n").alias("sources")), "left_key").join(right.select(F.col("key").alias("right_key"), F.col("n").alias("candidates")), "right_key")


def near_title_retrieval(spark, sf):
    """The ten nearest candidates of sources that no candidate equals in title and artist."""
    s, c = _long_titles(spark, sf)
    found = retrieve.near(s, c, retrieve.strict(s, c, False, 1))
    return found.select("source_id", F.col("candidate_id").cast("long").alias("candidate_id"), "rank", "distance")


def free_text_lookup(spark, sf):
    """The ten records that share most with a source's name and brand, by words."""
    parts = table(spark, sf, "part")
    queries = parts.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("query_id"), search.words(X.fold(F.concat_ws(" ", "p_name", "p_brand"))).alias("terms"))
    records = parts.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("record_id"), search.words(X.fold(F.concat_ws(" ", "p_name", "p_type", "p_brand"))).alias("terms"))
    return search.ranked(queries, records, common=100)


def free_artist_lookup(spark, sf):
    """The second query with the artists as free text: candidates of the title, those first that share the words."""
    parts = table(spark, sf, "part")
    base = [F.col("p_name").alias("title"), (F.col("p_size") * 1000).cast("long").alias("duration_ms")]
    artists = F.array(F.concat(F.lit("歌手"), _number("p_brand")), F.concat(F.lit("The "), "p_type"))
    s, members = prepare.classes(parts.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("source_id"), *base, artists.alias("artists"), F.lit("").alias("album")))
    c, copies = prepare.classes(parts.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("candidate_id"), *base, F.array("p_brand").alias("artists"), F.col("p_type").alias("album"), F.lit("").alias("isrc")), "candidate_id")
    words = stored(prepare.candidates(c).select(F.col("candidate_id").cast("long").alias("candidate_id"), "c_title_keys", "c_words"), "candidates")  # every copy counts in a word's weight
    s, c = stored(prepare.sources(s), "sources"), prepare.of_members(words, copies, "candidate_id").withColumn("c_order", F.col("candidate_id"))
    none = s.select("source_id").limit(0)
    found = prepare.of_members(retrieve.relaxed(s, c, none, none), members)
    return found.select("source_id", F.col("candidate_id").cast("long").alias("candidate_id"), "rank")


def artist_lookup(spark, sf):
    """Exact artists among the five that a search for a name ranks first."""
    parts, k = table(spark, sf, "part"), F.col("p_partkey")
    both, turned = F.concat_ws(" ", "p_brand", "p_type"), F.concat_ws(" ", "p_type", "p_brand")
    artists = parts.where(k % 2 == 1).select(F.concat(F.lit("m"), F.lpad(k.cast("string"), 9, "0")).alias("mbid"), F.col("p_name").alias("name"), F.concat_ws(", ", "p_brand", "p_type").alias("sort_name"), F.array(both).alias("aliases"))
    names = parts.where(k % 2 == 0).select(F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, both).otherwise(turned).alias("name"))
    return reference.lookup(names, artists, common=100)


# --- SQL ----------------------------------------------------------------------------------------------

_WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"
_BITS = "length(bin({} // {}))"
_RANKED = f"""
total AS (SELECT count(*) AS total FROM records),
having_ AS (SELECT w, count(*) AS n FROM (SELECT unnest(terms) AS w FROM records) GROUP BY 1),
met AS (
  SELECT q.query_id, r.record_id, sum({_BITS.format("total", "n")})::BIGINT AS score
  FROM (SELECT query_id, unnest(terms) AS w FROM queries) q JOIN (SELECT record_id, unnest(terms) AS w FROM records) r USING (w) JOIN having_ USING (w), total GROUP BY 1, 2
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id)::INT AS rank FROM met)"""

QUERIES = {f.__name__: f for f in (near_title_pairs, near_title_retrieval, free_text_lookup, free_artist_lookup, artist_lookup)}

ORACLES = {
    "near_title_pairs": f"""
WITH k AS (SELECT p_partkey % 2 AS side, {_KEY.format("p_name || p_type || p_brand")} AS key, count(*) AS n FROM part GROUP BY 1, 2)
SELECT l.key AS left_key, r.key AS right_key, levenshtein(l.key, r.key)::INT AS distance, l.n AS sources, r.n AS candidates
FROM k l JOIN k r ON l.side = 0 AND r.side = 1 AND abs(length(l.key) - length(r.key)) <= 3 AND 100 * levenshtein(l.key, r.key) <= 8 * (length(l.key) + length(r.key))""",
    "near_title_retrieval": f"""
WITH k AS (SELECT p_partkey AS id, {_KEY.format("p_name || p_type || p_brand")} AS key FROM part),
alone AS (SELECT * FROM k WHERE id % 2 = 0 AND key NOT IN (SELECT key FROM k WHERE id % 2 = 1)),
met AS (
  SELECT s.id AS source_id, c.id AS candidate_id, levenshtein(s.key, c.key)::INT AS distance
  FROM alone s JOIN k c ON c.id % 2 = 1 AND abs(length(s.key) - length(c.key)) <= 3 AND 100 * levenshtein(s.key, c.key) <= 8 * (length(s.key) + length(c.key))
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY distance, candidate_id)::INT AS rank FROM met) WHERE rank <= 10""",
    "free_text_lookup": f"""
WITH queries AS (SELECT p_partkey AS query_id, {_WORDS.format("p_name || ' ' || p_brand")} AS terms FROM part WHERE p_partkey % 2 = 0),
records AS (SELECT p_partkey AS record_id, {_WORDS.format("p_name || ' ' || p_type || ' ' || p_brand")} AS terms FROM part WHERE p_partkey % 2 = 1),{_RANKED}
SELECT query_id, rank, record_id, score FROM ranked WHERE rank <= 10""",
    "free_artist_lookup": f"""
WITH p AS (SELECT p_partkey AS id, {_KEY.format("p_name")} AS k, lower(p_type) AS t FROM part),
c AS (SELECT * FROM p WHERE id % 2 = 1), n AS (SELECT count(*) AS n FROM c),
by_k AS (SELECT k, count(*) AS a FROM c GROUP BY 1), by_t AS (SELECT k, t, count(*) AS b FROM c GROUP BY 1, 2),
met AS (
  SELECT s.id AS source_id, c.id AS candidate_id, {_BITS.format("n", "a")} + CASE WHEN s.t = c.t THEN {_BITS.format("n", "b")} ELSE 0 END AS score
  FROM p s JOIN c USING (k) JOIN by_k USING (k) LEFT JOIN by_t ON by_t.k = s.k AND by_t.t = s.t, n WHERE s.id % 2 = 0
)
SELECT source_id, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, candidate_id)::INT AS rank FROM met) WHERE rank <= 10""",
    "artist_lookup": f"""
WITH a AS (SELECT 'm' || lpad(p_partkey::VARCHAR, 9, '0') AS record_id, p_name, p_brand || ' ' || p_type AS pair FROM part WHERE p_partkey % 2 = 1),
records AS (SELECT record_id, {_WORDS.format("p_name || ' ' || pair")} AS terms FROM a),
names AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' ' || p_type ELSE p_type || ' ' || p_brand END AS name FROM part WHERE p_partkey % 2 = 0),
queries AS (SELECT name AS query_id, {_WORDS.format("name")} AS terms FROM names),{_RANKED}
SELECT query_id AS name, rank, record_id AS mbid FROM ranked JOIN a USING (record_id) WHERE rank <= 5 AND {_KEY.format("query_id")} IN ({_KEY.format("p_name")}, {_KEY.format("pair")})""",
}
