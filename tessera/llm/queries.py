"""One thin query for each corpus operator; digests come from the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, bpe_automaton, decontaminate, hard_negatives, impact_topk, language_mixture, log_bilinear, minhash, pii, prefix_trie, quality_rules, recompression, secret_index
from .spans import count_kind, of_kinds, spelled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_automaton.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "rule")


def _span_digests(spans, kinds: list[str], base: int):
    """Counts of the base kinds, the digest of their spans, and all spans."""
    counts = [count_kind(spans, i).alias(f"n_{k}") for i, k in enumerate(kinds[:base])]
    return [*counts, F.sha2(spelled(of_kinds(spans, base), kinds), 256).alias("base_sha256"), spelled(spans, kinds).alias("spans")]


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_index.BASE + secret_index.MORE
    found = secret_index.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    return found.select("doc_id", *_span_digests(F.col("secrets"), [r.kind for r in rules], len(secret_index.BASE)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.learn(docs)).select("doc_id", *_span_digests(F.col("pii"), pii.KINDS, pii.N_BASE))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score_documents(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.predict_documents(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return recompression.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs.withColumn("doc_id", F.col("doc_id").cast("long")), width=4, percent=80)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))))
    return nodes.drop("place", "end_place")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, columns=["doc_id"])
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names, (F.col("n_hit") > 0).alias("contaminated"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, least=30, most=90)


#: Fixed: how the queries' contracts split words, as DuckDB (RE2) text.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _spans_sql(pattern: str, kind: int, test: str = "true", group: int = 0) -> str:
    """A list of {start, kind, stop} in DuckDB; t is the text, test looks at x, the group's text."""
    quoted = pattern.replace("'", "''")
    found, gaps, tested = f"regexp_extract_all(t, '{quoted}')", f"string_split_regex(t, '{quoted}')", f"regexp_extract_all(t, '{quoted}', {group})"
    at = f"(list_sum([length(g) for g in list_slice({gaps}, 1, i)]) + coalesce(list_sum([length(g) for g in list_slice({found}, 1, i - 1)]), 0))::INT"
    return f"[{{'start': {at}, 'kind': {kind}, 'stop': ({at} + length({found}[i]))::INT}} for i in range(1, len({found}) + 1) if list_aggregate([({test}) for x in [{tested}[i]]], 'bool_and')]"


def _letters(word: str) -> str:
    """Either case of ASCII letters, without the library's folding of other letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _digest_sql(parts: list[str], kinds: list[str], base: int) -> str:
    spell = "array_to_string([" + "list_value(" + ", ".join(f"'{k}'" for k in kinds) + ")[s.kind + 1] || ':' || s.start || ':' || s.stop for s in {}], ',')"
    counts = ", ".join(f"len([s for s in a if s.kind = {i}])::BIGINT AS n_{k}" for i, k in enumerate(kinds[:base]))
    return f"""
SELECT doc_id, {counts}, sha256({spell.format(f"[s for s in a if s.kind < {base}]")}) AS base_sha256, {spell.format("a")} AS spans
FROM (SELECT doc_id, list_sort({" || ".join(parts)}) AS a FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""


def _op2_sql() -> str:
    words = "|".join(map(_letters, ["password", "passwd", "secret", "token"])) + f"|{_letters('api')}_?{_letters('key')}"
    assign = f"({words})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    rules = secret_index.BASE + secret_index.MORE
    parts = [_spans_sql(assign, 0, "length(x) >= 6", 2), _spans_sql("AKIA[A-Z0-9]+", 1, "length(x) >= 20")]
    parts += [_spans_sql(r.pattern, i + 2) for i, r in enumerate(rules[2:])]
    return _digest_sql(parts, [r.kind for r in rules], len(secret_index.BASE))


_OP7 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)
),
first_seen AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
covered AS (
  SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 13)) AS p
  FROM win JOIN first_seen USING (g) WHERE win.doc_id > m
),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM docs),
kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id AND words.p = covered.p
  WHERE covered.p IS NULL GROUP BY words.doc_id
)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

_OP9 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') for x in {_WORDS}] AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(list_slice(w, i, i + 3), ' ') for i in range(1, len(w) - 2)] END) AS g
  FROM w
),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
    FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.k >= 80 * (na.n + nb.n - p.k)
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reach.b)::BIGINT AS component_id, n.doc_id = min(reach.b) AS kept
FROM n JOIN reach ON n.doc_id = reach.a GROUP BY n.doc_id, n.n
"""

_OP10 = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         list_sum([p[1] * p[2] for p in list_zip(q.c, d.c)])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(q.c) = len(d.c)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: h of a conversation: the CRC-32 of its id's digits, bit by bit, modulo 6.
_CRC6 = "(xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(b)::UBIGINT for b in string_split(c::VARCHAR, '')]), lambda x, b: list_reduce(list_prepend(xor(x, b), [0::UBIGINT for i in range(8)]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)), 4294967295::UBIGINT) % 6)::BIGINT"

_OP11 = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
),
h AS (SELECT c, w, {_CRC6} AS h FROM own),
built AS (SELECT h.c, coalesce(list_slice(b.w, 1, h.h), []) || list_slice(h.w, h.h + 1, len(h.w)) AS w FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100),
members AS (SELECT c, list_slice(w, 1, d) AS p, d, len(w) AS n FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM built)),
nodes AS (
  SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM members GROUP BY p
),
kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(p[depth].t) ELSE 0 END AS saved FROM nodes LEFT JOIN kids USING (p)),
above AS (SELECT list_slice(p, 1, k) AS p, n_children = 0 AS leaf, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_nodes)),
sums AS (SELECT p, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY p)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums USING (p) LEFT JOIN nodes u ON f.depth > 0 AND u.p = list_slice(f.p, 1, f.depth - 1)
"""

_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_PLAIN} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, list_slice(w, i, i + n - 1) AS g, n FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs JOIN sizes ON len(w) >= n)),
hits AS (SELECT r, i, runs.n, item FROM runs JOIN windows USING (g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""

_OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, list_sum([p[1] * p[2] for p in list_zip(a.c, d.c)])::BIGINT AS score
  FROM v a JOIN v d ON a.vec_id % 100 = 0 AND d.vec_id <> a.vec_id AND len(a.c) = len(d.c)
),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op13_hard_negatives": _OP13,
    "op12_decontaminate": _OP12,
    "op11_prefix_trie": _OP11,
    "op2_secret_scan": _op2_sql(),
    "op7_substring_dedup": _OP7,
    "op9_minhash": _OP9,
    "op10_topk": _OP10,
}

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_pii": op3_pii,
    "op4_language_model": op4_language_model,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language": op6_language,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_minhash": op9_minhash,
    "op10_topk": op10_topk,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_decontaminate": op12_decontaminate,
    "op13_hard_negatives": op13_hard_negatives,
}
