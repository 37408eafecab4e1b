"""Secret scans over a trigram inverted index.

Each rule is a regular expression. Parsing it gives a Boolean query of trigrams that every match must contain: literal
runs are conjunctions, alternatives disjunctions, and what may be absent asks for nothing. The index lists for
each trigram that a rule set asks for the documents that have it, case ignored. Postings are intersected by
document, candidates are joined back to their texts, and there the rules whose query holds are verified. A rule
with no mandatory trigram scans every text. All steps are DataFrame expressions.

Defined results: a null text is empty; an empty text has no span. Rows are told apart by id and text, so repeated rows
and null ids each get their result. Very long texts are searched whole; spans of equal start go by kind. Spans count code points, the end exclusive. Extra columns pass through, but for
those with the name of an output. An empty table gives an empty table.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, let, materialize
from .spans import in_order, match_spans, no_spans

ANY: tuple = ("and",)
_MOST = 24


@dataclass(frozen=True)
class Rule:
    """A kind of secret; group must have least characters or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", """(?i:(password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Further kinds, by the public formats of such credentials.
MORE = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[0-9A-Za-z-]{12,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("url", "[a-z][a-z0-9+.]{1,15}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%-]{4,64}@"),
)


def trigram_query(pattern: str) -> tuple:
    """A nested ("and", ...) / ("or", ...) of lower-case trigrams that each match contains; ("and",) asks for nothing."""
    exact, query = _of(parser.parse(pattern))
    return _both(query, _grams(exact))


def _grams(strings) -> tuple:
    """What a text must contain if it contains one of strings."""
    if not strings:
        return ANY
    return _either([_all(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])


def _all(parts) -> tuple:
    flat: list = []
    for p in parts:
        flat.extend(p[1:] if isinstance(p, tuple) and p[0] == "and" else [p])
    return ("and", *dict.fromkeys(flat))


def _both(a: tuple, b: tuple) -> tuple:
    return _all([a, b])


def _either(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    if ANY in parts:
        return ANY
    # a part that asks for more than another one adds nothing to it
    parts = [p for p in parts if not any(q != p and set(q[1:]) <= set(p[1:]) for q in parts)]
    return parts[0] if len(parts) == 1 else ("and", ("or", *parts))


def _of(sequence) -> tuple[set | None, tuple]:
    """For a parsed sequence: the strings that it matches if they are few (else None), and the query of what was closed off."""
    exact: set | None = {""}
    query = ANY

    def add(strings: set | None) -> None:
        nonlocal exact, query
        joined = {a + b for a in exact for b in strings} if exact is not None and strings is not None else None
        if joined is None or len(joined) > _MOST:
            query = _both(query, _grams(exact))
            joined = strings if strings is not None and len(strings) <= _MOST else None
        exact = joined

    def close() -> None:
        nonlocal exact
        add(None)
        exact = {""}

    whole = True
    for op, arg in sequence:
        if op is K.LITERAL:
            add({chr(arg).lower()})
        elif op is K.IN and all(x is K.LITERAL for x, _ in arg):
            add({chr(c).lower() for _, c in arg})
        elif op is K.SUBPATTERN or op is K.BRANCH:
            inner = [_of(arg[-1])] if op is K.SUBPATTERN else [_of(x) for x in arg[1]]
            if all(e is not None for e, _ in inner):
                add(set().union(*[e for e, _ in inner]))
                query = _both(query, _either([q for _, q in inner]))
            else:
                close()
                whole = False
                query = _both(query, _either([_both(q, _grams(e)) for e, q in inner]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1 and (e := _of(arg[2])[0]) is not None:
            add(e | {""})
        elif op is K.AT:
            continue
        else:
            if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1:
                e, q = _of(arg[2])
                query = _both(query, _both(q, _grams(e)))
            close()
            whole = False
    if not whole:
        query = _both(query, _grams(exact))
        return None, query
    return exact, query


def grams_of(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(grams_of, query[1:]))


def _test(query, mask_of: dict[str, Column]) -> Column:
    if isinstance(query, str):
        return mask_of[query]
    parts = [_test(q, mask_of) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def _row_key(id_: str, text: str) -> list[Column]:
    return [F.coalesce(id_, F.lit(-1)), F.xxhash64(text)]


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, k1, k2) of docs (id, text): the number of a trigram, and a document whose text has it. Stored."""
    listed = F.array(*[F.lit(g) for g in grams])
    found = let(F.lower("text"), lambda low: F.filter(F.transform(listed, lambda g, i: F.when(F.contains(low, g), i)), lambda i: i.isNotNull()))
    k1, k2 = _row_key("id", "text")
    return materialize(docs.select(k1.alias("k1"), k2.alias("k2"), F.explode(found).alias("gram")), "secret-postings")


def candidates(index: DataFrame, grams: list[str], queries: list[tuple]) -> DataFrame:
    """(k1, k2, rules): documents in the intersections, rules with a bit for each query that holds."""
    words = -(-len(grams) // 60)
    masks = [F.bit_or(F.when((F.col("gram") >= 60 * w) & (F.col("gram") < 60 * (w + 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") - 60 * w)).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(words)]
    met = index.groupBy("k1", "k2").agg(*masks)
    has = {g: F.col(f"m{i // 60}").bitwiseAND(F.lit(1 << (i % 60))) != 0 for i, g in enumerate(grams)}
    bits = F.lit(0)
    for i, q in enumerate(queries):
        bits = bits + F.when(_test(q, has), F.lit(1 << i)).otherwise(F.lit(0))
    return met.select("k1", "k2", bits.alias("rules")).where("rules > 0")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with secrets: spans by start, then kind (its number among rules)."""
    keep = [c for c in docs.columns if c != "secrets"]
    id_, text, bits, key1, key2 = free_names([*docs.columns, "secrets"], "own_id", "whole_text", "rule_bits", "row_key1", "row_key2")
    rows = docs.select(*keep, F.col(id_col).cast("long").alias(id_), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [i for i, q in enumerate(queries) if q != ANY]
    grams = sorted(set().union(*[grams_of(queries[i]) for i in indexed]))
    met = rows.withColumn(bits, F.lit(0))
    if indexed:
        index = build_index(rows.select(F.col(id_).alias("id"), F.col(text).alias("text")), grams)
        found = candidates(index, grams, [queries[i] for i in indexed]).toDF(key1, key2, bits)
        k1, k2 = _row_key(id_, text)
        met = rows.withColumns({key1: k1, key2: k2}).join(found, [key1, key2], "left")
    parts = []
    for i, r in enumerate(rules):
        holds = (lambda x, n=r.least: F.char_length(x) >= n) if r.least else None
        spans = match_spans(F.col(text), r.pattern, i, holds, r.group)
        parts.append(F.when(F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(F.lit(1 << indexed.index(i))) != 0, spans).otherwise(no_spans()) if i in indexed else spans)
    return met.select(*keep, in_order(F.concat(*parts)).alias("secrets"))
