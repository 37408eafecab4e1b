"""Personal data: candidate spans by generators, chosen by boosted trees, beside a fixed set of formats.

The base formats (e-mail, IP address, payment card, telephone) are always found. Beyond them, four generators
with high recall propose spans that may overlap each other: runs of digits with any separators, each unbroken run of seven digits or more, anything around
an at sign, and names and hosts around a spelled one. Boosted trees judge a proposal by its format (digits, groups, separators, checksum, parts) and by its context (the
word before it, the characters around it).

They are fitted on a bounded sample (``sample_docs`` documents with the smallest hashes of their ids, ``sample_spans`` proposals and as many rewritten spans in them)
with two kinds of labels. Proposals that a base format confirms are examples, the others counter-examples. And each confirmed span is
rewritten where it stands, in forms that no base format matches (``REWRITTEN``): numbers without plus after a word that announces them and cards with other separators are
examples, bare numbers and cards with a wrong checksum counter-examples, and so on. On a third of the sample the threshold is set at which the chosen
proposals are nearly all examples; with nothing to learn from, nothing is added. A chosen proposal stays if it overlaps no base span and no chosen proposal
of a higher score (equal scores: the longer one, then the first). All steps are DataFrame expressions, row by row, with no shuffle of texts.

Defined results: a null text is empty; an empty text has no span. Spans count code points, the end exclusive. Very long texts
are searched whole. Repeated rows are judged alike; null ids take no part in the sample; ids with equal hashes go by id. Extra columns pass through, but for those with
the name of an output. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosted
from .common import free_names, let
from .spans import in_order, match_spans, no_spans

#: Kinds in the order in which they are listed; the last two are the generators'.
KINDS = ["email", "ip", "card", "phone", "number", "address"]
N_BASE = 4

#: Fixed formats. Possessive loops find the same matches and never go back over long runs; a match may start
#: inside a run of its own characters only where the match before it ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}"
NUMBER = r"[+(]?[0-9](?:[().\x20-]{0,2}[0-9])++"
LONG = r"[0-9]{7,}+"
ADDRESS = r"(?:(?<![^\s@])|\G)[^\s@]++@[^\s@]++"
SPELLED = r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[a-z0-9-]++(?:\.[a-z0-9-]++)*+"
#: Words that announce personal data, in the languages at hand.
ANNOUNCE = "(?i)(?:tel|phone|call|fax|mobile|mail|contact|reach|card|visa|ip|host|nr|num|telefon|téléphone|correo|karte|carte|tarjeta)[^a-z]{0,3}$"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the checksum."""

    def total(d: Column) -> Column:
        places = F.transform(F.sequence(F.lit(1), F.char_length(d)), lambda i: F.substring(d, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
        return F.aggregate(places, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))

    return let(F.reverse(digits(x)), lambda d: F.when(F.char_length(d) > 0, total(d) % 10 == 0).otherwise(False))


def base_spans(text: Column) -> Column:
    between = lambda low, high: lambda x: F.char_length(digits(x)).between(low, high)
    found = [
        F.when(F.contains(text, F.lit("@")), match_spans(text, EMAIL, 0)).otherwise(no_spans()),
        match_spans(text, IP, 1, lambda x: F.regexp_like(x, F.lit(IP_PARTS))),
        match_spans(text, CARD, 2, lambda x: between(12, 19)(x) & luhn(x)),
        F.when(F.contains(text, F.lit("+")), match_spans(text, PHONE, 3, between(9, 15))).otherwise(no_spans()),
    ]
    return F.concat(*found)


def _at_word(text: Column) -> Column:
    return F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")) | F.contains(text, F.lit("(AT)")) | F.contains(text, F.lit("[AT]"))


def _worth_a_look(text: Column) -> Column:
    return F.regexp_like(text, F.lit("[0-9@]")) | _at_word(text)


def proposals(text: Column) -> Column:
    enough = lambda x: F.char_length(digits(x)) >= 7
    at_sign = F.when(F.contains(text, F.lit("@")), match_spans(text, ADDRESS, 5)).otherwise(no_spans())
    at_word = F.when(_at_word(text), match_spans(text, SPELLED, 5)).otherwise(no_spans())
    return F.array_distinct(F.concat(match_spans(text, NUMBER, 4, enough), match_spans(text, LONG, 4), at_sign, at_word))


#: How a confirmed span of a base kind is rewritten: the kind, what is put before it, the new form (of the span's text and its digits), and whether it is an example.
REWRITTEN = [
    (3, "tel ", lambda x, d: F.regexp_replace(x, r"^\+", ""), True),
    (3, "phone: ", lambda x, d: d, True),
    (3, "", lambda x, d: F.regexp_replace(x, r"^\+", ""), False),
    (3, "", lambda x, d: d, False),
    (2, "", lambda x, d: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1."), True),
    (2, "", lambda x, d: F.regexp_replace(_wrong(d), "([0-9]{4})(?=[0-9])", "$1."), False),
    (2, "", lambda x, d: _wrong(d), False),
    (0, "", lambda x, d: F.regexp_replace(x, "@", " (at) "), True),
    (0, "", lambda x, d: F.regexp_replace(x, "@", "[at]"), True),
    (0, "", lambda x, d: F.regexp_replace(F.regexp_replace(x, "@", " (at) "), r"\..*$", ""), False),
    (1, "", lambda x, d: F.regexp_replace(x, "^[0-9]+", "731"), False),
]


def _wrong(d: Column) -> Column:
    """The digits with another last one, so that the checksum fails."""
    return F.concat(F.substring(d, F.lit(1), F.char_length(d) - 1), ((F.coalesce(F.right(d, F.lit(1)).try_cast("int"), F.lit(0)) + 1) % 10).cast("string"))


def _features(text: Column, span: Column) -> dict[str, Column]:
    body = F.substring(text, span["start"] + 1, span["stop"] - span["start"])
    before = F.substring(text, F.greatest(span["start"] - 15, F.lit(1)), F.least(span["start"], F.lit(16)))
    after = F.substring(text, span["stop"] + 1, 1)
    count = lambda pattern: F.regexp_count(body, F.lit(pattern))
    flag = lambda test: F.when(test, 1).otherwise(0)
    return {
        "is_address": flag(span["kind"] == 5),
        "length": span["stop"] - span["start"],
        "digits": F.char_length(digits(body)),
        "groups": count("[0-9]+"),
        "dots": count("[.]"),
        "dashes": count("-"),
        "spaces": count(" "),
        "brackets": count("[()]"),
        "plus": flag(F.startswith(body, F.lit("+"))),
        "double_marks": count("[().\\x20-]{2}"),
        "checksum": flag(luhn(body)),
        "parts": flag(F.regexp_like(body, F.lit(IP_PARTS))),
        "domain": flag(F.regexp_like(body, F.lit("@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"))),
        "local": flag(F.regexp_like(body, F.lit("[A-Za-z0-9._%+-]@"))),
        "at_word": flag(F.regexp_like(body, F.lit("(?i)[\\[(]at[\\])]"))),
        "domain_end": flag(F.regexp_like(body, F.lit("[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+$"))),
        "announced": flag(F.regexp_like(before, F.lit(ANNOUNCE))),
        "letter_before": flag(F.regexp_like(before, F.lit("\\p{L}$"))),
        "letter_after": flag(F.regexp_like(after, F.lit("\\p{L}"))),
    }


def _with_features(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), *[c.cast("int").alias(n) for n, c in _features(text, s).items()]))


FEATURES = ["is_address", "length", "digits", "groups", "dots", "dashes", "spaces", "brackets", "plus", "double_marks", "checksum", "parts", "domain", "local", "at_word", "domain_end", "announced", "letter_before", "letter_after"]


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def _rewritten(spans: DataFrame) -> DataFrame:
    """Of confirmed spans (id, text, s): the features of each in other forms, in its place in the text, and whether that is an example."""
    body, before = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")), F.substring(F.col("text"), F.greatest(F.col("s.start") - 23, F.lit(1)), F.least(F.col("s.start"), F.lit(24)))
    spans = spans.select("id", F.col("s.kind").alias("kind"), F.col("s.start").alias("at"), body.alias("body"), before.alias("before"), F.substring(F.col("text"), F.col("s.stop") + 1, F.lit(8)).alias("after"))
    forms = [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n"), F.lit(put).alias("put"), form(F.col("body"), digits(F.col("body"))).alias("form"), F.lit(good).alias("good")) for n, (kind, put, form, good) in enumerate(REWRITTEN)]
    each = spans.select("id", "at", "kind", "before", "after", F.explode(F.array(*forms)).alias("f")).where("f.kind = kind")
    start = F.char_length("before") + F.char_length("f.put")
    span = F.struct(start.alias("start"), F.when(F.col("kind") == 0, 5).otherwise(4).alias("kind"), (start + F.char_length("f.form")).alias("stop"))
    placed = each.select("id", "at", "f", F.concat("before", "f.put", "f.form", "after").alias("text"), span.alias("s"))
    return placed.select("id", F.col("f.good").alias("y"), F.xxhash64("id", "at", "f.n").alias("order"), *[c.cast("int").alias(n) for n, c in _features(F.col("text"), F.col("s")).items()])


def learn(docs: DataFrame, sample_docs: int = 20_000, sample_spans: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> boosted.Model:
    """The model of a bounded sample, the same at every run."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample_docs).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "id").where(_worth_a_look(F.col("text")))
    rows = rows.select("id", "text", base_spans(F.col("text")).alias("base"), proposals(F.col("text")).alias("proposed"))
    spans = rows.where(F.size("proposed") > 0).select("id", "base", F.explode(_with_features(F.col("text"), F.col("proposed"))).alias("s"))
    # a proposal is confirmed if a base span covers most of it
    covered = F.exists("base", lambda b: 10 * (F.least(b["stop"], F.col("s.stop")) - F.greatest(b["start"], F.col("s.start"))) >= 8 * (F.col("s.stop") - F.col("s.start")))
    picked = spans.select("id", covered.alias("y"), F.xxhash64("id", "s.start", "s.kind").alias("order"), *[F.col(f"s.{n}").alias(n) for n in FEATURES])
    other = _rewritten(rows.select("id", "text", F.explode("base").alias("s")))
    held = (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(3)) == 0).alias("held")
    found = [r.asDict() for some in (picked, other) for r in some.select("*", held).orderBy("order", "y", *FEATURES).limit(sample_spans).collect()]
    return boosted.fit(found, [r["y"] for r in found], [r["held"] for r in found], FEATURES)


def find(docs: DataFrame, model: boosted.Model, text_col: str = "text") -> DataFrame:
    """docs with pii: base spans and the proposals that the model chooses, by start, then kind."""
    keep = [c for c in docs.columns if c != "pii"]
    text, base, chosen = free_names([*docs.columns, "pii"], "whole_text", "base_spans", "chosen_spans")
    look = _worth_a_look(F.col(text))
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    rows = rows.withColumn(base, F.when(look, base_spans(F.col(text))).otherwise(no_spans()))
    if not model.trees:
        return rows.select(*keep, in_order(F.col(base)).alias("pii"))
    fresh = F.filter(proposals(F.col(text)), lambda s: ~F.exists(base, lambda b: _overlap(s, b)))

    def judged(spans: Column) -> Column:
        scored = F.transform(_with_features(F.col(text), spans), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), model.total(lambda name: s[name]).alias("score")))
        return F.filter(scored, lambda s: s["score"] >= F.lit(model.threshold))

    def beats(o: Column, s: Column) -> Column:
        rank = lambda x: F.struct(x["score"], x["stop"] - x["start"], -x["start"], x["kind"])
        return _overlap(o, s) & (rank(o) > rank(s))

    resolved = let(judged(fresh), lambda all_: F.filter(all_, lambda s: ~F.exists(all_, lambda o: beats(o, s))))
    plain = F.transform(resolved, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    rows = rows.withColumn(chosen, F.when(look, plain).otherwise(no_spans()))
    return rows.select(*keep, in_order(F.concat(base, chosen)).alias("pii"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; where spans overlap, the first names the whole stretch."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        stop = F.greatest(acc["at"], s["stop"])
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])))
        return F.struct(stop.alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
