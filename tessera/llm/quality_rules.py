"""Quality rules: a learned decision list of threshold conjunctions, applied as ordered conditional expressions.

Text statistics are DataFrame expressions, worked out row by row with no shuffle. Sequential covering runs on a bounded
sample of labelled rows (``sample_rows``, the rows with the smallest hash of their id): it grows a
conjunction of thresholds condition by condition for the best information gain on two thirds of the sample, prunes it
from its end on the other third, keeps it if it is precise enough on both, takes the rows it covers away, and goes
on. Thresholds stand where the rows that a rule covers begin, not where other rows end, so that a rule reaches
no further than it was shown. The list becomes one CASE: the first rule that holds names the reason.

Defined results: a null text has no words and fails the base rule; empty texts alike. Null labels
are left out of the fit; with no labelled rows, or none that is bad, there is no rule. Repeated rows are judged
alike. Very long texts count whole. Conditions of equal gain: the one tried first, in the order of ``FEATURES``, and of one feature the stricter one. Extra columns pass through; one with the name of an output gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, let, words_of

#: Fixed values of the base rule.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the rules look at, each in thousandths (of words, letters or lines), but for the mean word length in hundredths.
FEATURES = ["symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "mark_share", "mean_word", "letter_share", "digit_share", "stop_share"]


def repeat_words(words: Column) -> Column:
    """Words that stand in windows of 8 words which occur twice or more in the array."""
    return let(words, _repeat_words)  # a filter that is pushed down puts the expression in the column's place, even in lambdas


def _repeat_words(words: Column) -> Column:
    count = F.size(words)
    pair = lambda h, step: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def windows(w: Column) -> Column:
        # eight words by doubling, as slice would copy the array for each place
        spell = lambda a, step: F.transform(a, lambda x, i: F.concat_ws(" ", x, F.get(a, i + step)))
        keys = let(spell(w, 1), lambda w2: let(spell(w2, 2), lambda w4: spell(w4, 4)))
        return F.transform(F.slice(keys, F.lit(1), count - (WINDOW - 1)), lambda k, i: F.struct(k.alias("key"), i.alias("at")))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["key"] == x["key"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["key"] == x["key"], F.lit(False)))
        places = F.array_sort(F.transform(again, lambda x: x["at"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])

    # hashes of 8 words by doubling; where all differ, so do the windows, and else the windows themselves are compared
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(pair(h, 1), lambda h2: let(pair(h2, 2), lambda h4: F.transform(F.slice(h4, F.lit(1), count - (WINDOW - 1)), lambda x, i: F.xxhash64(x, F.get(h4, i + 4))))))
    differ = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(count < WINDOW + 1, F.lit(0)).when(differ, F.lit(0)).otherwise(let(F.array_sort(windows(words)), covered)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the five base counts, what the rules look at, and base_failed."""
    keep = [c for c in docs.columns if c not in {*STATISTICS, *FEATURES, "base_failed", "kept", "rule"}]
    taken = [*docs.columns, *STATISTICS, *FEATURES, "base_failed", "kept", "rule"]
    text, words, n_lines, distinct, digits, marks, other, stops, capitals = free_names(taken, "whole_text", "words", "n_lines", "n_distinct", "n_digits", "n_marks", "n_other", "n_stops", "n_capitals")
    docs = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    docs = docs.withColumn(words, words_of(F.col(text)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    share = lambda a, b: F.when(b > 0, (1000 * a / b).cast("int")).otherwise(0)
    counted = docs.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col(words)).alias("n_repeat_words"),
        F.size(lines).alias(n_lines),
        F.size(F.array_distinct(words)).alias(distinct),
        count("[!?]+").alias(marks),
        count("[0-9]+").alias(digits),
        count("[^\\p{L}\\s]+").alias(other),
        count("(?<=[\\p{Ll}])[.,](?=\\s|$)").alias(stops),
        F.char_length(F.regexp_replace(text, "\\P{Lu}+", "")).alias(capitals),
    )
    n = F.col("n_words")
    return counted.select(
        *keep,
        *STATISTICS,
        share(F.col("n_symbols"), n).alias("symbols_per_word"),
        share(F.col("n_dup_lines"), F.col(n_lines)).alias("dup_line_share"),
        share(F.col("n_repeat_words"), n).alias("repeat_share"),
        share(F.col(distinct), n).alias("distinct_share"),
        share(F.col(capitals), F.col("word_chars")).alias("upper_share"),
        share(F.col(marks), n).alias("mark_share"),
        F.when(n > 0, (100 * F.col("word_chars") / n).cast("int")).otherwise(0).alias("mean_word"),
        share(F.col("word_chars") - F.col(other), F.col("word_chars")).alias("letter_share"),
        share(F.col(digits), n).alias("digit_share"),
        share(F.col(stops), n).alias("stop_share"),
        ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: int

    def holds(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def cover(rows: list[dict], bad: list[bool], grow: list[bool], precision: float = 0.99, least: int = 8, longest: int = 4, cuts: int = 48) -> list[Rule]:
    """Ordered rules for the bad rows. Row sets are the bits of integers, so each condition is tried with a few word operations."""
    bits = lambda flags: sum(1 << i for i, f in enumerate(flags) if f)
    positive, training = bits(bad), bits(grow)
    everything = (1 << len(rows)) - 1
    conditions: list[tuple[Condition, int]] = []
    for f in FEATURES:
        seen = sorted(r[f] for r, b in zip(rows, bad, strict=True) if b)
        for t in sorted({seen[i * (len(seen) - 1) // cuts] for i in range(cuts + 1)}) if seen else []:
            for up in (True, False):
                conditions.append((Condition(f, up, t), bits(r[f] >= t if up else r[f] <= t for r in rows)))
    rules: list[Rule] = []
    left = everything

    def strict(c: Condition) -> int:
        return c.threshold if c.at_least else -c.threshold

    while (left & positive & training).bit_count() >= least:
        inside, rule = left & training, []
        while len(rule) < longest and inside & ~positive:
            p, n = (inside & positive).bit_count(), (inside & ~positive).bit_count()
            base, best = math.log2(p / (p + n)), None
            for c, where in conditions:
                q = (inside & where & positive).bit_count()
                if q:
                    m = (inside & where & ~positive).bit_count()
                    gain = q * (math.log2(q / (q + m)) - base)
                    if best is None or (gain, strict(c)) > best[:2] and (gain > best[0] or c.feature == best[2].feature and c.at_least == best[2].at_least):
                        best = (gain, strict(c), c, where)
            if best is None or best[0] <= 1e-9:
                break
            rule.append((best[2], best[3]))
            inside &= best[3]

        def worth(r: list, among: int) -> float:
            on = reduce(lambda a, x: a & x[1], r, among)
            p, n = (on & positive).bit_count(), (on & ~positive).bit_count()
            return (p - n) / (p + n) if p + n else -1.0

        if not rule:
            break
        test = left & ~training
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r, test))
        on = reduce(lambda a, x: a & x[1], rule, left)
        p, n = (on & positive).bit_count(), (on & ~positive).bit_count()
        if p < least or p < precision * (p + n):
            break
        rules.append(tuple(c for c, _ in rule))
        left &= ~on
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, text_col: str = "text", id_col: str = "doc_id") -> list[Rule]:
    """The decision list of at most sample_rows labelled rows (quality 0 is bad): a bounded sample, the same at every run."""
    named = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    sample = named.orderBy(F.xxhash64(F.col(id_col)), id_col, "quality").limit(sample_rows).select(F.col(id_col).alias("id"), "quality")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most sample_rows rows
    picked = statistics(rows).where("not base_failed").select("id", "quality", *FEATURES, (F.pmod(F.xxhash64("id", F.lit("grow")), F.lit(3)) > 0).alias("grow"))
    found = [r.asDict() for r in picked.orderBy(F.xxhash64("id"), "quality", *FEATURES).limit(sample_rows).collect()]
    return cover(found, [r["quality"] == 0 for r in found], [r["grow"] for r in found])


def apply(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule (0: none holds, else the number of the first that does) and kept."""
    verdict = F.lit(0)
    if rules:
        tests = [reduce(lambda a, b: a & b, [c.holds() for c in r]) for r in rules]
        verdict = reduce(lambda case, x: case.when(x[1], F.lit(x[0] + 1)), list(enumerate(tests))[1:], F.when(tests[0], F.lit(1))).otherwise(0)
    return stats.withColumn("rule", verdict).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with statistics, rule and kept."""
    return apply(statistics(docs, text_col), learn(docs, labels, text_col=text_col))
