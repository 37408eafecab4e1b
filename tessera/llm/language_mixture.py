"""Language identification by multilingual mixture inference.

Training counts letter trigrams (hashed to a fixed number of buckets) for each language over all
training documents: each task sums its own, Spark adds them up, and the driver gets one table of buckets by languages.
A document is then a draw from a mixture: expectation-maximisation estimates the share of each language from
the likelihoods of all its trigrams. The languages that it is written in are the set with the best
log-likelihood less a penalty for each language, tried from the largest share on. The prediction is the
set's largest share, which is also the score.

Text rules: letters are lower-cased one by one, all else is a gap between words, whole texts count. A text that is
null or has no letter is ``und`` with score 0. Ties in shares go to the name that sorts first. Documents whose
language or id is null are not learned from. With nothing to learn from, every text is ``und``. Repeated
rows are predicted alike. Extra columns pass through, but for those with the name of an output.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 16
UNKNOWN = "und"
_PIECE = 1 << 22


@cache
def _lowered() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def trigrams(text: str) -> np.ndarray:
    """Buckets of a text's trigrams: of letters, with one gap before, between and after words. None crosses a gap."""
    parts = []
    table = _lowered()
    for at in range(0, len(text), _PIECE):  # pieces bound scratch memory; each starts two characters early
        raw = np.frombuffer(text[max(0, at - 2) : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = table[raw]
        padded = np.concatenate([[0] * (at == 0), letters, [0]]).astype(np.uint32)
        a, b, c = padded[:-2], padded[1:-1], padded[2:]
        if at + _PIECE < len(text):
            a, b, c = a[:-1], b[:-1], c[:-1]
        on = b != 0
        x = a[on] * np.uint32(0x85EBCA6B) ^ b[on] * np.uint32(0xC2B2AE35) ^ c[on] * np.uint32(0x27D4EB2F)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        parts.append((x >> np.uint32(16)).astype(np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _strings(column) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and log-likelihoods (buckets x languages) from all rows of docs."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list] = {}

        def settle(lang):
            sums[lang] += np.bincount(np.concatenate([*waiting[lang], np.zeros(0, np.int32)]), minlength=BUCKETS)
            waiting[lang] = []

        for batch in batches:
            for text, lang in zip(_strings(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang], waiting[lang] = np.zeros(BUCKETS, np.int64), []
                waiting[lang].append(trigrams(text))
                if len(waiting[lang]) >= 64:
                    settle(lang)
        for lang, s in sums.items():
            settle(lang)
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(s[at])})

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    table = np.zeros((BUCKETS, len(langs)))
    where = {x: i for i, x in enumerate(langs)}
    if langs:
        table[np.asarray(found.column("bucket")), [where[x] for x in found.column("lang").to_pylist()]] = np.asarray(found.column("n"))
    table += 0.25
    return langs, (table / table.sum(axis=0)).astype(np.float64)


def mixture(like: np.ndarray, weight: np.ndarray, rounds: int, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Shares of the languages (columns of like) and the log-likelihood, by expectation-maximisation."""
    share = np.full(like.shape[1], 1.0 / like.shape[1])
    if len(share) == 1:
        return share, float(weight @ np.log(like[:, 0]))
    total = weight.sum()
    for _ in range(rounds):
        new = share * ((weight / (like @ share)) @ like) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < tolerance:
            break
    return share, float(weight @ np.log(like @ share))


def infer(grams: np.ndarray, like: np.ndarray, penalty: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """The languages chosen (columns, by falling share) and their shares."""
    if len(grams) > 3000:
        counts = np.bincount(grams, minlength=BUCKETS)
        bucket = np.flatnonzero(counts)
        weight = counts[bucket].astype(float)
    else:
        bucket, weight = np.unique(grams, return_counts=True)
        weight = weight.astype(float)
    own = like[bucket]
    share, _ = mixture(own, weight, 12)
    order = np.argsort(-share, kind="stable")
    order = order[share[order] >= 0.5 * min(0.02, share.max())]
    if len(order) == 1:
        return order, np.ones(1)
    best = None
    cost = penalty * np.log(weight.sum() + 1)
    for k in range(1, len(order) + 1):
        some, gained = mixture(own[:, order[:k]], weight, 30)
        if best is None or gained - k * cost > best[0]:
            best = (gained - k * cost, order[:k], some)
        else:
            break
    by = np.lexsort((best[1], -best[2]))
    return best[1][by], best[2][by]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score, and langs (the chosen set with shares, as name:share by falling share)."""
    outputs = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("langs", T.StringType())]
    keep = [c for c in docs.columns if c not in dict(outputs)]
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(n, t) for n, t in outputs]])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages: the size doesn't depend on the documents

    def run(batches):
        langs, like = sent.value
        for batch in batches:
            pred, score, sets = [], [], []
            for text in _strings(batch.column(batch.schema.get_field_index(text_col))):
                grams = trigrams(text)
                if not len(grams) or not langs:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    sets.append("")
                    continue
                chosen, share = infer(grams, like)
                pred.append(langs[chosen[0]])
                score.append(float(min(1.0, share[0])))
                sets.append(",".join(f"{langs[c]}:{s:.4f}" for c, s in zip(chosen, share, strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], [*keep, *dict(outputs)])

    return docs.select(*keep).mapInArrow(run, schema)


def held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves rest; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == rest, F.lit(True))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs, learned from the documents that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    model = train(docs.where(~out))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "langs")
