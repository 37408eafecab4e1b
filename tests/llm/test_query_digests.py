"""The registered queries themselves, over small tables, against plain readings of their contracts."""

import collections
import hashlib
import random
import re

import pytest

from tessera.llm import queries

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(1, 7)))
    bits = [
        "mail a.b+c@ex-ample.co.uk, or x@y", "ip 10.0.0.255 and 1.2.3.256 and 1.2.3.4.5", "card 4111 1111-1111 1111 or 4111111111111112", "call +44 (0)20 7946-0958 or +1 23", "+49.30.123456789012345678",
        "#*$%&|<> #", "line\nline\nother\n\n line", "Ünï 4242424242424242 é@b.cc +331 23 45 67 89", "0000000000000000", "a@b.c@d.e.f",
    ]
    out = [None, "", " \n\t", *bits]
    for _ in range(60):
        parts = [word() for _ in range(rng.randint(0, 60))] + rng.sample(bits, rng.randint(0, 3))
        rng.shuffle(parts)
        out.append(rng.choice([" ", "\n", "  "]).join(parts) + (" " + " ".join(parts[:12]) if rng.random() < 0.4 else ""))
    return [*out, " ".join(word() for _ in range(9000)) + " " + bits[0]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("sf")), [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, len(rows), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r[1] for r in rows}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return [(kinds[i][0], a, b) for a, i, b in sorted(found)]


def test_op3_base_columns(spark, folder):
    path, rows = folder
    got = queries.QUERIES["op3_pii"](spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = base_spans(rows[r.doc_id])
        count = collections.Counter(k for k, _, _ in spans)
        named = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == sha(",".join(named))
        assert set(named) <= set(r.spans.split(","))


def test_op1_base_columns(spark, folder):
    path, rows = folder
    got = queries.QUERIES["op1_quality_rules"](spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id] or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == failed and not (failed and r.kept)


def test_op8_digests(spark, folder):
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path, rows = folder
    plain = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    plain.no_truncation()
    plain.no_padding()
    for r in queries.QUERIES["op8_bpe"](spark, path).collect():
        ids = plain.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False)))


def test_op6_and_op4_columns(spark, folder):
    path, rows = folder
    languages = queries.QUERIES["op6_language"](spark, path).collect()
    assert len(languages) == len(rows) and all(0 <= r.score <= 1 for r in languages)
    for r in languages:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in rows[r.doc_id] or ""))
    scores = queries.QUERIES["op4_language_model"](spark, path).collect()
    assert len(scores) == len(rows) and {r.doc_id for r in scores} == set(rows) and all(r.score < 0 and r.base_score < 0 for r in scores)
