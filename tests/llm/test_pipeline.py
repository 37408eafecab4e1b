"""The pipeline's stages over the smallest tables, each against a plain version of its own input."""

import collections
import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tessera.llm import pii, quality_rules  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


@pytest.fixture(scope="module")
def steps(spark):
    """Inputs and outputs of all stages, as rows."""
    from tessera.llm.common import materialize

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, SF), "test")
        out.append((docs.columns, docs.collect(), made.columns, made.collect()))
        docs = made
    return out


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "substring dedup", "personal data", "best-fit packing"]
    assert all(before == after for before, _, after, _ in steps[:-1])
    for _, _, _, rows in steps[:-1]:
        assert all(r.n_chars == len(r.text) for r in rows)


def test_quality(spark, steps):
    _, rows, _, kept = steps[0]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.learn(docs, labels)
    stats = {r.doc_id: r for r in quality_rules.statistics(docs).collect()}
    bad = lambda s: s.base_failed or any(all((s[c.feature] >= c.threshold) == c.at_least or s[c.feature] == c.threshold for c in rule) for rule in rules)
    assert {r.doc_id for r in kept} == {r.doc_id for r in rows if not bad(stats[r.doc_id])}
    assert len(kept) > len(rows) / 2


def test_near_duplicates(steps):
    _, rows, _, kept = steps[1]
    sets = {}
    for r in rows:
        w = words((r.text or "").encode().lower().decode())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    at = {i: i for i in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    assert {r.doc_id for r in kept} == {i for i in sets if find(i) == i}


def test_substrings(steps):
    _, rows, _, kept = steps[2]
    first = {}
    for r in rows:
        w = words(r.text)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, r.doc_id), r.doc_id)
    want = {}
    for r in rows:
        w, gone = words(r.text), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r.doc_id:
                gone.update(range(k, k + 13))
        if len(gone) < len(w) or not w:
            want[r.doc_id] = ([x for k, x in enumerate(w) if k not in gone], r.text if not gone else None)
    assert {r.doc_id: words(r.text) for r in kept} == {i: w for i, (w, _) in want.items()}
    assert all(want[r.doc_id][1] in (None, r.text) for r in kept)


def test_personal_data(spark, steps):
    _, rows, columns, kept = steps[3]
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept}
    changed = [r for r, s in zip(sorted(kept), sorted(rows), strict=True) if r.text != s.text]
    left = spark.createDataFrame(kept, ", ".join(f"{c} {t}" for c, t in spark.read.parquet(f"{SF}/documents.parquet").dtypes))
    found = pii.find(left, pii.boosted.NEVER).where("size(pii) > 0").count()
    assert changed and found == 0 and columns == list(kept[0].__fields__)


def test_packing(steps):
    _, rows, _, placed = steps[4]
    total = collections.Counter()
    for p in placed:
        total[p.doc_id] += p.n_tokens
    assert total == collections.Counter({r.doc_id: len(words(r.text)) + 1 for r in rows})


ODD = ["kept", "rule", "secrets", "pii", "n_words", "kept_text", "component_id", "extra_0", "lang", "_text"]


def odd_rows():
    rng = __import__("random").Random(20)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, passage = make(60), make(60), make(30)
    texts = [(1, a), (2, a), (3, b), (3, b), (4, f"{passage} {make(30)}"), (5, f"{make(30)} {passage}"), (6, None), (7, ""), (8, "short"), (None, make(50)), (9, f"{make(30)} +49 (30) 123-4567 {make(10)}"), (10, make(30_000))]
    return texts


def test_odd_documents_pass_all_stages(spark, tmp_path):
    rows = [(i, t, None if t is None else len(t), *[f"{c}-{i}" for c in ODD]) for i, t in odd_rows()]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in ODD)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        docs = spark.createDataFrame(found.collect(), schema)
    got = docs.collect()
    assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in ODD) and all(r.n_chars == len(r.text) for r in got)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, 1, 3, 3, 4, 5, 9, 10]
    by = {r.doc_id: r.text for r in got}
    assert "[PHONE]" in by[9] and len(words(by[5])) == 30 and len(words(by[4])) == 60 and len(words(by[10])) == 30_000
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in packed) == sum(len(words(r.text)) + 1 for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
