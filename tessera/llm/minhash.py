"""Near-duplicate documents: many universal hash minima, banding, verification and connected components.

A document's set holds the 64-bit hashes of its distinct shingles (words in lower case; fewer words than a shingle
make one of their own). Documents with equal sets form a class, and the class goes on under a hash of its set, with the text of its smallest id, so
thousands of copies cost one row. Classes that share an id are linked. Each class gets the minima of 384 universal hash functions; 32 bands of 5 of them
make buckets. With a similarity of 0.8, two classes share no bucket with a probability of 3e-6.

Links are looked for in steps, and a pair counts only if its sets, made anew from the whole texts, are as similar
as asked. In the first ``stars`` steps (``STARS`` unless told otherwise) every member of a bucket meets two pivots of the bucket, other ones in each step: as many pairs as members.
Components follow from these links. A link within a component changes nothing, so each step looks only at buckets that still hold several
components. In what is left then, the members of different components meet, in cells of bounded size, if the sizes of their sets
permit the similarity. Before sets are compared, the share of equal minima must not be 4.5 standard deviations short (which misses as rarely as the bands).

Only signatures go through buckets and cells. The texts of pairs that are still in question are sent to the
task that compares them, once to each task however many pairs they have there, and a pivot's pairs are dealt to several tasks.

Defined results: null, empty and blank texts have no shingle, are linked with nothing and kept. A null id is kept
and linked with nothing (component_id null), but its n_shingles are its own. Rows that share an id are one document with several texts: n_shingles is each row's, component_id
that of all, but for a row without shingles, whose component_id is its id; repeated rows and ties are alike. Very long texts count whole: a task takes pairs by the size of their sets, so a few long texts fill one. Extra
columns pass through, but for those with the name of an output. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, free_names, materialize, mix, run_hash, text_buffer, windows_hash, word_hashes, word_spans
from .components import connected

BANDS, ROWS = 32, 5
_HASHES = 384  # the first BANDS * ROWS make bands, all of them signatures
STARS = 1  # more of them join families whose members are close to few others before cells are made, at the price of that many rounds
_PART, _CELLS = 256, 8
_TASK_SHINGLES = 1_000_000  # of the pairs that one task compares
_OUTPUTS = ["n_shingles", "component_id", "kept"]


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(9))
    return rng.integers(0, 1 << 63, (_HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, (_HASHES, 1), dtype=np.uint64)


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow string array."""
    data, offsets = text_buffer(texts)
    upper = (data >= 65) & (data <= 90)
    data = data + upper.astype(np.uint8) * np.uint8(32)
    starts, ends = word_spans(data)
    at = np.searchsorted(starts, offsets).tolist()
    h = word_hashes(data, starts, ends)
    full = windows_hash(h, width)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= width:
            out.append(np.unique(full[lo : hi - width + 1]))
        elif hi > lo:
            out.append(np.array([run_hash(h[lo:hi])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(hashes: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    best = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        values = a * hashes[None, k : k + 1024]
        values += b
        np.minimum(best, values.min(axis=1), out=best)
    return best


def sign(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, two fingerprints of the set, 8 bits of each minimum, band keys, and two hashes of the text, which tell rows of one id apart."""

    def run(batches):
        family = _family()
        band = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                n, f1, f2, sig, bands = [], [], [], [], []
                for s in shingle_sets(part.column(1), width):
                    n.append(len(s))
                    for f, x in zip((f1, f2), _fingerprints(s), strict=True):
                        f.append(x)
                    if len(s):
                        m = minima(s, family)
                        key = band
                        for column in m[: BANDS * ROWS].reshape(BANDS, ROWS).T:
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
                        sig.append(mix(m).astype(np.uint8).tobytes())  # the low byte of a mixed minimum: a minimum's own top bits are zero in long texts
                        bands.append(key.astype(np.int64))
                    else:
                        sig.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "n": pa.array(n, pa.int64()), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "sig": pa.array(sig, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "t1": part.column(2), "t2": part.column(3)})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *_of_text(text_col)).mapInArrow(run, "id long, n long, f1 long, f2 long, sig binary, bands array<long>, t1 long, t2 long")


def _of_text(text_col: str) -> list[Column]:
    return [F.xxhash64(F.lit(lane), F.col(text_col)).alias(f"t{lane}") for lane in (1, 2)]


def _node() -> Column:
    return F.xxhash64("f1", "f2")


def _fingerprints(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64).astype(np.int64))


def class_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(rep, text) of the classes in nodes (rep): of the texts that the class's id has, the one with the class's set."""

    def own(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                f1, f2 = part.column("f1").to_pylist(), part.column("f2").to_pylist()
                ok = [_fingerprints(s) == (x, y) for s, x, y in zip(shingle_sets(part.column("text"), width), f1, f2, strict=True)]
                yield part.select(["rep", "text"]).filter(pa.array(ok, pa.bool_()))

    named = classes.join(nodes, "rep", "left_semi").select("rep", "id", "f1", "f2")
    return docs.join(named, "id").select("rep", "text", "f1", "f2").mapInArrow(own, "rep long, text string").dropDuplicates(["rep"])


def _spread(percent: int) -> float:
    """How far below the similarity the share of equal minima may lie: at 4.5 standard deviations it misses as rarely as the bands do."""
    return 4.5 * (percent / 100 * (1 - percent / 100) / _HASHES) ** 0.5


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _HASHES)


def _plausible(a: np.ndarray, b: np.ndarray, bodies, least: float) -> np.ndarray:
    """Whether signatures allow the similarity."""
    sig = _signatures(bodies)
    return np.concatenate([(sig[a[k : k + 4096]] == sig[b[k : k + 4096]]).mean(axis=1) >= least for k in range(0, len(a), 4096)])


def _similar(a: np.ndarray, b: np.ndarray, bodies, width: int, percent: int, sets: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Whether the sets of texts are similar enough. sets: those made so far, by place."""
    sets = {} if sets is None else sets
    if sum(map(len, sets.values())) > 2 * _TASK_SHINGLES:
        sets.clear()
    bodies = bodies.combine_chunks() if isinstance(bodies, pa.ChunkedArray) else bodies

    def of(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingle_sets(bodies.slice(x, 1), width)[0]
        return sets[x]

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        both = len(np.intersect1d(of(x), of(y), assume_unique=True))
        out.append(both > 0 and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
    return np.array(out, bool)


def _compared(pairs: DataFrame, bodies: DataFrame, test, label: str) -> DataFrame:
    """The pairs (cell, a, b, size) that pass test, stored. bodies (rep, body) meet the pairs in tasks; all pairs of a cell go to one, and each task gets a body once."""
    total = pairs.agg(F.sum("size")).first()[0] or 0
    dealt = pairs.withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(max(12, -(-total // _TASK_SHINGLES))).cast("long")))
    sent = dealt.select(F.col("task").alias("to"), F.explode(F.array("a", "b")).alias("rep")).distinct().join(bodies, "rep").select("to", "rep", "body")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(["cell", "a", "b", "size"])
        rep = np.asarray(right.column("rep"))
        order = np.argsort(rep)
        place = lambda c: order[np.searchsorted(rep, np.asarray(left.column(c)), sorter=order)]
        return left.filter(pa.array(test(place("a"), place("b"), right.column("body")), pa.bool_())) if left.num_rows else left

    return materialize(dealt.groupBy("task").cogroup(sent.groupBy("to")).applyInArrow(compare, "cell long, a long, b long, size long"), label)


def star_pairs(placed: DataFrame, step: int) -> DataFrame:
    """(cell, a, b, size): each member of a mixed bucket (key, rep, n, component) with those of the bucket's two pivots that are in other components. A pivot's pairs are dealt into cells of about ``_PART``."""
    by = F.xxhash64("rep", F.lit(step)) if step else F.col("rep")
    one = F.struct(by.alias("by"), "rep", "component", "n")
    ends = placed.groupBy("key").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("m")).where("c1 < c2")
    met = placed.join(ends.select("key", "low", "high", "m"), "key").select("rep", "n", "component", "m", F.explode(F.array("low", "high")).alias("end"))
    met = met.where("component <> end.component").groupBy(F.col("end.rep").alias("pivot"), "rep").agg(F.max("m").alias("m"), F.max(F.col("n") + F.col("end.n")).alias("size"))
    cell = F.xxhash64("pivot", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / _PART)))
    return met.select(cell.alias("cell"), F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"), "size").dropDuplicates(["a", "b"])


def across(placed: DataFrame, classes: DataFrame, bodies: DataFrame, width: int, percent: int, label: str) -> DataFrame:
    """Links (a, b) between different components (placed: key, rep, n, component) that share a bucket, stored.

    A bucket's members are dealt into parts of about ``_PART``, and each pair of parts is a cell of bounded size; cells are
    packed into tasks. A pair is tried in the cell of the first band that it shares. Set sizes and signatures first show which members of a cell have
    a pair that may be similar enough. Only these come to the cell again, with their texts, and their pairs are verified on the spot, so no row is made for each pair."""
    least = percent / 100 - _spread(percent)
    sizes = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("m")).where("c1 < c2").select("key", F.ceil(F.col("m") / _PART).cast("int").alias("parts"))
    sizes = materialize(sizes, f"{label}-mixed")
    tasks = max(12, -(-(sizes.agg(F.sum(F.col("parts") * F.col("parts"))).first()[0] or 0) // _CELLS))
    short = F.transform("bands", lambda b: b.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(0x80000000)).cast("array<int>")  # enough to tell bands apart
    task = F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks).cast("long")).alias("task")
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("mine")
    signed = placed.join(sizes, "key").join(classes.select("rep", "sig", short.alias("bands")), "rep")
    met = signed.select("*", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = met.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "n", "component", "sig", "bands").select("*", task)

    def possible(table: pa.Table):
        """For each cell (i, members, a, b): the places of its members, and the pairs that sizes and signatures permit."""
        key, i, j, mine, rep, n, component = (np.asarray(table.column(c)) for c in ("key", "i", "j", "mine", "rep", "n", "component"))
        sig = _signatures(table.column("sig"))
        bands = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
        order = np.lexsort((j, i, key))
        new = np.flatnonzero((np.diff(key[order], prepend=key[order[:1]] - 1) != 0) | (np.diff(i[order], prepend=-1) != 0) | (np.diff(j[order], prepend=-1) != 0)) if len(order) else []
        for cell in np.split(order, new[1:]) if len(order) else []:
            left, right = cell[mine[cell] == i[cell[0]]], cell[mine[cell] == j[cell[0]]]
            for at in range(0, len(left), 64):
                x, y = left[at : at + 64, None], right[None, :]
                ok = (component[x] != component[y]) & (percent * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y]))
                if i[cell[0]] == j[cell[0]]:
                    ok &= rep[x] < rep[y]
                p, q = np.nonzero(ok)
                p, q = left[at + p], right[q]
                for k in range(0, len(p), 4096):
                    u, v = p[k : k + 4096], q[k : k + 4096]
                    good = (sig[u] == sig[v]).mean(axis=1) >= least
                    u, v = u[good], v[good]
                    same = bands[u] == bands[v]
                    first = bands[u, same.argmax(axis=1)] == (key[cell[0]] & 0xFFFFFFFF) - 0x80000000
                    yield u[first], v[first]

    def choose(table: pa.Table) -> pa.Table:
        ok = np.zeros(table.num_rows, bool)
        for u, v in possible(table):
            ok[u] = ok[v] = True
        return table.filter(pa.array(ok)).select(names)

    def verify(table: pa.Table) -> pa.Table:
        rep, bodies, found = np.asarray(table.column("rep")), table.column("body").combine_chunks(), [np.zeros((2, 0), np.int64)]
        sets: dict[int, np.ndarray] = {}
        for u, v in possible(table):
            held = _similar(u, v, bodies, width, percent, sets)
            found.append(np.stack([np.minimum(rep[u], rep[v])[held], np.maximum(rep[u], rep[v])[held]]))
        return pa.table(dict(zip("ab", map(pa.array, np.concatenate(found, axis=1)), strict=True)))

    names = cells.columns
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields)
    chosen = materialize(cells.groupBy("task").applyInArrow(choose, kind), f"{label}-chosen")
    drop_table(sizes)
    found = chosen.join(bodies, "rep").groupBy("task").applyInArrow(verify, "a long, b long").distinct()
    found = materialize(found, f"{label}-links")
    drop_table(chosen)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", stars: int = STARS) -> DataFrame:
    """Rows of docs (of docs with an id and a text only: the id) with n_shingles, component_id (the smallest id reachable over links) and kept (whether the row has that id)."""
    keep = [c for c in docs.columns if c not in _OUTPUTS]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    signed = materialize(sign(docs, width, id_col, text_col), "minhash-signed")
    real = signed.where("n > 0 and id is not null")
    best = real.groupBy("f1", "f2").agg(F.min(F.struct("id", "n", "sig", "bands")).alias("x"))
    classes = materialize(best.select("f1", "f2", _node().alias("rep"), "x.id", "x.n", "x.sig", "x.bands"), "minhash-classes")
    nodes = real.select("id", _node().alias("rep"))
    several = nodes.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
    found = materialize(nodes.join(several, "id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "minhash-links")
    buckets = classes.select(F.explode("bands").alias("key"), "rep", "n")
    filled = buckets.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    shared = materialize(buckets.join(filled.select("key"), "key"), "minhash-buckets")
    signatures = classes.select("rep", F.col("sig").alias("body"))
    bodies = materialize(class_texts(texts, classes, shared.select("rep").distinct(), width).withColumnRenamed("text", "body"), "minhash-texts")
    least = percent / 100 - _spread(percent)
    plausible = lambda a, b, sig: _plausible(a, b, sig, least)
    similar = lambda a, b, text: _similar(a, b, text, width, percent)
    component = None
    for step in range(stars + 1):
        placed = shared
        if step:
            known = component.select("node", "component")
            placed = shared.join(known, shared["rep"] == known["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
            placed = materialize(placed, "minhash-placed")
        else:
            placed = placed.withColumn("component", F.col("rep"))
        if step < stars:
            met = materialize(star_pairs(placed, step), "minhash-star")
            pairs = _compared(met, signatures, plausible, "minhash-likely")
            drop_table(met)
            fresh = _compared(pairs, bodies, similar, "minhash-fresh")
            drop_table(pairs)
        else:
            fresh = across(placed, classes, bodies, width, percent, "minhash-rest")
        if step:
            drop_table(placed)
        if component is None or fresh.limit(1).count():
            before, found = found, materialize(found.unionByName(fresh.select("a", "b")), "minhash-links")
            drop_table(before)
            old, component = component, connected(found, "minhash-components")
            if old is not None:
                drop_table(old)
        drop_table(fresh)
    for table in (shared, bodies):
        drop_table(table)
    of_class = classes.select("f1", "f2", "rep", "id").join(component, F.col("rep") == F.col("node"), "left").select("f1", "f2", "id", F.coalesce("component", "rep").alias("group"))
    of_class = of_class.join(of_class.groupBy("group").agg(F.min("id").alias("component")), "group").select("f1", "f2", "component")
    placed_docs = signed.select("id", "n", "f1", "f2", "t1", "t2").join(of_class, ["f1", "f2"], "left")
    verdict = placed_docs.select("id", "t1", "t2", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"))
    verdict = verdict.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    if set(keep) <= {id_col, text_col}:
        return verdict.select(F.col("id").alias(id_col), *_OUTPUTS)
    own, own1, own2, t1, t2 = free_names([*keep, *_OUTPUTS], "own_id", "own_1", "own_2", "text_1", "text_2")
    once = verdict.dropDuplicates(["id", "t1", "t2"]).withColumnsRenamed({"id": own, "t1": own1, "t2": own2})  # rows of one id and one text have one verdict
    hashed = docs.select(*keep, *[c.alias(n) for c, n in zip(_of_text(text_col), (t1, t2), strict=True)])
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(t1) == F.col(own1)) & (F.col(t2) == F.col(own2))
    return hashed.join(once, same, "left").select(*keep, *_OUTPUTS)
