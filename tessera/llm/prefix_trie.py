"""The prefix trie of conversations as preorder intervals: every distinct prefix is a node, every subtree a run of places.

A prefix is named by sums of mixed hashes of (place, turn), two of 64 bits, which are running sums inside a conversation. Nodes are aggregates of these
names. They are ranked by the lexicographic order of their paths, where of a node's children the one with most conversations comes first and the
others after all that is below it; a path is then spelled by its other edges alone, of which there are at most log2 of the number of conversations, however long
it is. A subtree ends at the last place that a conversation through its node ends at. Leaves and savings of a subtree are differences of
running sums over the whole order at its end and before its node.

Nothing gathers a conversation, a node's children or its conversations in one task: positions, names and ranks are running sums over
ranges, the rest joins on names and aggregates. Texts are read once and become hashes. The lists of conversations that end at a node are hashed as a stream; where
they lie in several ranges, the ranges' shares, in text, are what the last step reads.

Defined results: conversations with a null id take no part. Null and empty texts or roles are alike. Turns of equal number go by a hash of role and
text, so repeated rows are repeated turns. Very long texts count whole. An empty table has no node. Extra columns are ignored. Two prefixes share a name with a
probability of 1 in 2**128 a pair. An id whose decimal form is hashed is the number's, whatever its type.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import running

from .common import drop_table, materialize

KEY = ["depth", "k1", "k2"]
_PIECE = 1 << 16  # characters of a list of ids that travel as one row


def _hashes(*values: Column | str) -> list[Column]:
    return [F.xxhash64(F.lit(lane), *values) for lane in (1, 2)]


def turns_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth (from 1), two hashes and the length of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    t1, t2 = _hashes(role, text)
    base = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), t1.alias("t1"), t2.alias("t2"), F.char_length(text).cast("long").alias("chars")).where("conv_id is not null")
    return running(base, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")], {"depth": F.lit(1)}, keep=["conv_id", "t1", "t2", "chars"], label="trie-turns")


def rebuilt(turns: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Conversations c with the first h turns of conversation c - c % block in place of their own first h, h = crc32(c) % heads; a row of depth 0 for each."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("long")
    turn = F.struct("depth", "t1", "t2", "chars")
    first = turns.where((F.col("conv_id") % block == 0) & (F.col("depth") < heads)).groupBy(F.col("conv_id").alias("head")).agg(F.array_sort(F.collect_list(turn)).alias("given"))
    first = materialize(first, "trie-heads")
    met = turns.withColumn("head", F.col("conv_id") - F.col("conv_id") % block).join(first, "head", "left").withColumn("h", h)
    met = met.withColumn("given", F.coalesce(F.slice("given", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<depth:bigint,t1:bigint,t2:bigint,chars:bigint>>")))
    zero = F.lit(0).cast("long")
    top = F.array(F.struct(zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), zero.alias("chars")))
    own = F.array(F.struct((F.size("given") + F.col("depth") - F.col("h")).alias("depth"), "t1", "t2", "chars"))
    none = F.slice(top, 1, 0)
    every = F.concat(F.when(F.col("depth") == 1, F.concat(top, "given")).otherwise(none), F.when(F.col("depth") > F.col("h"), own).otherwise(none))
    return met.select("conv_id", F.explode(every).alias("t")).select("conv_id", "t.*")


def _ended(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the conversations (conv_id) that end at each node."""

    def shares(batches):
        node, ids, runs, part = None, [], 0, None

        def close(final: bool):
            """The node's list: hashed, if it lies wholly in this range, else in pieces of text."""
            if runs == 1 or final:
                text, at = ",".join(ids), 0
                while at < len(text):
                    yield (*node, part, at, None, text[at : at + _PIECE])
                    at += _PIECE
            else:
                yield (*node, part, 0, hashlib.sha256(",".join(ids).encode()).hexdigest(), None)

        for batch in batches:
            out = []
            for key, conv in zip(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True), batch.column("conv_id").to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        out += close(False)
                    node, ids, runs = key, [], runs + 1
                ids.append(str(conv))
            part = batch.column("part")[0].as_py() if part is None and batch.num_rows else part
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in close(True)], schema=schema)

    names = [*KEY, "part", "at", "ends_sha256", "ids"]
    schema = pa.schema([(n, pa.int64()) for n in names[:5]] + [(n, pa.string()) for n in names[5:]])
    order = [*KEY, "conv_id"]
    ranged = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.spark_partition_id().cast("long").alias("part"))
    shared = materialize(ranged.mapInArrow(shares, "depth long, k1 long, k2 long, part long, at long, ends_sha256 string, ids string"), "trie-ends")

    def joined(batches):
        node, digest = None, None
        for batch in batches:
            out = []
            for *key, part, at, ids in zip(*(batch.column(n).to_pylist() for n in [*KEY, "part", "at", "ids"]), strict=True):
                if key != node:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                elif at == 0:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(kept, r, strict=True)) for r in out], schema=final)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(kept, (*node, digest.hexdigest()), strict=True))], schema=final)

    kept = [*KEY, "ends_sha256"]
    final = pa.schema([(n, pa.int64()) for n in KEY] + [("ends_sha256", pa.string())])
    parts = shared.where("ids is not null").repartition(*KEY).sortWithinPartitions(*KEY, "part", "at").select(*KEY, "part", "at", "ids")
    return shared.where("ids is null").select(*kept).unionByName(parts.mapInArrow(joined, "depth long, k1 long, k2 long, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, depth, t1, t2, chars; a row of depth 0 for each), with intervals.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and place and end_place, the subtree's run of places in preorder."""
    k1, k2 = _hashes("depth", "t1", "t2")
    zero = F.lit(0).cast("long")
    paths = running(conversations, ["conv_id"], ["depth"], {"k1": F.when(F.col("depth") > 0, k1).otherwise(zero), "k2": F.when(F.col("depth") > 0, k2).otherwise(zero)}, {"p1": "k1", "p2": "k2"}, last="ends", keep=["conv_id", "depth", "chars"], label="trie-paths")
    nodes = materialize(paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2")), "trie-nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    below = nodes.where("depth > 0")
    kids = materialize(below.groupBy(*up).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", F.col("k1").alias("h1"), F.col("k2").alias("h2"))).alias("first")), "trie-children")
    parents = materialize(kids.join(nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id")), KEY), "trie-parents")
    over = parents.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_conv_id", "first")
    linked = nodes.join(over, ["depth", "p1", "p2"], "left").join(kids.select(*KEY, "n_children"), KEY, "left")
    aside = (F.col("depth") > 0) & ((F.col("first.h1") != F.col("k1")) | (F.col("first.h2") != F.col("k2")))
    linked = linked.select(*KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "chars", aside.alias("aside"))
    nodes_, nodes = nodes, materialize(linked, "trie-linked")

    # Paths of the conversations that are the smallest of some node: those of all others are the same.
    named = nodes.select("conv_id").distinct()
    own = materialize(paths.join(materialize(named, "trie-named"), "conv_id", "left_semi").select(*KEY, "conv_id", "ends"), "trie-own")
    edges = own.select(*KEY, "conv_id").join(nodes.where("aside").select(*KEY), KEY, "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "k1", "k2"))).alias("edges"))
    edges = materialize(edges, "trie-edges")
    spelled = nodes.join(edges, "conv_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<depth:bigint,k1:bigint,k2:bigint>>")))
    here = F.filter("edges", lambda e: e["depth"] <= F.col("depth"))
    path = F.concat(F.transform(here, lambda e: F.struct((-e["depth"]).alias("a"), e["k1"].alias("b"), e["k2"].alias("c"))), F.array(F.struct(F.lit(-(2**62)).alias("a"), F.col("depth").alias("b"), zero.alias("c"))))
    sums = {"place": F.lit(1), "leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}
    columns = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children"]
    placed = materialize(running(spelled.withColumn("path", path), [], ["path"], sums, {"leaves_before": "leaves", "saved_before": "saved"}, keep=columns, label="trie-places"), "trie-placed")

    # A subtree's end: the last place at which one of its conversations ends.
    last = materialize(own.where("ends").join(placed.select(*KEY, "place", "leaves", "saved"), KEY).select("conv_id", F.struct("place", "leaves", "saved").alias("final")), "trie-last")
    subtree = own.select(*KEY, "conv_id").join(last, "conv_id").groupBy(*KEY).agg(F.max("final").alias("final"))
    subtree = materialize(subtree, "trie-subtrees")
    digests = materialize(_ended(paths.where("ends")), "trie-digests")
    out = placed.join(subtree, KEY).join(digests, KEY, "left")
    for table in (nodes_, nodes, kids, parents, own, edges, last):
        drop_table(table)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("final.leaves") - F.col("leaves_before")).alias("n_leaves"), (F.col("final.saved") - F.col("saved_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "place", F.col("final.place").alias("end_place"),
    )
