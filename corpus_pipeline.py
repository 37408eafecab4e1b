"""From raw documents to packed training sequences, in stages that are stored in between.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept: quality rules drop what they reject,
of each group of near duplicates one document stays, passages that earlier documents have are cut out,
personal data is replaced by its kind, and what is left is packed into sequences. All but the last return the
columns of documents; n_chars follows the text.

Defined results: documents with null, empty, blank or short texts fail the quality rules. Null labels teach nothing. Documents with null ids pass, are
duplicates of none, and lose no passages. Of repeated rows with one id all or none stay. Of equal documents the one with the smallest id stays, and of passages that of
the smallest id. Very long texts are worked on whole. An empty table gives an empty table at every stage. Extra columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import best_fit, minhash, pii, quality_rules, recompression
from tessera.llm.common import materialize


def _shielded(docs: DataFrame) -> DataFrame:
    """docs with all columns but id and text under names that no operator gives."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"extra_{i}" for i, c in enumerate(docs.columns)])


def _restored(found: DataFrame, like: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of like, perhaps with another text."""
    named = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if text is not None:
        found = found.withColumn("text", text)
        if "n_chars" in like.columns:
            named["n_chars"] = F.char_length("text").cast(like.schema["n_chars"].dataType)
    return found.select(*[named.get(c, F.col(f"extra_{i}")).alias(c) for i, c in enumerate(like.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _restored(quality_rules.judge(_shielded(docs), labels).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; shingles of five words, a similarity of 0.8."""
    return _restored(minhash.near_duplicates(_shielded(docs), width=5, percent=80).where("kept"), docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document with nothing else goes."""
    found = recompression.dedup(_shielded(docs), layout=True).where("n_removed = 0 or n_removed < n_words")
    return _restored(found, docs, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    found = pii.find(_shielded(docs), pii.learn(docs))
    return _restored(found, docs, F.when(F.size("pii") > 0, pii.redact(F.col("text"), F.col("pii"))).otherwise(F.col("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go."""
    return best_fit.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]

#: Trained stages and hashed signatures have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
