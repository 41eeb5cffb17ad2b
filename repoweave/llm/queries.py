"""The numbered queries: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, language, license, linedup, minhash, packing, pii, sharding, substrings, trie, urlfilter, whitening
from .common import LOWEST, stored

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_id():
    return F.when(F.col("o") != LOWEST, F.col("o")).alias("doc_id")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents by the ordered rules."""
    return license.digest(license.scan(_table(spark, sf_dir, "documents")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at a similarity of 0.85."""
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses to earlier ones, and a digest of what is left."""
    found = linedup.deduplicated(_table(spark, sf_dir, "documents"))
    return found.select(_doc_id(), "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op4_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, with groups of equal ones."""
    docs = _table(spark, sf_dir, "documents")
    found = fingerprint.groups(docs, stored(fingerprint.edited(docs), "prints"))
    return found.select(_doc_id(), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "group_size")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return urlfilter.judged(_table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MB of text each, and the directory's entries."""
    return sharding.sharded(_table(spark, sf_dir, "documents"), limit=1 << 20)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned outside those that are held out."""
    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs.where(~language.held_out())))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in windows of the benchmark's items."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated"
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(pii.found(_table(spark, sf_dir, "documents")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the 16 leading components of the distinct ones' covariance."""
    found = whitening.whitened(_table(spark, sf_dir, "embeddings"))
    each = found.select("row.vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")), "identity_error")
    return each.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "col.whitened", "col.explained", "identity_error")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, which share the first turns of every twentieth."""
    return trie.nodes(trie.rebuilt(trie.sequences(_table(spark, sf_dir, "conversations"))))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each document loses to earlier windows of 20 words, and a digest of what is left."""
    found = substrings.deduplicated(_table(spark, sf_dir, "documents"))
    return found.select(_doc_id(), "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
