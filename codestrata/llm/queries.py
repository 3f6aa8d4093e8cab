"""Registered queries of the training-data operators and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, host_rules, langid, merkle, multiset, nbest, packing, pitman_yor, sentence_spans, sharding, simhash, spelling, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), capacity=2048, end=1)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@register
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses when all strings of 200 bytes that repeat are removed."""
    digest = suffix_dedup.removal_digest(_table(spark, sf_dir, "documents"), length=200, keep="none")
    return digest.withColumnRenamed("id", "doc_id")


@register
def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the documents is held out of training."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    held_out = F.coalesce(langid.remainder("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy class of every document."""
    classes = simhash.simhash_classes(_table(spark, sf_dir, "documents"))
    return classes.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@register
def op10_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return multiset.with_next(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register
def op1_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, compared within its label."""
    found = hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"), settings=hnsw.Settings(threshold=0.93))
    return found.withColumnRenamed("id", "vec_id")


#: Production setting of op3: 64 shards.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


@register
def op3_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS).withColumn("slot", F.col("slot").cast("long"))


#: Production setting of op5: any punctuation ends a sentence of 25 characters or more.
SENTENCES = {"ends": ".!?\n,;:", "least": 25}


@register
def op5_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses when later runs of three sentences are removed."""
    found = sentence_spans.remove_repeats(_table(spark, sf_dir, "documents"), run=3, **SENTENCES)
    return found.select(F.col("id").alias("doc_id"), "n_sentences", "n_removed", F.md5("kept").alias("kept_md5"))


ORACLE_SQL["op5_sentence_span_dedup"] = sentence_spans.oracle(run=3, **SENTENCES)


@register
def op6_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document, and the digest of what each is decoded to."""
    found = nbest.encode(_table(spark, sf_dir, "documents"), n=4, decoded=True)
    return found.select(
        F.col("id").alias("doc_id"), "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.md5("text").alias("decoded_md5")
    )


@register
def op4_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document under a model learned from four fifths of them."""
    return pitman_yor.score(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, witness and root of every document, a tree for each language; some rows are folded with a tampered leaf."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = merkle.leaf_of(*fields)
    changed = merkle.leaf_of(*fields[:3], F.try_add("n_chars", F.lit(1)), fields[4])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)
    found = merkle.manifest(
        _table(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"), leaf, {"doc_id": F.col("doc_id"), "tampered": tampered}
    )
    shown = [merkle.hexadecimal(c).alias(c) for c in ("leaf", "subroot", "root")]
    checked = merkle.folded(found.withColumn("given", F.coalesce("tampered", "leaf")), "given")
    return checked.select(
        "doc_id", *shown, F.sha2(merkle.hexadecimal("witness"), 256).alias("proof_sha256"),
        merkle.hexadecimal("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"),
    )


ORACLE_SQL["op11_merkle_manifest"] = merkle.oracle()


@register
def op13_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether it stays after the verdict on its source."""
    found = host_rules.judge(_table(spark, sf_dir, "documents"), F.col("source"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select(F.col("id").alias("doc_id"), *measures, "base_failed", "kept")


ORACLE_SQL["op13_host_quality_rules"] = host_rules.oracle()


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with the form it is a variant of."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op12_spelling_variants"] = spelling.oracle()
