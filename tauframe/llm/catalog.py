"""The queries over whole tables, one for each operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauframe.llm import (
    exact_dedup, merkle, mixing, near_dedup, oracles, pii, quality_classifier, quality_rules,
    sentencepiece_sampling, sharding, substring_dedup, suffix_tree, warc, whitening)
from tauframe.llm.storage import id_remainder

SHARDS = 24
MIX_WEIGHTS = [5, 2, 1]
#: Documents scored below this are rejected.
LEAST_QUALITY = 0.3


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_documents(spark, sf_dir), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir), keep="largest").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), words_per_shingle=3, percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.AttentionModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_classifier.fit(docs, labels, id_remainder("doc_id", 5) != 0)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = quality_classifier.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def sampled_pieces(docs: DataFrame) -> DataFrame:
    """``docs`` with sampled piece_ids, n_pieces, and whether decoding gives the text back."""
    decoded = sentencepiece_sampling.decode(sentencepiece_sampling.encode(docs))
    return decoded.select(
        *docs.columns, "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"),
        sentencepiece_sampling.lossless("text", "decoded").alias("lossless"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return sampled_pieces(docs).select("doc_id", "piece_ids", "n_pieces", "lossless")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir), MIX_WEIGHTS, max_epochs=3).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_documents(spark, sf_dir))
    base = [k.name for k in pii.KINDS if k.base]
    spans = found.withColumn("_base", F.concat(*base)).withColumn("_all", F.concat(*[k.name for k in pii.KINDS]))
    return spans.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(pii.span_text(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        pii.span_text(F.col("_all")).alias("spans"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = id_remainder("doc_id", 7) == 2
    tree, counts = suffix_tree.fit(suffix_tree.train_rows(docs, ~held_out))
    return suffix_tree.score(docs, tree, counts).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read_bundles(spark, folder, index)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), limit=32)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_documents(spark, sf_dir), window=35).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    shifted = [F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in columns]
    tampered = (id_remainder("doc_id", 7) == 0) & F.col("doc_id").isNotNull()
    leaves = _documents(spark, sf_dir).select(
        F.col("lang").alias("group"), F.col("doc_id").alias("id"), merkle.leaf_digest([F.col(c) for c in columns]).alias("leaf"),
        F.when(tampered, F.unhex(merkle.leaf_digest(shifted))).alias("shown"))
    proved = merkle.manifest(leaves, fanout=2, carry=["shown"])
    shown = F.coalesce(F.lower(F.hex("shown")), F.col("leaf"))
    return proved.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.fold(shown, F.col("proof")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op1_sharding": oracles.SHARDING,
    "op2_exact_dedup": oracles.EXACT_DEDUP,
    "op6_mixing": oracles.MIXING,
    "op10_warc": oracles.WARC,
    "op12_substring_dedup": oracles.SUBSTRINGS,
    "op13_merkle": oracles.MERKLE,
}
