"""Queries of the ten corpus operators, each over the whole of its table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import best_fit, bpe, exact_dedup, jpeg, langid, licenses, line_dedup, packed_ids, simhash, toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """CRC-32 of an id written as text; 0 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lambda: F.size(F.split("text", "\n")).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_lines", lines())
    return line_dedup.dedup_lines(docs).select(
        "doc_id",
        "n_lines",
        F.when(F.col("text") != "", lines()).otherwise(0).alias("n_kept"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = packed_ids.write_packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return written.select(
        "sequence_id",
        "n_tokens",
        F.size("doc_ids").alias("n_segments"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "cu_seqlens",
        "position_resets",
        "doc_ids",
        "pieces",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.stored_texts(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, id_crc() % 3 != 1)
    return langid.identify(docs, model).select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_line_dedup, op3_simhash, op4_best_fit_packing, op5_packed_ids, op6_license_scan,
        op7_toxicity, op8_jpeg_media, op9_exact_dedup, op10_language_id,
    )
}

ORACLE_SQL: dict[str, str] = {"op6_license_scan": licenses.SQL, "op9_exact_dedup": exact_dedup.SQL}
