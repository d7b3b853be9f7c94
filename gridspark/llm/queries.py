"""The numbered queries, each over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac, infill, langid, licenses, lines, merkle, minhash, mixing, packing, shards, spelling, suffixes, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_fingerprints(_documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_documents(spark, sf_dir))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(_documents(spark, sf_dir), shards=8)


def op5_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(_documents(spark, sf_dir), labels)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate(_documents(spark, sf_dir), unit="sentence", min_words=lines.MIN_WORDS)
    spans = [F.array_join(F.col(f"{kind}.{side}"), ",").alias(f"{kind}_{side}s") for kind in ("removed", "spared") for side in ("start", "end")]
    return out.select("doc_id", "text", F.col("n_units").cast("long").alias("n_units"), F.col("n_removed").cast("long").alias("n_removed"), *spans)


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.text_media(_documents(spark, sf_dir))


def op9_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without id too, which the operator by itself leaves out."""
    docs = _documents(spark, sf_dir).select(F.struct("doc_id").alias("row"), "text")
    return licenses.scan(docs, id_col="row").withColumn("doc_id", F.col("doc_id.doc_id"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(_documents(spark, sf_dir), min_chars=6)  # shorter ones give no word of six, misspelt or not
    words = spelling.word_counts(runs.select(spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word")))
    return spelling.group_variants(words).select("word", "form", "root", "n", F.col("n_near").cast("long").alias("n_near"), "form_n")


def op12_warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = warc.history(warc.read_archives(warc.write_archives(warc.captures(pages))))
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "url_key", "time", "position", "capture_no")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(_documents(spark, sf_dir))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_merkle_fingerprints": op2_merkle_fingerprints,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_minimax_shards": op4_minimax_shards,
    "op5_domain_mixing": op5_domain_mixing,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_flac_media": op8_flac_media,
    "op9_crf_language": op9_crf_language,
    "op10_license_scan": op10_license_scan,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_warc_history": op12_warc_history,
    "op13_fill_in_middle": op13_fill_in_middle,
}
