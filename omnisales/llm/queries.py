"""The registered queries of this package: each applies one operator to its whole table and digests the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, secrets
from .ann import nearest_neighbours
from .collocations import collocations
from .decontaminate import find_contamination
from .language import identify_language
from .near_dups import near_duplicates
from .packing import pack_documents
from .scratch import ship_package
from .sentencepieces import encode_and_decode
from .spans import base_only, joined, of_kind
from .spelling import spelling_variants
from .substrings import remove_repeated_passages
from .toxicity import score_toxicity
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                      F.sha2("decoded", 256).alias("decoded_sha256"),
                      (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "parity")


def _span_digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    return found.select("doc_id", *(of_kind(k).alias(f"n_{k}") for k in kinds),
                        F.sha2(joined(base_only(kinds)), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secrets.find_secrets(_table(spark, sf_dir, "documents")), secrets.BASE)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = write_archives(_table(spark, sf_dir, "pages"), least_bytes=0)
    return read_archives(folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.find_personal_data(_table(spark, sf_dir, "documents")), pii.BASE)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=5, percent=75)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(_table(spark, sf_dir, "documents"), capacity=1024)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=10, top=2000)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_sentencepiece, op3_secret_scan, op4_warc, op5_personal_data, op6_decontamination,
        op7_language, op8_near_duplicates, op9_toxicity, op10_nearest_neighbours,
        op11_best_fit_packing, op12_collocations, op13_spelling_variants,
    )}
