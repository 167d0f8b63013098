"""A training corpus from the documents table: five stages, each one operator of ``omnisales.llm``.

1. toxicity: documents predicted toxic go;
2. near duplicates: of each group of copies the document with the smallest id stays;
3. decontamination: documents that hold a passage of the benchmark go;
4. secrets: every secret in a text is replaced by its kind in brackets; all documents stay;
5. tokens: token ids of every text, decoded again and compared.

Every stage works on all rows its predecessor kept, and its result is written as Parquet and read again. Rows that
share an id stay or go together in stage 2 and are judged by their own text elsewhere; rows with a null id are never
duplicates. Null texts pass all stages and have no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omnisales.llm.decontaminate import drop_contaminated
from omnisales.llm.near_dups import drop_near_duplicates
from omnisales.llm.scratch import new_folder, own_steps, remove, ship_package, written
from omnisales.llm.secrets import redact_secrets
from omnisales.llm.sentencepieces import encode_and_decode
from omnisales.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    out = encode_and_decode(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "parity")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("tokens", tokens)]
#: Scores, entropy windows and token ids are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. Tables that a stage writes on its way, and the result of the stage before it, are
    removed when its own result is written; the last result stays with the application's steps (``scratch.drop_steps``)."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        with own_steps(spark, f"steps-{name}"):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return docs
