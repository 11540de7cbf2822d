"""A training-data pipeline over `documents`: language ID, near-duplicates, secrets, mixing, BPE.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.

Null, empty and letterless texts end at language ID. Null and repeated ids, ties and repeated rows: language ID and secret scans
treat each row by itself; near-dedup tells rows by id and text, and keeps one of rows equal in both; mixing gives each row a key
of its own. Very long texts are read whole by every stage. Extra columns are passed on by all stages but BPE, whatever their
names (those in `__` excepted); BPE drops them. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, langid, mixing, secret_scan, simhash
from riskloom.llm.common import checkpoint_folder, crc_mod, delete, prepare, table

#: A text whose language is less sure than this is rejected, as are texts without a letter. On sf0.1 this rejects 8 of 10,000
#: documents (half of them shouted or strewn with signs), all of 100 Greek texts, and about half of 300 texts of random letters,
#: of signs or in base64.
LEAST_LANGUAGE_SCORE = 0.40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell; it learns from those whose crc32(doc_id) mod 4 is not 2."""
    model = langid.fit_language_model(docs.where(crc_mod(F.col("doc_id"), 4) != 2), "text", "lang", "doc_id")
    own = {f"__c{i}": c for i, c in enumerate(docs.columns)}  # names that clash with no new column
    found = langid.detect_language(docs.toDF(*own), model, next(k for k, c in own.items() if c == "text"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*[F.col(k).alias(c) for k, c in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars follows the text."""
    return secret_scan.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Rows of files are told by file and place there."""
    try:
        rows = docs.select("*", F.concat_ws(":", "_metadata.file_name", "_metadata.row_index").alias("__row"))
    except AnalysisException:  # not read from files
        return mixing.mixed(docs)
    return mixing.mixed(rows, row_col="__row")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each row, with digests of them and of the text they decode to."""
    encoded = bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), keep=["doc_id", "lang", "source"]).withColumn("ids_sha256", F.sha2("ids", 256))
    return bpe.bpe_decode(encoded).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("secret scans", secrets), ("mixing", mixture), ("BPE", tokens)]

#: SQL cannot express the language model or BPE: tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:  # what that stage was made of
            delete(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
