"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_classifier, langid, quality_rules, sql
from .bpe import encode_documents
from .chat_format import repair_conversations
from .common import checkpoint_dir
from .line_dedup import dedup_lines
from .order_minhash import compare_with_next
from .packing import pack_documents
from .simhash_dedup import near_duplicates
from .substring_dedup import dedup_in_batches


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(n: int) -> Column:
    """A document's fold of n: CRC-32 of its id written out, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_in_batches(_documents(spark, sf_dir), f"{checkpoint_dir(spark)}/substring-index-{uuid.uuid4().hex}")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs, learnable=fold(3) != 1), held_out=fold(3) == 1)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir))


def op4_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = compression_classifier.train(docs, labels, learnable=fold(5) != 0)
    return compression_classifier.score_documents(docs, model, held_out=fold(5) == 0)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_documents(spark, sf_dir))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # lies beside the package, and imports this module

    return corpus_pipeline.run(spark, sf_dir)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_quality_rules, op4_compression_classifier, op5_simhash_dedup, op6_order_minhash, op7_chat_format, op8_bpe_codec, op9_packing, op10_line_dedup, pipeline)}


SQL: dict[str, str] = {"op1_substring_dedup": sql.SUBSTRING_DEDUP, "op3_quality_rules": quality_rules.SQL, "op10_line_dedup": sql.LINE_DEDUP}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
