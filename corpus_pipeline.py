"""The corpus pipeline: quality, line dedup, near-duplicates, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents, with n_chars brought up to date where texts change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake.llm import compression_classifier
from trendlake.llm.common import checkpoint_dir, positional
from trendlake.llm.line_dedup import dedup_lines
from trendlake.llm.packing import pack_documents
from trendlake.llm.queries import fold
from trendlake.llm.simhash_dedup import drop_near_duplicates
from trendlake.llm.substring_dedup import dedup_substrings

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.3

#: The classifier, the tokenizer and near-duplicate chains can't be written in SQL.
ORACLE_SQL = None


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    changed = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs
    return changed.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores LEAST_QUALITY or more.

    A null text is scored as an empty one; rows with a null id or a repeated one are scored each
    for itself. Columns of any name stay as they are. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = compression_classifier.train(docs, labels, learnable=fold(5) != 0)
    table, names = positional(docs)
    scored = compression_classifier.score(table, model, text_col=f"_c{names.index('text')}", out="_score")
    return scored.filter(F.col("_score") >= LEAST_QUALITY).drop("_score").toDF(*names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document has, of equal lines none.

    Null texts stay null; all lines of one id count as one document's, and a null id comes before
    all others. Repeated rows stay. An empty table stays empty.
    """
    return _with_length(dedup_lines(docs, emit="documents"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near-duplicates.

    Null and wordless texts are one group. Rows that repeat the smallest id stay as they come; rows
    without an id go if their group has one with an id. An empty table stays empty.
    """
    return drop_near_duplicates(docs, shingle=5, similarity=0.8).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 20 words or more that start earlier as well.

    Null texts stay null; rows of one id remove nothing from each other, and a null id comes before
    all others. Repeated rows stay. An empty table stays empty.
    """
    return _with_length(dedup_substrings(docs, emit="documents"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences of 2048: a row a piece. A null text is its end id alone."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near),
    ("substring_dedup", substrings),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet and read again.

    A stage's files go once the next one's are written.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                old = spark._jvm.org.apache.hadoop.fs.Path(before)
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            before = path
    return docs
