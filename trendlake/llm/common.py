"""Helpers shared by the operators: sizes, checkpoints, batches, sorted streams, joins by hot keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake.session import checkpoint, checkpoint_dir

__all__ = ["BYTE_SPACES", "SPACES", "batch_count", "batch_of", "checkpoint", "checkpoint_dir", "documents_of", "each_key", "input_bytes", "join_spread", "partitions_for", "positional", "public_tokenizer", "shuffle_partitions", "spread_out", "whole_keys"]

#: ASCII white space that separates words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
BYTE_SPACES = SPACES.encode()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, n: int, each: int) -> int:
    """Partitions of about `each` of n rows or bytes; as many as the session shuffles into, at least."""
    return max(shuffle_partitions(spark), -(-n // each))


def input_bytes(df: DataFrame, text: Column) -> int:
    """Bytes of the texts: for a scan of files about three times their size, else a sum over all rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = {line.strip(" +-:").split(" ")[0].split("[")[0] for line in plan.toString().split("\n") if line.strip()}
    if nodes <= {"Project", "Filter", "Relation"}:
        return 3 * int(str(plan.stats().sizeInBytes()))
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def batch_count(text_bytes: int, spark: SparkSession, batch_bytes: int = 8 << 20) -> int:
    """Batches of a bounded size, and enough of them to keep all cores busy."""
    return max(-(-text_bytes // batch_bytes), 4 * spark.sparkContext.defaultParallelism)


def batch_of(doc_id: Column, text: Column, n: int) -> Column:
    """An even batch number for a document; rows without an id are spread by their text."""
    code = F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id))
    return F.pmod(code, F.lit(n)).cast("int")


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The same rows with columns named _c0, _c1, ... so that no input name can clash with ours."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), df.columns


def documents_of(df: DataFrame, id_col: str, text_col: str, **more: Column | str) -> DataFrame:
    """(doc_id long, text, more): whatever other columns the input has, names that differ in case included.

    `more` are names of columns, or expressions over the input's own names.
    """
    made = {n: c for n, c in more.items() if isinstance(c, Column)}
    if made:
        df = df.select("*", *[c.alias(f"_more {n}") for n, c in made.items()])
    table, names = positional(df)
    column = lambda name: F.col(f"_c{names.index(name)}")
    others = [column(f"_more {n}" if n in made else c).alias(n) for n, c in more.items()]
    return table.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"), *others)


def spread_out(df: DataFrame) -> DataFrame:
    """Deals rows to all cores before costly work in map-only stages, where the scan has fewer splits.

    A scan of a large table has more splits than cores and is left as it is, and so is what comes
    from a shuffle.
    """
    cores, query = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if query.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    return df.repartition(4 * cores) if query.toRdd().getNumPartitions() < cores else df


def public_tokenizer(name: str) -> str:
    """Where a public vocabulary lies."""
    return public_tokenizers.path(name)


def whole_keys(batches: Iterable[pa.RecordBatch], most_rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about so many rows, cut only where the first column changes.

    For a stream that is sorted by that column: memory holds one table, or one key if that is larger.
    """
    parts: list[pa.RecordBatch] = []
    held, enough = 0, most_rows
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch)
        held += batch.num_rows
        if held >= enough:
            whole = pa.Table.from_batches(parts)
            keys = whole.column(0).to_numpy()
            at = int(np.searchsorted(-(keys != keys[-1]).astype(np.int8), 0))  # where the last key begins
            enough = most_rows if at else 2 * held
            if at:
                yield whole.slice(0, at)
                parts, held = whole.slice(at).to_batches(), len(keys) - at
    if parts:
        yield pa.Table.from_batches(parts)


def each_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table a key of a stream that is sorted by its first column, an integer."""
    for table in whole_keys(batches, 1):
        keys = table.column(0).to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield table.slice(start, end - start)


def join_spread(left: DataFrame, right: DataFrame, key: str, weight: str, *spread: str, least: int = 1000, most: int = 10_000) -> DataFrame:
    """Inner join of many rows a key with one row a key, where some keys are hot.

    `weight`, a column of `right`, says how many rows of `left` a key has. The `most` heaviest
    keys with over `least` rows are broadcast, at most so many rows, and their left rows stay
    where they are; all others have less than the left's rows / `most`. `spread` are columns of
    `left` by which rows of hot keys are dealt.
    """
    values = F.struct(*[c for c in right.columns if c != key])
    heavy = right.filter(F.col(weight) > least).orderBy(F.desc(weight), key).limit(most).select(key, values.alias("_hot"))
    dealt = left.join(F.broadcast(heavy), key, "left")
    dealt = dealt.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*spread)))
    joined = dealt.join(right.select(F.col(key).alias("_key"), values.alias("_cold")), "_key", "left")
    found = joined.withColumn("_found", F.coalesce("_hot", "_cold")).filter("_found IS NOT NULL")
    return found.select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in right.columns if c not in left.columns])
