"""Sorted runs of hashes and their merge: the log-structured index, spread over Spark tasks.

Each batch of documents makes one sorted run of 64-bit keys without repeats, cut into ranges of
the hash space ("buckets"), which are dealt to tasks in order. A task takes one bucket after the
other, merges the runs of all batches, and answers each run with a bitmap in the run's own order.
A key that is very common costs one entry a batch, not one a row, so no bucket grows with the
number of copies. There are as many buckets as make one of them a few megabytes; a run has a row
only where it has keys, so rows never outnumber entries.

Stored runs of earlier batches lie bucketed in files. New runs are exchanged to them; the stored
ones stay where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_key, shuffle_partitions

RUN_SCHEMA = "batch int, bucket int, round int, keys binary, more binary, owners binary"
REPLY_SCHEMA = "batch int, bucket int, round int, bits binary"
_RUN = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("round", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("owners", pa.binary())])
_REPLY = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("round", pa.int32()), ("bits", pa.binary())])

#: Batch number of runs that lie in an index from earlier calls: they get no answer and count as earlier.
HISTORY = -1
#: Owner of a key without a document id: sorts before all ids.
NULL_OWNER = -(1 << 63)
#: Bytes of keys that a bucket should hold.
BUCKET_BYTES = 8 << 20


def bucket_count(text_bytes: int, spark: SparkSession) -> int:
    """Buckets for runs of so many bytes of text, whose keys take up to four times as many.

    input_bytes may be three times the texts, hence the factor. Batches and buckets both follow
    the bytes, not the session's partitions: their product is the number of rows that runs have
    at most.
    """
    return max(-(-4 * text_bytes // (3 * BUCKET_BYTES)), 4 * spark.sparkContext.defaultParallelism)


def bucket_edges(n_buckets: int) -> np.ndarray:
    """First key of each bucket after the first one."""
    return np.array([(i << 64) // n_buckets for i in range(1, n_buckets)], dtype=np.uint64)


def cut(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Positions at which sorted keys change bucket: n_buckets + 1 of them."""
    return np.concatenate(([0], np.searchsorted(keys, bucket_edges(n_buckets)), [len(keys)]))


def run_table(batch: int, round_: int, n_buckets: int, keys: np.ndarray, more: np.ndarray | None = None, owners: np.ndarray | None = None) -> pa.Table:
    """The rows of one batch's run, a row for each bucket that has keys."""
    at = cut(keys, n_buckets)
    full = np.flatnonzero(np.diff(at)).tolist()

    def parts(values):
        if values is None:
            return pa.array([None] * len(full), pa.binary())
        return pa.array([values[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())

    n = len(full)
    return pa.Table.from_arrays([pa.array([batch] * n, pa.int32()), pa.array(full, pa.int32()), pa.array([round_] * n, pa.int32()), parts(keys), parts(more), parts(owners)], schema=_RUN)


def _joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    arrays = [np.frombuffer(x.as_buffer() or b"", dtype) for x in column]
    return np.concatenate(arrays), np.array([len(x) for x in arrays])


def _answers(table: pa.Table, flags: np.ndarray, sizes: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    columns = [table.column(c).to_pylist() for c in ("batch", "bucket", "round")]
    keep = [i for i in range(len(sizes)) if columns[0][i] != HISTORY and flags[ends[i] - sizes[i] : ends[i]].any()]
    bits = [np.packbits(flags[ends[i] - sizes[i] : ends[i]]).tobytes() for i in keep]
    return pa.Table.from_arrays([*[pa.array([c[i] for i in keep], pa.int32()) for c in columns], pa.array(bits, pa.binary())], schema=_REPLY)


def _merge_shared(table: pa.Table) -> pa.Table:
    """Marks keys that lie in two runs or more."""
    keys, sizes = _joined(table.column("keys"), np.uint64)
    order = np.argsort(keys, kind="stable")  # a merge of what is sorted already
    same = keys[order[1:]] == keys[order[:-1]]
    hit = np.zeros(len(keys), bool)
    hit[1:] |= same
    hit[:-1] |= same
    flags = np.empty(len(keys), bool)
    flags[order] = hit
    return _answers(table, flags, sizes)


def _merge_first(table: pa.Table) -> pa.Table:
    """Marks keys that another run holds for an earlier owner; equality is of all 128 bits."""
    keys, sizes = _joined(table.column("keys"), np.uint64)
    more, _ = _joined(table.column("more"), np.uint64)
    owners, _ = _joined(table.column("owners"), np.int64)
    past = np.repeat(np.array(table.column("batch").to_pylist()) == HISTORY, sizes)
    order = np.lexsort((owners, ~past, more, keys))
    k, m, o, p = keys[order], more[order], owners[order], past[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    flags = np.empty(len(k), bool)
    flags[order] = ~p & (p[head] | (o > o[head]))
    return _answers(table, flags, sizes)


def ranged(runs: DataFrame, n_buckets: int) -> DataFrame:
    """Rows dealt to tasks by ranges of buckets, sorted by bucket within each."""
    n = min(n_buckets, max(shuffle_partitions(runs.sparkSession), n_buckets // 4))
    rows = runs.select("bucket", "batch", "round", "keys", "more", "owners")
    return rows.repartitionById(n, (F.col("bucket").cast("long") * n / F.lit(n_buckets)).cast("int")).sortWithinPartitions("bucket")


def _merged(runs: DataFrame, base: DataFrame | None, n_buckets: int, merge) -> DataFrame:
    if base is None:

        def run(batches):
            for table in each_key(batches):
                yield from merge(table).to_batches()

        return ranged(runs, n_buckets).mapInArrow(run, REPLY_SCHEMA)

    def both(new: pa.Table, old: pa.Table) -> pa.Table:
        return merge(pa.concat_tables([new, old.select(new.column_names)])) if len(new) else _REPLY.empty_table()

    return runs.groupBy("bucket").cogroup(base.select(*runs.columns).groupBy("bucket")).applyInArrow(both, REPLY_SCHEMA)


def shared(runs: DataFrame, n_buckets: int, base: DataFrame | None = None) -> DataFrame:
    """For each run a bitmap of the keys that some other run has as well; runs without any are left out."""
    return _merged(runs, base, n_buckets, _merge_shared)


def not_first(runs: DataFrame, n_buckets: int, base: DataFrame | None = None) -> DataFrame:
    """For each run a bitmap of the keys that an earlier owner holds; runs without any are left out."""
    return _merged(runs, base, n_buckets, _merge_first)


def compacted(runs: DataFrame, n_files: int) -> DataFrame:
    """One sorted run without repeats a round from all runs, a row a round and bucket.

    Rows are dealt by the hash of the bucket, as a table bucketed by it into `n_files` has them.
    """

    def run(batches):
        for table in each_key(batches):
            rounds = table.column("round").to_numpy()
            for round_ in np.unique(rounds).tolist():
                part = table.take(pa.array(np.flatnonzero(rounds == round_)))
                keys, _ = _joined(part.column("keys"), np.uint64)
                if part.column("more").null_count:
                    columns = [np.unique(keys).tobytes(), None, None]
                else:
                    more, owners = _joined(part.column("more"), np.uint64)[0], _joined(part.column("owners"), np.int64)[0]
                    by = np.lexsort((owners, more, keys))
                    k, m = keys[by], more[by]
                    new = np.ones(len(k), bool)
                    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
                    columns = [k[new].tobytes(), m[new].tobytes(), owners[by][new].tobytes()]
                row = {"batch": HISTORY, "bucket": part.column("bucket")[0].as_py(), "round": round_, "keys": columns[0], "more": columns[1], "owners": columns[2]}
                yield from pa.Table.from_pylist([row], schema=_RUN).to_batches()

    rows = runs.select("bucket", "batch", "round", "keys", "more", "owners")
    return rows.repartition(n_files, "bucket").sortWithinPartitions("bucket").mapInArrow(run, RUN_SCHEMA)


def flags_of(replies: pa.Table, round_: int, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """A batch's answers of one round, in the order of its sorted keys."""
    at, flags = cut(keys, n_buckets), np.zeros(len(keys), bool)
    for r, bucket, bits in zip(replies.column("round").to_pylist(), replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
        if r == round_:
            n = at[bucket + 1] - at[bucket]
            flags[at[bucket] : at[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return flags
