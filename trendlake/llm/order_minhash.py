"""Document fingerprints by Order MinHash.

A text's pieces (words, long ones cut) form k-mers, each numbered by how often it occurred before.
In every one of `slots` random orders of the numbered k-mers the least `kept` are taken, put back
into text order, and hashed as a tuple. Two texts share a slot when the same k-mers are least and
stand in the same order, so likeness falls with edit distance, moved passages included.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import checkpoint, documents_of, input_bytes, partitions_for, spread_out

SLOTS, KEPT, K = 32, 2, 3
_PIECES = re.compile(r"[^\x20\x09-\x0D]{1,8}")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Sorts before all ids.
_NULL_KEY = -(1 << 63)


class _Codes(dict):
    most = 400_000

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[piece] = code = xxhash.xxh3_64_intdigest(piece.encode())
        return code


_CODES = _Codes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _A
    x ^= x >> np.uint64(31)
    return x


def _odd(n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(i.to_bytes(8, "little")) | 1 for i in range(n)], np.uint64)


_FACTORS = _odd(SLOTS)


def fingerprint(text: str) -> np.ndarray:
    """SLOTS 32-bit values, most significant byte first; all zero for a text without words."""
    pieces = _PIECES.findall(text)
    if not pieces:
        return np.zeros(SLOTS, ">u4")
    codes = np.fromiter(map(_CODES.__getitem__, pieces), np.uint64, len(pieces))
    n = max(1, len(codes) - K + 1)
    kmers = np.zeros(n, np.uint64)
    for i in range(min(K, len(codes))):
        kmers = kmers * _A + codes[i : i + n]
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ranked[1:] != ranked[:-1])), np.arange(n), 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = np.arange(n) - first
    numbered = _mixed(kmers + occurrence * _B)
    out = np.empty(SLOTS, np.uint64)
    step = max(1, 2_000_000 // n)
    for i in range(0, SLOTS, step):
        values = numbered[None, :] * _FACTORS[i : i + step, None]
        rows, places = np.arange(len(values)), []
        for _ in range(min(KEPT, n)):
            places.append(values.argmin(1))
            values[rows, places[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        found = numbered[np.sort(np.stack(places, 1), 1)]
        total = np.zeros(len(found), np.uint64)
        for j in range(found.shape[1]):
            total = _mixed(total * _A + found[:, j])
        out[i : i + step] = total
    return (out >> np.uint64(32)).astype(">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of slots that agree."""
    return float((a == b).mean())


def written(values: np.ndarray) -> str:
    return values.tobytes().hex()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row's whole text (null: empty); null ids and repeated rows are kept."""

    def run(batches):
        for batch in batches:
            found = [written(fingerprint(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return spread_out(documents_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, fingerprint string")


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double, part int, kind int, text string"
_NAMES = [c.split(" ")[0] for c in _COMPARED.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}[c.split(" ")[1]] for c in _COMPARED.split(", ")]
#: Rows of _COMPARED: a document compared with the next; the first and the last text of a partition.
_DONE, _HEAD, _LAST = 0, 1, 2


def _compared(doc_id: int | None, text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    size = len(text)
    edited = text[: size - size // 4] + following[: size // 4]
    new = fingerprint(edited)
    return (doc_id, size, hashlib.sha256(edited.encode()).hexdigest(), own.tobytes(), new.tobytes(), likeness(own, new), likeness(own, theirs), None, _DONE, None)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)] if rows else [pa.array([], k) for k in _KINDS], _NAMES)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last floor(n / 4) code points replaced by the first as many of the next
    document's (ascending id; after the last the first). One row an input row: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt out by ranges of (id, start of the text) and sorted; a task streams through
    its range and holds one text beside the current one. Only the first and the last text of each
    range go on, two rows a partition, and are joined to each other. Null texts are empty. Null ids
    come first; rows with the same id are in the order of their texts. A single document
    follows itself. An empty table gives no rows.
    """
    rows = documents_of(docs, id_col, text_col)
    n = partitions_for(docs.sparkSession, input_bytes(rows, F.col("text")), 128 << 20)
    # The bounds of ranges are a sample that Spark brings to the driver: of texts, 64 characters.
    text, key = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_NULL_KEY)).alias("key")
    dealt = rows.select("doc_id", text, key).repartitionByRange(n, "key", F.substring("text", 1, 64)).sortWithinPartitions("key", "text").select("doc_id", "text")

    def run(batches):
        part, before, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = fingerprint(text)
                if before is None:
                    out.append((*[None] * 7, part, _HEAD, text))
                else:
                    out.append(_compared(*before, text, own))
                before = doc_id, text, own
            yield _rows(out)
            out = []
        if before is not None:
            yield _rows([(before[0], *[None] * 6, part, _LAST, before[1])])

    found = checkpoint(dealt.mapInArrow(run, _COMPARED))
    ends = found.filter(F.col("kind") != _DONE).select("doc_id", "part", "kind", "text")
    # A row a partition that holds documents; the window sees their numbers alone.
    order = Window.orderBy("part")
    numbers = ends.filter(F.col("kind") == _HEAD).select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = ends.filter(F.col("kind") == _HEAD).select(F.col("part").alias("next"), F.col("text").alias("following"))
    borders = ends.filter(F.col("kind") == _LAST).join(numbers, "part").join(heads, "next").select("doc_id", "text", "following")

    def finish(batches):
        for batch in batches:
            yield _rows([_compared(i, t, fingerprint(t), f, fingerprint(f)) for i, t, f in zip(*(c.to_pylist() for c in batch.columns))])

    done = found.filter(F.col("kind") == _DONE).unionByName(borders.mapInArrow(finish, _COMPARED))
    written_ = lambda c: F.lower(F.hex(c))
    return done.select("doc_id", "n_chars", "edited_sha256", written_("print").alias("fingerprint"), written_("edited_print").alias("edited_fingerprint"), "near_edited", "near_next")
