"""Line dedup: lines that an earlier document has already are dropped.

Lines are hashed to 128 bits where they are read; what is shuffled is a hash, a document and a
position a line, never text. A batch of rows settles among itself what it can: only the first
document that holds a hash asks about it, all later ones drop the line whatever the answer. Hashes
are dealt to tasks by ranges and sorted by (hash, document, position); a task streams through
them, the first occurrence of each stays, and the others go back to their documents as positions.
These meet the texts once, in a join, which gives each document its lines and the run lengths of
its keep bitmap.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_SPACES, input_bytes, partitions_for, positional, whole_keys

#: Owner of a line without a document id: sorts before all ids.
NULL_OWNER = -(1 << 63)
_ENTRY = "range int, high long, low long, owner long, text_id long, pos int, sure binary"
_NAMES = [c.split(" ")[0] for c in _ENTRY.split(", ")]


def _key(line: bytes, least: int) -> bytes | None:
    """A line's key, or None if it has fewer than `least` code points."""
    key = line.strip(BYTE_SPACES).lower()  # bytes.lower() changes A-Z alone
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode()) < least):
        return None
    return key


def _entries(owners: np.ndarray, text_ids: np.ndarray, texts: list[bytes], least: int, n_ranges: int) -> pa.RecordBatch:
    """What a batch of rows has to ask, a row a hash and document, and what it knows, a row a document.

    A position stands for all lines of its document with the same key; it is the first of them.
    """
    digests, row, pos = [], [], []
    for r, text in enumerate(texts):
        for p, line in enumerate(text.split(b"\n")):
            key = _key(line, least)
            if key is not None:
                digests.append(xxhash.xxh3_128_digest(key))
                row.append(r)
                pos.append(p)
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    row, pos = np.array(row, np.int64), np.array(pos, np.int64)
    owner = owners[row] if len(row) else np.empty(0, np.int64)
    by = np.lexsort((pos, row, owner, both[:, 1], both[:, 0]))
    high, low, owner, row, pos = both[by, 0], both[by, 1], owner[by], row[by], pos[by]
    new = np.ones(len(by), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    leads = new.copy()  # the first line of its key and row
    leads[1:] |= row[1:] != row[:-1]
    first = owner[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(by) else owner
    asks = leads & (owner == first)
    goes = np.flatnonzero(leads & (owner > first))
    goes = goes[np.argsort(row[goes], kind="stable")]
    rows, at = np.unique(row[goes], return_index=True)
    sure = [pos[some].astype("<i4").tobytes() for some in np.split(goes, at[1:])] if len(rows) else []
    n = int(asks.sum())
    spread = (text_ids[rows].view(np.uint64) >> np.uint64(32)).astype(np.int64) * n_ranges >> 32
    columns = [
        pa.array(np.concatenate((((high[asks] >> np.uint64(32)).astype(np.int64) * n_ranges) >> 32, spread)).astype(np.int32)),
        pa.array(np.concatenate((high[asks].view(np.int64), np.zeros(len(rows), np.int64)))),
        pa.array(np.concatenate((low[asks].view(np.int64), np.zeros(len(rows), np.int64)))),
        pa.array(np.concatenate((owner[asks], owners[rows]))),
        pa.array(np.concatenate((text_ids[row[asks]], text_ids[rows]))),
        pa.array(np.concatenate((pos[asks], np.zeros(len(rows), np.int64))).astype(np.int32)),
        pa.array([None] * n + sure, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _later(table: pa.Table) -> pa.RecordBatch:
    """Of a stretch of whole keys, sorted by hash and document, the entries with an earlier document; and all that is known."""
    high, low, owner = (table.column(c).to_numpy() for c in ("high", "low", "owner"))
    order = np.lexsort((owner, low, high))
    sure = table.column("sure").is_valid().to_numpy(zero_copy_only=False)
    order = order[~sure[order]]
    h, m, o = high[order], low[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
    first = o[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else o
    goes = order[o > first]
    known = np.flatnonzero(sure)
    positions = [p.tobytes() for p in table.column("pos").to_numpy()[goes].astype("<i4")] + table.column("sure").take(pa.array(known)).to_pylist()
    at = pa.array(np.concatenate((goes, known)))
    found = table.select(["owner", "text_id"]).take(at).combine_chunks()
    columns = [pa.array(found.column(c).to_numpy()) for c in ("owner", "text_id")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(positions, pa.binary())], ["owner", "text_id", "positions"])


def _kept(text: bytes, drops: list[bytes] | None, least: int) -> tuple[bytes, np.ndarray]:
    """The lines that stay, joined, and a flag a line."""
    if not drops:
        return text, np.ones(text.count(b"\n") + 1, bool)
    lines = text.split(b"\n")
    gone = {_key(lines[p], least) for p in np.frombuffer(b"".join(drops), "<i4").tolist()}
    stays = np.fromiter((_key(line, least) not in gone for line in lines), bool, len(lines))
    return b"\n".join([line for line, s in zip(lines, stays) if s]), stays


def run_lengths(stays: np.ndarray) -> str:
    """A keep bitmap by the lengths of its runs, kept lines first: "3,1,2" is 111011; "0,2" is 00."""
    edge = np.flatnonzero(np.concatenate(([True], stays[1:] != stays[:-1], [True])))
    return ",".join(([] if stays[0] else ["0"]) + [str(n) for n in np.diff(edge).tolist()])


def bitmap(runs: str) -> np.ndarray:
    """The flags that run_lengths wrote."""
    lengths = [int(n) for n in runs.split(",")]
    return np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, emit: str = "digest") -> DataFrame:
    r"""Drops lines whose key an earlier document (smaller id) holds.

    A text is split at \n; a key is the line stripped of ASCII white space at both ends with A-Z
    in lower case. Keys under `least` code points always stay, and so do all lines of a key in the
    document with the smallest id that holds it.

    emit="digest": doc_id, n_lines, n_dropped, kept_sha256, keep_runs (the keep bitmap compressed
    to run lengths, see run_lengths), one row for each input row. emit="documents": the input's
    columns, the text replaced by the lines that stay.

    A null or empty text is one empty line (emit="documents" leaves a null text null). A null id
    counts as smaller than all ids. Rows of one id count as one document, so none of them removes
    lines from another. Repeated rows are returned as often as they come. An empty table gives none.
    """
    spark, (table, names) = docs.sparkSession, positional(docs)
    doc_id, text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    n_ranges = partitions_for(spark, input_bytes(table, F.col(text)), 64 << 20)
    owner, text_id = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_OWNER)), F.xxhash64(text)

    def ask(batches):
        for batch in batches:
            owners, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield _entries(owners, ids, texts, least, n_ranges)

    def answer(batches):
        for stretch in whole_keys(batches):
            yield _later(stretch)

    entries = table.select(owner.alias("owner"), text_id.alias("text_id"), F.col(text).alias("text")).mapInArrow(ask, _ENTRY)
    dealt = entries.repartitionById(n_ranges, "range").sortWithinPartitions("high", "low", "owner", "pos")
    answers = dealt.select("high", "low", "owner", "text_id", "pos", "sure").mapInArrow(answer, "owner long, text_id long, positions binary")
    # At most a position a line of the document; repeated rows ask and are answered alike.
    drops = answers.groupBy("owner", "text_id").agg(F.collect_list("positions").alias("_drops"))
    columns = table.columns if emit == "documents" else [doc_id, text]
    joined = table.select(owner.alias("owner"), text_id.alias("text_id"), *columns).join(drops, ["owner", "text_id"], "left").select(*columns, "_drops")

    def keep(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, lists = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            found = [_kept(t or b"", d, least) for t, d in zip(texts, lists)]
            if emit == "documents":
                kept = pa.array([k.decode() if t is not None else None for (k, _), t in zip(found, texts)], pa.string())
                yield pa.RecordBatch.from_arrays([kept if i == at else c for i, c in enumerate(batch.columns[:-1])], batch.schema.names[:-1])
            else:
                counts = [pa.array([int(f(s)) for _, s in found], pa.int64()) for f in (len, lambda s: len(s) - s.sum())]
                digests = [pa.array(x, pa.string()) for x in ([hashlib.sha256(k).hexdigest() for k, _ in found], [run_lengths(s) for _, s in found])]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts, *digests], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_runs"])

    if emit == "documents":
        return joined.mapInArrow(keep, table.schema).toDF(*names)
    return joined.mapInArrow(keep, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_runs string")
