"""Substring dedup over a log-structured index of window hashes.

A window is `width` consecutive words of one document. Every batch of documents is made into
sorted runs of hashes, which are merge-joined with the runs of all other batches and with the
stored runs of earlier calls (the index), in two rounds:

1. anchors: of the `gram`-word grams inside a window, the one with the least hash. Equal windows
   have equal anchors, so a window whose anchor occurs once cannot repeat. Neighbouring windows
   share anchors, so this run has about 2 / (width - gram + 2) entries a word;
2. windows: only those with a repeated anchor, by a 128-bit digest of the words themselves and
   with their first owner. This verifies the candidates: it owes nothing to the hashes of round 1.

SubstringIndex keeps the runs as immutable files and compacts them.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake.operators.manifest import Manifest

from . import sorted_runs as runs
from .common import batch_count, batch_of, input_bytes, partitions_for, positional, shuffle_partitions
from .words import Texts

ANCHORS, WINDOWS = 0, 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x += b
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling."""
    have, parts, size = h, [], 1
    at = 0
    out = None
    while True:
        if n & size:
            out = have[: len(h) - size + 1] if out is None else _mixed(out[: max(0, len(h) - at - size + 1)], have[at : at + max(0, len(h) - at - size + 1)])
            at += size
        size *= 2
        if size > n:
            return out[: max(0, len(h) - n + 1)]
        have = _mixed(have[: max(0, len(have) - size // 2)], have[size // 2 :])


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over every n consecutive values."""
    size = 1
    while size * 2 <= n:
        x = f(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    rest = n - size
    return f(x[:-rest], x[rest:]) if rest and len(x) > rest else x[:0] if rest else x


class _Batch:
    """The words of a batch of documents in the order of ids, and its windows."""

    def __init__(self, ids: list, texts: list, width: int, gram: int):
        self.width, self.gram = width, gram
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or b""))
        self.texts = Texts([texts[i] or b"" for i in self.order])
        self.words, self.row = self.texts.words, self.texts.row_of_words()
        self.owner = np.array([runs.NULL_OWNER if ids[i] is None else ids[i] for i in self.order], np.int64)
        n = max(0, len(self.words) - width + 1)
        self.valid = self.row[:n] == self.row[width - 1 :] if n else np.empty(0, bool)

    def anchors(self):
        """Anchor hashes in order, and whether they lie at two places of this batch."""
        span = self.width - self.gram + 1
        if not self.valid.any():
            self.keys, self.own = np.empty(0, np.uint64), np.empty(0, bool)
            return
        self.g = _grams(self.words, self.gram)
        self.least = _sliding(self.g, span, np.minimum)
        seen = np.where(self.valid, self.least, np.uint64(0))
        pad = np.zeros(span - 1, np.uint64)
        top = _sliding(np.concatenate((pad, seen, pad)), span, np.maximum)
        self.keys, count = np.unique(self.g[self.g == top], return_counts=True)
        self.own = count > 1

    def candidates(self, repeated: np.ndarray):
        """Windows whose anchor is repeated, grouped by their hash."""
        if not len(self.keys):
            self.start = self.group = self.first = np.empty(0, np.int64)
            self.high = self.more = np.empty(0, np.uint64)
            self.here = np.empty(0, bool)
            return
        hit = self.keys[repeated | self.own]
        near = np.full(len(self.g), _LAST)
        if len(hit):
            at = np.minimum(np.searchsorted(hit, self.g), len(hit) - 1)
            found = hit[at] == self.g
            near[found] = self.g[found]
        self.start = np.flatnonzero(self.valid & (_sliding(near, self.width - self.gram + 1, np.minimum) == self.least))
        high, low = self.digests()
        order = np.argsort(high, kind="stable")
        h, m = high[order], low[order]
        if ((h[1:] == h[:-1]) & (m[1:] != m[:-1])).any():
            order = np.lexsort((low, high))
            h, m = high[order], low[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
        heads = np.flatnonzero(new)
        row, group = self.row[self.start], np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        self.high, self.more, self.first = h[heads], m[heads], self.owner[row[order[heads]]]
        again = np.zeros(len(h), bool)  # has an earlier start in the same row
        again[order[1:]] = ~new[1:] & (row[order[1:]] == row[order[:-1]])
        self.group, self.here = group, again | (self.owner[row] > self.first[group])

    def removed(self, flags: np.ndarray) -> np.ndarray:
        """Of each word, whether a window that starts earlier elsewhere covers it."""
        start = self.start[flags[self.group] | self.here]
        edge = np.zeros(len(self.words) + 1, np.int32)
        edge[start] += 1
        edge[start + self.width] -= 1
        return np.cumsum(edge[:-1]) > 0

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of a 128-bit digest of the words of each candidate, with one space after each."""
        body, begin = self.texts.spaced()
        view, digest = memoryview(body), xxhash.xxh3_128_digest
        spans = zip(begin[self.start].tolist(), begin[self.start + self.width].tolist())
        both = np.frombuffer(b"".join([digest(view[a:b]) for a, b in spans]), ">u8").astype(np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def lost(self, gone: np.ndarray) -> np.ndarray:
        """Words that each document loses."""
        total = np.concatenate(([0], np.cumsum(gone)))
        return total[self.texts.last] - total[self.texts.first]

    def kept_words(self, gone: np.ndarray) -> list[bytes]:
        """Of each document the words that stay, joined by one space."""
        body, begin = self.texts.spaced()
        stays = ~gone
        kept = np.frombuffer(body, np.uint8)[np.repeat(stays, np.diff(begin))].tobytes()
        at = np.concatenate(([0], np.cumsum(np.diff(begin) * stays)))
        return [kept[a : max(a, b - 1)] for a, b in zip(at[self.texts.first].tolist(), at[self.texts.last].tolist())]

    def kept_texts(self, gone: np.ndarray) -> list[bytes]:
        """Each text without the words that go and the white space after them."""
        t = self.texts
        until = np.append(t.starts[1:], 0)  # a word's reach: to the next word, or to the end of its text
        final = t.last[t.last > t.first] - 1
        until[final] = t.end[t.last > t.first]
        edge = np.zeros(len(t.data) + 1, np.int8)
        np.add.at(edge, t.starts[gone], 1)
        np.add.at(edge, until[gone], -1)
        stays = np.cumsum(edge[:-1], dtype=np.int8) == 0
        kept, at = t.data[stays].tobytes(), np.concatenate(([0], np.cumsum(stays)))
        return [kept[a:b] for a, b in zip(at[t.begin].tolist(), at[t.end].tolist())]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, gram: int = 6, emit: str = "digest", base: DataFrame | None = None, young: DataFrame | None = None, n_buckets: int | None = None) -> DataFrame:
    """Removes each word covered by a window of `width` words that also starts earlier.

    Earlier: in a document with a smaller id, or in the same document further up, or in an index
    (`base` and `young`, its runs; see SubstringIndex). Windows are judged on the input.

    emit="digest": doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space), one row
    for each input row. emit="documents": the input's columns, the text without the removed words
    and the white space after them (texts that lose nothing are unchanged). emit="runs": the runs
    of this input, for an index.

    A null or empty text has no words (emit="documents" leaves it as it is). A null id counts as
    smaller than all ids. Rows of one id don't remove words from each other, as neither starts
    earlier; each repeats only within itself. An empty table gives no rows.
    """
    spark, (table, names) = docs.sparkSession, positional(docs)
    doc_id, text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    size = input_bytes(table, F.col(text))
    n_buckets = n_buckets or runs.bucket_count(size, spark)
    n_batches = batch_count(size, spark)
    columns = table.columns if emit == "documents" else [doc_id, text]
    dealt = table.select(batch_of(F.col(doc_id).cast("long"), F.col(text), n_batches).alias("batch"), *columns).repartition(partitions_for(spark, size, 128 << 20), "batch")

    def batch(part: pa.Table) -> _Batch:
        x = _Batch(part.column(doc_id).cast(pa.int64()).to_pylist(), part.column(text).cast(pa.binary()).to_pylist(), width, gram)
        x.anchors()
        return x

    def anchor_run(part: pa.Table) -> pa.Table:
        return runs.run_table(part.column("batch")[0].as_py(), ANCHORS, n_buckets, batch(part).keys)

    def window_run(part: pa.Table, replies: pa.Table) -> pa.Table:
        x = batch(part)
        x.candidates(runs.flags_of(replies, ANCHORS, x.keys, n_buckets))
        return runs.run_table(part.column("batch")[0].as_py(), WINDOWS, n_buckets, x.high, x.more, x.first)

    def full_runs(part: pa.Table) -> pa.Table:
        """Both runs with all windows: later batches may repeat any of them."""
        x = batch(part)
        anchors = runs.run_table(runs.HISTORY, ANCHORS, n_buckets, x.keys)
        x.candidates(np.ones(len(x.keys), bool))
        return pa.concat_tables([anchors, runs.run_table(runs.HISTORY, WINDOWS, n_buckets, x.high, x.more, x.first)])

    def keep(part: pa.Table, replies: pa.Table) -> pa.Table:
        x = batch(part)
        x.candidates(runs.flags_of(replies, ANCHORS, x.keys, n_buckets))
        gone = x.removed(runs.flags_of(replies, WINDOWS, x.high, n_buckets))
        if emit == "documents":
            kept = x.kept_texts(gone)
            out = part.drop(["batch"]).take(pa.array(x.order, pa.int64()))
            present = out.column(text).is_valid().to_pylist()
            return out.set_column(out.column_names.index(text), text, pa.array([k.decode() if p else None for k, p in zip(kept, present)], pa.string()))
        ids = part.column(doc_id).cast(pa.int64()).take(pa.array(x.order, pa.int64()))
        digests = [hashlib.sha256(k).hexdigest() for k in x.kept_words(gone)]
        return pa.table({"doc_id": ids, "n_words": pa.array(x.texts.last - x.texts.first, pa.int64()), "n_removed": pa.array(x.lost(gone), pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    if emit == "runs":
        return dealt.groupBy("batch").applyInArrow(full_runs, runs.RUN_SCHEMA)

    def of_round(old: DataFrame | None, round_: int) -> DataFrame | None:
        return None if old is None else old.filter(F.col("round") == round_)

    def with_young(new: DataFrame, round_: int) -> DataFrame:
        return new if young is None else new.unionByName(of_round(young, round_))

    by_batch = dealt.groupBy("batch")
    first = runs.shared(with_young(by_batch.applyInArrow(anchor_run, runs.RUN_SCHEMA), ANCHORS), n_buckets, of_round(base, ANCHORS))
    second = by_batch.cogroup(first.groupBy("batch")).applyInArrow(window_run, runs.RUN_SCHEMA)
    second = runs.not_first(with_young(second, WINDOWS), n_buckets, of_round(base, WINDOWS))
    schema = table.schema if emit == "documents" else "doc_id long, n_words long, n_removed long, kept_sha256 string"
    out = by_batch.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(keep, schema)
    return out.toDF(*names) if emit == "documents" else out


class SubstringIndex:
    """Runs of earlier batches in a shared folder, for incremental dedup.

    `dedup` removes from a batch what the index or the batch itself holds already; `append` adds
    the batch's own runs as one immutable generation; `compact` merges all generations into one
    sorted run a bucket, in files bucketed as a later batch's runs will be, so that the history
    isn't exchanged again. Its manifest holds the window, the gram and the numbers of buckets and
    files: what the stored runs were cut by holds for all that follow.

    Every batch counts as later than all that is in the index. A reader never sees a half-written
    generation; old files stay until their reader is done with them, and are not deleted here.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = 20, gram: int = 6, n_buckets: int | None = None):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), Manifest(spark, path)
        state = self.manifest.newest()[1]
        if state is None:
            state = {"width": width, "gram": gram, "n_buckets": n_buckets or 4 * shuffle_partitions(spark), "n_files": shuffle_partitions(spark), "base": None, "young": []}
            self.manifest.publish(-1, state)  # if another writer was first, its parameters hold
            state = self.manifest.newest()[1]
        if (state["width"], state["gram"]) != (width, gram) or n_buckets not in (None, state["n_buckets"]):
            raise ValueError(f"{path}: the index was made with {state}")
        self.width, self.gram, self.n_buckets, self.n_files = width, gram, state["n_buckets"], state["n_files"]

    def _options(self) -> dict:
        return {"width": self.width, "gram": self.gram, "n_buckets": self.n_buckets}

    def _base(self, name: str) -> DataFrame:
        """The compacted generation, known to the catalogue as bucketed."""
        known = f"substring_index_{xxhash.xxh3_64_hexdigest(f'{self.path}/{name}')}"
        if not self.spark.catalog.tableExists(known):
            place = f"{self.path}/{name}".replace("'", "''")
            self.spark.sql(f"CREATE TABLE {known} ({runs.RUN_SCHEMA}) USING parquet CLUSTERED BY (bucket) SORTED BY (bucket) INTO {self.n_files} BUCKETS LOCATION '{place}'")
        return self.spark.table(known)

    def runs(self) -> tuple[DataFrame | None, DataFrame | None]:
        """What the index holds now: the compacted generation, and all since."""
        state = self.manifest.newest()[1]
        base = self._base(state["base"]) if state["base"] else None
        young = self.spark.read.schema(runs.RUN_SCHEMA).parquet(*[f"{self.path}/{x}" for x in state["young"]]) if state["young"] else None
        return base, young

    def dedup(self, docs: DataFrame, **options) -> DataFrame:
        base, young = self.runs()
        return dedup_substrings(docs, base=base, young=young, **self._options(), **options)

    def append(self, docs: DataFrame, **options) -> None:
        name = f"g-{uuid.uuid4().hex}"
        dedup_substrings(docs, emit="runs", **self._options(), **options).write.parquet(f"{self.path}/{name}")
        while True:
            version, state = self.manifest.newest()
            if self.manifest.publish(version, state | {"young": [*state["young"], name]}):
                return

    def compact(self) -> None:
        """Merges what the index holds now; what is appended meanwhile stays young."""
        _, before = self.manifest.newest()
        if not before["young"]:
            return
        parts = [p for p in self.runs() if p is not None]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        name = f"c-{uuid.uuid4().hex}"
        known = f"substring_index_{xxhash.xxh3_64_hexdigest(f'{self.path}/{name}')}"
        writer = runs.compacted(rows, self.n_files).write.format("parquet").bucketBy(self.n_files, "bucket").sortBy("bucket")
        writer.option("path", f"{self.path}/{name}").saveAsTable(known)
        while True:
            version, state = self.manifest.newest()
            if state["base"] != before["base"] or state["young"][: len(before["young"])] != before["young"]:
                return  # another compaction was first
            if self.manifest.publish(version, state | {"base": name, "young": state["young"][len(before["young"]) :]}):
                return


def dedup_in_batches(docs: DataFrame, path: str, shares: tuple[float, ...] = (1 / 64, 1 / 32), id_col: str = "doc_id", text_col: str = "text", width: int = 20, gram: int = 6, **options) -> DataFrame:
    """dedup_substrings of a whole table by way of a new index at `path`, batch by batch in the order of ids.

    `shares`: of all ids, the parts that batches but the last reach up to. Each of these is deduplicated
    against the index and appended to it; the index is compacted, and the last batch, most of the
    rows, is merge-joined with it. The last isn't appended, as nothing follows. Any shares give the
    same rows: an id lies in one batch, and later batches hold greater ids.
    """
    table, names = positional(docs)
    key = F.col(f"_c{names.index(id_col)}").cast("long")
    cuts = table.agg(F.percentile_approx(key, list(shares), 10_000).alias("cuts")).first()["cuts"]
    bounds = sorted(set(cuts or []))
    index = SubstringIndex(docs.sparkSession, path, width, gram, runs.bucket_count(input_bytes(table, F.col(f"_c{names.index(text_col)}")), docs.sparkSession))
    out, rest = [], table
    for bound in bounds:
        batch = rest.filter(key.isNull() | (key <= bound)).toDF(*names)
        out.append(index.dedup(batch, id_col=id_col, text_col=text_col, **options))
        index.append(batch, id_col=id_col, text_col=text_col)
        rest = rest.filter(key > bound)
    index.compact()
    result = index.dedup(rest.toDF(*names), id_col=id_col, text_col=text_col, **options)
    for part in out:
        result = result.unionByName(part)
    return result
