"""Quality classifier by compression: which of two dictionaries makes a text shorter?

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text's
sizes under both give the normalised difference (bad - good) / (bad + good); with the size a byte
under the good dictionary, which tells text that only repeats itself, it is calibrated to a
probability by logistic regression on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, spread_out

DICTIONARY_BYTES, LEVEL = 112_640, 3


@dataclasses.dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = (features(self.good, self.bad, texts) - self.centre) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(z @ np.array(self.weights[1:]) + self.weights[0], -40, 40)))


@functools.lru_cache(4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    # A dictionary without zstandard's magic number is taken as raw content.
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def features(good: bytes, bad: bytes, texts: list[bytes]) -> np.ndarray:
    """For each text: normalised difference, log of its size a byte, and a flag for hardly any text."""
    cg, cb = _compressor(good), _compressor(bad)
    sizes = np.array([(len(cg.compress(t)), len(cb.compress(t)), len(t)) for t in texts], np.float64).reshape(-1, 3)
    g, b, n = sizes.T
    return np.stack(((b - g) / (b + g), np.log((g + 1) / (n + 16)), np.log(n + 16)), 1)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method, with a slight pull to zero."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate((np.ones((len(x), 1)), (x - centre) / scale), 1)
    w = np.zeros(z.shape[1])
    pull = np.diag([1e-6] + [1e-2] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:DICTIONARY_BYTES] or b"\n" * 8


def middle(text: Column, chars: int) -> Column:
    """A text's middle, of so many characters; the whole text if it has no more."""
    start = F.greatest(F.lit(0), F.floor((F.length(text) - F.lit(chars)) / 2)).cast("int")
    return F.substring(text, start + 1, F.lit(chars))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 2000, slice_chars: int = 4000, calibration_chars: int = 20_000) -> CompressionModel:
    """Fits the model on labelled texts whose label row satisfies `learnable`.

    Bounds of the fit (scoring reads whole texts): `per_label` documents of each label, those with
    the least hash of the id, so the choice doesn't depend on the order of rows; of each, the middle
    `slice_chars` characters go into a dictionary, or the middle `calibration_chars` into the
    calibration. Texts of any length take part. Labels that are null or not 0 or 1 are left out; a
    document with several labels has the least one, and one whose id has several rows the least of
    their texts. Without texts of both labels the model gives every text the share of good labels
    (0.5 without any label).
    """
    spark = docs.sparkSession
    known = labels.filter(learnable).filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    ranks = [known.filter(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(per_label).collect() for v in (0, 1)]
    chosen = spark.createDataFrame([tuple(r) for rows in ranks for r in rows], "_id long, _label int")
    texts = documents_of(docs, id_col, text_col).filter("text IS NOT NULL").select(F.col("doc_id").alias("_id"), middle(F.col("text"), calibration_chars).alias("_text"))
    # At most 2 * per_label rows of 12 bytes are broadcast.
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    rows.sort(key=lambda r: r["_id"])
    share = float(np.mean([r["_label"] for r in rows])) if rows else 0.5
    if share in (0.0, 1.0) or len(rows) < 8:
        p = min(max(share, 0.01), 0.99)
        return CompressionModel(b"\n" * 8, b"\n" * 8, (float(np.log(p / (1 - p))), 0.0, 0.0, 0.0), (0.0,) * 3, (1.0,) * 3)
    known_texts: dict[int, list[bytes]] = {0: [], 1: []}
    calibration: list[tuple[bytes, int]] = []
    for i, r in enumerate(rows):
        if i % 3 == 2:
            calibration.append((r["_text"].encode(), r["_label"]))
        else:
            at = max(0, (len(r["_text"]) - slice_chars) // 2)
            known_texts[r["_label"]].append(r["_text"][at : at + slice_chars].encode())
    good, bad = _dictionary(known_texts[1]), _dictionary(known_texts[0])
    y = np.array([v for _, v in calibration], np.float64)
    w, centre, scale = _fit(features(good, bad, [t for t, _ in calibration]), y)
    # The sample holds as many bad as good texts, where there are enough; the score should follow the corpus.
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    w[0] += np.log(max(totals.get(1, 0), 1) / max(totals.get(0, 0), 1)) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return CompressionModel(good, bad, tuple(map(float, w)), tuple(map(float, centre)), tuple(map(float, scale)))


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """The input with a column `out`: chance (0 to 1) that the whole text is good; null is empty."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.scores([(t or "").encode() for t in texts]), dtype="float64")

    return docs.withColumn(out, scored(F.col(text_col)))


def score_documents(docs: DataFrame, model: CompressionModel, held_out: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from `threshold` on), a row for each input row.

    Empty and null texts are scored like any other. Repeated rows and null ids are kept (held_out
    is false without an id). An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            found = model.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents_of(docs, id_col, text_col, held_out=F.coalesce(held_out, F.lit(False))).select("doc_id", "held_out", "text")
    return spread_out(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
