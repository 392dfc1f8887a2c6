"""Language identification by word-first backoff.

A word that was seen in training scores by its log frequency in each language. An unseen word is
read from the left in its longest known character n-grams, falling back to shorter ones; each
scores by its log frequency among n-grams of its length. Sums over a text give the language.
"""

from __future__ import annotations

import dataclasses
import unicodedata
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, spread_out

LONGEST = 4
#: Count of an entry in a language that it was not seen in.
UNSEEN = 0.5
UNKNOWN = "und"
_EDGE = "\x00"


def words_of(token: str) -> list[str]:
    """Runs of letters (with their combining marks) in a white-space separated token, lower case."""
    if token.isalpha():
        return [token.lower()]
    runs, run = [], ""
    for c in token.lower():
        if c.isalpha() or (run and unicodedata.category(c)[0] == "M"):
            run += c
        elif run:
            runs.append(run)
            run = ""
    return [*runs, run] if run else runs


def grams_of(word: str, n: int):
    edged = _EDGE + word + _EDGE
    return (edged[i : i + n] for i in range(len(edged) - n + 1))


@dataclasses.dataclass(frozen=True)
class LanguageModel:
    """Sparse log frequencies. entries[n] are the known words (n = 0) or n-grams, in order.

    Entry i has scores[n][starts[n][i] : starts[n][i + 1]] in the languages of the same places of
    owners[n], and in all others the score of an entry that was not seen, unseen[n].
    """

    languages: list[str]
    entries: list[list[str]]
    starts: list[np.ndarray]
    owners: list[np.ndarray]
    scores: list[np.ndarray]
    unseen: list[np.ndarray]
    #: Tells models apart in a process that holds one for some time.
    fit: str = dataclasses.field(default_factory=lambda: uuid.uuid4().hex)


def model_of(counts: dict[tuple[str, int, str], int], languages: list[str]) -> LanguageModel:
    """The model of counts of (language, size, entry); size 0 is a word."""
    number = {lang: i for i, lang in enumerate(languages)}
    columns: list[list] = [[], [], [], [], []]
    for n in range(LONGEST + 1):
        mine = sorted((entry, number[lang], c) for (lang, size, entry), c in counts.items() if size == n)
        known = sorted({entry for entry, _, _ in mine})
        owner, count = np.array([o for _, o, _ in mine], np.int32), np.array([c for _, _, c in mine], np.float64)
        # As if every entry had been seen UNSEEN times more in every language.
        total = np.bincount(owner, count, len(languages)) + UNSEEN * len(known)
        spans = np.searchsorted([entry for entry, _, _ in mine], known) if mine else np.empty(0, np.int64)
        columns[0].append(known)
        columns[1].append(np.append(spans, len(mine)).astype(np.int64))
        columns[2].append(owner)
        columns[3].append(np.log((count + UNSEEN) / np.maximum(total[owner], 1)))
        columns[4].append(np.log(UNSEEN / np.maximum(total, 1)))
    return LanguageModel(languages, *columns)


class _Scorer:
    """Entries of tokens and their scores under one model, remembered; forgets all when it has grown large."""

    most, most_scores = 300_000, 4_000_000

    def __init__(self, model: LanguageModel):
        self.model = model
        self.words = {e: (0, i) for i, e in enumerate(model.entries[0])}
        self.grams = {e: (n, i) for n in range(1, LONGEST + 1) for i, e in enumerate(model.entries[n])}
        self.clear()

    def clear(self) -> None:
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.places: dict[tuple[int, int], int] = {}
        self.matrix = np.zeros((1024, len(self.model.languages) + 1))
        self.matrix[0, -1] = 1  # an unseen word, whose n-grams follow
        self.used = 1

    def place(self, n: int, at: int) -> int:
        """The matrix row of an entry: its scores in all languages, and 1 for a word."""
        m, row = self.model, self.used
        if row >= len(self.matrix):
            self.matrix = np.concatenate((self.matrix, np.zeros_like(self.matrix)))
        span, scores = slice(m.starts[n][at], m.starts[n][at + 1]), self.matrix[row]
        scores[:-1], scores[-1] = m.unseen[n], n == 0
        scores[m.owners[n][span]] = m.scores[n][span]
        self.places[n, at], self.used = row, row + 1
        return row

    def found(self, word: str) -> list[tuple[int, int]]:
        """The word, or the longest known n-grams that cover it, each beginning inside the one before."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        grams, edged, out, i = self.grams, _EDGE + word + _EDGE, [], 0
        last = len(edged)
        while i < last:
            for end in range(min(i + LONGEST, last), i, -1):
                known = grams.get(edged[i:end])
                if known is not None:
                    out.append(known)
                    break
            i = max(i + 1, end - 1)
        return out

    def learn(self, token: str) -> None:
        rows, places = [], self.places
        for w in words_of(token):
            entries = self.found(w)
            if not entries or entries[0][0]:
                rows.append(0)
            for e in entries:
                at = places.get(e)
                rows.append(self.place(*e) if at is None else at)
        self.tokens[token] = tuple(rows)

    def score(self, text: str) -> np.ndarray:
        """Summed log frequencies a language, and in the last place the number of words."""
        total, all_tokens = np.zeros(self.matrix.shape[1]), text.split()
        for start in range(0, len(all_tokens), 100_000):
            if len(self.tokens) > self.most or self.used * len(total) > self.most_scores:
                self.clear()
            some, tokens = all_tokens[start : start + 100_000], self.tokens
            for t in set(some).difference(tokens):
                self.learn(t)
            total += self.matrix[np.array(list(chain.from_iterable(map(tokens.__getitem__, some))), np.int64)].sum(0)
        return total


_SCORERS: dict[str, _Scorer] = {}


def _scorer(model: LanguageModel) -> _Scorer:
    if model.fit not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.fit] = _Scorer(model)
    return _SCORERS[model.fit]


def train(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 4000, entries_per_language: int = 20_000, least_count: int = 2) -> LanguageModel:
    """Counts words and n-grams in a bounded sample of the documents that satisfy `learnable`.

    Bounds of the fit: about `docs_per_language` documents of each language, drawn by a hash of the
    id, and of their words and of their n-grams of each length the `entries_per_language` most
    frequent that occur `least_count` times or more. All languages are learned. Rows with a null
    text, language or id are not learned from. What comes to the driver is the counts of those
    entries.
    """
    usable = documents_of(docs, id_col, text_col, lang=lang_col, learnable=learnable).filter("learnable AND lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())  # a row a language
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    shares = sizes.select("lang", (F.lit(docs_per_language) / F.greatest(F.col("n"), F.lit(docs_per_language))).alias("share"))
    sample = spread_out(usable.join(F.broadcast(shares), "lang").filter(drawn < F.col("share")).select("lang", "text"))

    def count(batches):
        for batch in batches:
            tokens: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens.setdefault(lang, Counter()).update(text.split())
            words: dict[str, Counter] = {lang: Counter() for lang in tokens}
            for lang, found in tokens.items():
                for t, c in found.items():
                    for w in words_of(t):
                        words[lang][w] += c
            rows: dict[tuple[str, int, str], int] = {}
            for lang, found in words.items():
                for w, c in found.items():
                    rows[lang, 0, w] = rows.get((lang, 0, w), 0) + c
                    for n in range(1, LONGEST + 1):
                        for g in grams_of(w, n):
                            rows[lang, n, g] = rows.get((lang, n, g), 0) + c
            if rows:
                langs, sizes_, entries = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes_, pa.int32()), pa.array(entries, pa.string()), pa.array(list(rows.values()), pa.int64())], ["lang", "size", "entry", "n"])

    counts = sample.mapInArrow(count, "lang string, size int, entry string, n long").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "entry")  # a group limit before the shuffle
    rows = counts.filter(F.col("n") >= least_count).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= entries_per_language).collect()
    return model_of({(r["lang"], r["size"], r["entry"]): r["n"] for r in rows}, languages)


def identify(docs: DataFrame, model: LanguageModel, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the best language, 0 to 1): a row an input row.

    A text that is null or has no letter is "und" with score 0, and so is every text if nothing
    was learned. Of languages that score the same, the first in order is given. Repeated rows and
    null ids are kept (held_out is false without an id). An empty table gives no rows.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit

    def run(batches):
        scorer = _scorer(shared.value)
        for batch in batches:
            preds, shares = [], []
            for text in batch.column(2).to_pylist():
                total = scorer.score(text or "")
                if not total[-1] or not scorer.model.languages:
                    preds.append(UNKNOWN)
                    shares.append(0.0)
                    continue
                best = int(np.argmax(total[:-1]))
                preds.append(scorer.model.languages[best])
                shares.append(float(1 / np.exp(total[:-1] - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents_of(docs, id_col, text_col, held_out=F.coalesce(held_out, F.lit(False))).select("doc_id", "held_out", "text")
    return spread_out(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
