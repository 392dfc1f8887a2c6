"""BPE encoding by speculation and verification, and decoding.

Words that were not seen lately are encoded together: an automaton proposes the longest known
token from the left, again and again; vectorised checks test every two neighbouring proposals;
only words with a pair that the merges would not have left apart are merged exactly.

Why pairs suffice: a word's merges leave tokens A and B side by side if and only if no merge
crosses the border between them. What touches the border are the right ends of A's parts and the
left ends of B's parts. Undoing the younger of the two merges step by step visits every pair of
parts that ever met at the border; the tokens are compatible if none of those pairs has a merge
that would have come first.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import documents_of, public_tokenizer, spread_out

_NEVER = np.int32(2**31 - 1)
#: Marks the end of a word in the strings that the automaton reads; they hold bytes as U+0000 to U+00FF.
_END, _GAP = "\u0100", "\u0101"
#: Code points with the property White_Space (fixed values of Unicode).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(wanted) -> str:
    """The inside of a character class with all code points that `wanted` accepts."""
    points = [i for i in range(sys.maxunicode + 1) if wanted(chr(i))]
    parts = []
    for _, run in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]):
        run = [p for _, p in run]
        parts.append(re.escape(chr(run[0])) + (f"-{re.escape(chr(run[-1]))}" if len(run) > 1 else ""))
    return "".join(parts)


@functools.cache
def _classes(own: bool) -> tuple[str, str]:
    """Letters and digits: by the tables of the tokenizers library's patterns, or by this Python's."""
    if own:
        everything = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
        found = []
        for kind in (r"[\p{L}]+", r"[\p{N}]+"):
            kept = pre_tokenizers.Split(Regex(kind), behavior="removed", invert=True).pre_tokenize_str(everything)
            found.append(_ranges({c for run, _ in kept for c in run}.__contains__))
        return found[0], found[1]
    return _ranges(lambda c: unicodedata.category(c)[0] == "L"), _ranges(lambda c: unicodedata.category(c)[0] == "N")


@functools.cache
def _byte_symbols() -> dict[str, str]:
    """Byte-level vocabularies write a byte that isn't printable as a code point from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class Model:
    """Vocabulary and merges of a tokenizer file; encodes words given as strings of bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        size = max(self.tokens) + 1
        self.rank = np.full(size, -1, np.int32)
        self.left, self.right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ia, ib, ic = vocab[a], vocab[b], vocab[a + b]
            self.merges[ia, ib] = (r, ic)
            self.rank[ic], self.left[ic], self.right[ic] = r, ia, ib
        keys = np.array([(a << 32) | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int32)[order]
        self.base = {self._plain(t): i for t, i in vocab.items() if self.rank[i] < 0}
        self._sizes = np.zeros(size)
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            plain = self._plain(t)
            if self.rank[i] < 0 or self.merge_exactly(plain) == [i]:  # some tokens can't come of their own text
                self.automaton.add_word(plain, i)
            self._sizes[i] = len(plain)
        self.automaton.make_automaton()

    def _plain(self, token: str) -> str:
        end = self.suffix and token.endswith(self.suffix)
        body = token[: -len(self.suffix)] if end else token
        return "".join(map(_byte_symbols().__getitem__, body)) + (_END if end else "")

    def merge_exactly(self, plain: str) -> list[int]:
        """Merges a word step by step, the lowest rank first and from the left among equals, in n log n steps."""
        symbols = list(plain)
        if symbols and symbols[-1] == _END:
            symbols[-2:] = [symbols[-2] + _END]
        ids = [self.base[s] for s in symbols]
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # Rank and place of each pair that can be merged, in one number; a pair that is gone is told by its rank.
        heap = [(found[0] << 32) | i for i, found in enumerate(map(merges.get, zip(ids, ids[1:]))) if found is not None]
        heapq.heapify(heap)
        while heap:
            best = heapq.heappop(heap)
            i = best & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0:
                continue
            found = merges.get((ids[i], ids[j]))
            if found is None or found[0] != best >> 32:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merges.get((ids[i], ids[k]))
                if found is not None:
                    heapq.heappush(heap, (found[0] << 32) | i)
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], ids[i]))
                if found is not None:
                    heapq.heappush(heap, (found[0] << 32) | h)
        return [x for x in ids if x >= 0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave the neighbours a[i] and b[i] apart."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, at = np.ones(len(a), bool), np.arange(len(a))
        next_a = next_b = np.full(len(a), _NEVER)
        while len(at):
            key = (a << 32) | b
            spot = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            rank = np.where(self._keys[spot] == key, self._ranks[spot], _NEVER)
            crossed = (rank < next_a) & (rank <= next_b) & (rank != _NEVER)
            good[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            a, b, ra, rb, at = a[go], b[go], ra[go], rb[go], at[go]
            undo = ra > rb
            next_a, next_b = np.where(undo, ra, next_a[go]), np.where(undo, next_b[go], rb)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word; a word is encoded without regard to its neighbours."""
        end = _END if self.suffix else ""
        plain = [w.encode().decode("latin-1") + end for w in words]
        starts = np.cumsum([0] + [len(p) + 1 for p in plain])
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter_long(_GAP.join(plain))), np.int64)
        if not len(found):
            return [self.merge_exactly(p) for p in plain]
        last, ids = found[::2], found[1::2]
        owner = np.searchsorted(starts, last, "right") - 1
        wrong = np.bincount(owner, self._sizes[ids], len(plain)) != np.diff(starts) - 1
        inside = owner[1:] == owner[:-1]
        pairs, back = np.unique((ids[:-1][inside] << 32) | ids[1:][inside], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        wrong[owner[:-1][inside][bad]] = True
        edges = np.searchsorted(owner, np.arange(len(plain) + 1)).tolist()
        flat = ids.tolist()
        out = [flat[a:b] for a, b in zip(edges, edges[1:])]
        again = np.flatnonzero(wrong).tolist()
        for i in again:
            out[i] = self.merge_exactly(plain[i])
        return out


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Words that a process remembers, about 250 bytes each.
MOST_CACHED = 900_000


class Tokenizer:
    """Splits text into words as the file says, and encodes them with a cache.

    Two kinds of files are known: byte-level BPE with its usual pattern, and BPE with an
    end-of-word suffix over text in NFC and lower case with white space dropped.
    """

    def __init__(self, path: str):
        self.model = Model(path)
        self.pattern = self._pattern(*_classes(bool(self.model.suffix)))
        # Of these characters alone: the same pattern, but with classes that are looked up faster.
        self.latin = self._pattern(*("".join(re.escape(chr(i)) for i in range(256) if re.fullmatch(f"[{c}]", chr(i))) for c in _classes(bool(self.model.suffix))))
        self.marks = re.compile("(" + "|".join(map(re.escape, self.model.special)) + ")")
        self.cache: dict = {}
        if self.model.suffix:
            self.young = re.compile("[" + _ranges(lambda c: unicodedata.ucd_3_2_0.category(c) == "Cn") + "]")
            self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])

    def _pattern(self, letters: str, digits: str) -> re.Pattern:
        other, short = f"[^{WHITE_SPACE}{letters}{digits}]", "'s|'t|'re|'ve|'m|'ll|'d"
        if self.model.suffix:
            return re.compile(f"{short}|[{letters}]+|[{digits}]|{other}+")
        return re.compile(f"{short}| ?[{letters}]+| ?[{digits}]+| ?{other}+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")

    def words(self, text: str) -> list[str]:
        """The words of a text. Special tokens stand as they are, after a mark that no text can hold."""
        if "<|" in text:
            parts = self.marks.split(text)
            if len(parts) > 1:
                return [w for i, p in enumerate(parts) for w in (["\ud800" + p] if i % 2 else self._split(p))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        latin = text.isascii() or _is_latin(text)
        if self.model.suffix:
            if not latin and self.young.search(text):
                text = self.normalizer.normalize_str(text)  # characters on which versions of Unicode differ
            else:
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no special form of sigma at a word's end
        return (self.latin if latin else self.pattern).findall(text)

    def codes(self, texts: list[str], make) -> list[list]:
        """For each text make(ids) of its words; make must always be the same function for a tokenizer."""
        split = [self.words(t) for t in texts]
        missing = set(itertools.chain.from_iterable(split)).difference(self.cache)
        if len(self.cache) + len(missing) > MOST_CACHED:
            self.cache.clear()
            missing = set(itertools.chain.from_iterable(split))
        cache, plain = self.cache, [w for w in missing if w[0] != "\ud800"]
        cache.update(zip(plain, map(make, self.model.encode_words(plain))))
        cache.update((w, make([self.model.special[w[1:]]])) for w in missing if w[0] == "\ud800")
        return [list(map(cache.__getitem__, words)) for words in split]


@functools.cache
def load(path: str, use: str = "") -> Tokenizer:
    """A tokenizer of this process; `use` keeps caches with different codes apart."""
    return Tokenizer(path)


def in_chunks(texts: list[str | None], most_chars: int = 1_000_000):
    """Slices of texts with a bounded number of characters (one text at least); null is empty."""
    chunk, size = [], 0
    for t in texts:
        chunk.append(t or "")
        size += len(chunk[-1])
        if size >= most_chars:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", emit: str = "digest") -> DataFrame:
    """Encodes every text and decodes the ids again, a row for each input row.

    emit="digest": doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256.
    emit="ids": doc_id, ids (array<int>), decoded. As the file has no decoder, decoding joins the
    tokens' strings by a space. A null text is empty; null ids and repeated rows are kept.
    """
    path = path or public_tokenizer("word_bpe_49k.json")
    digest = emit == "digest"

    def run(batches):
        tokenizer = load(path, "encode")
        names = tokenizer.model.tokens

        def make(ids: list[int]) -> tuple[str, str, int]:
            return " ".join(map(str, ids)), " ".join(map(names.__getitem__, ids)), len(ids)

        for batch in batches:
            counts, ids, decoded = [], [], []
            for chunk in in_chunks(batch.column(1).to_pylist()):
                for codes in tokenizer.codes(chunk, make):
                    parts = list(zip(*codes)) or [(), (), ()]
                    counts.append(sum(parts[2]))
                    ids.append(" ".join(parts[0]))
                    decoded.append(" ".join(parts[1]))
            if digest:
                columns = [pa.array(counts, pa.int64())] + [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in c], pa.string()) for c in (ids, decoded)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                columns = [pa.array([list(map(int, x.split())) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"
    return spread_out(documents_of(docs, id_col, text_col)).mapInArrow(run, schema)
