"""Words of many texts at once: places and 64-bit hashes, by numpy over the bytes.

A word is a run of bytes other than U+0020 and U+0009 to U+000D, which in UTF-8 stand for
themselves alone.
"""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word that are hashed by position; longer words are hashed one by one.
_LONG = 64


def _random(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(i.to_bytes(4, "little"), seed) | 1 for i in range(n)], np.uint64)


_BYTES, _PLACES = _random(256, 1), _random(_LONG + 1, 2)
_BYTES[_SPACE] = 0  # white space after a word adds nothing to it


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of words. Equal words have equal hashes; others agree with a chance of about 2**-64."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + block)))
        first = starts[at:to]
        until = int(starts[to]) if to < len(starts) else len(data)
        reach = np.diff(np.append(first, until))
        place = np.arange(int(first[0]), until) - np.repeat(first, reach)
        values = _BYTES[data[int(first[0]) : until]] * _PLACES[np.minimum(place, _LONG)]
        out[at:to] = np.add.reduceat(values, first - first[0])
        at = to
    length = (ends - starts).astype(np.uint64)
    out = mixed(out + length * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(length > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


class Texts:
    """Texts (bytes) with the places and hashes of their words, in one buffer."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(np.append(0, sizes[:-1] + 1)) if len(texts) else np.empty(0, np.int64)
        self.end = self.begin + sizes
        self.starts, self.ends = places(self.data)
        #: For each text the number of its first word, and of the one after its last.
        self.first, self.last = np.searchsorted(self.starts, self.begin), np.searchsorted(self.starts, self.end)
        self.words = hashes(self.data, self.starts, self.ends)

    def row_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin), dtype=np.int32), self.last - self.first)

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each word begins there (one more for the end)."""
        size = self.ends - self.starts
        begin = np.cumsum(np.append(0, size + 1))
        out = np.full(int(begin[-1]), 0x20, np.uint8)
        if len(size):
            inside = ~_SPACE[self.data]
            to = np.ones(len(out), bool)
            to[begin[1:] - 1] = False
            out[to] = self.data[inside]
        return out.tobytes(), begin


def chunks(texts: list[bytes], most_bytes: int = 4 << 20):
    """Slices of texts with a bounded number of bytes; one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most_bytes:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]
