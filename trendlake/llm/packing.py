"""Packing: first-fit decreasing in randomised groups of documents.

A document's group is a hash of its id, so a group is a random sample of the corpus whatever the
order of the input, and groups are packed independently of each other. Documents longer than a
sequence are cut into full pieces; what is left is packed by first-fit decreasing, where a
tournament tree over the bins' free room finds the first bin that fits in a logarithm of steps.
As documents may be cut, the emptiest bins are then dealt out into the room left in the others.
"""

from __future__ import annotations

import functools
import struct
import zlib

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import batch_of, documents_of, each_key, input_bytes, partitions_for, public_tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_GROUP_BITS = 31


#: The words of byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The library takes time by the square of a word's length, and very long ones exhaust it: a text
#: with a run of twice so many characters of one kind goes to our own encoder, which takes n log n.
_BLOCK = 500


def has_long_run(text: str) -> bool:
    """Whether a whole block is white space or has none; any run of two blocks' length holds one."""
    for at in range(0, len(text) - _BLOCK + 1, _BLOCK):
        first = text[at : at + _BLOCK].split(None, 1)
        if not first or len(first[0]) == _BLOCK:
            return True
    return False


class ByteCodec:
    """Ids of a text as little-endian unsigned 32-bit numbers, for a byte-level BPE file."""

    def __init__(self, path: str):
        self.own = bpe.Tokenizer(path)
        model = self.own.model
        plain = {model._plain(t).encode("latin-1"): i for i, t in model.tokens.items() if i not in model.special.values()}
        if any(c != 256 + r for r, c in model.merges.values()):
            raise ValueError(f"{path}: ids must be in the order of merges")
        self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})

    def _plain(self, text: str) -> bytes:
        if has_long_run(text):
            return b"".join(self.own.codes([text], _packed)[0])
        return self.library.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return self._plain(text)
        special = self.own.model.special
        return b"".join(_packed([special[p]]) if i % 2 else self._plain(p) for i, p in enumerate(self.own.marks.split(text)))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def codec(path: str) -> ByteCodec:
    return ByteCodec(path)


class Tournament:
    """Free room of bins, all of one size at first; each inner node holds the most room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes `size` from the first bin that has it, and gives its number; there must be one."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return found


def pack(lengths: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length); every token of every item lies in exactly one of them."""
    bins, rest = [], []
    for i, n in enumerate(lengths):
        full = n - n % room
        bins.extend([(i, s, room)] for s in range(0, full, room))
        if n % room:
            rest.append((i, full, n % room))
    rest.sort(key=lambda x: (-x[2], x[0]))
    open_bins: list[list[tuple[int, int, int]]] = []
    tree = Tournament(len(rest), room)
    for item in rest:
        at = tree.place(item[2])
        if at == len(open_bins):
            open_bins.append([])
        open_bins[at].append(item)
    filled = [sum(x[2] for x in b) for b in open_bins]
    least = -(-sum(filled) // room)
    order = sorted(range(len(open_bins)), key=lambda b: (-filled[b], b))
    kept, dealt = order[:least], [x for b in order[least:] for x in open_bins[b]]
    for b in kept:
        free = room - filled[b]
        while free and dealt:
            i, s, n = dealt.pop()
            take = min(n, free)
            open_bins[b].append((i, s, take))
            free -= take
            if take < n:
                dealt.append((i, s + take, n - take))
    return bins + [open_bins[b] for b in kept]


def pack_documents(docs: DataFrame, path: str | None = None, room: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 6 << 20) -> DataFrame:
    """Tokenizes every text, adds `end_id`, and packs all of it into sequences of `room` tokens.

    One row a piece: doc_id, start (tokens of its document before it), length, ids_crc32 (of its
    ids as little-endian unsigned 32-bit numbers), doc_tokens (with the end id), sequence_id,
    offset (in the sequence, without gaps). A group of documents leaves less than one sequence of
    padding. A null or empty text is its end id alone. Rows with a null id, and repeated rows, are
    packed each for itself. An empty table gives no rows.
    """
    path = path or public_tokenizer("byte_bpe_50k.json")
    spark, rows = docs.sparkSession, documents_of(docs, id_col, text_col)
    size = input_bytes(rows, F.col("text"))
    n_groups = max(1, -(-size // group_bytes))
    n_parts = min(n_groups, partitions_for(spark, size, 64 << 20))
    each = -(-n_groups // n_parts)
    n_groups = each * n_parts
    grouped = rows.select(batch_of(F.col("doc_id"), F.col("text"), n_groups).alias("group"), "doc_id", "text")
    # Groups go to partitions by their numbers, as many to each.
    dealt = grouped.repartitionById(n_parts, (F.col("group") / F.lit(each)).cast("int")).sortWithinPartitions("group")

    def packed(part: pa.Table) -> pa.Table:
        encode = codec(path).encode
        tail, group = _packed([end_id]), part.column("group")[0].as_py()
        ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
        ids = [ids[i] for i in order]
        codes = [encode(texts[i] or "") + tail for i in order]
        rows = []
        for number, pieces in enumerate(pack([len(c) // 4 for c in codes], room)):
            offset, sequence = 0, (group << _GROUP_BITS) + number
            for i, start, length in pieces:
                rows.append((ids[i], start, length, zlib.crc32(codes[i][4 * start : 4 * (start + length)]), len(codes[i]) // 4, sequence, offset))
                offset += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))})

    def run(batches):
        for part in each_key(batches):
            yield from packed(part).to_batches()

    return dealt.mapInArrow(run, SCHEMA)
