"""SimHash near-dedup by the generalised pigeonhole principle.

If two fingerprints differ in at most T bits and the bits are dealt to parts with thresholds t_i,
sum(t_i + 1) = T + 1, then some part differs in at most t_i bits. Bits that go together in the
corpus are put into one part, and thresholds (-1: part not probed) come from dynamic programming
over the estimated number of candidates. A part with threshold t is probed under its value and the
values up to ceil(t / 2) flips away, so equal keys hold all its pairs.

Texts alike by a `similarity` differ in a share of the bits, not in a fixed number. For them the
fingerprint has 256 bits, and the same programme allocates thresholds so that some part keeps
within its threshold with all but a stated chance; a guarantee over the worst spread of so many
differing bits would make nearly all pairs candidates. Candidates only make groups; within a
group the sets of shingles are compared exactly.

Probe rows are sorted by key and streamed: a task holds a slice of them, or one key. Only a
spanning forest of the links leaves a task. A key with more than `hot` members is not brought
together at all: at up to 4 bits its members are linked through every value up to T / 2 flips
away, which needs a fixed number of rows a member and no comparison, and finds exactly the same
components; otherwise they are compared block by block.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, documents_of, join_spread, partitions_for, positional, spread_out, whole_keys
from .components import connected_components
from .words import Texts, chunks, mixed

WORD_BITS = 64
#: Words of a fingerprint where a similarity is asked for.
WIDE = 4
_SEED = 42
#: Cost of one probe row against one comparison, both measured in nanoseconds of CPU.
ROW_COST, COMPARE_COST = 2000.0, 15.0
#: Keys that a plan has at least, so that comparisons are dealt over many tasks: parts of few bits
#: need few rows, but their few keys grow with the corpus.
LEAST_KEYS = 8192
#: Chance that a pair right at the similarity is no candidate, and standard deviations of the
#: number of differing bits up to which a candidate is taken.
MISS, SPREAD = 0.002, 4.0
#: Probe rows a partition.
PARTITION_ROWS = 4_000_000
#: Shingles that are compared exactly in one task, and as many again of another block.
BLOCK_SHINGLES = 100_000

Plan = list[tuple[list[int], int]]


def _bits_over_half(words: np.ndarray, ties: np.ndarray | None = None) -> np.ndarray:
    """Bits set in over half the rows (n x words); a tie is a zero, or the bit of `ties`."""
    counts, step = np.zeros(words.shape[1] * WORD_BITS, np.int64), 255 * 64
    for i in range(0, len(words), step):
        bits = np.unpackbits(np.ascontiguousarray(words[i : i + step], "<u8").view(np.uint8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[whole:].sum(0, dtype=np.uint8)  # less than 255 rows, so that bytes hold the sums
        if whole:
            counts += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    over = 2 * counts > len(words)
    if ties is not None:
        over |= (2 * counts == len(words)) & np.unpackbits(ties.astype("<u8").view(np.uint8), bitorder="little").astype(bool)
    return np.packbits(over, bitorder="little").view("<u8").astype(np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, split at U+0020 and U+0009 to U+000D."""
    return (text or b"").lower().split()


def shingle_hashes(text: bytes | None, shingle: int = 4) -> np.ndarray:
    """XXH64 of a text's word shingles in their order, repeats included.

    None without words. A text of fewer words than a shingle is one shingle.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), _SEED)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    spans = zip(starts, (ends[shingle - 1 :] - 1).tolist())
    return np.fromiter((digest(joined[s:e], _SEED) for s, e in spans), np.uint64, len(starts))


def shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its distinct shingles, made of the hashes of their words."""
    out: list[np.ndarray] = []
    for some in chunks([(t or b"").lower() for t in texts]):
        found = Texts(some)
        n = max(0, len(found.words) - shingle + 1)
        runs = np.zeros(n, np.uint64)
        for i in range(shingle):
            runs = mixed(runs + found.words[i : i + n])
        for first, last in zip(found.first.tolist(), found.last.tolist()):
            if last - first >= shingle or last == first:
                out.append(np.unique(runs[first : max(first, last - shingle + 1)]))
            else:  # the whole text, if it has fewer words
                code = np.zeros(1, np.uint64)
                for i in range(first, last):
                    code = mixed(code + found.words[i])
                out.append(code)
    return out


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    return int(_bits_over_half(hashes[:, None])[0]) if len(hashes) else 0


def wide_fingerprint(distinct: np.ndarray) -> np.ndarray:
    """WIDE words of SimHash of a set of shingles; ties go to the least of them, so short texts are told apart."""
    words = np.empty((len(distinct), WIDE), np.uint64)
    for i in range(WIDE):
        words[:, i] = distinct = mixed(distinct + np.uint64(i + 1))
    return _bits_over_half(words, words[0]) if len(words) else np.zeros(WIDE, np.uint64)


def _fields(n: int) -> list[str]:
    return [f"f{i}" for i in range(n)]


def _signed(words: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(words.shape[1])]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, similar: bool = False) -> DataFrame:
    """(doc_id, text_id, node, size, f0, ...): the fingerprint of every row's whole text, as signed longs.

    node: the fingerprint itself; if `similar`, a hash of the set of shingles, `size` of them.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            if similar:
                sets = shingle_sets(texts, shingle)
                words = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, WIDE)
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), _SEED) for s in sets], np.uint64)
                sizes = np.array([len(s) for s in sets], np.int64)
            else:
                nodes = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
                words, sizes = nodes[:, None], np.zeros(len(nodes), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes.view(np.int64)), pa.array(sizes), *_signed(words)], ["doc_id", "text_id", "node", "size", *_fields(words.shape[1])])

    rows = spread_out(documents_of(docs, id_col, text_col)).select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text_id long, node long, size long, " + ", ".join(f"{f} long" for f in _fields(WIDE if similar else 1)))


def _matrix(batch: pa.RecordBatch | pa.Table, fields: list[str]) -> np.ndarray:
    """Fingerprints as rows of unsigned words."""
    columns = [batch.column(f).to_numpy() if isinstance(batch, pa.Table) else batch.column(f).to_numpy(zero_copy_only=False) for f in fields]
    return np.stack(columns, 1).view(np.uint64) if len(columns) > 1 else np.ascontiguousarray(columns[0]).view(np.uint64)[:, None]


def _unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8), axis=1, bitorder="little")


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for all pairs of bits how many have both; over all of them.

    Each task adds up its own counts; what is brought here is a row of sums a bit.
    """
    fields = [c for c in classes.columns if c.startswith("f")]
    bits = WORD_BITS * len(fields)

    def run(batches):
        total, n = np.zeros((bits, bits), np.float64), 0
        for batch in batches:
            found = _unpacked(_matrix(batch, fields)).astype(np.float32)
            total += found.T @ found
            n += len(found)
        if n:
            rows = {"bit": list(range(bits)), "n": [n] * bits} | {f"with_{j}": total[:, j].astype(np.int64).tolist() for j in range(bits)}
            yield pa.RecordBatch.from_pydict(rows)

    schema = "bit long, n long, " + ", ".join(f"with_{j} long" for j in range(bits))
    summed = classes.select(*fields).mapInArrow(run, schema).groupBy("bit").agg(*[F.sum(c).alias(c) for c in ("n", *(f"with_{j}" for j in range(bits)))])
    rows = {r["bit"]: r for r in summed.collect()}
    if not rows:
        return 0, np.zeros((bits, bits))
    return rows[0]["n"], np.array([[rows[i][f"with_{j}"] for j in range(bits)] for i in range(bits)], np.float64)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deals the bits to m parts of nearly equal size; each part gathers bits that go together."""
    bits = len(both)
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    left, parts = np.ones(bits, bool), []
    for i in range(m):
        size = bits * (i + 1) // m - bits * i // m
        near = np.where(left, tie[:, left].sum(1), -1.0)
        part = [int(np.argmax(near))]
        left[part[0]] = False
        near = tie[:, part[0]].copy()
        while len(part) < size:
            part.append(int(np.argmax(np.where(left, near, -1.0))))
            left[part[-1]] = False
            near += tie[:, part[-1]]
        parts.append(sorted(part))
    return parts


def probes(width: int, t: int) -> int:
    """Rows that a fingerprint needs for a part of so many bits with threshold t."""
    return sum(math.comb(width, f) for f in range((t + 1) // 2 + 1))


def expected_candidates(n: int, both: np.ndarray, part: list[int], t: int) -> float:
    """Pairs under the same key of a part: of all pairs of probe rows those whose values agree, from the share of ones in each bit."""
    mean = np.diag(both)[part] / max(n, 1)
    return n * n / 2 * probes(len(part), t) ** 2 * float(np.prod(1 - 2 * mean * (1 - mean)))


def _cost(n: int, both: np.ndarray, part: list[int], t: int) -> float:
    return ROW_COST * n * probes(len(part), t) + COMPARE_COST * expected_candidates(n, both, part, t)


def _best(n: int, both: np.ndarray, part_counts, spend, limit: int, choices: list[int], exactly: bool) -> Plan:
    """The cheapest parts and thresholds, over all numbers of parts, that together spend `limit`, or more.

    spend(width, t) says how much a part with threshold t adds; a part can be left out.
    """
    best: tuple[float, Plan] | None = None
    for m in part_counts:
        state: dict[int, tuple[float, Plan]] = {0: (0.0, [])}
        for part in correlated_parts(n, both, m):
            new = dict(state)
            ways = [(t, spend(len(part), t), _cost(n, both, part, t)) for t in choices if t <= len(part)]
            for spent, (cost, chosen) in state.items():
                for t, adds, costs in ways:
                    if exactly and spent + adds > limit:
                        continue
                    key, more = min(limit, spent + adds), cost + costs
                    if key not in new or more < new[key][0]:
                        new[key] = (more, [*chosen, (part, t)])
            state = new
        if limit in state:
            cost, chosen = state[limit]
            few = sum(1 << len(p) for p, _ in chosen) < LEAST_KEYS
            if best is None or (not few and cost < best[0]):
                best = cost, chosen
    if best is None:
        raise ValueError("no allocation reaches the limit")
    return best[1]


def allocate(n: int, both: np.ndarray, threshold: int) -> Plan:
    """Parts with thresholds for fingerprints that differ in at most `threshold` bits: none is missed.

    One part of all bits comes first and always will do; others must have LEAST_KEYS keys.
    """
    return _best(n, both, range(1, threshold + 2), lambda width, t: t + 1, threshold + 1, list(range(threshold + 1)), True)


def _within(width: int, t: int, differ: float) -> float:
    """Chance that of `width` bits at most t differ."""
    return sum(math.comb(width, k) * differ**k * (1 - differ) ** (width - k) for k in range(t + 1))


def allocate_likely(n: int, both: np.ndarray, differ: float, miss: float = MISS) -> Plan:
    """Parts with thresholds for fingerprints whose bits differ with chance `differ`: all but a chance of `miss` are found.

    The chance that a part fails is taken as independent of the other parts; its logarithm is what
    the programme adds up, in steps of a hundredth of the goal.
    """
    bits, step = len(both), -math.log(miss) / 100
    spend = lambda width, t: int(-math.log(max(1e-300, 1 - _within(width, t, differ))) / step)
    return _best(n, both, [m for m in range(4, 33) if bits // m >= 8], spend, 100, [0, 2, 4, 6], False)


def _flips(bits: list[int], most: int) -> np.ndarray:
    """All masks with at most so many of the bits set."""
    masks = [sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(bits, k)]
    return np.array(masks, np.uint64)


def _values(words: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part, of each fingerprint, put together."""
    found, out = _unpacked(words), np.zeros(len(words), np.uint64)
    for place, bit in enumerate(part):
        out |= found[:, bit].astype(np.uint64) << np.uint64(place)
    return out


def _key(values: np.ndarray, number: int) -> np.ndarray:
    """One key for part and value. Two that agree by chance only make comparisons that fail."""
    return mixed(values ^ mixed(np.array([number + 1], np.uint64))).view(np.int64)


def probe_keys(classes: DataFrame, plan: Plan, near: bool = True) -> DataFrame:
    """(key, node, f0, ...): the keys under which each fingerprint is found; with `near` false only those of its own values."""
    fields = [c for c in classes.columns if c.startswith("f")]

    def run(batches):
        for batch in batches:
            all_words, nodes = _matrix(batch, fields), batch.column("node").to_numpy(zero_copy_only=False)
            for number, (part, t) in enumerate(plan):
                flips = _flips(list(range(len(part))), (t + 1) // 2 if near else 0)
                step = max(1, 200_000 // len(flips))
                for i in range(0, len(all_words), step):
                    words = all_words[i : i + step]
                    values = (_values(words, part)[:, None] ^ flips[None, :]).ravel()
                    columns = [_key(values, number), np.repeat(nodes[i : i + step], len(flips))]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *_signed(np.repeat(words, len(flips), axis=0))], ["key", "node", *fields])

    return classes.select("node", *fields).mapInArrow(run, "key long, node long, " + ", ".join(f"{f} long" for f in fields))


def _crowded(classes: DataFrame, plan: Plan, keys: DataFrame, hot: int) -> DataFrame | None:
    """(key, members): keys with over `hot` members, or None.

    First values are counted as they are, a row a fingerprint and part: a key with over `hot`
    members has a value with over hot / probes of them at most as far away as its flips.
    """
    most = max(probes(len(part), t) for part, t in plan)
    fields = [c for c in classes.columns if c.startswith("f")]

    def run(batches):
        for batch in batches:
            words = _matrix(batch, fields)
            for number, (part, _) in enumerate(plan):
                values, counts = np.unique(_values(words, part), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), number, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)], ["part", "value", "n"])

    counts = classes.select(*fields).mapInArrow(run, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n"))
    full = checkpoint(counts.filter(F.col("n") > hot // most).select("part", "value"))
    if full.isEmpty():
        return None

    def around(batches):
        for batch in batches:
            numbers, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for number, value in zip(numbers.tolist(), values):
                part, t = plan[number]
                yield pa.RecordBatch.from_arrays([pa.array(_key(value ^ _flips(list(range(len(part))), (t + 1) // 2), number))], ["key"])

    suspects = full.mapInArrow(around, "key long").distinct()
    found = checkpoint(keys.select("key").join(suspects, "key", "left_semi").groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > hot))
    return None if found.isEmpty() else found


def _near(words: np.ndarray, word: np.ndarray, most: int) -> np.ndarray:
    """Which rows differ from a row, or from the rows of another matrix, in at most so many bits."""
    apart = np.bitwise_count(words[..., 0] ^ word[..., 0]).astype(np.int16)
    for i in range(1, words.shape[-1]):
        apart += np.bitwise_count(words[..., i] ^ word[..., i])
    return apart <= most


def _links(keys: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links within equal keys (sorted): all of them if few, else a spanning forest."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((edge, [len(keys)])))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.flatnonzero(np.repeat(size <= 32, size))
    for step in range(1, 32):
        left, right = small[:-step], small[step:]
        same = keys[left] == keys[right]
        if not same.any():
            break
        left, right = left[same], right[same]
        near = _near(words[left], words[right], most)
        a.append(left[near])
        b.append(right[near])
    for start, n in zip(edge[size > 32].tolist(), size[size > 32].tolist()):
        rest, own = np.arange(n), words[start : start + n]
        while len(rest):
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                at = frontier.pop()
                near = _near(own[rest], own[at], most)
                if near.any():
                    found = rest[near]
                    a.append(np.full(len(found), at + start))
                    b.append(found + start)
                    frontier.extend(found.tolist())
                    rest = rest[~near]
    return np.concatenate(a), np.concatenate(b)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as a[i] - b[i], one for each node but the least of each component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


class _Forest:
    """Links of a task as a forest; hands it out when it has grown to `most` links."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.a, self.b = most, np.empty(0, np.int64), np.empty(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def _pressed(self) -> None:
        a, b = zip((self.a, self.b), *self.new)
        self.a, self.b = _forest(np.concatenate(a), np.concatenate(b))
        self.new, self.waiting = [], 0

    def add(self, a: np.ndarray, b: np.ndarray):
        if len(a):
            self.new.append((a, b))
            self.waiting += len(a)
        if self.waiting > self.most:
            self._pressed()
            if len(self.a) > self.most:
                yield from self.rest()

    def rest(self):
        self._pressed()
        yield pa.RecordBatch.from_arrays([pa.array(self.a), pa.array(self.b)], ["a", "b"])
        self.a, self.b = np.empty(0, np.int64), np.empty(0, np.int64)


def link_classes(classes: DataFrame, threshold: int | None = 4, similarity: float | None = None, hot: int = 20_000) -> DataFrame:
    """(a, b): links between nodes that connect all pairs within `threshold` bits.

    With `similarity` instead, all pairs within the bits that so similar texts differ in, but for
    a chance of MISS.
    """
    spark = classes.sparkSession
    fields = [c for c in classes.columns if c.startswith("f")]
    n, both = bit_statistics(classes)
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    if similarity is not None:
        plan, threshold = allocate_likely(n, both, differing(similarity)), bits_for(similarity, len(both), SPREAD)
    else:
        plan = allocate(n, both, threshold)
    keys = probe_keys(classes, plan)
    crowded = _crowded(classes, plan, keys, hot)
    n_parts = partitions_for(spark, n * sum(probes(len(part), t) for part, t in plan), PARTITION_ROWS)

    def compare(batches):
        """A stream of rows sorted by key."""
        out = _Forest()
        for table in whole_keys(batches):
            key, node = (table.column(c).to_numpy() for c in ("key", "node"))
            a, b = _links(key, _matrix(table, fields), threshold)
            yield from out.add(node[a], node[b])
        yield from out.rest()

    def links(rows: DataFrame) -> DataFrame:
        return rows.select("key", "node", *fields).repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")

    if crowded is None:
        return links(keys)
    edges = links(keys.join(crowded, "key", "left_anti"))
    warm = keys.join(crowded, "key")
    if similarity is not None or threshold > 4 or threshold % 2:
        blocks = F.ceil(F.col("members") / F.lit(hot)).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        dealt = warm.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        return edges.unionAll(links(dealt.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))))

    def stars(batches):
        """Each member with all values up to threshold / 2 flips away: who shares one is linked."""
        near = _flips(list(range(WORD_BITS)), threshold // 2)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 200):
                some = fps[i : i + 200]
                values = (some[:, None] ^ near[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(near)).view(np.int64)), pa.array(values.view(np.int64))], ["fp", "via"])

    # A value has at most as many members as values near it, so none is hot.
    reached = warm.select("f0").distinct().mapInArrow(stars, "fp long, via long")
    first = reached.groupBy("via").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).filter("a <> last").select("via", "a")
    return edges.unionAll(reached.join(first, "via").select("a", F.col("fp").alias("b")).filter("a <> b"))


def _alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that connect all pairs of sets whose Jaccard similarity is so much or more."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    size = np.array([len(x) for x in sets], np.int64)
    starts = np.concatenate(([0], np.cumsum(size)))
    values, items = np.unique(np.concatenate(sets), return_inverse=True)
    owner, marked = np.repeat(np.arange(len(sets)), size), np.zeros(len(values), bool)
    own, flat = owner, items  # of the sets that are left, and perhaps of more
    rest = np.arange(len(sets))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            mine = items[starts[at] : starts[at + 1]]
            marked[mine] = True
            common = np.bincount(own[marked[flat]], minlength=len(sets))[rest]
            marked[mine] = False
            near = common >= similarity * (size[rest] + size[at] - common) - 1e-9
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), at))
                b.append(found)
                frontier.extend(found.tolist())
                rest = rest[~near]
                if 2 * size[rest].sum() <= len(flat):
                    left = np.zeros(len(sets), bool)
                    left[rest] = True
                    keep = left[own]
                    own, flat = own[keep], flat[keep]
    return np.concatenate(a), np.concatenate(b)


def verified_links(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links between nodes that connect all pairs of one group whose shingles are alike by `similarity`.

    sets: (group, node, size, doc_id, text_id), a row a set, with a row of docs that has it. A
    group of more than BLOCK_SHINGLES is compared block by block, each pair of blocks for itself.
    """
    total = sets.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).filter("n > 1")
    total = total.select("group", "n", F.greatest(F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES)).cast("int"), F.lit(1)).alias("blocks"))
    wanted = join_spread(sets, total, "group", "n", "node").select("group", "node", "doc_id", "text_id", "blocks")
    rows = documents_of(docs, id_col, text_col).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_id"), "text")
    # By the hash of the text first: null ids, or rows of one id, are no hot key then.
    texts = rows.join(wanted, (F.col("_text_id") == F.col("text_id")) & F.col("_id").eqNullSafe(F.col("doc_id")))

    def hashed(batches):
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch.column(3).cast(pa.binary()).to_pylist(), shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["group", "node", "blocks", "shingles"])

    members = texts.select("group", "node", "blocks", "text").mapInArrow(hashed, "group long, node long, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    unit = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))

    def compare(batches):
        """A stream of sets sorted by unit and node."""
        out = _Forest()
        for table in whole_keys(batches, 4000):
            units, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
            kept = table.column(2).to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1], [True])))
            for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                some = np.arange(start, end)
                some = some[np.concatenate(([True], ids[some[1:]] != ids[some[:-1]]))]  # without repeated rows of docs
                if len(some) > 1:
                    a, b = _alike([np.frombuffer(kept[k], np.uint64) for k in some], similarity)
                    yield from out.add(ids[some[a]], ids[some[b]])
        yield from out.rest()

    return dealt.select(unit.alias("unit"), "node", "shingles").repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(compare, "a long, b long")


def differing(similarity: float) -> float:
    """Chance that a bit differs between texts of equal size with a shingle similarity (Jaccard): their angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_for(similarity: float, bits: int, spread: float) -> int:
    """Bits that texts of a shingle similarity differ in, and `spread` standard deviations more."""
    share = differing(similarity)
    return math.floor(bits * share + spread * math.sqrt(bits * share * (1 - share)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4, similarity: float | None = None, hot: int = 20_000) -> DataFrame:
    """Links documents whose SimHash fingerprints differ in at most `threshold` bits.

    With `similarity` instead, documents whose sets of shingles have a Jaccard similarity of so much
    or more: no link below it is made, as sets are compared; of the pairs right at the limit a
    chance of about MISS is no candidate, more of texts with a handful of shingles.

    One row for each input row: doc_id, fingerprint (hex digits), component_id (the smallest
    doc_id reachable over links, itself included), class_id (the smallest doc_id with the same
    fingerprint, or set of shingles for `similarity`), text_id (a hash of the text). Null and
    wordless texts have fingerprint 0 and are linked like any other. A component without any id
    has a null component_id. Repeated rows are kept; an empty table gives no rows.
    """
    similar = similarity is not None
    marked = checkpoint(fingerprints(docs, id_col, text_col, shingle, similar))
    fields = [c for c in marked.columns if c.startswith("f")]
    first = [F.min("doc_id").alias("class_id"), F.count("*").alias("rows"), F.min("size").alias("size"), F.min(F.struct("doc_id", "text_id")).alias("row")]
    classes = checkpoint(marked.groupBy("node", *fields).agg(*first))
    groups = connected_components(link_classes(classes, threshold, similarity, hot))
    if similar:  # until here these are candidates: now only links between sets alike enough
        loose = classes.join(groups, "node").select(F.col("component").alias("group"), "node", "size", "row.*")
        groups = connected_components(verified_links(docs, loose, id_col, text_col, shingle, similarity))
    named = classes.join(groups, "node", "left").select("node", "class_id", "rows", F.coalesce("component", "node").alias("group"))
    least = named.groupBy("group").agg(F.min("class_id").alias("component_id"), F.count("*").alias("classes"))
    named = join_spread(named, least, "group", "classes", "node").select("node", "class_id", "rows", "component_id")
    out = join_spread(marked, named, "node", "rows", "doc_id", "text_id")
    written = F.concat(*[F.lpad(F.lower(F.hex(f)), 16, "0") for f in fields])
    return out.select("doc_id", written.alias("fingerprint"), "component_id", "class_id", "text_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's columns without documents that a link connects to one with a smaller id.

    Rows without a doc_id are kept when their whole component has none, otherwise dropped. Rows
    that repeat the smallest id of a component are kept as they come.
    """
    table, names = positional(docs)
    key, text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    found = near_duplicates(docs, id_col, text_col, **options)
    losers = found.filter(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "text_id").distinct()
    same = F.col(key).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_id"))
    return table.join(losers, same, "left_anti").toDF(*names)
