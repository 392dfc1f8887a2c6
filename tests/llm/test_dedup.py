"""Substring, line and near-duplicate removal against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trendlake.llm import line_dedup, simhash_dedup, substring_dedup
from trendlake.llm.components import connected_components
from trendlake.llm.substring_dedup import SubstringIndex


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def order(d):
    return (d is not None, d or 0)


def brute_substrings(rows, width=20):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k not in first or order(d) < order(first[k]):
                first[k] = d
    out = []
    for d, t in rows:
        w, gone, mine = words(t), set(), set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if order(first[k]) < order(d) or k in mine:
                gone |= set(range(i, i + width))
            mine.add(k)
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return Counter(out)


def brute_lines(rows, least=10):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            if k not in first or order(d) < order(first[k]):
                first[k] = d
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


def taken(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def source(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_substrings(edge_docs):
    got = taken(substring_dedup.dedup_substrings(edge_docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(source(edge_docs))
    assert sum(k[2] * n for k, n in got.items()) > 0


@pytest.mark.parametrize("width,gram", [(3, 2), (7, 3), (20, 20), (5, 1)])
def test_substrings_of_other_widths(edge_docs, width, gram):
    got = taken(substring_dedup.dedup_substrings(edge_docs, width=width, gram=gram), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(source(edge_docs), width)


def test_substring_documents_keep_all_columns(edge_docs):
    out = substring_dedup.dedup_substrings(edge_docs, emit="documents")
    assert out.columns == edge_docs.columns
    kept = Counter((r["doc_id"], None if r["text"] is None else " ".join(words(r["text"]))) for r in out.collect())
    digests = Counter((d, sha(t or "")) for (d, t), n in kept.items() for _ in range(n))
    assert digests == Counter((k[0], k[3]) for k, n in brute_substrings(source(edge_docs)).items() for _ in range(n))
    assert sum(t is None for _, t in kept) == 2


def test_substring_index_over_batches(spark, edge_docs, tmp_path):
    rows = [r for r in source(edge_docs) if r[0] is not None]
    older, newer = [r for r in rows if r[0] < 60], [r for r in rows if r[0] >= 60]
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    index = SubstringIndex(spark, str(tmp_path / "index"), n_buckets=5)
    assert taken(index.dedup(make(older)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(older)
    half = len(older) // 2
    index.append(make(older[:half]))
    index.append(make(older[half:]))
    want = Counter({k: n for k, n in brute_substrings(older + newer).items() if k[0] >= 60})
    got = taken(index.dedup(make(newer)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == want
    index.compact()
    assert taken(index.dedup(make(newer)), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_whole_tables_through_an_index(spark, edge_docs, no_docs, tmp_path):
    for i, shares in enumerate([(1 / 16, 1 / 8), (0.3, 0.5, 0.9), (1.0,)]):
        out = substring_dedup.dedup_in_batches(edge_docs, str(tmp_path / f"i{i}"), shares)
        assert taken(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(source(edge_docs))
    assert substring_dedup.dedup_in_batches(no_docs, str(tmp_path / "none")).count() == 0


def test_parameters_of_an_index_are_kept(spark, edge_docs, tmp_path):
    index = SubstringIndex(spark, str(tmp_path / "i"), width=7, gram=3, n_buckets=6)
    index.append(edge_docs)
    index.compact()
    again = SubstringIndex(spark, str(tmp_path / "i"), width=7, gram=3)
    assert again.n_buckets == 6
    for other in ({"width": 8, "gram": 3}, {"width": 7, "gram": 3, "n_buckets": 5}):
        with pytest.raises(ValueError):
            SubstringIndex(spark, str(tmp_path / "i"), **other)
    plan = runs_plan(again, edge_docs)
    assert "Bucketed: true" in plan


def runs_plan(index, docs):
    return index.dedup(docs)._jdf.queryExecution().toString()


def test_a_crowd_of_lines_over_many_batches(spark):
    """One line in most rows, more rows than a batch, repeated lines within a document."""
    rows = [(i, "\n".join(["a line that all have", f"own line number {i}", "a line that all have"][: 1 + i % 3])) for i in range(700)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert taken(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines(edge_docs):
    got = taken(line_dedup.dedup_lines(edge_docs), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == brute_lines(source(edge_docs))
    assert sum(k[2] * n for k, n in got.items()) > 0


def test_line_bitmaps_and_documents(edge_docs):
    out = line_dedup.dedup_lines(edge_docs, emit="documents")
    assert out.columns == edge_docs.columns
    digests = Counter((r["doc_id"], sha(r["text"] or "")) for r in out.collect())
    assert digests == Counter((k[0], k[3]) for k, n in brute_lines(source(edge_docs)).items() for _ in range(n))
    for r in line_dedup.dedup_lines(edge_docs).collect():
        bits = line_dedup.bitmap(r["keep_runs"])
        assert len(bits) == r["n_lines"] and bits.sum() == r["n_lines"] - r["n_dropped"]
        assert line_dedup.run_lengths(bits) == r["keep_runs"]


def brute_near(rows, threshold=4):
    fps = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return Counter((d, f"{fp:016x}", least.get(g)) for (d, _), fp, g in zip(rows, fps, group))


@pytest.mark.parametrize("hot", [20_000, 1])
def test_near_duplicates(edge_docs, hot):
    got = taken(simhash_dedup.near_duplicates(edge_docs, hot=hot), "doc_id", "fingerprint", "component_id")
    assert got == brute_near(source(edge_docs))


def test_links_of_clustered_fingerprints(spark):
    """A dense cluster and chains, by every way that crowded keys can be linked."""
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(30):
            x = int(b)
            for bit in r.choice(63, r.integers(1, 8), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    arr = np.array(fps, np.int64).view(np.uint64)

    def components(threshold):
        left, out = set(range(len(fps))), []
        while left:
            todo, group = [left.pop()], []
            while todo:
                i = todo.pop()
                group.append(fps[i])
                near = {int(j) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= threshold)} & left
                left -= near
                todo.extend(near)
            out.append(frozenset(group))
        return {g for g in out if len(g) > 1}

    classes = spark.createDataFrame([(f, f) for f in fps], "node long, f0 long")
    for threshold, hot in ((4, 20_000), (4, 10), (6, 15), (3, 10)):
        found = connected_components(simhash_dedup.link_classes(classes, threshold, hot=hot)).collect()
        groups = {}
        for row in found:
            groups.setdefault(row["component"], set()).add(row["node"])
        assert {frozenset(g) for g in groups.values()} == components(threshold)


def test_similar_documents_go_and_others_stay(spark, edge_docs):
    out = simhash_dedup.drop_near_duplicates(edge_docs, shingle=5, similarity=0.8)
    assert out.columns == edge_docs.columns
    texts = Counter(r["text"] for r in out.collect())
    full = source(edge_docs)
    long = max((t for _, t in full if t), key=len)
    assert sum(n for t, n in texts.items() if t and t[:200] == long[:200]) <= 2  # one id, which comes twice
    assert texts["word"] == 1 and texts["UPPER lower"] == 1 and texts["without an id"] == 1


def test_allocation_keeps_the_principle():
    r = np.random.default_rng(1)
    bits = r.integers(0, 2, (500, 64)).astype(float)
    bits[:, 1] = bits[:, 0]
    for n in (100, 10**6, 10**10):
        plan = simhash_dedup.allocate(n, bits.T @ bits * (n / 500), 4)
        assert sum(t + 1 for _, t in plan) == 5
        used = [b for part, _ in plan for b in part]
        assert len(used) == len(set(used))
        assert sum(1 << len(part) for part, _ in plan) >= simhash_dedup.LEAST_KEYS
    assert any({0, 1} <= set(p) for p in simhash_dedup.correlated_parts(500, bits.T @ bits, 4))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150), (7, 7), (None, 3), (5, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def test_empty_tables(spark, no_docs):
    assert substring_dedup.dedup_substrings(no_docs).count() == 0
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert simhash_dedup.near_duplicates(no_docs).count() == 0
    assert simhash_dedup.drop_near_duplicates(no_docs.withColumn("n_chars", F.lit(1))).count() == 0
