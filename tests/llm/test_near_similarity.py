"""Near-duplicates by shingle similarity against brute-force Jaccard components."""

import random

import pytest

from trendlake.llm import simhash_dedup

SIMILARITY, SHINGLE = 0.8, 5


def made(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def sets_of(text):
    w = text.lower().split()
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def tail_changed(r, words, similarity):
    """A text as long whose shingles are alike by about so much: its last words are others."""
    n = len(words) - SHINGLE + 1
    same = round(2 * similarity * n / (1 + similarity))
    return [*words[: same + SHINGLE - 1], *made(r, n - same)]


def pairs(similarity, n, seed, length=300):
    r, rows = random.Random(seed), []
    for k in range(n):
        words = made(r, length)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(tail_changed(r, words, similarity)))]
    return rows


def brute_kept(rows):
    """Ids with no smaller one in their component, over all pairs of rows."""
    sets, group = [sets_of(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= SIMILARITY and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min(least.get(g, d), d)
    return set(least.values())


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(docs, shingle=SHINGLE, similarity=SIMILARITY).select("doc_id").collect()}


@pytest.mark.parametrize("similarity", [0.6, 0.7, 0.75, 0.79])
def test_texts_below_the_limit_stay(spark, similarity):
    rows = pairs(similarity, 40, 11)
    assert kept(spark, rows) == brute_kept(rows) == {d for d, _ in rows}


def test_groups_compared_by_blocks(spark, monkeypatch):
    """Chains and clusters, some alike by less, in blocks of few shingles."""
    r, rows = random.Random(12), []
    for k in range(4):
        words = made(r, 200)
        for step in range(12):
            rows.append((100 * k + step, " ".join(words)))
            words = tail_changed(r, words[8:] + made(r, 8), 0.9) if k < 3 else tail_changed(r, words, 0.77)
    whole = kept(spark, rows)
    monkeypatch.setattr(simhash_dedup, "BLOCK_SHINGLES", 400)
    assert kept(spark, rows) == whole >= brute_kept(rows)


@pytest.mark.parametrize("similarity", [0.81, 0.83, 0.86])
def test_texts_over_the_limit_are_found(spark, similarity):
    """Three standard deviations of the bits: a few in a hundred may be no candidates, never a quarter."""
    rows = pairs(similarity, 100, 13)
    want, got = brute_kept(rows), kept(spark, rows)
    assert len(want) == 100 and want <= got and len(got - want) <= 3


def test_repeated_lines_do_not_hide_copies(spark):
    r, rows = random.Random(14), []
    for k, times in enumerate([3, 5, 10, 30] * 10):
        words, line = made(r, 304), made(r, 10)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:150] + line * times + words[150:]))]
    want = brute_kept(rows)
    assert len(want) == 40 and kept(spark, rows) == want
