"""Language, rules, quality and fingerprints: held-out accuracy, SQL, brute force, edge cases."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from trendlake.llm import compression_classifier, langid, order_minhash, quality_rules
from trendlake.llm import queries as Q

SF = "/root/testdata/sf0.001"


def source(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_languages_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in Q.op2_language_id(spark, SF).collect() if r["held_out"]]
    assert len(got) > 40
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in got) / len(got) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_unseen_words_fall_back_to_ngrams(spark):
    rows = [(i, f"xylophon{c * k} wassermann ärger", "de") for i, (c, k) in enumerate(zip("abcdefgh" * 3, range(1, 25)))]
    rows += [(100 + i, f"quelque{c * k} chose là", "fr") for i, (c, k) in enumerate(zip("abcdefgh" * 3, range(1, 25)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert model.languages == ["de", "fr"]
    new = spark.createDataFrame([(0, "xylophonen"), (1, "quelques"), (2, "123 --"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"] > 0.5) for r in langid.identify(new, model, F.lit(True)).collect()}
    assert got == {0: ("de", True), 1: ("fr", True), 2: ("und", False), 3: ("und", False), 4: ("und", False)}


def test_language_edges(spark, edge_docs, no_docs):
    model = langid.train(no_docs, F.lit(True))
    got = langid.identify(edge_docs, model, Q.fold(3) == 1).collect()
    assert {r["lang_pred"] for r in got} == {"und"} and len(got) == edge_docs.count()
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert langid.identify(no_docs, model, F.lit(True)).count() == 0


def plain_words(text):
    """Letters with the marks after them, lower case, by one character after the other."""
    out, run = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] == "L" or (run and unicodedata.category(c)[0] == "M"):
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def brute_languages(rows, text, least_count=2):
    """(language, share) of a text by counts of (text, language) rows, in plain Python."""
    langs = sorted({lang for _, lang in rows})
    counts = {}
    for t, lang in rows:
        for w in plain_words(t):
            edged = "\0" + w + "\0"
            for size in range(5):
                for e in [w] if size == 0 else [edged[i : i + size] for i in range(len(edged) - size + 1)]:
                    counts[lang, size, e] = counts.get((lang, size, e), 0) + 1
    counts = {k: n for k, n in counts.items() if n >= least_count}
    known = [{e for _, size, e in counts if size == n} for n in range(5)]
    total = {(lang, n): sum(counts.get((lang, n, e), 0) + 0.5 for e in known[n]) for lang in langs for n in range(5)}
    score = lambda lang, n, e: math.log((counts.get((lang, n, e), 0) + 0.5) / total[lang, n])
    sums = dict.fromkeys(langs, 0.0)
    for w in plain_words(text):
        if w in known[0]:
            parts = [(0, w)]
        else:
            parts, edged, i = [], "\0" + w + "\0", 0
            while i < len(edged):
                n = next((n for n in (4, 3, 2, 1) if i + n <= len(edged) and edged[i : i + n] in known[n]), 0)
                parts += [(n, edged[i : i + n])] if n else []
                i += max(1, n - 1)
        for n, e in parts:
            for lang in langs:
                sums[lang] += score(lang, n, e)
    best = max(langs, key=lambda lang: (sums[lang], -langs.index(lang)))
    return best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())


def test_language_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").filter("length(text) < 3000")
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    got = langid.identify(docs.limit(25), langid.train(docs, F.lit(True)), F.lit(True)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        lang, share = brute_languages(rows, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(share, rel=1e-6, abs=1e-12)


def brute_rules(t):
    t = t or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_rules(edge_docs):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r["doc_id"], *[r[c] for c in columns]) for r in quality_rules.judge(edge_docs).collect())
    assert got == Counter((d, *brute_rules(t)) for d, t in source(edge_docs))


def test_rules_are_native(edge_docs):
    plan = quality_rules.judge(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_policies_and_ablations(edge_docs):
    entries = quality_rules.ledger(edge_docs)
    rows = quality_rules.apply_policy(entries, "v1").collect()
    mask = quality_rules.POLICIES["v1"].mask
    assert all(r["kept"] == (r["failed_bits"] & mask == 0) for r in rows)
    for r in quality_rules.ablations(entries, "v1").collect():
        bit = quality_rules.BIT[r["rule"]]
        assert r["n_failed"] == sum(x["failed_bits"] & bit != 0 for x in rows)
        assert r["n_failed_alone"] == sum(x["failed_bits"] & mask == bit for x in rows)
        assert r["n_kept_without"] == sum(x["failed_bits"] & mask & ~bit == 0 for x in rows)


def test_rules_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(quality_rules.SQL)
    got = Q.op3_quality_rules(spark, SF).select(*[d[0] for d in rel.description]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rel.fetchall()))


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in Q.op4_compression_classifier(spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in got) / len(got) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_scores_by_brute_force(spark, edge_docs):
    """Sizes under each dictionary by the library itself, the formula in plain Python."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = compression_classifier.train(docs, labels, F.lit(True))
    size = lambda d, t: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t))
    want = []
    for d, text in source(edge_docs):
        t = (text or "").encode()
        g, b = size(model.good, t), size(model.bad, t)
        x = ((b - g) / (b + g), math.log((g + 1) / (len(t) + 16)), math.log(len(t) + 16))
        z = model.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights[1:], x, model.centre, model.scale))
        want.append((d, round(1 / (1 + math.exp(-max(-40, min(40, z)))), 9)))
    got = compression_classifier.score_documents(edge_docs, model, F.lit(True)).collect()
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in got) == Counter(want)


def test_long_labelled_texts_take_part(spark):
    r = random.Random(3)
    rows = [(i, ("good words here " if i % 2 else "BAD!!! ### ") * 3000 + str(r.random())) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = compression_classifier.train(docs, labels, F.lit(True))
    assert b"good words" in model.good and b"BAD!!!" in model.bad
    assert all(x["predicted"] == x["doc_id"] % 2 for x in compression_classifier.score_documents(docs, model, F.lit(True)).collect())


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(100, 1, 0), (None, 1, 0), (97, None, 0)], "doc_id long, quality int, toxic int")
    model = compression_classifier.train(edge_docs, labels, F.lit(True))
    got = compression_classifier.score_documents(edge_docs, model, Q.fold(5) == 0).collect()
    assert len(got) == edge_docs.count() and len({r["score"] for r in got}) == 1
    assert compression_classifier.score_documents(no_docs, model, F.lit(True)).count() == 0
    none = compression_classifier.train(no_docs, labels.limit(0), F.lit(True))
    assert compression_classifier.score(edge_docs, none, out="chance").filter("chance <> 0.5").count() == 0


def test_order_minhash(edge_docs):
    rows = sorted(source(edge_docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        a, b, c = (order_minhash.fingerprint(x) for x in (t, edited, after))
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), order_minhash.written(a), order_minhash.written(b), (a == b).mean(), (a == c).mean()))
    got = order_minhash.compare_with_next(edge_docs).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def brute_order_minhash(text):
    """For each order the two least numbered 3-mers, in text order; hashes by whole numbers."""
    top, a, b = 2**64, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def mix(x):
        x = ((x ^ (x >> 30)) * b) % top
        x = ((x ^ (x >> 27)) * a) % top
        return x ^ (x >> 31)

    pieces = re.findall(r"[^\x20\x09-\x0D]{1,8}", text)
    if not pieces:
        return "0" * 256
    codes = [xxhash.xxh3_64_intdigest(p.encode()) for p in pieces]
    seen, numbered = Counter(), []
    for i in range(max(1, len(codes) - 2)):
        h = 0
        for c in codes[i : i + 3]:
            h = (h * a + c) % top
        numbered.append(mix((h + seen[h] * b) % top))
        seen[h] += 1
    out = []
    for slot in range(32):
        factor = xxhash.xxh3_64_intdigest(slot.to_bytes(8, "little")) | 1
        chosen = sorted(sorted(range(len(numbered)), key=lambda i: (numbered[i] * factor % top, i))[:2])
        total = 0
        for i in chosen:
            total = mix((total * a + numbered[i]) % top)
        out.append(f"{total >> 32:08x}")
    return "".join(out)


def test_order_minhash_by_brute_force(edge_docs):
    for _, t in source(edge_docs):
        if len(t or "") < 3000:
            assert order_minhash.written(order_minhash.fingerprint(t or "")) == brute_order_minhash(t or "")


def test_order_minhash_of_one_and_none(spark, no_docs):
    one = spark.createDataFrame([(1, "abcdefgh ijkl")], "doc_id long, text string")
    row = order_minhash.compare_with_next(one).collect()[0]
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcdefgh iabc").hexdigest()
    assert order_minhash.compare_with_next(no_docs).count() == 0
    assert order_minhash.fingerprint_documents(no_docs).count() == 0


def test_order_minhash_sees_order():
    text = " ".join(f"w{i}" for i in range(400))
    half = text.split(" ")
    moved = " ".join(half[200:] + half[:200])
    a, b, c = (order_minhash.fingerprint(x) for x in (text, text.replace("w7 ", "v7 "), moved))
    assert order_minhash.likeness(a, a) == 1.0
    assert order_minhash.likeness(a, b) > 0.8 > order_minhash.likeness(a, c)
    many = np.mean([order_minhash.likeness(order_minhash.fingerprint("a b c " * n), order_minhash.fingerprint("a b c " * (2 * n))) for n in (5, 9)])
    assert many < 1.0  # occurrences are numbered, so repeats count
