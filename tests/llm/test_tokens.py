"""Tokens, packing, chats and the pipeline."""

import hashlib
import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlake.llm import bpe, chat_format, packing
from trendlake.llm import queries as Q
from trendlake.llm.common import public_tokenizer

tokenizers = pytest.importorskip("tokenizers")
WORD, BYTE = public_tokenizer("word_bpe_49k.json"), public_tokenizer("byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(WORD), reason="no vocabulary files")


def source(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_codec_against_the_library(edge_docs, no_docs):
    lib = tokenizers.Tokenizer.from_file(WORD)
    want = Counter()
    for d, t in source(edge_docs):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.encode_documents(edge_docs).collect())) == want
    row = bpe.encode_documents(edge_docs.filter("doc_id = 88"), emit="ids").collect()[0]
    assert row["ids"] == lib.encode("word", add_special_tokens=False).ids
    assert bpe.encode_documents(no_docs).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_speculation_is_verified(path):
    model, r = bpe.Model(path), random.Random(2)
    parts = ["th", "on", "er", "an", "re", "in", "ed", "a", "aa", "é", "ß", "日", "🙂", "7", "!", "z", "q"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(1500)] + ["a" * 300, "ab" * 90]
    end = "Ā" if model.suffix else ""
    assert model.encode_words(made) == [model.merge_exactly(w.encode().decode("latin-1") + end) for w in made]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_characters_against_the_library(path):
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.Tokenizer(path)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x600 or c % 37 == 0)]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)} !{chr(c)}! e{chr(c)}́ 'S" for c in points]
    got = [list(itertools.chain.from_iterable(x)) for x in own.codes(texts, list)]
    assert got == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_byte_codec_against_the_library(edge_docs):
    lib, own = tokenizers.Tokenizer.from_file(BYTE), packing.ByteCodec(BYTE)
    long = "ab " * 70_000 + " " * 3000 + "x<|endoftext|>" + "!" * 300
    for t in [*(t or "" for _, t in source(edge_docs)), long]:
        assert own.encode(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def packed_right(rows, docs, room):
    lib = tokenizers.Tokenizer.from_file(BYTE)
    ids = defaultdict(list)
    for d, t in docs:
        ids[d].append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    tokens = Counter()
    sequences, total = defaultdict(list), Counter()
    for r in rows:
        assert r["length"] > 0
        found = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert found
        tokens[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert tokens == {d: sum(map(len, x)) for d, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= room
        total[at] += 1
    return sum(n * (room - at) for at, n in total.items() if at & (at - 1)), sum(tokens.values())


@pytest.mark.parametrize("room", [2048, 16])
def test_packing(edge_docs, no_docs, room):
    rows = packing.pack_documents(edge_docs, room=room).collect()
    padding, total = packed_right(rows, source(edge_docs), room)
    assert padding < room <= total or padding < room
    assert packing.pack_documents(no_docs).count() == 0


def test_first_fit_by_tournament():
    r = random.Random(4)
    for room in (8, 100):
        sizes = sorted((r.randint(1, room) for _ in range(200)), reverse=True)
        tree, free, want = packing.Tournament(len(sizes), room), [], []
        for s in sizes:
            at = next((i for i, f in enumerate(free) if f >= s), len(free))
            if at == len(free):
                free.append(room)
            free[at] -= s
            want.append(at)
        assert [tree.place(s) for s in sizes] == want


@pytest.mark.parametrize("lengths", [[], [0], [5], [10, 10, 10], [3, 3, 3, 3], [25, 9, 9, 9, 9, 2], [1] * 40])
def test_pack_covers_every_token_once(lengths):
    seen = Counter()
    bins = packing.pack(lengths, 10)
    for b in bins:
        assert sum(n for _, _, n in b) <= 10
        seen.update((i, s + k) for i, s, n in b for k in range(n))
    assert seen == Counter((i, k) for i, n in enumerate(lengths) for k in range(n))
    assert len(bins) <= -(-sum(lengths) // 10) + 1


NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
ORDER = ["", "system", "user", "assistant"]


def between(last, role):
    """The fewest turns to insert after `last` so that `role` may follow, or None."""
    for n in range(3):
        for path in itertools.product(ORDER[1:], repeat=n):
            if all(b in NEXT[a] for a, b in zip((last, *path), (*path, role))):
                return path
    return None


def brute_repairs(turns):
    """Every repair of a short chat, by trying all: the rows of the best, (new_role, action, n_inserted, cost, piece)."""
    done = [([], "", 0)]  # rows, last role, cost
    for role, _ in turns:
        own = (role or "").strip().lower()
        new = []
        for rows, last, cost in done:
            for to in ORDER[1:]:
                path = between(last, to)
                if path is not None:
                    c = 5 * len(path) + (0 if to == own else 4)
                    new.append(([*rows, (to, "keep" if to == own else "relabel", path, c)], to, cost + c))
            if last:
                c = 1 if last == own else 7
                new.append(([*rows, (last, "merge", (), c)], last, cost + c))
        done = new
    least = min(cost for _, _, cost in done)
    best = min((rows for rows, _, cost in done if cost == least), key=lambda rows: ([ORDER.index(r[0]) for r in rows[::-1]], [(r[3], r[1]) for r in rows[::-1]]))
    out = []
    for i, ((role, action, path, cost), (_, text)) in enumerate(zip(best, turns)):
        if action == "merge":
            piece = "\n" + (text or "")
        else:
            piece = ("<|end|>\n" if i else "") + "".join(f"<|{r}|>\n<|end|>\n" for r in path) + f"<|{role}|>\n" + (text or "")
        out.append((role, action, len(path), cost, piece + ("<|end|>\n" if i == len(turns) - 1 else "")))
    return out


def test_stretches_join_in_any_grouping():
    """The sequence that counts is the same however a chat is cut up, on thousands of random ones."""
    r = random.Random(8)
    for _ in range(3000):
        roles = [r.randrange(4) for _ in range(r.randrange(1, 12))]
        whole = [step[2] for step in chat_format.best_path(roles, chat_format.START, None)]
        cuts = sorted(r.sample(range(1, len(roles)), r.randrange(0, len(roles)))) if len(roles) > 1 else []
        parts = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)])]
        found = [chat_format.whole_stretch(p) for p in parts]
        until = list(itertools.accumulate(found, chat_format.Stretch.then))
        state, states = until[-1].best_end(0), []
        for i in range(len(parts) - 1, -1, -1):
            before = until[i - 1].between(found[i], 0, state) if i else 0
            states = [step[2] for step in chat_format.best_path(parts[i], before, state)] + states
            state = before
        assert states == whole


def legal(text):
    roles = [line[2:-2] for line in text.split("\n") if line in ("<|system|>", "<|user|>", "<|assistant|>")]
    return all(b in NEXT[a] for a, b in zip(["", *roles], roles))


@pytest.fixture(scope="module")
def chats():
    """Short chats of all kinds, a long one, one without an id, repeated turns, null turns and texts."""
    r = random.Random(5)
    kinds = ["system", "user", "assistant", "User ", "tool", None, ""]
    rows = [(c, t, r.choice(kinds), None if r.random() < 0.1 else f"text {c} {t}") for c in range(60) for t in range(r.randrange(1, 7))]
    rows += [(77, t, r.choice(kinds), f"long {t}") for t in range(2000)]
    rows += [(None, t, r.choice(kinds), "no id") for t in range(4)] + [(5, 0, "user", "again"), (5, 0, "user", "again"), (6, None, "user", "nowhere")]
    return rows


def rendered(spark, rows, n_parts):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("clash"))
    got = chat_format.repair_conversations(turns.repartition(3), n_parts=n_parts).collect()
    return Counter((g["conv_id"], g["turn"], g["role"], g["new_role"], g["action"], g["n_inserted"], g["cost"], g["piece"]) for g in got)


def test_chats(spark, chats):
    got = rendered(spark, chats, 1)
    by = {}
    for row in chats:
        by.setdefault(row[0], []).append(row)
    key = lambda x: (x is not None, x if x is not None else 0)
    for conv, mine in by.items():
        mine.sort(key=lambda x: (key(x[1]), (x[2] is not None, x[2] or ""), (x[3] is not None, x[3] or "")))
        if conv != 77:
            want = Counter((conv, t, role, *done) for (_, t, role, _), done in zip(mine, brute_repairs([(x[2], x[3]) for x in mine])))
            assert want == Counter({k: n for k, n in got.items() if k[0] == conv})
    long = {k[1]: k[7] for k in got if k[0] == 77}
    assert legal("".join(long[t] for t in range(2000)))


@pytest.mark.parametrize("n_parts", [2, 5, 40])
def test_chats_do_not_depend_on_partitions(spark, chats, n_parts):
    assert rendered(spark, chats, n_parts) == rendered(spark, chats, 1)


def test_a_good_chat_is_left_alone(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be nice"), (1, 1, "user", "q"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    got = sorted(chat_format.repair_conversations(turns).collect(), key=lambda r: r["turn"])
    assert "".join(r["piece"] for r in got) == "<|system|>\nbe nice<|end|>\n<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n"
    assert {r["action"] for r in got} == {"keep"} and sum(r["cost"] for r in got) == 0
    assert chat_format.repair_conversations(turns.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    assert len(corpus_pipeline.STAGES) == 5
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r["doc_id"] for r in rows}
    assert ids and ids < {r["doc_id"] for r in docs.collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    first = corpus_pipeline.quality(spark, docs, folder)
    assert first.columns == docs.columns
    kept = {r["doc_id"] for r in first.collect()}
    good = [r for r in labels if r["quality"] == 1]
    assert sum(r["doc_id"] in kept for r in good) >= 0.95 * len(good)
    once = corpus_pipeline.near(spark, corpus_pipeline.lines(spark, first, folder), folder)
    assert once.columns == docs.columns
    texts = [t for _, t in source(once)]
    assert len(texts) == len(set(texts))


def test_names():
    numbers = {n.split("_")[0] for n in Q.queries()}
    assert numbers == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert set(Q.oracle_sql()) <= set(Q.queries())
