import random

import pytest

WORDS = [f"{a}{b}" for a in ("th", "on", "er", "an", "re", "he", "in", "ed", "nd", "ha") for b in ("at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(n)).strip()


def edge_texts() -> list[str | None]:
    """Nulls, empty and blank texts, one word, long texts, copies, near copies, shared passages."""
    shared, long = prose(1, 60), prose(2, 4000)
    near = prose(3, 200).split(" ")
    return [
        None, "", " ", "\n\n", "word", "UPPER lower", long, long, long + " tail",
        prose(4, 50) + "\n" + shared + "\n" + prose(5, 50), prose(6, 30) + "\n" + shared, shared,
        " ".join(near), " ".join([*near[:90], "changed", *near[91:]]), prose(7, 120), prose(7, 120),
        "a line of some length\nshort\nA LINE of some length \nshort", "a line of some length", "ééé ñ日本語 🙂\x85x y", "ha " * 100,
        "same line here again\n" * 5, "\tsame line here again\n!!! ### $$$ %%%", "x" * 5000, "<|endoftext|> a <|startoftext|> b", "İΣΑΣ ǅ ½ Ⅷ é",
    ]


def edge_rows() -> list[tuple]:
    """(doc_id, text): ids out of order, one repeated, one repeated with its text, some null."""
    rows = [(100 - 3 * i, t) for i, t in enumerate(edge_texts())]
    return [*rows, rows[6], (rows[7][0], "another text of the same id"), (None, "without an id"), (None, None), (-5, prose(8, 40))]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """With extra columns whose names clash with ours."""
    rows = [(d, t, 1, "x", 2.0, "y") for d, t in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, batch int, keys string, score double, node string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
