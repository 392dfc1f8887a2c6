"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once a document; its failure is one bit of `failed_bits`, beside the
measurements. A policy is a version and a mask of rules that count, applied to the ledger without
reading texts again. Ablations (what would each rule's removal bring back?) need only the counts
of distinct bitmasks.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents_of, spread_out

#: Rules in the order of their bits: name, and the condition under which a document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("many_symbols", "n_words > 0 AND 10 * n_symbols > n_words"),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("shouting", "n_letters > 0 AND 100 * n_capitals > 60 * n_letters"),
    ("exclaiming", "n_words > 0 AND 100 * n_exclamations > 30 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]


@dataclasses.dataclass(frozen=True)
class Policy:
    """A version of what counts: a document is kept if it fails none of these rules."""

    version: str
    mask: int


#: Versions are never changed, only added.
POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("v1", BASE | BIT["repeated_lines"] | BIT["many_symbols"]),
        Policy("v2", (1 << len(RULES)) - 1),
    )
}
CURRENT = "v2"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _sorted_trigrams(words: Column) -> Column:
    """(hash of three words, position) in the order of hashes; the hash chains all three words.

    XXH64 with 64 bits: two different trigrams of a text of a million words agree with a chance
    below 3e-8.
    """
    at = F.sequence(F.lit(0), F.size(words) - 3)
    made = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) >= 3, F.sort_array(made))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of every whole text; null is empty, rows are kept as they come."""
    rows = spread_out(documents_of(docs, id_col, text_col)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spaced = F.translate("text", SPACES, " " * len(SPACES))
    # One stage a step, so that no array is computed anew for each of its elements.
    rows = rows.select("doc_id", "text", F.array_remove(F.split(spaced, " ", -1), "").alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: _without(line, SPACES) != "")
    letters = F.regexp_replace("text", r"[^\p{L}]+", "")
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), "!"))).cast("long").alias("n_exclamations"),
        F.length(letters).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(letters, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        lines.alias("lines"),
        _sorted_trigrams(F.col("words")).alias("grams"),
    )
    gram = lambda k: F.get(F.col("grams"), k)["h"]
    repeated = F.filter(F.col("grams"), lambda g, k: gram(k - 1).eqNullSafe(g["h"]) | gram(k + 1).eqNullSafe(g["h"]))
    rows = rows.select(*[c for c in rows.columns if c not in ("lines", "grams")], F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.sort_array(F.transform(repeated, lambda g: g["i"])).alias("at"))
    covered = F.aggregate(F.transform(F.col("at"), lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return rows.select(*[c for c in rows.columns if c != "at"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements with `failed_bits`: bit i is set if rule i fails. An empty table gives no rows."""
    bits = [F.when(F.expr(condition), BIT[name]).otherwise(0) for name, condition in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failed_bits", total.cast("long"))


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a version of the policy."""
    bits = F.col("failed_bits")
    return entries.withColumns({"base_failed": bits.bitwiseAND(F.lit(BASE)) != 0, "kept": bits.bitwiseAND(F.lit(POLICIES[version].mask | BASE)) == 0})


def ablations(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it, and that stay without it.

    Counts come from the distinct bitmasks, at most 2 ** len(RULES) rows after one partial sum.
    """
    mask = POLICIES[version].mask
    counts = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for name, _ in RULES if BIT[name] & mask])
    each = counts.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(total(hit).alias("n_failed"), total(alone).alias("n_failed_alone"), total(alone | (F.col("bits") == 0)).alias("n_kept_without"))


def judge(docs: DataFrame, version: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, failed_bits, base_failed and kept: a row for each input row."""
    return apply_policy(ledger(docs, id_col, text_col), version)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, list_filter(string_split(translate(text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: translate(x, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '') <> '') AS lines
  FROM d
), m AS (
  SELECT doc_id, text, words, len(words) AS n_words, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         length(translate(text, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         length(text) - length(translate(text, '!', '')) AS n_exclamations,
         length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_capitals
  FROM w
), p AS (
  SELECT doc_id, words, unnest(range(0, greatest(len(words) - 2, 0))) AS i FROM w
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i + 1], words[i + 2], words[i + 3]) AS c FROM p
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id
), b AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, n_exclamations, n_letters, n_capitals, n_lines, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM m LEFT JOIN r ON m.doc_id = r.doc_id
), f AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 4 ELSE 0 END
    + CASE WHEN n_words > 0 AND 10 * n_symbols > n_words THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_letters > 0 AND 100 * n_capitals > 60 * n_letters THEN 64 ELSE 0 END
    + CASE WHEN n_words > 0 AND 100 * n_exclamations > 30 * n_words THEN 128 ELSE 0 END AS failed_bits
  FROM b
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_exclamations AS BIGINT) AS n_exclamations, CAST(n_letters AS BIGINT) AS n_letters, CAST(n_capitals AS BIGINT) AS n_capitals,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       CAST(failed_bits AS BIGINT) AS failed_bits, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept
FROM f
"""
