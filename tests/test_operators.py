"""Dedup, limits, ranking and upsert against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from trendlake.operators import dedup as D
from trendlake.operators import limits as L
from trendlake.operators import posts as P
from trendlake.operators.upsert import KeyedTable, upsert_keywords


def posts(spark, rows):
    return spark.createDataFrame(rows, "seq long, source_url string, title string")


def ids(df, c="seq"):
    return sorted(r[c] for r in df.select(c).collect())


def test_dedup_chain_is_not_one_dedup(spark):
    rows = posts(spark, [(0, "a", "one"), (1, "a", "two"), (2, "b", "TWO "), (3, "c", "One")])
    assert ids(D.dedup(rows)) == [0, 2]
    assert ids(D.dedup(D.dedup(rows))) == [0, 2]


def test_dedup_comes_before_the_filter(spark):
    rows = posts(spark, [(0, "a", "[PR] hello world"), (1, "b", "[pr] hello world")])
    assert ids(P.filter_notices(D.dedup(rows))) == []


def test_dedup_does_not_depend_on_partitions(spark):
    r = random.Random(5)
    rows = [(i, f"u{r.randrange(40)}", f"t{r.randrange(30)}") for i in range(300)]
    kept, urls, titles = [], set(), set()
    for s, u, t in rows:
        if u not in urls:
            urls.add(u)
            if t not in titles:
                titles.add(t)
                kept.append(s)
    for n in (1, 3, 11):
        assert ids(D.dedup(posts(spark, rows).repartition(n))) == kept


def test_null_keys_are_one_key_and_an_empty_table_stays_empty(spark):
    assert ids(D.dedup_by_url(posts(spark, [(0, None, "x"), (1, None, "y")]))) == [0]
    assert ids(D.dedup(posts(spark, []))) == []


def nodes(spark):
    rows = [("s", 0, "k", ""), ("s", 1, "k", "abc"), ("s", 2, "m", "def"), ("s", 3, "m", "ghi"), ("t", 0, "k", "jkl"), ("s", 4, "n", "x")]
    return spark.createDataFrame(rows, "site string, pos int, href string, text string").withColumn("seq", F.col("pos") + F.when(F.col("site") == "t", 100).otherwise(0))


def test_marking_before_and_after(spark):
    valid = F.length("text") >= 3
    assert ids(D.first_marked_before(nodes(spark), valid, F.col("site"), F.col("href"))) == [2, 100]
    assert ids(D.first_marked_after(nodes(spark), valid, F.col("site"), F.col("href"))) == [1, 2, 100]


def test_limits(spark):
    valid = F.length("text") >= 3
    assert ids(L.prefix_limit(nodes(spark), valid, ["site"], "pos", 2)) == [1, 100]
    assert ids(L.valid_limit(nodes(spark), valid, ["site"], "pos", 2)) == [1, 2, 100]
    assert ids(L.both_limit(nodes(spark), valid, ["site"], "pos", 3, 1)) == [1, 100]


def test_group_limit_is_in_the_plan(spark):
    plan = L.first_rows(nodes(spark), ["site"], "pos", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_caps(spark):
    got = {r["seq"]: r["image_url"] for r in L.enrich_cap(nodes(spark), ["site"], "pos", F.col("href"), 2).collect()}
    assert got == {0: "k", 1: "k", 2: None, 3: None, 4: None, 100: "k"}
    have = F.when(F.col("pos") == 1, F.lit("own"))
    got = {r["seq"]: r["image_url"] for r in L.enrich_missing(nodes(spark), ["site"], "pos", have, F.col("href"), 2).collect()}
    assert got == {0: "k", 1: "own", 2: "m", 3: None, 4: None, 100: "k"}


def test_rank_with_ties(spark):
    rows = [(i, float(i % 3)) for i in range(50)]
    got = {r["seq"]: r["rank"] for r in P.ranked(spark.createDataFrame(rows, "seq long, score double")).collect()}
    want = {s: i + 1 for i, (s, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_union_keeps_registry_order(spark):
    a, b = (spark.createDataFrame([(0, x), (1, x)], "pos int, v string") for x in "ab")
    assert [r["v"] for r in P.union_sources([a, b]).orderBy("seq").collect()] == ["a", "a", "b", "b"]


def test_observed_counts(spark):
    df, seen = P.counted(spark.range(7), "rows seen")
    df.collect()
    assert seen.get["rows"] == 7


def test_site_labels(spark):
    got = P.with_site_labels(spark.createDataFrame([("clien",), ("nowhere",)], "source_site string")).collect()
    assert [r["site_color"] for r in got] == ["#1DA462", None]
    assert P.site_dimension(spark).count() == 15


def test_upsert(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k")
    make = lambda rows: spark.createDataFrame(rows, "k string, v int, at int")
    assert t.upsert(make([("a", 1, 0), ("b", 2, 0)])) == 2
    assert t.upsert(make([("b", 3, 1), ("b", 4, 2), ("c", 5, 0)]), F.col("at")) == 2
    assert t.upsert(make([])) == 0
    want = {("a", 1), ("b", 4), ("c", 5)}
    assert {(r["k"], r["v"]) for r in t.read().collect()} == want
    t.upsert(make([("b", 4, 2)]))
    t.compact()
    assert len(t.generations()) == 1
    assert {(r["k"], r["v"]) for r in t.read().collect()} == want


def test_keywords_keep_the_old_list_when_nothing_is_found(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "source")
    kind = "source string, keywords array<struct<keyword:string,url:string>>"
    now = F.lit("2024-01-01").cast("timestamp")
    assert upsert_keywords(t, spark.createDataFrame([("daum", [("a", "u")]), ("danawa", [("b", "u")])], kind), now) == 2
    assert upsert_keywords(t, spark.createDataFrame([("daum", []), ("danawa", [("c", "u")])], kind), now) == 1
    assert {r["source"]: r["keywords"][0]["keyword"] for r in t.read().collect()} == {"daum": "a", "danawa": "c"}


def test_reading_a_table_that_is_not_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, str(tmp_path / "none"), "k").read()


def test_one_scan_for_each_dedup_chain(spark, tmp_path):
    posts(spark, [(0, "a", "x")]).write.parquet(str(tmp_path / "p"))
    plan = D.dedup(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan


def test_two_writers_lose_nothing(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    a, b = (KeyedTable(spark, str(tmp_path / "t"), "k") for _ in "ab")
    a.upsert(make([("a", 1)]))
    version, _ = b.manifest.newest()
    a.upsert(make([("b", 2)]))
    assert not b.manifest.publish(version, [])  # b looked before a's second write
    b.upsert(make([("c", 3)]))
    assert {(r["k"], r["v"]) for r in a.read().collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_empty_batches_of_partitioned_tables(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", ["v"])
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    assert t.upsert(make([])) == 0 and t.generations() == []
    t.upsert(make([("a", 1)]))
    assert t.upsert(make([])) == 0 and t.read().count() == 1

