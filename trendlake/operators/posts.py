"""Filter, score, rank, union and lookups over posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.noise import is_noise
from ..functions.score import score
from ..session import checkpoint

#: Colours and names by which sites are shown (fixed values).
SITE_COLORS = {
    "clien": "#1DA462",
    "fmkorea": "#E8501C",
    "ruliweb": "#1B6FBF",
    "ppomppu": "#E85C00",
    "mlbpark": "#003B8E",
    "bobaedream": "#C0392B",
    "inven": "#2E7D32",
    "slrclub": "#5C6BC0",
    "82cook": "#D81B60",
    "humoruniv": "#F57C00",
    "dcinside": "#1565C0",
    "ddanzi": "#333333",
    "theqoo": "#FF6B6B",
    "todayhumor": "#FF8C00",
    "natepann": "#FF3366",
}
SITE_NAMES = {
    "clien": "클리앙",
    "fmkorea": "에펨코리아",
    "ruliweb": "루리웹",
    "ppomppu": "뽐뿌",
    "mlbpark": "엠팍",
    "bobaedream": "보배드림",
    "inven": "인벤",
    "slrclub": "SLR클럽",
    "82cook": "82쿡",
    "humoruniv": "웃긴대학",
    "dcinside": "디씨인사이드",
    "ddanzi": "딴지일보",
    "theqoo": "더쿠",
    "todayhumor": "오늘의유머",
    "natepann": "네이트판",
}


def filter_notices(posts: DataFrame) -> DataFrame:
    """Posts whose title is not noise. Comes after dedup: a noisy first title still claims its key."""
    return posts.filter(~is_noise("title"))


def score_all(posts: DataFrame, as_of: Column) -> DataFrame:
    """Posts with their score at a given time."""
    return posts.withColumn("score", score(F.col("upvotes"), F.col("comments"), F.col("views"), F.col("created_at"), as_of))


def sorted_by_score(posts: DataFrame, seq: str = "seq") -> DataFrame:
    """Highest score first, equal scores in the order of seq: a range-partitioned sort."""
    return posts.orderBy(F.desc("score"), F.asc(seq))


def ranked(posts: DataFrame, seq: str = "seq", out: str = "rank") -> DataFrame:
    """Adds the place in the order of sorted_by_score, from 1, without one task for all rows.

    Rows are sorted by ranges of (score, seq) and checkpointed, so that partitions hold still; a
    row's place is its place in the partition and the sizes of the partitions before.
    """
    order = [F.desc("score"), F.asc(seq)]
    dealt = checkpoint(posts.repartitionByRange(*order).sortWithinPartitions(*order))
    # Partition number in the high bits, place in the partition in the low 33.
    numbered = dealt.withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row a partition: neither the window above nor this broadcast grows with the rows.
    return numbered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + place + 1).drop("_part", "_before", "_id")


def union_sources(sources: list[DataFrame], pos: str = "pos") -> DataFrame:
    """All sources one after the other; site_rank and seq keep their order."""
    numbered = [s.withColumn("site_rank", F.lit(i)) for i, s in enumerate(sources)]
    return with_seq(reduce(DataFrame.unionByName, numbered), pos)


def with_seq(posts: DataFrame, pos: str = "pos") -> DataFrame:
    """seq from (site_rank, pos)."""
    return posts.withColumn("seq", F.shiftleft(F.col("site_rank").cast("bigint"), 40) + F.col(pos).cast("bigint"))


def site_dimension(spark) -> DataFrame:
    rows = [(site, SITE_NAMES[site], SITE_COLORS[site]) for site in SITE_NAMES]
    return spark.createDataFrame(rows, "source_site string, site_name string, site_color string")


def with_site_labels(posts: DataFrame) -> DataFrame:
    """Names and colours of sites; null for others. Constant maps, so no join."""
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("source_site")]
    return posts.withColumns({"site_name": lookup(SITE_NAMES), "site_color": lookup(SITE_COLORS)})


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Counts rows as they pass, without a job of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen
