"""Record types of the engine."""

from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

#: One fetched response: decoded text, or bytes whose charset is still to be found.
RAW_PAGE = StructType(
    [
        StructField("source", StringType(), False),
        StructField("url", StringType(), False),
        StructField("html", StringType()),
        StructField("body", BinaryType()),
    ]
)

#: One list entry as it stands in the page, before any cleaning.
CANDIDATE = StructType(
    [
        StructField("site_rank", IntegerType(), False),
        StructField("pos", IntegerType(), False),
        StructField("source_site", StringType(), False),
        StructField("href", StringType()),
        StructField("text", StringType()),
        StructField("loose_text", StringType()),
        StructField("title_attr", StringType()),
        StructField("upvotes_raw", StringType()),
        StructField("comments_raw", StringType()),
        StructField("views_raw", StringType()),
        StructField("image_raw", StringType()),
    ]
)

#: A post; `seq` makes the order of emission explicit.
POST = StructType(
    [
        StructField("seq", LongType(), False),
        StructField("title", StringType(), False),
        StructField("source_url", StringType(), False),
        StructField("source_site", StringType(), False),
        StructField("content", StringType()),
        StructField("image_url", StringType()),
        StructField("upvotes", LongType(), False),
        StructField("comments", LongType(), False),
        StructField("views", LongType(), False),
        StructField("created_at", TimestampType()),
        StructField("score", DoubleType(), False),
        StructField("img_hash", StringType()),
    ]
)

#: Columns that the post table keeps, in order; `collected_at` is added on writing.
POST_TABLE = ["title", "source_url", "source_site", "content", "image_url", "upvotes", "comments", "views", "score", "created_at", "collected_at"]

KEYWORD = StructType([StructField("keyword", StringType()), StructField("url", StringType())])

#: Trending keywords of one source, in order.
KEYWORD_CACHE = StructType(
    [
        StructField("source", StringType(), False),
        StructField("keywords", ArrayType(KEYWORD), False),
        StructField("updated_at", TimestampType(), False),
    ]
)
