"""Column functions against plain Python, on awkward strings."""

import random
import re
import urllib.parse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendlake.functions import noise, score
from trendlake.functions import text as T

ODD = list("aB7 []()#+-,\t\n\x0b\x1c\x1f\x85 　​가공지안내★◆◇AD:K ") + ["공지", "[공지]", "[PR]", "AD", "#x"]


def strings(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 9))) for _ in range(n)]


def applied(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("v"))
    return [r["v"] for r in sorted(rows.collect())]


def test_strip_and_key(spark):
    texts = strings(3000)
    assert applied(spark, T.strip("t"), texts) == [t.strip() for t in texts]
    assert applied(spark, T.title_key("t"), texts) == [t.strip().lower() for t in texts]


def test_noise_both_lists_agree_with_python(spark):
    def plain(title):
        t = title.strip()
        return len(t) < 6 or any(k in t for k in noise.KEYWORDS) or any(re.search(p, t, re.IGNORECASE) for p in noise.PATTERNS)

    texts = strings(4000, 2) + [k + " some more" for k in noise.KEYWORDS]
    want = [plain(t) for t in texts]
    assert applied(spark, noise.is_noise("t"), texts) == want
    assert applied(spark, noise.is_noise("t", folded=False), texts) == want


def test_folded_lists():
    assert len(noise.KEYWORDS) == 38
    assert len(noise.effective_keywords()) == 27
    assert noise.effective_patterns() == noise.PATTERNS[6:]


def test_counts(spark):
    texts = ["1,234", "", None, " 7 ", "1.5", "12/3", "3000000000", "-3", "+7", "x", "99999999999999999999"]
    assert applied(spark, T.to_count("t"), texts) == [1234, 0, 0, 7, 0, 0, 3000000000, -3, 7, 0, 0]
    assert applied(spark, T.bracketed_count("t"), ["[12]", "[12/3]", "[1,024]", None]) == [12, 0, 1024, 0]
    assert applied(spark, T.rating_count("t"), ["12 - 3", "-3", "5", None]) == [12, 0, 5, 0]
    assert applied(spark, T.last_paren_count("t"), ["a (3)", "a (3) ", "(3) a", "a (3)\n"]) == [3, 3, 0, 3]


def test_quote_and_unquote(spark):
    texts = [t for t in strings(500, 3)] + ["a b/c~d*e+f", "100%"]
    assert applied(spark, T.quote("t"), texts) == [urllib.parse.quote(t) for t in texts]
    good = [urllib.parse.quote(t) for t in texts] + ["a+b"]
    assert applied(spark, T.unquote("t"), good) == [urllib.parse.unquote(t) for t in good]
    assert applied(spark, T.unquote("t"), ["%zz", "%"]) == ["%zz", "%"]


def test_rounding_is_of_the_binary_value(spark):
    rows = [(u, c, v, s) for u in range(0, 40, 7) for c in (0, 1, 5) for v in range(0, 500, 5) for _, s in score.DECAY]
    df = spark.createDataFrame(rows, "u long, c long, v long, s double")
    made = df.select("u", "c", "v", "s", T.round_half_even_2(score.base_score(F.col("u"), F.col("c"), F.col("v")) * F.col("s")).alias("x"))
    assert all(r["x"] == round((r["u"] * 3 + r["c"] * 2 + r["v"] * 0.1) * r["s"], 2) for r in made.collect())


def test_decay_bounds_belong_to_the_younger_side(spark):
    hours = [(h,) for bound, _ in score.DECAY for h in (float(bound), bound + 1e-9)] + [(-5.0,), (None,)]
    got = [r[0] for r in spark.createDataFrame(hours, "h double").select(score.decay(F.col("h"))).collect()]
    assert got == [1.0, 0.7, 0.7, 0.4, 0.4, 0.2, 0.2, 0.08, 0.08, 0.03, 0.03, 0.02, 1.0, 0.02]


@settings(max_examples=20, deadline=None)
@given(st.floats(0, 1e4), st.floats(0, 1e4))
def test_decay_never_grows_with_age(a, b):
    def plain(h):
        return next((s for bound, s in score.DECAY if h <= bound), score.OLDEST)

    assert plain(min(a, b)) >= plain(max(a, b))


def test_urls(spark):
    hrefs = ["http://a/x", "/x", "x", "//h/x", "", "/v?document_srl=9"]
    assert applied(spark, T.absolute("B", "t"), hrefs) == ["http://a/x", "B/x", "Bx", "B//h/x", "B", "B/v?document_srl=9"]
    assert applied(spark, T.url_by_id("B", "t"), hrefs)[-1] == "B/9"
    assert applied(spark, T.with_scheme("t"), ["//h/x", "", "u"]) == ["https://h/x", None, "u"]
    assert applied(spark, T.without_query("t"), ["/a?b#c", "/a#c", "/a"]) == ["/a", "/a#c", "/a"]
