"""Pages with more than a thousand anchors."""

import pytest

from trendlake import queries as Q


@pytest.mark.parametrize("name", ["mark_before", "mark_after"])
def test_marking_tells_rows_of_large_pages_apart(spark, tmp_path, name):
    def page(hrefs):
        return "".join(f'<a href="/{h}">some text</a>' for h in hrefs)

    pages = [(0, "http://h/0", page(range(1002))), (1, "http://h/1", page([0, 5000]))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"], r["pos"]) for r in Q.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == [(0, i) for i in range(1002)] + [(1, 1)]
