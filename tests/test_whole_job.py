"""Queries that read whole tables and run the method that they are named for."""

import os

import pytest

from shelfmark.operators import pages as P
from shelfmark.plans import catalog

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@tables
def test_images_of_all_parts_are_found(spark):
    parts = {r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert any(k % 10 == 9 for k in parts)
    assert {r.page_id for r in catalog.queries()["candidate_images"](spark, SF).collect()} == parts


def test_the_counts_of_the_filter_come_from_the_filter(spark, monkeypatch):
    """The plan holds the filter's own steps, its order of distinct URLs included; a page of which nothing stays has a row."""
    seen = []
    own = P.filter_image_urls
    monkeypatch.setattr(P, "filter_image_urls", lambda *a, **k: seen.append(1) or own(*a, **k))
    gallery = lambda *urls: '<div class="gallery">' + "".join(f'<img src="{u}">' for u in urls) + "</div>"
    html = [gallery("/a.jpg", "/b.jpg", "/thumbnail/c.jpg"), gallery("/thumbnail/c.jpg"), gallery("/a.jpg", "https://s.example/a.jpg", "//s.example/a.jpg"), "", None]
    pages = spark.createDataFrame([(i, "https://s.example/p", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    stats = P.image_filter_stats(pages)
    assert seen and "row_number" in stats._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in stats.collect()} == {(0, 3, 2), (1, 1, 0), (2, 1, 1)}
    rows = spark.createDataFrame([(1, "https://s.example/p", i, u) for i, u in enumerate(["/thumbnail/x.jpg", "/b.jpg", "//s.example/b.jpg", "https://", "/a.jpg"])], "page_id long, url string, seq int, candidate string")
    assert sorted(map(tuple, own(rows).collect())) == [(1, 0, "https://s.example/b.jpg"), (1, 1, "https://s.example/a.jpg")]
    assert sorted(map(tuple, own(rows, rejected=True).collect())) == [(1, 0, "https://s.example/b.jpg", 2), (1, 1, "https://s.example/a.jpg", 1), (1, 2, None, 2)]
