"""Equal times and repeated rows settle alike in every run; definitions removed by key."""

from __future__ import annotations

import random

from footfall.operators.funnels import drop_definitions
from footfall.operators.text import upsert_pages
from footfall.sources.search_feeds import upsert_search

PAGE = "path string, title string, content string, fetched_at long"
STAT = "site_id long, day string, source string, dim string, key string, clicks long, impressions long, position double"


def test_pages_fetched_at_one_time(spark):
    old = spark.createDataFrame([("/a", "t", "zzz", 5), ("/b", "t", "kept", 9), ("/c", None, None, 5)], PAGE)
    new = [("/a", "t", "aaa", 5), ("/a", "t", "bbb", 5), ("/b", "t", "late", 8), ("/c", "t", "c", 5)]
    for seed in range(3):
        random.Random(seed).shuffle(new)
        got = {r.path: r.content for r in upsert_pages(old, spark.createDataFrame(new, PAGE)).collect()}
        assert got == {"/a": "bbb", "/b": "kept", "/c": "c"}


def test_repeated_fresh_search_rows(spark):
    key = (1, "2024-01-01", "google", "total", "")
    old = spark.createDataFrame([(*key, 99, 99, 1.0)], STAT)
    for rows in ([(3, 5), (4, 1), (4, 2)], [(4, 2), (3, 5), (4, 1)]):
        r = upsert_search(old, spark.createDataFrame([(*key, c, i, 2.0) for c, i in rows], STAT)).collect()
        assert [(x.clicks, x.impressions) for x in r] == [(4, 2)]


def test_definitions_go_by_site_and_id(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, None, "d")], "site_id long, id long, name string")
    gone = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "site_id long, id long")
    assert sorted(r.name for r in drop_definitions(old, gone).collect()) == ["b", "c", "d"]
