"""The burst operator on hand-worked waves, against the first fire in SQL, and under other part lengths."""

import random

import pytest
from pyspark.sql import functions as F

from footfall.operators.bursts import RULE, S, BurstRule, find_bursts

SCHEMA = "site_id long, visitor_hash string, us long, id long, path string, country string, tagged boolean"
T0 = 1_700_000_000 * S


FIRST_FIRE = """
WITH s AS (SELECT * FROM landings WHERE country <> '' AND path <> '/' AND NOT tagged),
pairs AS (
  SELECT t.site_id, t.country, t.us AS at_us, t.id AS at_id, c.path, count(*) AS near, count(*) FILTER (c.us <= t.us) AS pool
  FROM s t JOIN s c ON c.site_id = t.site_id AND c.country = t.country AND c.us BETWEEN t.us - {w} AND t.us + {a} GROUP BY ALL),
lone AS (SELECT site_id, country, at_us, at_id, count(*) AS lone FROM pairs WHERE near = 1 AND pool = 1 GROUP BY ALL),
usual AS (
  SELECT l.*, (SELECT count(*) FROM landings c WHERE c.site_id = l.site_id AND c.country = l.country
    AND c.us >= l.at_us - {w} - {b} AND c.us < l.at_us - {w}) AS base FROM lone l),
fire AS (
  SELECT *, row_number() OVER (PARTITION BY site_id, country ORDER BY at_us, at_id) AS r FROM usual
  WHERE lone >= {least} AND lone >= {factor} * base * {w} / {b})
SELECT f.site_id, f.country, f.at_us, list_sort(list(s.id)) AS ids FROM fire f
JOIN s ON s.site_id = f.site_id AND s.country = f.country AND s.us BETWEEN f.at_us - {w} AND f.at_us
JOIN pairs p ON p.at_id = f.at_id AND p.at_us = f.at_us AND p.site_id = f.site_id AND p.country = f.country AND p.path = s.path AND p.near = 1
WHERE f.r = 1 GROUP BY ALL"""


def first_fires(rows, rule):
    """{(site, country): (time, ids)}: until a series fires, nothing is taken out of it, so the first
    fire can be said in SQL."""
    import duckdb
    import pandas as pd

    landings = pd.DataFrame(rows, columns=["site_id", "visitor_hash", "us", "id", "path", "country", "tagged"])  # noqa: F841
    sql = FIRST_FIRE.format(
        w=rule.window * S, a=rule.lookahead * S, b=rule.baseline * S, least=rule.min_unique, factor=rule.rate_factor)
    return {(r[0], r[1]): (r[2], r[3]) for r in duckdb.sql(sql).fetchall()}


def check_first_fires(rows, got, rule):
    at = {r[3]: (r[0], r[5], r[2]) for r in rows}
    fires = first_fires(rows, rule)
    by = {}
    for i in got:
        by.setdefault(at[i][:2], []).append(i)
    assert by.keys() == fires.keys()
    for key, (t, ids) in fires.items():
        assert sorted(i for i in by[key] if at[i][2] <= t) == ids


def run(spark, rows, rule=RULE, horizon=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(r.id for r in find_bursts(df, rule, horizon=horizon).collect())


def wave(n, step=0.45, at=0.0, path=None, country="US", tagged=False, site=1, first=0):
    return [
        (site, f"h{first + i}", T0 + int((at + i * step) * S), first + i,
         path(i) if path else f"/deep/{first + i}", country, tagged)
        for i in range(n)
    ]


CASES = {
    "whole wave": (wave(20), 20),
    "threshold": (wave(8, 1), 8),
    "one less": (wave(7, 1), 0),
    "same page": (wave(60, 0.3, path=lambda i: "/kampanje"), 0),
    "tagged links": (wave(60, 0.4, path=lambda i: f"/artikkel/{i % 12}", tagged=True), 0),
    "few pages": (wave(40, 0.3, path=lambda i: f"/artikkel/{i % 12}"), 0),
    "eight pages": (wave(8, 0.3), 8),
    "opened again": (wave(8, 0.3, path=lambda i: f"/a/{i}") + wave(8, 0.3, 2.4, path=lambda i: f"/a/{i}", first=10), 0),
    "one person": (wave(1), 0),
    "trickle": (wave(30, 6), 0),
    "front page": (wave(30, 0.3, path=lambda i: "/"), 0),
    "no country": (wave(30, 0.3, country=None), 0),
    "two countries": (wave(7, 1) + wave(7, 1, 0.5, country="DE", first=20), 0),
    "two sites": (wave(7, 1) + wave(7, 1, 0.5, site=2, first=20), 0),
    "slows down": (wave(10, 0.5) + wave(3, 10, 8, first=100), 13),
    "minute later": (wave(10, 0.5) + wave(1, 1, 98, first=200), 10),
}


@pytest.mark.parametrize("case", list(CASES))
def test_cases(spark, case):
    rows, n = CASES[case]
    got = run(spark, rows)
    assert len(got) == n
    check_first_fires(rows, got, RULE)


def test_busy_country_is_business_as_usual(spark):
    usual = wave(3000, 0.6, -1815, path=lambda i: "/")
    assert run(spark, usual + wave(12, 0.5, first=5000)) == []


def test_horizon_only_looks_ahead(spark):
    rows = wave(20, 0.5)
    got = run(spark, rows, horizon=T0 + 5 * S)
    assert got == run(spark, [r for r in rows if r[2] <= T0 + (5 + RULE.lookahead) * S], horizon=T0 + 5 * S)
    assert got and max(r[2] for r in rows if r[3] in got) <= T0 + 5 * S


def test_random_series_across_parts(spark, monkeypatch):
    """Short parts, so that bursts, exclusions and state cross many part borders."""
    rule = BurstRule(window=15, lookahead=5, min_unique=4, rate_factor=3, baseline=60, extend=30)
    rng = random.Random(7)
    rows = []
    for site in range(40):
        t, i = 0.0, 0
        calm = rng.choice([2, 6, 12])
        while t < 900:
            t += rng.expovariate(1 / (rng.choice([0.5, calm, calm * 3])))
            path = rng.choice(["/", f"/p/{rng.randrange(30)}", f"/q/{rng.randrange(500)}"])
            rows.append((site, f"{site}-{i}", T0 + int(t * S), site * 10_000 + i, path, rng.choice(["US", "US", "NO", None]),
                         rng.random() < 0.1))
            i += 1
    got = run(spark, rows, rule)
    assert len(got) > 500
    check_first_fires(rows, got, rule)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert run(spark, shuffled, rule) == got
    # One part that holds all: the same rule in a single ordered pass.
    monkeypatch.setattr(BurstRule, "part_us", property(lambda self: 10**15))
    assert run(spark, rows, rule) == got
