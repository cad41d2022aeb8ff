"""Sessions, transitions and funnels against plain loops, with one visitor who makes most hits."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators.commerce import revenue_by_source
from footfall.operators.funnels import funnel, reached
from footfall.operators.metrics import goal_stats, kpis
from footfall.operators.sessions import entry_exit, sessionize, transitions

T0 = datetime(2024, 3, 1)
SCHEMA = "id long, site_id long, visitor_hash string, ts timestamp_ntz, name string, path string"
FUNNELS = [
    (1, 1, "a", '[{"type":"path","value":"/"},{"type":"path","value":"/a"},{"type":"event","value":"buy"}]'),
    (2, 1, "twice", '[{"type":"path","value":"/a"},{"type":"path","value":"/a"},{"type":"event","value":"pageview"}]'),
    (3, 1, "broken", "not json"),
]


def make_rows(seed=3):
    rng = random.Random(seed)
    rows, i = [], 0
    for v in range(25):
        t = T0 + timedelta(seconds=rng.randrange(3000))
        for _ in range(600 if v == 0 else rng.randrange(1, 20)):
            gap = rng.choice([0, 0.2, 1, 20, 59.9, 60, 300, 1799.999999, 1800, 1800.000001, 2000, 7200])
            t += timedelta(microseconds=round(gap * 1_000_000))
            rows.append((i, 1 + v % 2 if v else 1, f"v{v}", t, rng.choice(["pageview", "pageview", "pageview", "buy"]),
                         rng.choice(["/", "/a", "/b", "/c"])))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def hits(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_visitor(rows, views_only=True):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        if r[4] == "pageview" or not views_only:
            out.setdefault((r[1], r[2]), []).append(r)
    return out


def split(seq):
    visits = [[seq[0]]]
    for a, b in zip(seq, seq[1:]):
        if b[3] - a[3] > timedelta(seconds=1800):
            visits.append([])
        visits[-1].append(b)
    return visits


def test_sessions(rows, hits):
    want = set()
    for (site, v), seq in by_visitor(rows).items():
        for n, s in enumerate(split(seq), 1):
            want.add((site, v, n, len(s), s[0][5], s[-1][5]))
    got = {(r.site_id, r.visitor_hash, r.visit_no, r.views, r.entry_path, r.exit_path)
           for r in sessionize(hits, paths=True).collect()}
    assert got == want
    k = {r.site_id: (r.pageviews, r.visitors, r.sessions) for r in kpis(hits).collect()}
    for site in (1, 2):
        mine = [w for w in want if w[0] == site]
        assert k[site] == (sum(w[3] for w in mine), len({w[1] for w in mine}), len(mine))


def test_entry_exit_is_every_session_once(hits):
    n = sessionize(hits).count()
    got = {r.kind: r.n for r in entry_exit(hits, limit=None).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert got == {"entry": n, "exit": n}


def test_transitions(rows, hits):
    want = {}
    for (site, _), seq in by_visitor(rows).items():
        for s in split(seq):
            for a, b in zip(s, s[1:]):
                if a[5] != b[5]:
                    want[site, a[5], b[5]] = want.get((site, a[5], b[5]), 0) + 1
    got = {(r.site_id, r.from_path, r.to_path): r.n for r in transitions(hits, limit=None).collect()}
    assert got == want


def walk(seq, steps):
    at = 0
    for r in seq:
        if at < len(steps):
            kind, value = steps[at]
            at += r[4] == value if kind == "event" else (r[4] == "pageview" and r[5] == value)
    return at


def test_funnels(spark, rows, hits):
    f = spark.createDataFrame(FUNNELS, "id long, site_id long, name string, steps string")
    steps = {1: [("path", "/"), ("path", "/a"), ("event", "buy")], 2: [("path", "/a"), ("path", "/a"), ("event", "pageview")]}
    want = {
        (fid, v): walk(seq, s) for (site, v), seq in by_visitor(rows, False).items() if site == 1 for fid, s in steps.items()}
    got = {(r.funnel_id, r.visitor_hash): r.reached for r in reached(hits, f).collect()}
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}
    table = {(r.funnel_id, r.step): r.visitors for r in funnel(hits, f).collect()}
    assert table == {(fid, i + 1): sum(1 for (g, _), n in want.items() if g == fid and n > i) for fid in steps for i in range(3)}


def test_goals(spark, rows, hits):
    g = spark.createDataFrame(
        [(1, 1, "x", "path", "/a"), (2, 1, "y", "event", "buy"), (3, 2, "z", "event", "never")],
        "id long, site_id long, name string, match_type string, match_value string")
    got = {r.id: r.completions for r in goal_stats(hits, g).collect()}
    site1 = [r for r in rows if r[1] == 1]
    assert got == {
        1: len({r[2] for r in site1 if r[4] == "pageview" and r[5] == "/a"}),
        2: len({r[2] for r in site1 if r[4] == "buy"}), 3: 0}


def test_first_touch(spark):
    def at(s):
        return T0 + timedelta(seconds=s)

    rows = [
        (1, 1, "a", at(0), "pageview", "google.com", None, None), (2, 1, "a", at(5), "pageview", "bing.com", None, None),
        (3, 1, "a", at(9), "buy", "checkout.stripe.com", None, 100),
        (4, 1, "b", at(0), "buy", None, None, 50), (5, 1, "b", at(1), "pageview", "x.no", "mail", None),
        (6, 1, "b", at(1), "buy", None, None, 25), (7, 1, "c", at(0), "pageview", "pay.klarna.com", None, None),
        (8, 1, "c", at(2), "buy", None, None, 7)]
    df = spark.createDataFrame(
        rows, "id long, site_id long, visitor_hash string, ts timestamp_ntz, name string, referrer_src string, utm_source string, revenue_cents long"
    ).withColumn("currency", F.lit(None).cast("string"))
    got = {r.source: (r.orders, r.revenue_cents) for r in revenue_by_source(df).collect()}
    assert got == {"google.com": (1, 100), "mail": (1, 25), "direkte": (2, 57)}
