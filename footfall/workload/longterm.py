"""Rollups, breakdown cube, long windows, retention and the inclusion tree."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from footfall.operators import history as h
from footfall.operators import merkle as mk
from footfall.operators import rollup as ru
from footfall.schema import BREAKDOWNS, ROLLUPS
from footfall.session import cut_lineage, stored
from footfall.workload.behaviour import AI, SOURCED, _CUR, _PAY, _SRC
from footfall.workload.metrics import PV, SESS, WHOLE, _DIM_SQL, _SERIES, kpi_sql, many_sites
from footfall.workload.registry import query
from footfall.workload.views import AS_OF, ctes

HORIZON = datetime(2024, 1, 20)

DAYSESS = """
dpv AS (SELECT *, CAST(ts AS DATE) AS day, epoch_us(ts) AS us FROM {hits} WHERE name = 'pageview'),
dmarked AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS st
  FROM dpv WINDOW w AS (PARTITION BY site_id, day, visitor_hash ORDER BY us, id)),
dnum AS (SELECT *, sum(st) OVER (PARTITION BY site_id, day, visitor_hash ORDER BY us, id) AS v FROM dmarked),
dsess AS (SELECT site_id, day, visitor_hash, v, count(*) AS views, arg_min(path, (us, id)) AS entry_path,
  arg_max(path, (us, id)) AS exit_path FROM dnum GROUP BY ALL),
dtot AS (SELECT site_id, day, CAST(sum(views) AS BIGINT) AS pageviews, count(DISTINCT visitor_hash) AS visitors,
  count(*) AS sessions, CAST(sum(CASE WHEN views = 1 THEN 1 ELSE 0 END) AS BIGINT) AS bounces FROM dsess GROUP BY ALL)"""
ROLL = """
roll AS (SELECT *, sha256(concat('{{"bounce_rate": ', CAST(bounce_rate AS VARCHAR), ', "day": "', CAST(day AS VARCHAR),
  '", "pageviews": ', CAST(pageviews AS VARCHAR), ', "sessions": ', CAST(sessions AS VARCHAR), ', "site_id": ',
  CAST(site_id AS VARCHAR), ', "visitors": ', CAST(visitors AS VARCHAR), '}}')) AS rollup_hash FROM (
  SELECT c.site_id, c.day, coalesce(pageviews, 0) AS pageviews, coalesce(visitors, 0) AS visitors, coalesce(sessions, 0) AS sessions,
    coalesce(CAST(round_even(bounces / sessions * 100, 0) AS BIGINT), 0) AS bounce_rate
  FROM {targets} c LEFT JOIN dtot d ON d.site_id = c.site_id AND d.day = c.day))"""
CAL = """(SELECT id AS site_id, CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM sites)"""


def rollups(t, hits=None, targets=None):
    targets = targets if targets is not None else ru.site_days(t.sites, date(2024, 1, 1), date(2024, 1, 30))
    r = ru.daily_rollup(hits if hits is not None else t.hits, targets)
    none = lambda c, ty: F.lit(None).cast(ty).alias(c)
    return r.select("*", none("merkle_root", "string"), none("merkle_proof", "string"),
                    none("txid", "string"), none("anchored_at", "timestamp_ntz"))


def _day():
    return F.date_format("day", "yyyy-MM-dd").alias("day")


@query("daily_rollup", ctes("hits", "sites", extra=DAYSESS.format(hits="hits") + "," + ROLL.format(targets=CAL)) + """
SELECT site_id, CAST(day AS VARCHAR) AS day, pageviews, visitors, sessions, CAST(bounce_rate AS DOUBLE) AS bounce_rate, rollup_hash FROM roll""")
def daily_rollup(t):
    return rollups(t).select("site_id", _day(), "pageviews", "visitors", "sessions", "bounce_rate", "rollup_hash")


@query("rollup_merge", ctes("hits", "sites", extra=DAYSESS.format(hits="hits") + "," + ROLL.format(targets=CAL)) + """
SELECT site_id, CAST(day AS VARCHAR) AS day, CASE WHEN day < DATE '2024-01-10' THEN 7 ELSE pageviews END AS pageviews,
  visitors, CASE WHEN day < DATE '2024-01-10' THEN 'tx' END AS txid FROM roll""")
def rollup_merge(t):
    fresh = rollups(t)
    sealed = F.col("day") < F.lit(date(2024, 1, 10))
    old = fresh.withColumn("pageviews", F.lit(7).cast("long")).withColumn("txid", F.when(sealed, "tx"))
    return ru.merge_rollups(old, fresh).select("site_id", _day(), "pageviews", "visitors", "txid")


CUBE = PV + """,
hd AS (SELECT *, CAST(ts AS DATE) AS day FROM hits),
pd AS (SELECT *, CAST(ts AS DATE) AS day FROM pv),""" + AI.lstrip() + """,
e1 AS (
  SELECT site_id, day, visitor_hash, 'page' AS dim, path AS key FROM pd
  UNION ALL SELECT site_id, day, visitor_hash, 'source', coalesce(referrer_src, 'direkte') FROM pd
    WHERE referrer_src IS NULL OR referrer_src <> concat('site', CAST(site_id AS VARCHAR), '.example')
  UNION ALL SELECT site_id, day, visitor_hash, 'country', coalesce(country, 'ukjent') FROM pd
  UNION ALL SELECT site_id, day, visitor_hash, 'region', coalesce(region, 'ukjent') FROM pd
  UNION ALL SELECT site_id, day, visitor_hash, 'device', coalesce(device, 'ukjent') FROM pd
  UNION ALL SELECT site_id, day, visitor_hash, 'browser', coalesce(browser, 'ukjent') FROM pd
  UNION ALL SELECT site_id, day, visitor_hash, 'os', coalesce(os, 'ukjent') FROM pd
  UNION ALL SELECT site_id, day, visitor_hash, 'campaign', concat('["', coalesce(utm_source, ''), '", "', coalesce(utm_medium, ''), '", "', coalesce(utm_campaign, ''), '"]')
    FROM pd WHERE utm_source IS NOT NULL OR utm_campaign IS NOT NULL
  UNION ALL SELECT site_id, CAST(ts AS DATE), visitor_hash, 'ai', assistant FROM ai
  UNION ALL SELECT site_id, CAST(ts AS DATE), visitor_hash, 'ai_total', '' FROM ai
  UNION ALL SELECT site_id, day, visitor_hash, 'event', name FROM hd WHERE name <> 'pageview'),
""" + DAYSESS.format(hits="hits").lstrip() + """,
""" + SOURCED + """,
od AS (SELECT *, CAST(ts AS DATE) AS day FROM os),
cube AS (
  SELECT site_id, day, dim, key, '' AS currency, count(*) AS n, count(DISTINCT visitor_hash) AS visitors, CAST(NULL AS BIGINT) AS revenue_cents FROM e1 GROUP BY ALL
  UNION ALL SELECT site_id, day, 'entry', entry_path, '', count(*), NULL, NULL FROM dsess GROUP BY ALL
  UNION ALL SELECT site_id, day, 'exit', exit_path, '', count(*), NULL, NULL FROM dsess GROUP BY ALL
  UNION ALL SELECT site_id, day, 'kpi', u.k, '', u.v, NULL, NULL FROM (
    SELECT h.site_id, h.day, unnest([{k: 'pageviews', v: coalesce(pageviews, 0)}, {k: 'visitors', v: coalesce(visitors, 0)},
      {k: 'sessions', v: coalesce(sessions, 0)}, {k: 'bounces', v: coalesce(bounces, 0)}]) AS u
    FROM (SELECT DISTINCT site_id, day FROM hd) h LEFT JOIN dtot USING (site_id, day))
  UNION ALL SELECT site_id, day, 'ecom', '', cur, count(*), NULL, CAST(sum(revenue_cents) AS BIGINT) FROM od GROUP BY ALL
  UNION ALL SELECT site_id, day, 'ecom_payment', method, cur, count(*), NULL, CAST(sum(revenue_cents) AS BIGINT) FROM od GROUP BY ALL
  UNION ALL SELECT site_id, day, 'ecom_source', source, cur, count(*), NULL, CAST(sum(revenue_cents) AS BIGINT) FROM od GROUP BY ALL
  UNION ALL SELECT site_id, CAST(ts AS DATE), 'product', name, coalesce(currency, 'NOK'), CAST(sum(qty) AS BIGINT), NULL, CAST(sum(qty * unit_price_cents) AS BIGINT) FROM items GROUP BY ALL
  UNION ALL SELECT site_id, day, 'bot', concat('["', bot_class, '", "', agent, '"]'), '', CAST(sum(n) AS BIGINT), NULL, NULL FROM bots GROUP BY ALL
  UNION ALL SELECT site_id, day, 'bot_ai_path', path, '', CAST(sum(n) AS BIGINT), NULL, NULL FROM bots WHERE bot_class = 'ai' AND path <> '' GROUP BY ALL)"""


def cube(t, window=None, cap=None, dims=None):
    return ru.breakdown_cube(t.hits, t.items, t.bots, t.sites, window, cap=cap, dims=dims)


@query("breakdown_cube", ctes("hits", "items", "bots", extra=CUBE) + """
SELECT site_id, CAST(day AS VARCHAR) AS day, dim, key, currency, n, visitors, revenue_cents FROM cube""")
def breakdown_cube(t):
    return cube(t).withColumn("day", _day())


@query("breakdown_cap", ctes("hits", "items", "bots", extra=CUBE) + """
SELECT site_id, CAST(day AS VARCHAR) AS day, dim, key, currency, n, visitors, revenue_cents FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, day, dim ORDER BY
    CASE WHEN dim IN ('ecom_source', 'ecom_payment', 'product') THEN revenue_cents ELSE n END DESC, key, currency) AS r FROM cube)
WHERE r <= 3 OR dim IN ('kpi', 'ecom', 'ai_total')""")
def breakdown_cap(t):
    return cube(t, cap=3).withColumn("day", _day())


@query("breakdown_cut", ctes("hits", "items", "bots", extra=CUBE) + """
SELECT site_id, CAST(day AS VARCHAR) AS day, dim, count(*) AS keys_cut, CAST(sum(n) AS BIGINT) AS n_cut FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, day, dim ORDER BY
    CASE WHEN dim IN ('ecom_source', 'ecom_payment', 'product') THEN revenue_cents ELSE n END DESC, key, currency) AS r FROM cube)
WHERE r > 3 AND dim NOT IN ('kpi', 'ecom', 'ai_total') GROUP BY ALL""")
def breakdown_cut(t):
    # What the limit of breakdown_cap leaves out.
    whole = cut_lineage(cube(t))
    return ru.cut_keys(whole, ru.cap_keys(whole, ["site_id", "day"], 3), ["site_id", "day"]).withColumn("day", _day())


@query("source_days", ctes("hits", "bots") + """
SELECT DISTINCT site_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM hits WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'
UNION SELECT site_id, CAST(day AS VARCHAR) FROM bots WHERE day >= DATE '2024-01-05' AND day < DATE '2024-01-25'""")
def source_days(t):
    return ru.source_days(t.hits, t.bots, date(2024, 1, 5), date(2024, 1, 25)).withColumn("day", _day())


@query("breakdown_merge", ctes("hits", "items", "bots", extra=CUBE) + """
SELECT site_id, CAST(day AS VARCHAR) AS day, dim, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT site_id, day, dim, n FROM cube WHERE day >= DATE '2024-01-01' AND (dim <> 'product' OR day < DATE '2024-02-01')
  UNION ALL SELECT 1, DATE '2023-12-31', 'page', 77 ) GROUP BY ALL""")
def breakdown_merge(t):
    # A stored day without raw rows must survive; stored days with raw rows are replaced.
    new = cube(t, (datetime(2024, 1, 1), datetime(2024, 1, 31)))
    stale = new.withColumn("n", F.col("n") * 0 - 5)
    gone = t.spark.createDataFrame([(1, date(2023, 12, 31), "page", "/old", "", 77, None, None)], BREAKDOWNS)
    out = ru.merge_breakdowns(stale.unionByName(gone), new, ru.source_families(t.hits, t.bots))
    return out.groupBy("site_id", "day", "dim").agg(F.sum("n").alias("n")).withColumn("day", _day())


@query("backfill_summary", ctes("hits", "bots") + """
SELECT count(*) AS site_days, count(DISTINCT site_id) AS sites, CAST(min(day) AS VARCHAR) AS first_day,
  CAST(max(day) AS VARCHAR) AS last_day, count(*) FILTER (day < DATE '2024-01-11') AS already_present
FROM (SELECT DISTINCT site_id, CAST(ts AS DATE) AS day FROM hits WHERE ts < TIMESTAMP '2024-01-30')""")
def backfill_summary(t):
    old = cube(t, (datetime(2024, 1, 1), datetime(2024, 1, 11)))
    return ru.backfill(t.hits, t.items, t.bots, t.sites, old, date(2024, 1, 30))[0]


@query("backfill", ctes("hits", "items", "bots", extra=CUBE) + """
SELECT site_id, dim, count(*) AS rows, CAST(sum(n) AS BIGINT) AS n FROM cube
WHERE day < DATE '2024-01-30' AND day >= DATE '2024-01-01' GROUP BY ALL""")
def backfill(t):
    empty = t.spark.createDataFrame([], BREAKDOWNS)
    out = ru.backfill(t.hits, t.items, t.bots, t.sites, empty, date(2024, 1, 30))[1]
    return out.groupBy("site_id", "dim").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))


def long_frame(t, *dims):
    """Stored days before the horizon, raw rows after it, as a long report sees them."""
    kept = cube(t, (datetime(2024, 1, 1), HORIZON), dims=dims)
    none = t.spark.createDataFrame([], ROLLUPS)
    return h.merged(kept, none, t.hits, t.items, t.bots, t.sites, WHOLE, HORIZON, dims)


@query("long_kpis", ctes("hits", extra=SESS) + kpi_sql())
def long_kpis(t):
    return h.long_kpis(long_frame(t, "kpi"))


@query("long_stats", ctes("hits", extra=PV + "," + _DIM_SQL) + """
SELECT site_id, dim, key, n, visitors FROM ranked WHERE r <= 10
UNION ALL SELECT site_id, 'campaign', key, n, u FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, key) AS r FROM (
  SELECT site_id, concat('["', coalesce(utm_source, ''), '", "', coalesce(utm_medium, ''), '", "', coalesce(utm_campaign, ''), '"]') AS key,
  count(*) AS n, count(DISTINCT visitor_hash) AS u FROM pv WHERE utm_source IS NOT NULL OR utm_campaign IS NOT NULL GROUP BY ALL)) WHERE r <= 10""")
def long_stats(t):
    return h.long_stats(long_frame(t, *h.STATS_DIMS))


@query("long_campaigns", ctes("hits", extra=PV) + """
SELECT site_id, source, medium, campaign, n, visitors FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, concat('["', source, '", "', medium, '", "', campaign, '"]')) AS r FROM (
    SELECT site_id, coalesce(utm_source, '') AS source, coalesce(utm_medium, '') AS medium, coalesce(utm_campaign, '') AS campaign,
      count(*) AS n, count(DISTINCT visitor_hash) AS visitors FROM pv WHERE utm_source IS NOT NULL OR utm_campaign IS NOT NULL GROUP BY ALL)) WHERE r <= 10""")
def long_campaigns(t):
    return h.long_campaigns(long_frame(t, "campaign"))


@query("long_flow", ctes("hits", extra=SESS) + """
SELECT site_id, kind, path, n FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, kind ORDER BY n DESC, path) AS r FROM (
    SELECT site_id, 'entry' AS kind, entry_path AS path, count(*) AS n FROM sess GROUP BY ALL
    UNION ALL SELECT site_id, 'exit', exit_path, count(*) FROM sess GROUP BY ALL)) WHERE r <= 10""")
def long_flow(t):
    return h.long_flow(long_frame(t, "entry", "exit"))


@query("long_breakdown", ctes("hits", extra=PV + "," + _DIM_SQL) + """
SELECT site_id, key AS value, n AS pageviews, visitors FROM counted WHERE dim = 'country'""")
def long_breakdown(t):
    return h.long_breakdown(long_frame(t, "country"), "countries")


@query("long_events", ctes("hits") + """
SELECT site_id, name AS event, count(*) AS n, count(DISTINCT visitor_hash) AS visitors FROM hits WHERE name <> 'pageview' GROUP BY ALL""")
def long_events(t):
    return h.long_events(long_frame(t, "event"))


@query("long_orders", ctes("hits", extra=SOURCED) + _CUR)
def long_orders(t):
    return h.long_orders(long_frame(t, "ecom"))


@query("long_revenue_by_source", ctes("hits", extra=SOURCED) + _SRC)
def long_revenue_by_source(t):
    return h.long_revenue_by_source(long_frame(t, "ecom_source"), None, None)


@query("long_revenue_by_payment", ctes("hits", extra=SOURCED) + _PAY)
def long_revenue_by_payment(t):
    return h.long_revenue_by_payment(long_frame(t, "ecom_payment"), None, None)


@query("long_products", ctes("items") + """
SELECT site_id, coalesce(currency, 'NOK') AS currency, name AS product, CAST(sum(qty) AS BIGINT) AS qty,
  CAST(sum(qty * unit_price_cents) AS BIGINT) AS revenue_cents FROM items GROUP BY ALL""")
def long_products(t):
    window, cut = (datetime(1992, 1, 1), datetime(2010, 1, 1)), datetime(1999, 1, 1)
    kept = cube(t, (window[0], cut), None, ["product"])
    none = t.spark.createDataFrame([], ROLLUPS)
    m = h.merged(kept, none, t.hits, t.items, t.bots, t.sites, window, cut, ["product"])
    return h.long_products(m, None, None)


@query("long_ai_referrals", ctes("hits", extra=PV + "," + AI) + """
SELECT site_id, count(DISTINCT visitor_hash) AS visitors, count(*) AS views FROM ai GROUP BY site_id""")
def long_ai_referrals(t):
    return h.long_ai_referrals(long_frame(t, "ai_total"))


@query("long_ai_sources", ctes("hits", extra=PV + "," + AI) + """
SELECT site_id, assistant, CASE assistant WHEN 'chatgpt.com' THEN 'ChatGPT' WHEN 'perplexity.ai' THEN 'Perplexity' END AS name,
  count(DISTINCT visitor_hash) AS visitors, count(*) AS views FROM ai GROUP BY ALL""")
def long_ai_sources(t):
    return h.long_ai_sources(long_frame(t, "ai"))


@query("long_bot_summary", ctes("bots") + """
, a AS (SELECT site_id, 'agents' AS section, bot_class, agent AS key, CAST(sum(n) AS BIGINT) AS n FROM bots GROUP BY ALL),
p AS (SELECT site_id, 'ai_paths' AS section, 'ai' AS bot_class, path AS key, CAST(sum(n) AS BIGINT) AS n FROM bots
  WHERE bot_class = 'ai' AND path <> '' GROUP BY ALL),
u AS (SELECT * FROM a UNION ALL SELECT * FROM p)
SELECT site_id, 'total' AS section, '' AS bot_class, '' AS key, CAST(sum(n) AS BIGINT) AS n FROM bots GROUP BY ALL
UNION ALL SELECT site_id, 'classes', bot_class, bot_class, CAST(sum(n) AS BIGINT) FROM bots GROUP BY ALL
UNION ALL SELECT site_id, section, bot_class, key, n FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, section ORDER BY n DESC, key, bot_class) AS r FROM u) WHERE r <= 10""")
def long_bot_summary(t):
    return h.long_bot_summary(long_frame(t, "bot", "bot_ai_path"))


@query("long_goals", ctes("hits", "goals") + """
, base AS (SELECT site_id, count(DISTINCT visitor_hash) AS b FROM hits WHERE name = 'pageview' GROUP BY 1),
done AS (SELECT g.site_id, g.id, g.name, g.match_type, g.match_value, count(DISTINCT h.visitor_hash) AS completions
FROM goals g LEFT JOIN hits h ON h.site_id = g.site_id AND
  ((g.match_type = 'event' AND h.name = g.match_value) OR (g.match_type <> 'event' AND h.name = 'pageview' AND h.path = g.match_value))
GROUP BY ALL)
SELECT done.*, round_even(completions / b * 100, 1) AS rate FROM done JOIN base USING (site_id)""")
def long_goals(t):
    return h.long_goals(long_frame(t, "kpi", "event", "page"), t.goals)


@query("long_series", ctes("hits", "sites") + _SERIES.replace("FROM hits", "FROM hits WHERE name = 'pageview'").format(
    fmt="%Y-%m-%d", out="day", grain="day", first="2023-12-02", last="2024-01-30"))
def long_series(t):
    kept = cube(t, (datetime(2024, 1, 1), HORIZON), dims=["kpi"])
    return h.long_series(kept, t.spark.createDataFrame([], ROLLUPS), t.hits, t.sites, 60, AS_OF, HORIZON)


@query("stored_kpis", ctes("hits", "sites", extra=DAYSESS.format(hits="hits") + "," + ROLL.format(targets=CAL)) + """
SELECT r.site_id, CAST(r.day AS VARCHAR) AS day, r.pageviews, r.visitors, r.sessions,
  CASE WHEN r.day >= DATE '2024-01-11' AND d.pageviews IS NOT NULL THEN d.bounces
    ELSE CAST(round_even(CAST(r.bounce_rate AS DOUBLE) * r.sessions / 100, 0) AS BIGINT) END AS bounces
FROM roll r LEFT JOIN dtot d ON d.site_id = r.site_id AND d.day = r.day WHERE r.day < DATE '2024-01-20'""")
def stored_kpis(t):
    kept = cube(t, (datetime(2024, 1, 11), HORIZON), dims=["kpi"])
    k = h.stored_kpis(kept, rollups(t), (datetime(2024, 1, 1), HORIZON))
    return k.withColumn("day", _day())


@query("retention_summary", ctes("hits", "sites") + """
SELECT count(*) AS deleted, count(DISTINCT (site_id, CAST(ts AS DATE))) FILTER (ts >= TIMESTAMP '2024-01-06') AS sealed
FROM hits WHERE ts < TIMESTAMP '2024-01-20'""")
def retention_summary(t):
    return _swept(t)["summary"]


def _swept(t):
    known = rollups(t, targets=ru.site_days(t.sites, date(2024, 1, 1), date(2024, 1, 5)))
    kept = cube(t, (datetime(2024, 1, 1), datetime(2024, 1, 6)))
    return ru.retention(t.hits, t.items, t.bots, t.sites, known, kept, AS_OF, days=10)


@query("retention_tables", ctes("hits", "items", "bots", "sites", extra=CUBE) + """
SELECT 'hits' AS part, site_id, count(*) AS rows FROM hits WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL
UNION ALL SELECT 'items', site_id, count(*) FROM items WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL
UNION ALL SELECT 'bots', site_id, count(*) FROM bots WHERE day >= DATE '2024-01-20' GROUP BY ALL
UNION ALL SELECT 'rollups', site_id, count(*) FROM (SELECT DISTINCT site_id, CAST(ts AS DATE) FROM hits WHERE ts < TIMESTAMP '2024-01-20'
  UNION SELECT id, CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-05', INTERVAL 1 DAY)) AS DATE) FROM sites) GROUP BY ALL
UNION ALL SELECT 'breakdowns', site_id, count(*) FROM cube WHERE day < DATE '2024-01-20' AND day >= DATE '2024-01-01' GROUP BY ALL""")
def retention_tables(t):
    from footfall.operators.frames import union_all

    swept = _swept(t)
    return union_all([
        swept[p].groupBy("site_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(p).alias("part"), "site_id", "rows")
        for p in ("hits", "items", "bots", "rollups", "breakdowns")])


@query("recent_rollups", ctes("hits", "sites", extra=DAYSESS.format(hits="hits") + "," + ROLL.format(targets=CAL)) + """
SELECT site_id, CAST(day AS VARCHAR) AS day, pageviews, visitors, rollup_hash FROM roll WHERE day > DATE '2024-01-16'""")
def recent_rollups(t):
    return ru.recent_rollups(rollups(t)).drop("txid").withColumn("day", _day())


@query("seal_audit", ctes("hits", "sites", extra=DAYSESS.format(hits="hits") + "," + ROLL.format(targets=CAL)) + """
SELECT site_id, CAST(day AS VARCHAR) AS day, CASE WHEN visitors > 8 THEN 0 ELSE 1 END AS intact FROM roll""")
def seal_audit(t):
    tampered = rollups(t).withColumn(
        "pageviews", F.when(F.col("visitors") > 8, F.col("pageviews") + 1).otherwise(F.col("pageviews")))
    return ru.seal_audit(tampered).select("site_id", _day(), F.col("intact").cast("int").alias("intact"))


# --- the tree over very many site days -------------------------------------------------------

_MH = """
mh AS (SELECT h.* REPLACE (1 + h.id % (SELECT count(*) FROM customer) AS site_id) FROM hits h),
targets AS (SELECT DISTINCT site_id, CAST(ts AS DATE) AS day FROM mh)"""
_LEAVES = _MH + "," + DAYSESS.format(hits="mh") + "," + ROLL.format(targets="targets") + """,
leaves AS (SELECT *, row_number() OVER (ORDER BY site_id, day) - 1 AS idx FROM roll),
l0 AS (SELECT idx, unhex(sha256(unhex('00') || unhex(rollup_hash))) AS h FROM leaves)"""
_LEVELS_SQL = "".join(f""",
l{i + 1} AS (SELECT idx // 2 AS idx, CASE WHEN count(*) = 2
  THEN unhex(sha256(unhex('01') || min(h) FILTER (idx % 2 = 0) || min(h) FILTER (idx % 2 = 1))) ELSE min(h) END AS h
  FROM l{i} GROUP BY idx // 2)""" for i in range(18))


def many_rollups(t):
    hits, _ = many_sites(t)
    targets = hits.select("site_id", F.to_date("ts").alias("day")).distinct()
    return rollups(t, hits, targets)


@query("pending_leaves", ctes("hits", extra=_LEAVES) + """
SELECT idx, site_id, CAST(day AS VARCHAR) AS day, rollup_hash FROM leaves""")
def pending_leaves(t):
    return mk.pending_leaves(many_rollups(t)).withColumn("day", _day())


@query("merkle_root", ctes("hits", extra=_LEAVES + _LEVELS_SQL) + "SELECT lower(hex(h)) AS root FROM l18")
def merkle_root(t):
    return mk.merkle_root(mk.pending_leaves(many_rollups(t)))


@query("merkle_proofs", ctes("hits", extra=_LEAVES + _LEVELS_SQL) + """
, steps AS (""" + " UNION ALL ".join(
    f"SELECT a.idx AS leaf, {i} AS lvl, lower(hex(s.h)) AS sib, (a.idx >> {i}) % 2 = 0 AS right FROM leaves a JOIN l{i} s ON s.idx = xor(a.idx >> {i}, 1)"
    for i in range(18)) + """)
SELECT l.idx, l.site_id, string_agg(concat(CASE WHEN s.right THEN 'R' ELSE 'L' END, s.sib), ',' ORDER BY s.lvl) AS proof
FROM leaves l LEFT JOIN steps s ON s.leaf = l.idx GROUP BY ALL""")
def merkle_proofs(t):
    p = mk.merkle_proofs(mk.pending_leaves(many_rollups(t)))
    text = F.transform("proof", lambda s: F.concat(F.when(s["right"], "R").otherwise("L"), s["sibling"]))
    return p.select("idx", "site_id", F.array_join(text, ",").alias("proof"))


# Three quarters of the leaves are a stored tree, the last quarter comes later.
_SPLIT = """
, s AS (SELECT count(*) AS n, 3 * count(*) // 4 AS cut FROM leaves)"""


def _grown(t):
    leaves = stored(mk.pending_leaves(many_rollups(t)), "leaves")
    cut = 3 * leaves.count() // 4
    old = stored(mk.grown(t.spark.createDataFrame([], mk.TREE), leaves.where(F.col("idx") < cut)), "tree")
    more = mk.grown(old, leaves.where(F.col("idx") >= cut))
    return leaves, more, stored(mk.with_blocks(old, more), "tree")


@query("merkle_grown", ctes("hits", extra=_LEAVES + _LEVELS_SQL) + _SPLIT + """
SELECT (SELECT lower(hex(h)) FROM l18) AS root, CAST(((n - 1) >> 10) - (cut >> 10) + 1 + CASE WHEN n > 1024 THEN ((n - 1) >> 20) - (cut >> 20) + 1 ELSE 0 END AS BIGINT) AS written FROM s""")
def merkle_grown(t):
    """Root after growth, and how many blocks the growth wrote."""
    _, more, tree = _grown(t)
    return mk.tree_root(tree).withColumn("written", more.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("merkle_lookups", ctes("hits", extra=_LEAVES + _LEVELS_SQL) + """
, steps AS (""" + " UNION ALL ".join(
    f"SELECT a.idx AS leaf, {i} AS lvl, lower(hex(s.h)) AS sib, (a.idx >> {i}) % 2 = 0 AS right FROM leaves a JOIN l{i} s ON s.idx = xor(a.idx >> {i}, 1)"
    for i in range(18)) + """)
SELECT l.idx, l.site_id, string_agg(concat(CASE WHEN s.right THEN 'R' ELSE 'L' END, s.sib), ',' ORDER BY s.lvl) AS proof
FROM (SELECT site_id, max(idx) AS idx FROM leaves GROUP BY 1) l LEFT JOIN steps s ON s.leaf = l.idx GROUP BY ALL""")
def merkle_lookups(t):
    """Proof of every site's newest day, looked up in the grown tree."""
    leaves, _, tree = _grown(t)
    p = mk.tree_proofs(tree, leaves.groupBy("site_id").agg(F.max("idx").alias("idx")))
    text = F.transform("proof", lambda s: F.concat(F.when(s["right"], "R").otherwise("L"), s["sibling"]))
    return p.select("idx", "site_id", F.array_join(text, ",").alias("proof"))


@query("anchor_verified", ctes("hits", extra=_LEAVES) + """
SELECT site_id, CAST(day AS VARCHAR) AS day, 1 AS valid FROM leaves""")
def anchor_verified(t):
    anchored = mk.attach_anchor(many_rollups(t), "tx1", "2024-02-01 00:00:00")
    return mk.verify_proofs(anchored).select("site_id", _day(), F.col("valid").cast("int").alias("valid"))


@query("proof_documents", ctes("hits", "sites", extra=DAYSESS.format(hits="hits") + "," + ROLL.format(targets=CAL)) + """
SELECT r.site_id, CAST(day AS VARCHAR) AS day, concat('{"domain":"', s.domain, '","day":"', CAST(day AS VARCHAR), '","payload":{"site_id":', CAST(r.site_id AS VARCHAR),
  ',"day":"', CAST(day AS VARCHAR), '","pageviews":', CAST(pageviews AS VARCHAR), ',"visitors":', CAST(visitors AS VARCHAR), ',"sessions":', CAST(sessions AS VARCHAR),
  ',"bounce_rate":', CAST(bounce_rate AS VARCHAR), '},"rollup_hash":"', rollup_hash, '","merkle":{},"chain":{"status":"venter"}}') AS document
FROM roll r JOIN sites s ON s.id = r.site_id""")
def proof_documents(t):
    return mk.proof_documents(rollups(t), t.sites).withColumn("day", _day())
