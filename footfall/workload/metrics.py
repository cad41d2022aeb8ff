"""Totals, breakdowns, series and per-tenant reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions.numbers import delta
from footfall.functions.timewin import period_window
from footfall.operators import metrics as m
from footfall.operators import sessions as s
from footfall.workload.registry import query
from footfall.workload.views import AS_OF, ctes

WHOLE = period_window(30, AS_OF)

PV = "pv AS (SELECT *, epoch_us(ts) AS us FROM hits WHERE name = 'pageview')"
SESS = PV + """,
marked AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS st
  FROM pv WINDOW w AS (PARTITION BY site_id, visitor_hash ORDER BY us, id)),
numbered AS (SELECT *, sum(st) OVER (PARTITION BY site_id, visitor_hash ORDER BY us, id) AS visit_no FROM marked),
sess AS (SELECT site_id, visitor_hash, CAST(visit_no AS BIGINT) AS visit_no, min(us) AS first_us, max(us) AS last_us,
  count(*) AS views, arg_min(path, (us, id)) AS entry_path, arg_max(path, (us, id)) AS exit_path
  FROM numbered GROUP BY ALL)"""


def kpi_sql(where: str = "TRUE") -> str:
    return f"""
SELECT site_id, CAST(sum(views) AS BIGINT) AS pageviews, count(DISTINCT visitor_hash) AS visitors,
  count(*) AS sessions,
  CAST(round_even(sum(CASE WHEN views = 1 THEN 1 ELSE 0 END) / count(*) * 100, 0) AS BIGINT) AS bounce_rate,
  round_even(sum(views) / count(*), 1) AS views_per_session
FROM sess WHERE {where} GROUP BY site_id"""


@query("kpis", ctes("hits", extra=SESS) + kpi_sql())
def kpis(t):
    return m.kpis(t.hits, WHOLE)


@query("sessionize", ctes("hits", extra=SESS) + """
SELECT site_id, visitor_hash, visit_no, first_us, last_us, views, entry_path, exit_path FROM sess""")
def sessionize(t):
    return s.sessionize(t.hits, WHOLE, paths=True).select(
        "site_id", "visitor_hash", "visit_no", "first_us", "last_us", "views", "entry_path", "exit_path")


@query("entry_exit", ctes("hits", extra=SESS) + """
SELECT site_id, kind, path, n FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, kind ORDER BY n DESC, path) AS r FROM (
    SELECT site_id, 'entry' AS kind, entry_path AS path, count(*) AS n FROM sess GROUP BY ALL
    UNION ALL SELECT site_id, 'exit', exit_path, count(*) FROM sess GROUP BY ALL)) WHERE r <= 10""")
def entry_exit(t):
    return s.entry_exit(t.hits, WHOLE)


@query("transitions", ctes("hits", extra=PV) + """
SELECT site_id, from_path, to_path, n FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, from_path, to_path) AS r FROM (
    SELECT site_id, from_path, path AS to_path, count(*) AS n FROM (
      SELECT site_id, path, lag(path) OVER w AS from_path, us - lag(us) OVER w AS gap
      FROM pv WINDOW w AS (PARTITION BY site_id, visitor_hash ORDER BY us, id))
    WHERE gap <= 1800000000 AND from_path <> path GROUP BY ALL)) WHERE r <= 12""")
def transitions(t):
    return s.transitions(t.hits, WHOLE)


@query("same_page_dedupe", ctes("hits", extra=PV) + """
SELECT id, site_id, path, CASE WHEN prev IS NULL THEN referrer_src
  ELSE concat('https://site', CAST(site_id AS VARCHAR), '.example', prev) END AS referrer
FROM (SELECT *, lag(path) OVER (PARTITION BY site_id, visitor_hash ORDER BY us, id) AS prev FROM pv)
WHERE prev IS NULL OR prev <> path""")
def same_page_dedupe(t):
    nav = t.hits.where("name = 'pageview'").select(
        "id", "site_id", "visitor_hash", "ts", F.col("path").alias("page"),
        F.concat(F.lit("https://site"), F.col("site_id").cast("string"), F.lit(".example")).alias("origin"),
        F.col("referrer_src").alias("referrer"))
    return s.without_reloads(nav, ["site_id", "visitor_hash"]).select(
        "id", "site_id", F.col("page").alias("path"), "referrer")


_DIM_SQL = """
dims AS (
  SELECT site_id, visitor_hash, 'page' AS dim, path AS key FROM pv
  UNION ALL SELECT site_id, visitor_hash, 'source', coalesce(referrer_src, 'direkte') FROM pv
    WHERE referrer_src IS NULL OR referrer_src NOT IN (concat('site', CAST(site_id AS VARCHAR), '.example'), concat('www.site', CAST(site_id AS VARCHAR), '.example'))
  UNION ALL SELECT site_id, visitor_hash, 'country', coalesce(country, 'ukjent') FROM pv
  UNION ALL SELECT site_id, visitor_hash, 'region', coalesce(region, 'ukjent') FROM pv
  UNION ALL SELECT site_id, visitor_hash, 'device', coalesce(device, 'ukjent') FROM pv
  UNION ALL SELECT site_id, visitor_hash, 'browser', coalesce(browser, 'ukjent') FROM pv
  UNION ALL SELECT site_id, visitor_hash, 'os', coalesce(os, 'ukjent') FROM pv),
counted AS (SELECT site_id, dim, key, count(*) AS n, count(DISTINCT visitor_hash) AS visitors FROM dims GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id, dim ORDER BY n DESC, key) AS r FROM counted)"""


@query("breakdowns", ctes("hits", extra=PV + "," + _DIM_SQL) + """
SELECT site_id, dim, key, n, visitors FROM ranked WHERE r <= 10""")
def breakdowns(t):
    return m.all_breakdowns(t.hits, t.sites, WHOLE)


@query("breakdown_sources", ctes("hits", extra=PV + "," + _DIM_SQL) + """
SELECT site_id, key AS value, n AS pageviews, visitors FROM ranked WHERE dim = 'source' AND r <= 100""")
def breakdown_sources(t):
    return m.breakdown(t.hits, t.sites, "sources", WHOLE)


@query("breakdown_export", ctes("hits", extra=PV + "," + _DIM_SQL) + """
SELECT site_id, key AS value, n AS pageviews, visitors FROM counted WHERE dim = 'page'""")
def breakdown_export(t):
    return m.breakdown(t.hits, t.sites, "pages", WHOLE, limit=None)


@query("campaigns", ctes("hits", extra=PV) + """
SELECT site_id, source, medium, campaign, n, visitors FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, source, medium, campaign) AS r FROM (
    SELECT site_id, coalesce(utm_source, '') AS source, coalesce(utm_medium, '') AS medium,
      coalesce(utm_campaign, '') AS campaign, count(*) AS n, count(DISTINCT visitor_hash) AS visitors
    FROM pv WHERE utm_source IS NOT NULL OR utm_campaign IS NOT NULL GROUP BY ALL)) WHERE r <= 10""")
def campaigns(t):
    return m.campaigns(t.hits, WHOLE)


@query("stats_report", ctes("hits", extra=SESS + "," + _DIM_SQL) + """
, k AS (""" + kpi_sql() + """)
SELECT k.*, tops.top_pages, tops.top_sources FROM k JOIN (
  SELECT site_id,
    string_agg(CASE WHEN dim = 'page' THEN concat(key, ':', CAST(n AS VARCHAR)) END, ' ' ORDER BY r) AS top_pages,
    string_agg(CASE WHEN dim = 'source' THEN concat(key, ':', CAST(n AS VARCHAR)) END, ' ' ORDER BY r) AS top_sources
  FROM ranked WHERE r <= 10 GROUP BY site_id) tops USING (site_id)""")
def stats_report(t):
    st = m.stats(t.hits, t.sites, WHOLE)
    text = lambda c: F.array_join(
        F.transform(c, lambda e: F.concat(e["key"], F.lit(":"), e["n"].cast("string"))), " ")
    return st.select("site_id", "pageviews", "visitors", "sessions", "bounce_rate", "views_per_session",
                     text("top_page").alias("top_pages"), text("top_source").alias("top_sources"))


@query("stats_with_previous", ctes("hits", "sites", extra=PV) + """
, parts AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 'now' ELSE 'before' END AS part FROM pv),
m2 AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS st
  FROM parts WINDOW w AS (PARTITION BY part, site_id, visitor_hash ORDER BY us, id)),
n2 AS (SELECT *, sum(st) OVER (PARTITION BY part, site_id, visitor_hash ORDER BY us, id) AS v FROM m2),
s2 AS (SELECT part, site_id, visitor_hash, v, count(*) AS views FROM n2 GROUP BY ALL),
k2 AS (SELECT part, site_id, CAST(sum(views) AS BIGINT) AS pageviews, count(DISTINCT visitor_hash) AS visitors, count(*) AS sessions,
  CAST(round_even(sum(CASE WHEN views = 1 THEN 1 ELSE 0 END) / count(*) * 100, 0) AS BIGINT) AS bounce_rate FROM s2 GROUP BY ALL)
SELECT sites.id AS site_id, coalesce(a.pageviews, 0) AS pageviews, coalesce(a.visitors, 0) AS visitors,
  coalesce(a.sessions, 0) AS sessions, coalesce(a.bounce_rate, 0) AS bounce_rate,
  coalesce(b.pageviews, 0) AS previous_pageviews, coalesce(b.visitors, 0) AS previous_visitors,
  coalesce(b.sessions, 0) AS previous_sessions, coalesce(b.bounce_rate, 0) AS previous_bounce_rate
FROM sites LEFT JOIN k2 a ON a.site_id = sites.id AND a.part = 'now'
  LEFT JOIN k2 b ON b.site_id = sites.id AND b.part = 'before'""")
def stats_with_previous(t):
    return m.stats_with_previous(t.hits, t.sites, 15, AS_OF)


@query("month_report", ctes("hits", "sites", extra=SESS) + """
, k AS (""" + kpi_sql() + """)
SELECT sites.id AS site_id, coalesce(pageviews, 0) AS pageviews, coalesce(visitors, 0) AS visitors,
  coalesce(sessions, 0) AS sessions, coalesce(bounce_rate, 0) AS bounce_rate,
  CAST(0 AS BIGINT) AS previous_pageviews, CAST(0 AS BIGINT) AS previous_visitors,
  CAST(0 AS BIGINT) AS previous_sessions, CAST(0 AS BIGINT) AS previous_bounce_rate
FROM sites LEFT JOIN k ON k.site_id = sites.id""")
def month_report(t):
    return m.month_with_previous(t.hits, t.sites, "2024-01")


_SERIES = """
SELECT site_id, strftime(b, '{fmt}') AS bucket, CAST(coalesce(sum(pv), 0) AS BIGINT) AS pageviews,
  CAST(coalesce(sum(u), 0) AS BIGINT) AS visitors FROM (
  SELECT c.site_id, date_trunc('{out}', c.b) AS b, d.pv, d.u FROM
    (SELECT id AS site_id, unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 {grain})) AS b FROM sites) c
  LEFT JOIN (SELECT site_id, date_trunc('{grain}', ts) AS b, count(*) AS pv, count(DISTINCT visitor_hash) AS u
    FROM hits GROUP BY ALL) d ON d.site_id = c.site_id AND d.b = c.b)
GROUP BY site_id, b"""


@query("timeseries_daily", ctes("hits", "sites") + _SERIES.format(
    fmt="%Y-%m-%d", out="day", grain="day", first="2024-01-01", last="2024-01-30"))
def timeseries_daily(t):
    return m.timeseries(t.hits, t.sites, 30, AS_OF)


@query("timeseries_hourly", ctes("hits", "sites") + _SERIES.format(
    fmt="%Y-%m-%d %H", out="hour", grain="hour", first="2024-01-30", last="2024-01-30 23:00:00"))
def timeseries_hourly(t):
    return m.timeseries(t.hits, t.sites, 1, AS_OF)


@query("timeseries_weekly", ctes("hits", "sites") + _SERIES.format(
    fmt="%Y-%m-%d", out="week", grain="day", first="2023-12-02", last="2024-01-30"))
def timeseries_weekly(t):
    return m.timeseries(t.hits, t.sites, 60, AS_OF)


@query("overview", ctes("hits", "sites") + """
, d AS (SELECT site_id, CAST(ts AS DATE) AS day, count(*) AS pv, count(DISTINCT visitor_hash) AS u
  FROM hits WHERE name = 'pageview' GROUP BY ALL),
w AS (SELECT s.id AS site_id, s.tenant_id, s.public_id, s.domain,
  CAST(coalesce(sum(pv) FILTER (day >= DATE '2024-01-16'), 0) AS BIGINT) AS pageviews,
  CAST(coalesce(sum(u) FILTER (day >= DATE '2024-01-16'), 0) AS BIGINT) AS visitors,
  CAST(coalesce(sum(pv) FILTER (day < DATE '2024-01-16'), 0) AS BIGINT) AS prev_pageviews,
  CAST(coalesce(sum(u) FILTER (day < DATE '2024-01-16'), 0) AS BIGINT) AS prev_visitors
  FROM sites s LEFT JOIN d ON d.site_id = s.id GROUP BY ALL),
sp AS (SELECT c.site_id, string_agg(CAST(coalesce(d.u, 0) AS VARCHAR), ',' ORDER BY c.b) AS spark FROM
  (SELECT id AS site_id, CAST(unnest(generate_series(TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS b FROM sites) c
  LEFT JOIN d ON d.site_id = c.site_id AND d.day = c.b GROUP BY c.site_id)
SELECT w.*, sp.spark, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM hits WHERE hits.site_id = w.site_id) AS last_ts,
  row_number() OVER (PARTITION BY tenant_id ORDER BY visitors DESC, domain) AS rank
FROM w JOIN sp USING (site_id)""")
def overview(t):
    o = m.overview(t.hits, t.sites, 15, AS_OF)
    return o.select(
        "site_id", "tenant_id", "public_id", "domain", "pageviews", "visitors", "prev_pageviews", "prev_visitors",
        F.array_join(F.col("spark").cast("array<string>"), ",").alias("spark"),
        F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), F.col("rank").cast("long").alias("rank"))


@query("site_list", ctes("hits", "sites", "tenants") + """
SELECT s.tenant_id, t.name AS tenant, s.id AS site_id, s.public_id, s.domain,
  count(h.id) FILTER (h.ts >= TIMESTAMP '2024-01-30') AS pageviews,
  count(DISTINCT h.visitor_hash) FILTER (h.ts >= TIMESTAMP '2024-01-30') AS visitors,
  strftime(max(h.ts), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM sites s JOIN tenants t ON t.id = s.tenant_id LEFT JOIN hits h ON h.site_id = s.id GROUP BY ALL""")
def site_list(t):
    return m.site_list(t.hits, t.sites, t.tenants, AS_OF).withColumn(
        "last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


@query("top_events", ctes("hits") + """
SELECT site_id, event, n, visitors FROM (
  SELECT site_id, name AS event, count(*) AS n, count(DISTINCT visitor_hash) AS visitors,
    row_number() OVER (PARTITION BY site_id ORDER BY count(*) DESC, name) AS r
  FROM hits WHERE name <> 'pageview' GROUP BY site_id, name) WHERE r <= 10""")
def top_events(t):
    return m.top_events(t.hits, WHOLE)


GOAL_SQL = """
, base AS (SELECT site_id, count(DISTINCT visitor_hash) AS b FROM hits WHERE name = 'pageview' GROUP BY 1),
done AS (SELECT g.site_id, g.id, g.name, g.match_type, g.match_value, count(DISTINCT h.visitor_hash) AS completions
FROM goals g LEFT JOIN hits h ON h.site_id = g.site_id AND
  ((g.match_type = 'event' AND h.name = g.match_value) OR (g.match_type <> 'event' AND h.name = 'pageview' AND h.path = g.match_value))
GROUP BY ALL)
SELECT done.*, round_even(completions / b * 100, 1) AS rate FROM done JOIN base USING (site_id)"""


@query("goals", ctes("hits", "goals") + GOAL_SQL)
def goals(t):
    return m.goal_stats(t.hits, t.goals, WHOLE)


@query("monthly_usage", ctes("hits", "sites") + """
SELECT s.tenant_id, count(h.id) AS pageviews, count(DISTINCT s.id) AS sites
FROM sites s LEFT JOIN hits h ON h.site_id = s.id AND h.name = 'pageview' GROUP BY s.tenant_id""")
def monthly_usage(t):
    return m.monthly_usage(t.hits, t.sites, AS_OF)


# One site per tenant, so that plans and addresses of many tenants come into play.
_MANY = """
many AS (SELECT c_custkey + 1 AS id, c_custkey + 1 AS tenant_id,
  concat('s', CAST(c_custkey + 1 AS VARCHAR), '.example') AS domain FROM customer),
mh AS (SELECT h.* REPLACE (1 + h.id % (SELECT count(*) FROM customer) AS site_id) FROM hits h)"""


def many_sites(t):
    c = t.raw("customer")
    sites = c.selectExpr("c_custkey + 1 AS id", "c_custkey + 1 AS tenant_id",
                         "concat('s', CAST(c_custkey + 1 AS STRING), '.example') AS domain")
    hits = t.spark.sql("SELECT *, (SELECT count(*) FROM {c}) AS n FROM {h}", c=c, h=t.hits)
    return hits.withColumn("site_id", 1 + F.col("id") % F.col("n")).drop("n"), sites


_LIMIT = """CASE plan WHEN 'trial' THEN 100000 WHEN 'liten' THEN 10000 WHEN 'vekst' THEN 100000
  WHEN 'pro' THEN 1000000 WHEN 'byra' THEN NULL WHEN 'owner' THEN NULL WHEN 'cancelled' THEN 0 ELSE 100000 END"""


@query("usage_report", ctes("hits", "tenants", extra=_MANY) + f"""
SELECT tenant_id, plan, pageviews, CAST(sites AS BIGINT) AS sites, CAST(page_limit AS BIGINT) AS page_limit,
  CASE WHEN page_limit > 0 THEN CAST(least(100, round_even(pageviews / page_limit * 100, 0)) AS BIGINT) END AS share
FROM (SELECT t.id AS tenant_id, t.plan, {_LIMIT} AS page_limit, count(h.id) AS pageviews, count(DISTINCT m.id) AS sites
  FROM tenants t LEFT JOIN many m ON m.tenant_id = t.id LEFT JOIN mh h ON h.site_id = m.id AND h.name = 'pageview'
  GROUP BY ALL)""")
def usage_report(t):
    hits, sites = many_sites(t)
    return m.usage_report(hits, sites, t.tenants, AS_OF).drop("over", "warn")


@query("overage", ctes("tenants", "users") + f"""
, x AS (SELECT 1 + l_suppkey % 3 AS tenant_id, count(*) AS pageviews, CAST(1 AS BIGINT) AS sites FROM lineitem GROUP BY 1)
SELECT t.id AS tenant_id, t.plan, CAST({_LIMIT} AS BIGINT) AS page_limit, u.email, x.pageviews, x.sites FROM tenants t
JOIN (SELECT tenant_id, arg_min(email, id) AS email FROM users GROUP BY 1) u ON u.tenant_id = t.id
JOIN x ON x.tenant_id = t.id
WHERE t.email_optout = 0 AND (t.overage_notified_month IS NULL OR t.overage_notified_month <> '2024-01')
  AND x.pageviews > {_LIMIT} AND {_LIMIT} > 0 AND t.plan <> 'cancelled' AND u.email <> ''""")
def overage(t):
    # Every order line is one page view of this month: enough traffic to pass a small plan.
    hits = t.raw("lineitem").selectExpr(
        "1 + l_suppkey % 3 AS site_id", "TIMESTAMP_NTZ '2024-01-15 12:00:00' AS ts", "'pageview' AS name")
    sites = t.raw("customer").selectExpr("c_custkey + 1 AS id", "c_custkey + 1 AS tenant_id")
    return m.overage(hits, sites, t.tenants, t.users, AS_OF)


@query("weekly_report", ctes("hits", "tenants", "users", extra=_MANY) + """
, per AS (SELECT m.tenant_id, m.id AS site_id, m.domain, count(h.id) AS pageviews, count(DISTINCT h.visitor_hash) AS visitors
  FROM many m LEFT JOIN mh h ON h.site_id = m.id AND h.name = 'pageview' AND h.ts >= TIMESTAMP '2024-01-01' GROUP BY ALL)
SELECT t.id AS tenant_id, u.email, p.site_id, p.domain, p.pageviews, p.visitors
FROM tenants t JOIN users u ON u.tenant_id = t.id JOIN per p ON p.tenant_id = t.id
WHERE t.email_optout = 0 AND p.pageviews > 0 AND u.email <> ''""")
def weekly_report(t):
    hits, sites = many_sites(t)
    return m.weekly_report(hits, sites, t.tenants, t.users, AS_OF, days=30)


@query("last_event", ctes("hits") + """
SELECT site_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM hits GROUP BY site_id""")
def last_event(t):
    return m.last_event(t.hits).withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


@query("stalled_sites", ctes("hits", extra=_MANY) + """
SELECT m.id AS site_id, m.domain, m.tenant_id, strftime(max(h.ts), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM many m JOIN mh h ON h.site_id = m.id GROUP BY ALL
HAVING max(h.ts) >= TIMESTAMP '2024-01-21 23:59:59' AND max(h.ts) < TIMESTAMP '2024-01-29 17:59:59'""")
def stalled_sites(t):
    hits, sites = many_sites(t)
    return m.stalled_sites(hits, sites, AS_OF).withColumn(
        "last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


@query("headline", ctes("hits", extra=SESS) + """
, k30 AS (""" + kpi_sql() + """), k7 AS (""" + kpi_sql("first_us >= epoch_us(TIMESTAMP '2024-01-24')") + """)
SELECT k30.site_id, CAST(CASE WHEN coalesce(k7.visitors, 0) >= 100 THEN 7 ELSE 30 END AS INT) AS period,
  CASE WHEN coalesce(k7.visitors, 0) >= 100 THEN k7.visitors ELSE k30.visitors END AS visitors,
  CASE WHEN coalesce(k7.visitors, 0) >= 100 THEN k7.bounce_rate END AS bounce,
  CASE WHEN coalesce(k7.visitors, 0) < 100 THEN k30.pageviews END AS pageviews
FROM k30 LEFT JOIN k7 USING (site_id)""")
def headline(t):
    return m.headline(t.hits, AS_OF)


@query("period_delta", ctes("hits", "sites") + """
, d AS (SELECT site_id, country, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS now,
  count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS before FROM hits GROUP BY ALL),
p AS (SELECT *, CASE WHEN before > 0 THEN CAST(round_even((now - before) / before * 100, 0) AS BIGINT) END AS pct FROM d)
SELECT site_id, coalesce(country, '-') AS country, now, before, CASE WHEN abs(pct) <= 500 THEN pct END AS pct,
  CASE WHEN abs(pct) > 500 OR pct IS NULL THEN NULL WHEN pct > 0 THEN 'better' WHEN pct < 0 THEN 'worse' ELSE 'same' END AS trend
FROM p""")
def period_delta(t):
    now, before = period_window(15, AS_OF), period_window(15, AS_OF, 1)
    cut = F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{now[0]}'")
    g = t.hits.groupBy("site_id", "country").agg(
        F.count(F.when(cut, 1)).alias("now"), F.count(F.when(~cut, 1)).alias("before"))
    d = delta(F.col("now"), F.col("before"))
    return g.select("site_id", F.coalesce("country", F.lit("-")).alias("country"), "now", "before",
                    d["pct"].alias("pct"), d["trend"].alias("trend"))


@query("site_gates", ctes("hits", "sites", "bots", "search") + """
SELECT s.id AS site_id, CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.site_id = s.id AND revenue_cents IS NOT NULL) THEN 1 ELSE 0 END AS has_ecommerce,
  CASE WHEN EXISTS (SELECT 1 FROM search x WHERE x.site_id = s.id) THEN 1 ELSE 0 END AS has_search,
  (SELECT strftime(min(day), '%Y-%m-%d') FROM bots b WHERE b.site_id = s.id) AS first_bot_day
FROM sites s""")
def site_gates(t):
    from footfall.schema import BREAKDOWNS

    empty = t.spark.createDataFrame([], BREAKDOWNS)
    return m.site_gates(t.sites, t.hits, empty, t.search, t.bots)
