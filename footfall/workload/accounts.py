"""Search, accounts, upkeep, texts and export."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from footfall.functions.geonames import country_label
from footfall.operators import accounts as ac
from footfall.operators import search as se
from footfall.operators import text as tx
from footfall.operators import upkeep as up
from footfall.plans import export as ex
from footfall.sources import csv_sink, search_feeds as sf
from footfall.workload.behaviour import ORDERS, SOURCED, _CUR, _SRC
from footfall.workload.metrics import PV, _DIM_SQL
from footfall.workload.registry import query
from footfall.workload.views import AS_OF, ctes

# Orders run over several years: one window over all of them.
SEARCH_AS_OF = datetime(2024, 1, 30, 12)
SEARCH_DAYS = 20_000
HALF = 8_800  # two equal windows that together reach before the first order


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_POS = "CASE WHEN sum(impressions) > 0 AND sum(position * impressions) <> 0 THEN round_even(sum(position * impressions) / sum(impressions), 1) END"


@query("search_kpis", ctes("search") + f"""
SELECT site_id, source, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
  CASE WHEN source = 'google' THEN {_POS} END AS position FROM search WHERE dim = 'total' GROUP BY site_id, source""")
def search_kpis(t):
    return se.search_kpis(t.search, SEARCH_DAYS, SEARCH_AS_OF)


@query("search_top", ctes("search") + f"""
SELECT site_id, key, clicks, impressions, position FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY clicks DESC, impressions DESC, key) AS r FROM (
    SELECT site_id, key, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {_POS} AS position
    FROM search WHERE source = 'google' AND dim = 'query' GROUP BY site_id, key)) WHERE r <= 10""")
def search_top(t):
    return se.search_top(t.search, "query", SEARCH_DAYS, SEARCH_AS_OF)


@query("seo_overview", ctes("search", "hits", "sites", extra=PV) + """
, s AS (SELECT site_id, CAST(sum(clicks) FILTER (source = 'google') AS BIGINT) AS clicks,
  CAST(sum(impressions) FILTER (source = 'google') AS BIGINT) AS impressions,
  sum(position * impressions) FILTER (source = 'google') AS w, CAST(sum(clicks) FILTER (source = 'bing') AS BIGINT) AS bing_clicks
  FROM search WHERE dim = 'total' AND day >= DATE '2024-01-28' - 8799 GROUP BY 1),
p AS (SELECT site_id, CAST(sum(clicks) AS BIGINT) AS prev_clicks FROM search WHERE dim = 'total' AND source = 'google'
  AND day < DATE '2024-01-28' - 8799 AND day >= DATE '2024-01-28' - 17599 GROUP BY 1),
a AS (SELECT site_id, count(DISTINCT visitor_hash) AS ai FROM pv WHERE referrer_src IN ('chatgpt.com', 'www.perplexity.ai') OR utm_source = 'ChatGPT' GROUP BY 1)
SELECT x.id AS site_id, x.tenant_id, x.public_id, x.domain, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions,
  CASE WHEN impressions > 0 THEN round_even(w / impressions, 1) END AS position, coalesce(prev_clicks, 0) AS prev_clicks,
  coalesce(bing_clicks, 0) AS bing_clicks, coalesce(ai, 0) AS ai, CAST(0 AS BIGINT) AS prev_ai
FROM sites x LEFT JOIN s ON s.site_id = x.id LEFT JOIN p ON p.site_id = x.id LEFT JOIN a ON a.site_id = x.id""")
def seo_overview(t):
    return se.seo_overview(t.search, t.hits, t.sites, HALF, SEARCH_AS_OF)


@query("search_upsert", ctes("search") + """
SELECT site_id, source, dim, CAST(sum(c) AS BIGINT) AS clicks, count(*) AS rows FROM (
  SELECT site_id, source, dim, CASE WHEN source = 'bing' THEN clicks + 1 ELSE clicks END AS c FROM search
  UNION ALL SELECT site_id, 'extra', dim, clicks FROM search WHERE source = 'gmc') GROUP BY ALL""")
def search_upsert(t):
    s = t.search
    new = s.where("source = 'bing'").withColumn("clicks", F.col("clicks") + 1).unionByName(
        s.where("source = 'gmc'").withColumn("source", F.lit("extra")))
    return sf.upsert_search(s, new).groupBy("site_id", "source", "dim").agg(
        F.sum("clicks").alias("clicks"), F.count(F.lit(1)).alias("rows"))


@query("search_feed_pages", """
WITH r AS (SELECT CAST(1 + o_custkey % 2 AS BIGINT) AS site_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
  concat('/order-info/', CAST(o_orderkey AS VARCHAR)) AS key, CAST(o_custkey % 50 AS BIGINT) AS clicks,
  CAST(o_totalprice AS BIGINT) AS impressions, 1.5 AS position FROM orders)
SELECT site_id, day, 'google' AS source, 'page' AS dim, key, clicks, CAST(floor(p.o_totalprice) AS BIGINT) AS impressions, CAST(1.5 AS DOUBLE) AS position
FROM (SELECT r.*, o.o_totalprice, row_number() OVER (PARTITION BY site_id, day ORDER BY clicks DESC, floor(o.o_totalprice) DESC, key) AS rk
  FROM r JOIN orders o ON r.key = concat('/order-info/', CAST(o.o_orderkey AS VARCHAR))) p WHERE rk <= 2""")
def search_feed_pages(t):
    return sf.normalize_gsc(_search_pages(t), top=2).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _search_pages(t):
    return t.raw("orders").selectExpr(
        "CAST(1 + o_custkey % 2 AS BIGINT) AS site_id", "'page' AS dim",
        """concat('{"keys":["', date_format(o_orderdate, 'yyyy-MM-dd'), '","https://site.example/order-info/', o_orderkey,
           '?a=b"],"clicks":', o_custkey % 50, '.0,"impressions":', floor(o_totalprice), ',"position":1.5}') AS body""")


@query("search_feed_pages_all", """
SELECT CAST(1 + o_custkey % 2 AS BIGINT) AS site_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 'google' AS source, 'page' AS dim,
  concat('/order-info/', CAST(o_orderkey AS VARCHAR)) AS key, CAST(o_custkey % 50 AS BIGINT) AS clicks,
  CAST(floor(o_totalprice) AS BIGINT) AS impressions, CAST(1.5 AS DOUBLE) AS position FROM orders""")
def search_feed_pages_all(t):
    """All keys of all days, without a limit."""
    return sf.normalize_gsc(_search_pages(t)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("search_feed_bing", """
SELECT CAST(1 + o_custkey % 2 AS BIGINT) AS site_id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, 'bing' AS source, 'total' AS dim, '' AS key,
  CAST(sum(o_custkey % 50) AS BIGINT) AS clicks, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL""")
def search_feed_bing(t):
    raw = t.raw("orders").selectExpr(
        "CAST(1 + o_custkey % 2 AS BIGINT) AS site_id",
        """concat('{"Date":"/Date(', unix_millis(CAST(o_orderdate AS TIMESTAMP)), '-0700)/","Clicks":', o_custkey % 50, ',"Impressions":9}') AS body""")
    return sf.normalize_bing(raw, date(1997, 1, 1)).groupBy(
        "site_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "source", "dim", "key").agg(
        F.sum("clicks").alias("clicks"), F.count(F.lit(1)).alias("n"))


@query("search_feed_merchant", """
SELECT CAST(1 + o_custkey % 2 AS BIGINT) AS site_id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, 'gmc' AS source,
  CAST(sum(o_custkey % 50) AS BIGINT) AS clicks, count(*) AS n FROM orders GROUP BY ALL""")
def search_feed_merchant(t):
    raw = t.raw("orders").selectExpr(
        "CAST(1 + o_custkey % 2 AS BIGINT) AS site_id",
        """concat('{"productPerformanceView":{"date":', CASE WHEN o_orderkey % 2 = 0 THEN concat('"', date_format(o_orderdate, 'yyyy-MM-dd'), '"')
           ELSE concat('{"year":', year(o_orderdate), ',"month":', month(o_orderdate), ',"day":', day(o_orderdate), '}') END,
           ',"clicks":"', o_custkey % 50, '","impressions":3}}') AS body""")
    return sf.normalize_gmc(raw).groupBy("site_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "source").agg(
        F.sum("clicks").alias("clicks"), F.count(F.lit(1)).alias("n"))


@query("match_property", """
SELECT c_custkey + 1 AS site_id, CASE c_custkey % 4 WHEN 0 THEN concat('sc-domain:', d) WHEN 1 THEN concat('https://', d, '/')
  WHEN 2 THEN concat('http://www.', d, '/') END AS property
FROM (SELECT c_custkey, concat('s', CAST(c_custkey AS VARCHAR), '.example') AS d FROM customer) WHERE c_custkey % 4 < 3""")
def match_property(t):
    c = t.raw("customer").selectExpr("c_custkey", "concat('s', c_custkey, '.example') AS domain")
    props = c.selectExpr(
        "explode(CASE c_custkey % 4 WHEN 0 THEN array(concat('http://', domain, '/'), concat('sc-domain:', domain))"
        " WHEN 1 THEN array(concat('https://www.', domain, '/'), concat('https://', domain, '/'))"
        " WHEN 2 THEN array(concat('http://www.', domain, '/')) ELSE array('other') END) AS property")
    return sf.match_property(c.selectExpr("c_custkey + 1 AS id", "domain"), props)


@query("match_host", """
SELECT c_custkey + 1 AS site_id, concat('https://', CASE WHEN c_custkey % 2 = 0 THEN 'WWW.' ELSE '' END, 'S', CAST(c_custkey AS VARCHAR), '.example/x') AS url
FROM customer""")
def match_host(t):
    c = t.raw("customer")
    urls = c.selectExpr("concat('https://', CASE WHEN c_custkey % 2 = 0 THEN 'WWW.' ELSE '' END, 'S', c_custkey, '.example/x') AS url")
    return sf.match_host(c.selectExpr("c_custkey + 1 AS id", "concat('www.s', c_custkey, '.example') AS domain"), urls)


@query("new_urls", """
SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)""")
def new_urls(t):
    pages = t.raw("pages")
    maps = pages.select(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url>")).alias("xml"))
    seen = pages.where("page_id % 3 = 0").select("url").distinct()
    return sf.new_urls(sf.sitemap_urls(maps), seen)[0]


# --- accounts -------------------------------------------------------------------------------

LATE = datetime(2024, 6, 15, 12)
_LATE = "TIMESTAMP '2024-06-15 12:00:00'"
_FIRST = "fu AS (SELECT tenant_id, arg_min(email, id) AS email FROM users GROUP BY 1)"
_MONEY = "vipps_agreement_id IS NULL AND vipps_pending_plan IS NULL AND invoice_details IS NULL"
_DUE = f"""
due AS (SELECT id AS tenant_id, name, trial_ends_at, cancelled_at, deletion_warned_at, CASE
  WHEN plan = 'trial' AND stripe_subscription_id IS NULL AND {_MONEY} AND created_at < {_LATE} - INTERVAL 14 DAY
    AND id IN (SELECT tenant_id FROM users) AND id NOT IN (SELECT tenant_id FROM users WHERE email_verified = 1)
    AND id NOT IN (SELECT tenant_id FROM sites WHERE id IN (SELECT site_id FROM hits)) THEN 'unverified'
  WHEN plan = 'trial' AND stripe_subscription_id IS NULL AND {_MONEY} AND trial_ends_at < {_LATE} - INTERVAL 84 DAY THEN 'trial_expired'
  WHEN plan = 'cancelled' AND {_MONEY} AND cancelled_at < {_LATE} - INTERVAL 84 DAY THEN 'cancelled' END AS category FROM tenants)"""
_ENDED = f"""
en AS (SELECT *, CASE WHEN warned >= ended_at THEN warned END AS warned_at FROM (
  SELECT id AS tenant_id, name, deletion_warned_at AS warned,
  CASE WHEN plan = 'trial' THEN 'trial_expired' ELSE 'cancelled' END AS category,
  CASE WHEN plan = 'trial' THEN trial_ends_at ELSE cancelled_at END AS ended_at FROM tenants
  WHERE {_MONEY} AND ((plan = 'trial' AND stripe_subscription_id IS NULL) OR plan = 'cancelled')) WHERE ended_at < {_LATE})"""
_DELETE_ON = "least(greatest(ended_at + INTERVAL 84 DAY, {told} + INTERVAL 7 DAY), ended_at + INTERVAL 89 DAY)"


@query("trials_ending", ctes("tenants", "users", extra=_FIRST) + """
SELECT t.id AS tenant_id, strftime(trial_ends_at, '%Y-%m-%d %H:%M:%S') AS trial_ends_at, email FROM tenants t LEFT JOIN fu ON fu.tenant_id = t.id
WHERE plan = 'trial' AND trial_reminded_at IS NULL AND trial_ends_at > TIMESTAMP '2024-01-30 23:59:59' AND trial_ends_at <= TIMESTAMP '2024-02-02 23:59:59'""")
def trials_ending(t):
    return ac.trials_ending(t.tenants, t.users, AS_OF).withColumn("trial_ends_at", _ts("trial_ends_at"))


def _due(t):
    from footfall.schema import ROLLUPS

    return ac.dormant(t.tenants, t.users, t.sites, t.hits, t.spark.createDataFrame([], ROLLUPS), LATE)


@query("dormant", ctes("tenants", "users", "sites", "hits", extra=_DUE) + """
SELECT tenant_id, category FROM due WHERE category IS NOT NULL""")
def dormant(t):
    return _due(t)


@query("to_warn", ctes("tenants", "users", extra=_FIRST + "," + _ENDED) + f"""
SELECT en.tenant_id, name, email, category, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended_at,
  strftime({_DELETE_ON.format(told=_LATE)}, '%Y-%m-%d %H:%M:%S') AS delete_on
FROM en JOIN fu ON fu.tenant_id = en.tenant_id WHERE email <> '' AND warned_at IS NULL AND ended_at < {_LATE} - INTERVAL 70 DAY""")
def to_warn(t):
    return ac.to_warn(t.tenants, t.users, LATE).withColumn("ended_at", _ts("ended_at")).withColumn(
        "delete_on", _ts("delete_on"))


_HELD = f"""
held AS (SELECT due.tenant_id, category FROM due JOIN fu ON fu.tenant_id = due.tenant_id,
  LATERAL (SELECT CASE WHEN category = 'trial_expired' THEN trial_ends_at ELSE cancelled_at END AS e) x
  WHERE fu.email <> '' AND category IN ('trial_expired', 'cancelled') AND NOT {_LATE} >= e + INTERVAL 89 DAY
  AND NOT coalesce(deletion_warned_at >= e AND {_LATE} >= deletion_warned_at + INTERVAL 7 DAY, FALSE))"""


@query("held_for_notice", ctes("tenants", "users", "sites", "hits", extra=_FIRST + "," + _DUE + "," + _HELD) + """
SELECT tenant_id, category FROM held""")
def held_for_notice(t):
    return ac.held_for_notice(t.tenants, t.users, _due(t), LATE)


@query("deletion_notice", ctes("tenants", extra=_ENDED) + f"""
SELECT tenant_id, category, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended_at,
  strftime({_DELETE_ON.format(told=f"coalesce(warned_at, {_LATE})")}, '%Y-%m-%d %H:%M:%S') AS delete_on FROM en""")
def deletion_notice(t):
    return ac.deletion_notice(t.tenants, LATE).withColumn("ended_at", _ts("ended_at")).withColumn(
        "delete_on", _ts("delete_on"))


def _account_tables(t):
    from footfall.schema import ROLLUPS
    from footfall.workload.metrics import many_sites

    hits, sites = many_sites(t)
    # Events go to the sites with even numbers, so that accounts without events exist.
    events = t.spark.sql("SELECT *, (SELECT count(*) FROM {c}) AS many FROM {h}", c=t.raw("customer"), h=t.hits).selectExpr(
        "id", "2 * (1 + id % (many div 2)) AS site_id")
    users = t.users
    return {
        "tenants": t.tenants, "users": users, "sites": sites, "events": events, "goals": hits.select("id", "site_id"),
        "daily_rollups": t.spark.createDataFrame([], ROLLUPS),
        "reset_tokens": users.selectExpr("email", "created_at + INTERVAL 100 DAY AS expires_at"),
        "invites": users.selectExpr("tenant_id", "created_at + INTERVAL 200 DAY AS expires_at"),
    }


_MANYID = "(SELECT count(*) FROM customer)"
_EVENT_SITE = f"2 * (1 + id % ({_MANYID} // 2))"
_DUE_MANY = _DUE.replace(
    "AND id NOT IN (SELECT tenant_id FROM sites WHERE id IN (SELECT site_id FROM hits))", f"AND id NOT IN (SELECT {_EVENT_SITE} FROM hits)")


@query("purge_dry_run", ctes("tenants", "users", "sites", "hits", extra=_FIRST + "," + _DUE_MANY + "," + _HELD) + f"""
SELECT concat('accounts.', category) AS measure, count(*) AS n FROM due WHERE category IS NOT NULL GROUP BY category
UNION ALL SELECT 'held_for_notice', count(*) FROM held
UNION ALL SELECT 'expired_links.reset_tokens', count(*) FROM users WHERE created_at + INTERVAL 100 DAY <= {_LATE}
UNION ALL SELECT 'expired_links.invites', count(*) FROM users WHERE created_at + INTERVAL 200 DAY <= {_LATE}""")
def purge_dry_run(t):
    return ac.purge_dormant(_account_tables(t), LATE)[1]


_FREE = """
, free AS (SELECT tenant_id, category FROM due WHERE category IS NOT NULL AND tenant_id NOT IN (SELECT tenant_id FROM held)),
chosen AS (SELECT tenant_id FROM free {limit}),
cu AS (SELECT * FROM users WHERE tenant_id IN (SELECT tenant_id FROM chosen))"""
_PURGED = _FREE + """
SELECT 'tenants' AS "table", count(*) AS n FROM tenants WHERE id NOT IN (SELECT tenant_id FROM chosen)
UNION ALL SELECT 'users', count(*) FROM users WHERE tenant_id NOT IN (SELECT tenant_id FROM chosen)
UNION ALL SELECT 'sites', count(*) FROM tenants WHERE id NOT IN (SELECT tenant_id FROM chosen)
UNION ALL SELECT 'events', count(*) FROM hits WHERE {event} NOT IN (SELECT tenant_id FROM chosen)
UNION ALL SELECT 'goals', count(*) FROM hits WHERE 1 + id % {many} NOT IN (SELECT tenant_id FROM chosen)
UNION ALL SELECT 'reset_tokens', count(*) FROM users WHERE created_at + INTERVAL 100 DAY > {late} AND email NOT IN (SELECT email FROM cu)
UNION ALL SELECT 'invites', count(*) FROM users WHERE created_at + INTERVAL 200 DAY > {late} AND tenant_id NOT IN (SELECT tenant_id FROM chosen)
UNION ALL SELECT 'deleted_accounts', count(*) FROM chosen
UNION ALL SELECT 'remaining_accounts', (SELECT count(*) FROM due WHERE category IS NOT NULL) - (SELECT count(*) FROM chosen)"""


def _purged(t, batch=None):
    from footfall.operators.frames import union_all

    out, counts = ac.purge_dormant(_account_tables(t), LATE, enforce=True, batch=batch)
    return union_all([
        out[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "n")
        for n in ("tenants", "users", "sites", "events", "goals", "reset_tokens", "invites")
    ] + [counts.where("measure IN ('deleted_accounts', 'remaining_accounts')").select(F.col("measure").alias("table"), "n")])


def _purge_sql(limit: str) -> str:
    return ctes("tenants", "users", "sites", "hits", extra=_FIRST + "," + _DUE_MANY + "," + _HELD) + _PURGED.format(
        limit=limit, event=_EVENT_SITE, many=_MANYID, late=_LATE)


@query("purge_enforced", _purge_sql(""))
def purge_enforced(t):
    return _purged(t)


@query("purge_batch", _purge_sql("ORDER BY CASE category WHEN 'unverified' THEN 0 WHEN 'trial_expired' THEN 1 ELSE 2 END, tenant_id LIMIT 50"))
def purge_batch(t):
    return _purged(t, batch=50)


_MEASURES = f"""
SELECT concat('accounts.', category) AS measure, count(*) AS n FROM due WHERE category IS NOT NULL GROUP BY category
UNION ALL SELECT 'held_for_notice', count(*) FROM held
UNION ALL SELECT 'expired_links.reset_tokens', count(*) FROM users WHERE created_at + INTERVAL 100 DAY <= {_LATE}
UNION ALL SELECT 'expired_links.invites', count(*) FROM users WHERE created_at + INTERVAL 200 DAY <= {_LATE}
UNION ALL SELECT 'deleted_accounts', count(*) FROM chosen
UNION ALL SELECT 'remaining_accounts', (SELECT count(*) FROM due WHERE category IS NOT NULL) - (SELECT count(*) FROM chosen)
UNION ALL SELECT 'deleted_rows.tenants', count(*) FROM chosen UNION ALL SELECT 'deleted_rows.sites', count(*) FROM chosen
UNION ALL SELECT 'deleted_rows.users', count(*) FROM cu UNION ALL SELECT 'deleted_rows.invites', count(*) FROM cu
UNION ALL SELECT 'deleted_rows.reset_tokens', count(*) FROM users WHERE email IN (SELECT email FROM cu)
UNION ALL SELECT 'deleted_rows.daily_rollups', 0
UNION ALL SELECT 'deleted_rows.events', count(*) FROM hits WHERE {_EVENT_SITE} IN (SELECT tenant_id FROM chosen)
UNION ALL SELECT 'deleted_rows.goals', count(*) FROM hits WHERE 1 + id % {_MANYID} IN (SELECT tenant_id FROM chosen)"""


@query("purge_audit", ctes("tenants", "users", "sites", "hits", extra=_FIRST + "," + _DUE_MANY + "," + _HELD) + _FREE.format(limit="") + f"""
, measures AS ({_MEASURES}),
cuts AS (SELECT unnest([{{k: 'cancelled', d: 84}}, {{k: 'expired_links', d: 0}}, {{k: 'trial_expired', d: 84}}, {{k: 'unverified', d: 14}}], recursive := true))
SELECT strftime({_LATE}, '%Y-%m-%d %H:%M:%S') AS ran_at, 1 AS enforce,
  (SELECT concat('{{', string_agg(concat('"', k, '":"', strftime({_LATE} - to_days(d), '%Y-%m-%d %H:%M:%S'), '"'), ',' ORDER BY k), '}}') FROM cuts) AS cutoffs,
  (SELECT concat('{{', string_agg(concat('"', measure, '":', CAST(n AS VARCHAR)), ',' ORDER BY measure), '}}') FROM measures) AS counts""")
def purge_audit(t):
    """What an enforced run writes into the retention log."""
    return ac.audit_row(ac.purge_dormant(_account_tables(t), LATE, enforce=True)[1], LATE, True)


@query("delete_tenants_counts", ctes("hits", "users") + f"""
, gone AS (SELECT c_custkey + 1 AS tenant_id FROM customer WHERE c_nationkey = 3)
SELECT 'tenants' AS "table", count(*) AS deleted FROM gone
UNION ALL SELECT 'sites', count(*) FROM gone
UNION ALL SELECT 'users', count(*) FROM users WHERE tenant_id IN (SELECT tenant_id FROM gone)
UNION ALL SELECT 'reset_tokens', count(*) FROM users WHERE email IN (SELECT email FROM users WHERE tenant_id IN (SELECT tenant_id FROM gone))
UNION ALL SELECT 'invites', count(*) FROM users WHERE tenant_id IN (SELECT tenant_id FROM gone)
UNION ALL SELECT 'events', count(*) FROM hits WHERE {_EVENT_SITE} IN (SELECT tenant_id FROM gone) UNION ALL SELECT 'daily_rollups', 0
UNION ALL SELECT 'goals', count(*) FROM hits WHERE 1 + id % {_MANYID} IN (SELECT tenant_id FROM gone)""")
def delete_tenants_counts(t):
    gone = t.raw("customer").where("c_nationkey = 3").selectExpr("c_custkey + 1 AS tenant_id")
    return ac.delete_tenants(_account_tables(t), gone)[1]


_SIGNUPS = "cand AS (SELECT * FROM users WHERE id BETWEEN 2 AND 1000000 AND email_verified = 0 AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-04-01')"


def _signups(t):
    return ac.select_signups(t.users, (2, 1_000_000), date(2024, 1, 5), date(2024, 3, 31))


@query("signup_digest", ctes("users", extra=_SIGNUPS) + """
SELECT sha256(string_agg(lower(trim(email)), chr(10) ORDER BY lower(trim(email)))) AS digest, count(*) AS users FROM cand""")
def signup_digest(t):
    return ac.email_digest(_signups(t))


@query("signup_refusals", ctes("users", "hits", extra=_SIGNUPS) + f"""
, r AS (SELECT 'has events' AS reason, count(DISTINCT tenant_id) AS n FROM cand WHERE tenant_id IN (SELECT 1 + id % {_MANYID} FROM hits)
UNION ALL SELECT 'first user', count(*) FROM cand WHERE id = 1)
SELECT * FROM r WHERE n > 0""")
def signup_refusals(t):
    from footfall.workload.metrics import many_sites

    hits, sites = many_sites(t)
    return ac.unsafe_reasons(_signups(t), {"users": t.users, "sites": sites, "events": hits})


_TRIES = "tries AS (SELECT id, ts, CASE WHEN id % 2 = 0 THEN 'signup' ELSE 'forgot_email' END AS kind, concat('u', CAST(id % 7 AS VARCHAR)) AS key FROM hits)"


def _tries(t):
    return t.hits.selectExpr(
        "id", "ts", "CASE WHEN id % 2 = 0 THEN 'signup' ELSE 'forgot_email' END AS kind", "concat('u', CAST(id % 7 AS STRING)) AS key")


@query("attempt_counts", ctes("hits", extra=_TRIES) + """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS bucket, kind, key, count(*) AS used,
  CAST(sum(count(*)) OVER (PARTITION BY date_trunc('day', ts), kind) AS BIGINT) AS total FROM tries GROUP BY date_trunc('day', ts), kind, key""")
def attempt_counts(t):
    return ac.attempt_counts(_tries(t), "day").withColumn("bucket", _ts("bucket"))


@query("attempts_throttled", ctes("hits", extra=_TRIES) + """
SELECT id, kind, nth, nth_all, CASE WHEN nth > CASE kind WHEN 'signup' THEN 5 ELSE 3 END OR (kind = 'signup' AND nth_all > 40) THEN 1 ELSE 0 END AS blocked FROM (
  SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts), kind, key ORDER BY ts, id) AS nth,
    row_number() OVER (PARTITION BY date_trunc('day', ts), kind ORDER BY ts, id) AS nth_all FROM tries)""")
def attempts_throttled(t):
    return ac.throttled(_tries(t), unit="day").select("id", "kind", "nth", "nth_all", F.col("blocked").cast("int").alias("blocked"))


# --- upkeep ---------------------------------------------------------------------------------

@query("mask_summary", ctes("hits", "goals", "funnels") + """
, e AS (SELECT id, concat('/order/', substr(md5(CAST(id AS VARCHAR)), 1, 16)) AS path, id % 3 AS k FROM hits)
SELECT 'rows' AS section, 'events.path' AS key, count(*) AS n FROM e
UNION ALL SELECT 'rows', 'events.name', count(*) FROM e WHERE k = 0
UNION ALL SELECT 'example', '/order/:id', count(*) FROM e""")
def mask_summary(t):
    hits = t.hits.selectExpr(
        "id", "concat('/order/', substr(md5(CAST(id AS STRING)), 1, 16), '') AS path",
        "CASE WHEN id % 3 = 0 THEN concat('paid 4242', lpad(CAST(id AS STRING), 12, '0')) ELSE name END AS name")
    return up.mask_summary(up.mask_changes(hits.withColumn(
        "path", F.concat(F.col("path"))), t.goals, t.funnels))


@query("blind_hashes", ctes("hits") + """
SELECT id, CASE WHEN ts < TIMESTAMP '2024-01-30' THEN sha256(concat('key', visitor_hash)) ELSE visitor_hash END AS visitor_hash FROM hits""")
def blind_hashes(t):
    return up.blind_hashes(t.hits, "key", datetime(2024, 1, 30)).select("id", "visitor_hash")


@query("blind_plan", ctes("hits") + """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM hits WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1""")
def blind_plan(t):
    return up.blind_plan(t.hits, datetime(2024, 1, 30))


@query("reassign_sites", """
SELECT c_custkey + 1 AS id, concat('p', CAST(c_custkey AS VARCHAR)) AS public_id, CASE WHEN c_custkey % 5 = 0 THEN 99 ELSE c_custkey + 1 END AS tenant_id,
  CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 = 0 THEN 1 ELSE 0 END AS public_dash FROM customer""")
def reassign_sites(t):
    c = t.raw("customer")
    sites = c.selectExpr("c_custkey + 1 AS id", "concat('p', c_custkey) AS public_id", "c_custkey + 1 AS tenant_id", "0 AS public_dash")
    moves = c.where("c_custkey % 5 = 0").selectExpr("concat('p', c_custkey) AS public_id", "99L AS new_tenant_id")
    flips = c.where("c_custkey % 3 = 0").selectExpr("concat('p', c_custkey) AS public_id", "c_custkey + 1 AS tenant_id", "true AS on")
    return up.set_public(up.reassign_sites(sites, moves), flips).select("id", "public_id", "tenant_id", "public_dash")


# --- texts ----------------------------------------------------------------------------------

def _docs(t):
    return t.raw("documents").select(
        F.concat(F.lit("/d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"),
        F.col("source").alias("title"), F.col("text").alias("content"))


_UPSERT = """
SELECT concat('/d/', CAST(doc_id % 400 AS VARCHAR)) AS path, arg_max(source, doc_id) AS title,
  CAST(length(arg_max(text, doc_id)) AS BIGINT) AS size, arg_max(cut, doc_id) AS cut
FROM ({rows}) GROUP BY doc_id % 400"""


def _fetched(t):
    return t.raw("documents").select(
        F.concat(F.lit("/d/"), (F.col("doc_id") % 400).cast("string")).alias("path"), F.col("source").alias("title"),
        F.col("text").alias("content"), F.col("doc_id").alias("fetched_at"))


@query("page_upsert", _UPSERT.format(rows="SELECT doc_id, source, text, CAST(0 AS BIGINT) AS cut FROM documents"))
def page_upsert(t):
    d = _fetched(t)
    return tx.upsert_pages(d.where("false"), d).select("path", "title", F.length("content").cast("long").alias("size"), "cut")


@query("page_upsert_limits", _UPSERT.format(rows="""SELECT doc_id, source, substr(text, 1, 8000) AS text,
  CAST(greatest(length(text) - 8000, 0) AS BIGINT) AS cut FROM documents WHERE length(text) >= 100"""))
def page_upsert_limits(t):
    d = _fetched(t)
    return tx.upsert_pages(d.where("false"), d, least=100, most=8000).select(
        "path", "title", F.length("content").cast("long").alias("size"), "cut")


_OVERLAP = """
WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{4,}'))) AS w FROM benchmark),
d AS (SELECT concat('/d/', lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS path, source AS title, lower(text) AS lt, length(text) AS size FROM documents),
dw AS (SELECT w, path, (length(lt) - length(replace(lt, w, ''))) // length(w) AS n FROM (SELECT DISTINCT w FROM q) JOIN d ON contains(lt, w)),
sc AS (SELECT item_id AS question_id, path, CAST(sum(n) AS BIGINT) AS score FROM q JOIN dw USING (w) GROUP BY ALL)"""


def _questions(t):
    return t.raw("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query("rank_pages", _OVERLAP + """
, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, path) AS rank FROM sc),
b AS (SELECT r.*, d.title, d.size, coalesce(sum(d.size) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM r JOIN d USING (path) WHERE rank <= 3)
SELECT question_id, CAST(rank AS INT) AS rank, path, title, score, CAST(least(size, 9000 - used) AS BIGINT) AS taken FROM b WHERE used < 9000""")
def rank_pages(t):
    return tx.rank_pages(_questions(t), _docs(t)).withColumn("rank", F.col("rank").cast("int")).withColumn(
        "taken", F.col("taken").cast("long"))


# --- export ---------------------------------------------------------------------------------

@query("export_daily", ctes("hits") + """
SELECT site_id, strftime(ts, '%Y-%m-%d') AS dag, count(*) AS sidevisninger, count(DISTINCT visitor_hash) AS unike_besoekende
FROM hits WHERE name = 'pageview' GROUP BY ALL""")
def export_daily(t):
    return ex.daily_series(t.hits)


@query("export_countries", ctes("hits", extra=PV + "," + _DIM_SQL) + """
SELECT site_id, CASE key WHEN 'Norway' THEN 'Norge' WHEN 'Sweden' THEN 'Sverige' WHEN 'Germany' THEN 'Tyskland' WHEN 'United States' THEN 'USA' ELSE key END AS land,
  key AS lagret_verdi, n AS sidevisninger, visitors AS unike_besoekende FROM counted WHERE dim = 'country'""")
def export_countries(t):
    return ex.breakdown_files(t.hits, t.sites)["land"]


def _breakdown_file(name, dim, header):
    @query(f"export_{name}", ctes("hits", extra=PV + "," + _DIM_SQL) + f"""
SELECT site_id, key AS {header}, n AS sidevisninger, visitors AS unike_besoekende FROM counted WHERE dim = '{dim}'""")
    def run(t):
        return ex.breakdown_files(t.hits, t.sites)[name]


for _name, (_dim, _header) in ex.BREAKDOWN_FILES.items():
    if _name != "land":
        _breakdown_file(_name, _dim, _header)


_KR = "concat(CAST(revenue_cents // 100 AS VARCHAR), ',', lpad(CAST(revenue_cents % 100 AS VARCHAR), 2, '0'))"


@query("export_orders", ctes("hits", extra=SOURCED) + f"""
SELECT site_id, currency AS valuta, source AS kilde, orders AS ordrer, {_KR} AS omsetning FROM ({_SRC})""")
def export_orders(t):
    return ex.order_files(t.hits, t.items)["ehandel_kilder"]


@query("export_products", ctes("items") + f"""
SELECT site_id, valuta, produkt, antall, {_KR} AS omsetning FROM (SELECT site_id, coalesce(currency, 'NOK') AS valuta, name AS produkt,
  CAST(sum(qty) AS BIGINT) AS antall, CAST(sum(qty * unit_price_cents) AS BIGINT) AS revenue_cents FROM items GROUP BY ALL)""")
def export_products(t):
    return ex.order_files(t.hits, t.items)["ehandel_produkter"]


@query("export_raw", ctes("hits") + """
SELECT CAST(site_id AS VARCHAR) AS site_id, CAST(id AS VARCHAR) AS hendelse_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tidspunkt_utc, name AS hendelse, path AS side,
  coalesce(referrer_src, '') AS kilde, coalesce(country, '') AS land, coalesce(region, '') AS region, device AS enhet, browser AS nettleser, coalesce(os, '') AS operativsystem,
  coalesce(utm_source, '') AS utm_source, coalesce(utm_medium, '') AS utm_medium, coalesce(utm_campaign, '') AS utm_campaign,
  coalesce(CAST(revenue_cents AS VARCHAR), '') AS omsetning_minste_enhet, coalesce(currency, '') AS valuta, coalesce(payment_method, '') AS betalingsmaate FROM hits""")
def export_raw(t):
    return csv_sink.cells(ex.raw_files(t.hits, t.items)["raadata_hendelser"])


@query("export_raw_items", ctes("items") + """
SELECT site_id, id AS varelinje_id, event_id AS hendelse_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tidspunkt_utc, name AS produkt, qty AS antall,
  unit_price_cents AS enhetspris_minste_enhet, currency AS valuta FROM items""")
def export_raw_items(t):
    return ex.raw_files(t.hits, t.items)["raadata_varelinjer"].withColumn("tidspunkt_utc", _ts("tidspunkt_utc"))


def _site_tables(t):
    none = t.hits.where("false")
    return ex.SiteTables(t.hits, t.items, t.sites, t.goals, t.funnels, none, none, t.bots, none)


def _direct_file(name, file, sql):
    @query(f"export_{name}", sql)
    def run(t):
        return ex.direct_files(_site_tables(t))[file]


_direct_file("robots", "roboter", ctes("hits", "bots") + """
SELECT site_id, strftime(day, '%Y-%m-%d') AS dag, bot_class AS klasse, agent, path AS side, n AS antall FROM bots""")
_direct_file("site", "nettsted", ctes("sites") + """
SELECT id AS site_id, domain AS domene, public_id AS nettsted_id, public_dash = 1 AS offentlig_dashboard FROM sites""")


@query("export_account", ctes("tenants") + """
SELECT id AS tenant_id, name AS firmanavn, plan, strftime(trial_ends_at, '%Y-%m-%d %H:%M:%S') AS proveperiode_slutt,
  strftime(cancelled_at, '%Y-%m-%d %H:%M:%S') AS avsluttet FROM tenants""")
def export_account(t):
    return ex.account_tables(t.tenants, t.users)["konto"].select(
        "tenant_id", "firmanavn", "plan", _ts("proveperiode_slutt").alias("proveperiode_slutt"), _ts("avsluttet").alias("avsluttet"))


@query("export_users", ctes("users") + """
SELECT tenant_id, email AS epost, email_verified = 1 AS bekreftet, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS opprettet FROM users""")
def export_users(t):
    return ex.account_tables(t.tenants, t.users)["brukere"].withColumn("opprettet", _ts("opprettet"))


@query("export_cells", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  CASE WHEN l_discount = floor(l_discount) THEN CAST(CAST(l_discount AS BIGINT) AS VARCHAR)
    ELSE replace(rtrim(rtrim(printf('%.4f', l_discount), '0'), '.'), '.', ',') END AS l_discount,
  concat('''', '=', l_returnflag) AS formula FROM lineitem""")
def export_cells(t):
    return csv_sink.cells(t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", F.concat(F.lit("="), "l_returnflag").alias("formula")))


@query("export_folders", """
SELECT c_custkey AS site_id, CAST(c_nationkey AS BIGINT) AS tenant_id, CASE WHEN r = 1 THEN f ELSE concat(f, '-', CAST(r AS VARCHAR)) END AS folder FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey, lower(f) ORDER BY d, c_custkey) AS r FROM (
    SELECT *, concat(c_mktsegment, '.example_s') AS f, concat(c_mktsegment, '.example/s') AS d FROM customer))""")
def export_folders(t):
    return ex.folder_names(t.raw("customer").selectExpr(
        "c_custkey AS id", "CAST(c_nationkey AS BIGINT) AS tenant_id", "concat(c_mktsegment, '.example/s') AS domain"))


@query("country_labels", ctes("hits") + """
SELECT CASE country WHEN 'Norway' THEN 'Norge' WHEN 'Sweden' THEN 'Sverige' WHEN 'Germany' THEN 'Tyskland' WHEN 'United States' THEN 'USA' END AS label, count(*) AS n
FROM hits GROUP BY 1""")
def country_labels(t):
    return t.hits.groupBy(country_label(F.col("country")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
