"""The analytics tables as views over the driver tables, in Spark and in SQL.

Both dialects are written from one template so that a query and its SQL twin see the same
rows: `hits` over events, sites and tenants over customer, product lines over lineitem,
search rows over orders, and so on. No view leaves rows of its source out.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from footfall.session import prepare

AS_OF = datetime(2024, 1, 30, 23, 59, 59)

_HITS = """
SELECT event_id AS id, 1 + person % 2 AS site_id, ts,
  CASE WHEN event_type IN ('view','click','error') THEN 'pageview' ELSE event_type END AS name,
  CASE WHEN k % 12 = 0 THEN '/' ELSE concat('/p/', CAST(k % 12 AS {S})) END AS path,
  CASE event_id % 7 WHEN 0 THEN 'google.com' WHEN 1 THEN 'chatgpt.com' WHEN 2 THEN 'www.perplexity.ai'
    WHEN 3 THEN concat('site', CAST(1 + person % 2 AS {S}), '.example') WHEN 4 THEN 'checkout.vipps.no' END AS referrer_src,
  CASE event_id % 5 WHEN 0 THEN 'Norway' WHEN 1 THEN 'Sweden' WHEN 2 THEN 'Germany' WHEN 3 THEN 'United States' END AS country,
  CASE event_id % 4 WHEN 0 THEN 'Oslo' WHEN 1 THEN 'Vestland' WHEN 2 THEN 'Troms' END AS region,
  CASE user_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobil' ELSE 'tablet' END AS device,
  CASE user_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Safari' ELSE 'Edge' END AS browser,
  CASE user_id % 5 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS' WHEN 2 THEN 'macOS' WHEN 3 THEN 'Android' END AS os,
  CASE event_id % 11 WHEN 0 THEN 'newsletter' WHEN 1 THEN 'ChatGPT' END AS utm_source,
  CASE event_id % 11 WHEN 0 THEN 'email' END AS utm_medium,
  CASE event_id % 11 WHEN 0 THEN concat('c', CAST(k % 3 AS {S})) END AS utm_campaign,
  {HASH} AS visitor_hash,
  CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END AS revenue_cents,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'EUR' END AS currency,
  CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0 THEN CASE k % 2 WHEN 0 THEN 'vipps' ELSE 'stripe_card' END END AS payment_method
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
             CAST(floor(user_id / 9.0) AS BIGINT) AS person FROM events) e"""

_RAW = "concat('salt|', CAST(1 + person % 2 AS {S}), '|', CAST(person AS {S}), '|', {DAY})"

_SITES = """
SELECT * FROM (VALUES
  (CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'site1.example', 'pub1', 1),
  (CAST(2 AS BIGINT), CAST(1 AS BIGINT), 'site2.example', 'pub2', 0),
  (CAST(3 AS BIGINT), CAST(2 AS BIGINT), 'empty.example', 'pub3', 0)
) AS s(id, tenant_id, domain, public_id, public_dash)"""

_ITEMS = """
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(1 + l_suppkey % 2 AS BIGINT) AS site_id,
  l_orderkey AS event_id, l_shipdate AS ts, p_name AS name, CAST(l_quantity AS INT) AS qty,
  CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS unit_price_cents,
  CASE WHEN l_linenumber % 3 = 0 THEN 'EUR' END AS currency
FROM lineitem JOIN part ON l_partkey = p_partkey"""

_GOALS = """
SELECT * FROM (VALUES
  (CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'Page three', 'path', '/p/3'),
  (CAST(2 AS BIGINT), CAST(1 AS BIGINT), 'Sign-up', 'event', 'signup'),
  (CAST(3 AS BIGINT), CAST(2 AS BIGINT), 'Never', 'path', '/none'),
  (CAST(4 AS BIGINT), CAST(2 AS BIGINT), 'Bought', 'event', 'purchase')
) AS g(id, site_id, name, match_type, match_value)"""

_FUNNELS = """
SELECT * FROM (VALUES
  (CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'Front to buy',
   '[{{"type":"path","value":"/"}},{{"type":"path","value":"/p/3"}},{{"type":"event","value":"purchase"}}]'),
  (CAST(2 AS BIGINT), CAST(2 AS BIGINT), 'Front to buy',
   '[{{"type":"path","value":"/"}},{{"type":"path","value":"/p/3"}},{{"type":"event","value":"purchase"}}]'),
  (CAST(3 AS BIGINT), CAST(2 AS BIGINT), 'Twice',
   '[{{"type":"path","value":"/p/5"}},{{"type":"path","value":"/p/5"}}]')
) AS f(id, site_id, name, steps)"""

_BOTS = """
SELECT site_id, day, bot_class, agent,
  CASE WHEN bot_class IN ('ai', 'search', 'agent') THEN path ELSE '' END AS path, count(*) AS n
FROM (SELECT site_id, CAST(ts AS DATE) AS day, path,
        CASE id % 8 WHEN 0 THEN 'ai' WHEN 1 THEN 'search' WHEN 2 THEN 'agent' WHEN 3 THEN 'script'
          WHEN 4 THEN 'social' WHEN 5 THEN 'monitor' WHEN 6 THEN 'datacenter' ELSE 'other' END AS bot_class,
        concat('agent', CAST(id % 5 AS {S})) AS agent
      FROM hits) b
GROUP BY site_id, day, bot_class, agent, CASE WHEN bot_class IN ('ai', 'search', 'agent') THEN path ELSE '' END"""

_SEARCH = """
SELECT 1 + o_custkey % 2 AS site_id, CAST(o_orderdate AS DATE) AS day,
  CASE o_orderkey % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'bing' ELSE 'gmc' END AS source,
  CASE o_orderkey % 2 WHEN 0 THEN 'total' ELSE 'query' END AS dim, o_orderpriority AS key,
  CAST(sum(o_custkey % 50) AS BIGINT) AS clicks, CAST(sum(100 + o_custkey % 900) AS BIGINT) AS impressions,
  CAST(min(1 + o_orderkey % 40) AS DOUBLE) AS position
FROM orders
GROUP BY 1 + o_custkey % 2, CAST(o_orderdate AS DATE),
  CASE o_orderkey % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'bing' ELSE 'gmc' END,
  CASE o_orderkey % 2 WHEN 0 THEN 'total' ELSE 'query' END, o_orderpriority"""

_TENANTS = """
SELECT c_custkey + 1 AS id, c_name AS name,
  CASE c_custkey % 7 WHEN 0 THEN 'trial' WHEN 1 THEN 'liten' WHEN 2 THEN 'vekst' WHEN 3 THEN 'pro'
    WHEN 4 THEN 'byra' WHEN 5 THEN 'cancelled' ELSE 'trial' END AS plan,
  CASE WHEN c_custkey % 7 IN (0, 6) THEN {TS0} + ({DAYS}) END AS trial_ends_at,
  CASE WHEN c_custkey % 9 = 0 THEN {TS0} END AS trial_reminded_at,
  CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS email_optout,
  CASE WHEN c_custkey % 4 = 0 THEN '2024-01' END AS overage_notified_month,
  CASE WHEN c_custkey % 17 = 0 THEN 'sub' END AS stripe_subscription_id,
  CASE WHEN c_custkey % 19 = 0 THEN 'agr' END AS vipps_agreement_id,
  CAST(NULL AS {S}) AS vipps_pending_plan, CAST(NULL AS {S}) AS invoice_details,
  CASE WHEN c_custkey % 7 = 5 THEN {TS0} + ({DAYS}) END AS cancelled_at,
  CASE WHEN c_custkey % 5 = 0 THEN {TS0} + ({DAYS}) + INTERVAL 75 DAY END AS deletion_warned_at,
  {TS0} + ({DAYS}) - INTERVAL 30 DAY AS created_at
FROM customer"""

_USERS = """
SELECT c_custkey * 2 + 1 AS id, c_custkey + 1 AS tenant_id,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat(lower(c_name), '@example.com') END AS email, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS email_verified,
  {TS0} + ({DAYS}) - INTERVAL 30 DAY AS created_at
FROM customer"""

_TEMPLATES = {
    "hits": _HITS, "sites": _SITES, "items": _ITEMS, "goals": _GOALS, "funnels": _FUNNELS,
    "bots": _BOTS, "search": _SEARCH, "tenants": _TENANTS, "users": _USERS,
}
_NEEDS = {"bots": ["hits"]}

_SPARK = {
    "S": "STRING",
    "HASH": "sha2(" + _RAW.format(S="STRING", DAY="date_format(ts, 'yyyy-MM-dd')") + ", 256)",
    "TS0": "TIMESTAMP_NTZ '2024-01-01 00:00:00'",
    "DAYS": "make_dt_interval(CAST(c_custkey % 200 AS INT))",
}
_DUCK = {
    "S": "VARCHAR",
    "HASH": "sha256(" + _RAW.format(S="VARCHAR", DAY="strftime(ts, '%Y-%m-%d')") + ")",
    "TS0": "TIMESTAMP '2024-01-01 00:00:00'",
    "DAYS": "to_days(CAST(c_custkey % 200 AS INT))",
}


def ctes(*names: str, extra: str = "") -> str:
    """WITH clause of the named views (and what they need) for the SQL twin."""
    order: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    parts = [f"{n} AS ({_TEMPLATES[n].format(**_DUCK)})" for n in order]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


class Tables:
    """Driver tables of one directory and the views over them, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self._once(f"{name}.parquet", lambda: self.spark.read.parquet(f"{self.dir}/{name}.parquet"))

    def _once(self, key: str, make) -> DataFrame:
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def view(self, name: str) -> DataFrame:
        text = _TEMPLATES[name].format(**_SPARK)
        sources = {
            "hits": ["events"], "items": ["lineitem", "part"], "search": ["orders"],
            "tenants": ["customer"], "users": ["customer"],
        }.get(name, [])
        frames = {s: self.raw(s) for s in sources}
        if name == "bots":
            frames["hits"] = self.hits
        for s in frames:
            text = text.replace(f"FROM {s}", f"FROM {{{s}}}").replace(f"JOIN {s}", f"JOIN {{{s}}}")
        return self.spark.sql(text, **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in _TEMPLATES:
            return self._once(name, lambda: self.view(name))
        raise AttributeError(name)
