"""Cleaning, classification, the ingest plan and bursts over the driver tables."""

from __future__ import annotations

import re
import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from footfall.functions import agents, cleaning, masking, network, referrers
from footfall.operators import bursts as bu
from footfall.operators import upkeep as up
from footfall.plans import ingest as ig
from footfall.session import cut_lineage, shared_dir
from footfall.sources.beacons import respect_opt_out
from footfall.sources.versions import StoredTable
from footfall.streaming.keyed import live_bursts, use_state_store
from footfall.workload.registry import query
from footfall.workload.views import ctes

# --- single rules over whole tables -----------------------------------------------------------

# Every order as a path of one of twelve shapes; the same text in both dialects.
_PATHS = """
SELECT o_orderkey AS id, CASE o_orderkey % 12
  WHEN 0 THEN concat('/order/', substr(md5(CAST(o_orderkey AS {S})), 1, 16), '/receipt.pdf')
  WHEN 1 THEN concat('/checkout/order-received/', CAST(o_orderkey AS {S}), '/')
  WHEN 2 THEN concat('/files/report-', substr(md5(CAST(o_orderkey AS {S})), 1, 8), '-', substr(md5(CAST(o_orderkey AS {S})), 9, 4), '-',
    substr(md5(CAST(o_orderkey AS {S})), 13, 4), '-', substr(md5(CAST(o_orderkey AS {S})), 17, 4), '-', substr(md5(CAST(o_orderkey AS {S})), 21, 12), '.pdf')
  WHEN 3 THEN concat('/n/', lpad(CAST(o_orderkey AS {S}), 12, '7'))
  WHEN 4 THEN concat('/n/', lpad(CAST(o_orderkey AS {S}), 11, '7'))
  WHEN 5 THEN concat('/unsubscribe/kunde', CAST(o_orderkey AS {S}), '%40example.no')
  WHEN 6 THEN '/guide/esim-tyrkia-10gb-30-dager'
  WHEN 7 THEN concat('/a/', substr(md5(CAST(o_orderkey AS {S})), 1, 11))
  WHEN 8 THEN concat('/a/', substr(md5(CAST(o_orderkey AS {S})), 1, 12))
  WHEN 9 THEN concat('/t/', upper(substr(md5(CAST(o_orderkey AS {S})), 1, 6)), '_', substr(md5(CAST(o_orderkey AS {S})), 7, 6), '-', upper(substr(md5(CAST(o_orderkey AS {S})), 13, 6)))
  WHEN 10 THEN concat('/Order/', CAST(o_orderkey AS {S}), '/view')
  ELSE concat('/p/', substr(md5(CAST(o_orderkey AS {S})), 1, 4), '-xyz-', CAST(o_orderkey AS {S})) END AS path
FROM orders"""
_SLUGS = ", ".join(f"'{s}'" for s in masking.ORDER_SLUGS)
_CLASS = "CASE WHEN regexp_matches(substr({s}, {i}, 1), '[0-9]') THEN 0 WHEN regexp_matches(substr({s}, {i}, 1), '[A-Z]') THEN 1 WHEN regexp_matches(substr({s}, {i}, 1), '[a-z]') THEN 2 END"
_MASK_SQL = f"""
segs AS (SELECT id, seg, i, lag(seg) OVER (PARTITION BY id ORDER BY i) AS before FROM (
  SELECT id, unnest(string_split(path, '/')) AS seg, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM paths)),
tested AS (SELECT *, (lower(before) IN ({_SLUGS}) AND regexp_matches(seg, '[0-9]'))
  OR regexp_matches(seg, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}')
  OR regexp_matches(seg, '(?i)[^@/\\s]+(@|%40)[^@/\\s]+\\.[a-z]{{2,}}')
  OR regexp_matches(seg, '[0-9]{{12}}')
  OR len(list_filter(regexp_extract_all(seg, '[0-9A-Fa-f]{{12,}}'), lambda r: regexp_matches(r, '[0-9]'))) > 0
  OR len(list_filter(regexp_extract_all(seg, '[A-Za-z0-9]{{16,}}'), lambda r: regexp_matches(r, '[0-9]') AND regexp_matches(r, '[A-Za-z]'))) > 0
  OR (regexp_full_match(seg, '[A-Za-z0-9_-]{{16,}}') AND regexp_matches(seg, '[0-9]') AND regexp_matches(seg, '[A-Za-z]')
    AND len(list_filter(range(1, length(seg)), lambda k: ({_CLASS.format(s='seg', i='k')}) <> ({_CLASS.format(s='seg', i='k + 1')}))) >= greatest(5, ceil(length(seg) / 3.0)))
  AS hit FROM segs)
SELECT id, string_agg(CASE WHEN hit THEN ':id' ELSE seg END, '/' ORDER BY i) AS masked FROM tested GROUP BY id"""


@query("mask_path", "WITH paths AS (" + _PATHS.format(S="VARCHAR") + "),\n" + _MASK_SQL)
def mask_path(t):
    p = t.spark.sql(_PATHS.format(S="STRING").replace("FROM orders", "FROM {orders}"), orders=t.raw("orders"))
    return p.select("id", masking.mask_path(F.col("path")).alias("masked"))


@query("mask_label", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'paid  :id/x y' ELSE concat('step ', CAST(o_orderkey AS VARCHAR), ' done') END AS label FROM orders""")
def mask_label(t):
    p = t.raw("orders").selectExpr(
        "o_orderkey AS id",
        "CASE WHEN o_orderkey % 2 = 0 THEN concat('paid  ', lpad(CAST(o_orderkey AS STRING), 12, '4'), '/x y') ELSE concat('step ', o_orderkey, ' done') END AS name")
    return p.select("id", masking.mask_label(F.col("name")).alias("label"))


@query("clean_path", """
SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (
  SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^[^?#]*'), ';[^/]*$', '') AS p FROM pages)""")
def clean_path(t):
    return t.raw("pages").select("page_id", cleaning.clean_path(F.col("url")).alias("path"))


@query("referrer_host", """
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages
UNION ALL SELECT -1 - page_id, 'www.shop.example' FROM pages""")
def referrer_host(t):
    p = t.raw("pages")
    creds = p.selectExpr("-1 - page_id AS page_id", "concat('HTTPS://user:', page_id, '@WWW.Shop.example:8443/x') AS url")
    return p.select("page_id", "url").unionByName(creds).select("page_id", cleaning.referrer_host(F.col("url")).alias("host"))


@query("normalize_domain", """
SELECT page_id, regexp_replace(trim(regexp_extract(regexp_replace(lower(trim(url)), '^https?://', ''), '^[^?]*'), '/'), '^www\\.', '') AS domain FROM pages""")
def normalize_domain(t):
    return t.raw("pages").select("page_id", cleaning.normalize_domain(F.col("url")).alias("domain"))


@query("clean_fields", """
SELECT l_orderkey * 10 + l_linenumber AS id,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN CAST(floor(l_extendedprice) AS BIGINT)
    WHEN l_extendedprice = floor(l_extendedprice) AND l_linenumber % 4 = 2 THEN CAST(l_extendedprice AS BIGINT) END AS revenue,
  CASE l_suppkey % 4 WHEN 0 THEN 'NOK' WHEN 1 THEN 'EUR' WHEN 2 THEN NULL ELSE 'NOK' END AS currency,
  CASE WHEN l_partkey % 3 = 0 THEN concat('m_', CAST(l_partkey AS VARCHAR)) END AS payment,
  CASE WHEN l_quantity BETWEEN 1 AND 999 THEN CAST(l_quantity AS INT) ELSE 1 END AS qty
FROM lineitem""")
def clean_fields(t):
    body = t.raw("lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id",
        """concat('{"rv":', CASE l_linenumber % 4 WHEN 0 THEN concat('"', floor(l_extendedprice), '"') WHEN 1 THEN concat(floor(l_extendedprice), '.0')
             WHEN 2 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) ELSE 'true' END,
           ',"cur":', CASE l_suppkey % 4 WHEN 0 THEN '""' WHEN 1 THEN '" eur"' WHEN 2 THEN '"KR"' ELSE 'null' END,
           ',"pm":', CASE WHEN l_partkey % 3 = 0 THEN concat('" M_', l_partkey, ' "') ELSE '"not a slug!"' END,
           ',"it":[{"n":"x","q":', CAST(l_quantity AS INT), '}]}') AS body""")
    p = F.col("p")
    return body.withColumn("p", F.try_parse_json("body")).select(
        "id", cleaning.clean_money(F.try_variant_get(p, "$.rv", "variant")).alias("revenue"),
        cleaning.clean_currency(F.try_variant_get(p, "$.cur", "variant")).alias("currency"),
        cleaning.clean_payment(cleaning.text_field(p, "$.pm")).alias("payment"),
        cleaning.clean_items(F.try_variant_get(p, "$.it", "variant"))[0]["qty"].alias("qty"))


_UAS = {
    0: ("Mozilla/5.0 (compatible; GPTBot/1.2; +https://openai.com/gptbot)", "ai", "GPTBot"),
    1: ("curl/8.5.0", "script", "curl"),
    2: ("SomeCrawler/1.0", "other", "crawl"),
    3: ("Opera/8.57.(X11; Linux) Presto/2.9", "script", "fake-ua"),
    4: ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/126.0 Safari/537.36 Edg/126.0", None, None),
    5: ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Mobile/15E148 Safari/604.1", None, None),
    6: ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "search", "Googlebot"),
    7: ("  ", "script", "empty"),
}


def _case(index: str, col: int) -> str:
    return f"CASE {index} " + " ".join(
        f"WHEN {k} THEN '{v[col]}'" for k, v in _UAS.items() if v[col] is not None) + " END"


@query("classify_agents", f"""
SELECT event_id, {_case('event_id % 8', 1)} AS bot_class, {_case('event_id % 8', 2)} AS agent,
  CASE event_id % 8 WHEN 5 THEN 'mobil' ELSE 'desktop' END AS device,
  CASE event_id % 8 WHEN 4 THEN 'Edge' WHEN 5 THEN 'Safari' WHEN 3 THEN 'Opera' ELSE 'Annet' END AS browser,
  CASE event_id % 8 WHEN 4 THEN 'Windows' WHEN 5 THEN 'iOS' WHEN 3 THEN 'Linux' ELSE 'Annet' END AS os FROM events""")
def classify_agents(t):
    e = t.raw("events").selectExpr("event_id", f"{_case('event_id % 8', 0)} AS ua")
    c, u = agents.classify_ua(F.col("ua")), agents.parse_ua(F.col("ua"))
    return e.select("event_id", c["bot_class"].alias("bot_class"), c["agent"].alias("agent"), u["device"].alias("device"),
                    u["browser"].alias("browser"), u["os"].alias("os"))


@query("spoofed_referrers", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 IN (0, 3) THEN 1 ELSE 0 END AS fake FROM customer""")
def spoofed_referrers(t):
    hosts = "CASE c_custkey % 5 WHEN 0 THEN 'www.yahoo.no' WHEN 1 THEN 'www.google.no' WHEN 2 THEN 'yandex.com.tr' WHEN 3 THEN 'BING.co.uk.' ELSE 'yahoo.no.example.com' END"
    return t.raw("customer").selectExpr("c_custkey AS id", f"{hosts} AS host").select(
        "id", agents.spoofed_referrer(F.col("host")).cast("int").alias("fake"))


@query("ai_keys", ctes("hits") + """
SELECT id, CASE WHEN referrer_src IN ('chatgpt.com', 'www.perplexity.ai') THEN replace(referrer_src, 'www.', '')
  WHEN utm_source = 'ChatGPT' THEN 'chatgpt.com' END AS assistant FROM hits""")
def ai_keys(t):
    r, u = F.col("referrer_src"), F.col("utm_source")
    return t.hits.select("id", F.when(referrers.is_ai_referral(r, u), referrers.ai_key(r, u)).alias("assistant"))


@query("private_addresses", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 0 END AS private FROM events""")
def private_addresses(t):
    ip = """CASE event_id % 6 WHEN 0 THEN concat('10.', user_id % 256, '.', event_id % 256, '.7') WHEN 1 THEN concat('84.208.', user_id % 256, '.', event_id % 256)
      WHEN 2 THEN concat('fd00::', hex(event_id % 65536)) WHEN 3 THEN concat('2a02:', hex(user_id % 65536), '::1') WHEN 4 THEN concat('::ffff:192.168.', event_id % 256, '.1')
      ELSE 'not-an-ip' END"""
    return t.raw("events").selectExpr("event_id", f"{ip} AS ip").select(
        "event_id", network.is_private_ip(F.col("ip")).cast("int").alias("private"))


_GEO = "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def geo_ranges(t):
    n, r = t.raw("nation"), t.raw("region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "concat('84.', n_nationkey, '.0.0') AS start_ip", "concat('84.', n_nationkey, '.255.255') AS end_ip",
        "n_name AS country", "r_name AS region")


def asn_ranges(t):
    return t.spark.createDataFrame(
        [("52.0.0.0", "52.31.255.255", 16509), ("95.216.0.0", "95.217.255.255", 24940), ("84.0.0.0", "84.255.255.255", 2119)],
        "start_ip string, end_ip string, asn int")


@query("geo_lookup", f"""
SELECT event_id, n_name AS country, r_name AS region FROM events LEFT JOIN ({_GEO}) ON n_nationkey = user_id % 30""")
def geo_lookup(t):
    rows = t.raw("events").selectExpr("event_id", "concat('84.', user_id % 30, '.', event_id % 256, '.9') AS ip")
    rows = rows.withColumn("key", network.ip_key(F.col("ip")))
    return network.with_geo(rows, "key", geo_ranges(t)).select("event_id", "country", "region")


@query("datacenter_lookup", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'Hetzner' END AS provider FROM events""")
def datacenter_lookup(t):
    rows = t.raw("events").selectExpr(
        "event_id", "CASE event_id % 3 WHEN 0 THEN concat('52.', event_id % 32, '.1.1') WHEN 1 THEN '95.217.3.4' ELSE '84.1.1.1' END AS ip")
    rows = rows.withColumn("key", network.ip_key(F.col("ip")))
    return network.with_datacenter(rows, "key", asn_ranges(t)).select(
        "event_id", network.datacenter_name(F.col("dc_asn")).alias("provider"))


_NEST = """CASE event_id % 6 WHEN 0 THEN '84.5.1.1' WHEN 1 THEN '84.200.1.1' WHEN 2 THEN '84.5.128.7' WHEN 3 THEN '2a00:1::5'
  WHEN 4 THEN '2a00:1:2::9' ELSE '9.9.9.9' END"""


@query("geo_nested", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Sweden' WHEN 1 THEN 'Norway' WHEN 2 THEN 'Denmark' WHEN 3 THEN 'France' WHEN 4 THEN 'Spain' END AS country,
  CASE event_id % 6 WHEN 0 THEN 'inner' WHEN 1 THEN 'outer' WHEN 2 THEN 'innermost' WHEN 3 THEN 'wide' WHEN 4 THEN 'narrow' END AS region FROM events""")
def geo_nested(t):
    """Nested ranges: each address once, with its most specific range."""
    ranges = t.spark.sql("""SELECT * FROM VALUES ('84.0.0.0', '84.255.255.255', 'Norway', 'outer'), ('84.5.0.0', '84.5.255.255', 'Sweden', 'inner'),
      ('84.5.128.0', '84.5.129.255', 'Denmark', 'innermost'), ('2000::', '3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff', 'France', 'wide'),
      ('2a00:1:2::', '2a00:1:2:ffff:ffff:ffff:ffff:ffff', 'Spain', 'narrow') AS r(start_ip, end_ip, country, region)""")
    rows = t.raw("events").selectExpr("event_id", f"{_NEST} AS ip").withColumn("key", network.ip_key(F.col("ip")))
    return network.with_geo(rows, "key", ranges).select("event_id", "country", "region")


def _address(number: str) -> str:
    return f"concat('84.', {number} div 65536, '.', {number} div 256 % 256, '.', {number} % 256)"


@query("geo_dense", """
WITH r AS (
  SELECT o_orderkey * 37 % 1000000 AS a, o_orderkey * 37 % 1000000 + o_custkey % 997 AS z, o_orderpriority AS country, o_orderstatus AS region FROM orders),
met AS (
  SELECT event_id, country, region, row_number() OVER (PARTITION BY event_id ORDER BY a DESC NULLS LAST, z, country DESC, region DESC) AS place
  FROM events LEFT JOIN r ON event_id * 101 % 1100000 BETWEEN a AND z)
SELECT event_id, country, region FROM met WHERE place = 1""")
def geo_dense(t):
    """A range per order, overlapping at will within a few prefixes: each address once, with its most specific range."""
    r = t.raw("orders").selectExpr(
        "o_orderkey * 37 % 1000000 AS a", "o_orderkey * 37 % 1000000 + o_custkey % 997 AS z",
        "o_orderpriority AS country", "o_orderstatus AS region")
    ranges = r.selectExpr(f"{_address('a')} AS start_ip", f"{_address('z')} AS end_ip", "country", "region")
    rows = t.raw("events").selectExpr("event_id", "event_id * 101 % 1100000 AS n").selectExpr("event_id", f"{_address('n')} AS ip")
    rows = rows.withColumn("key", network.ip_key(F.col("ip")))
    return network.lookup_blocks(rows, "key", ranges, ["country", "region"]).select("event_id", "country", "region")


# --- the whole plan -----------------------------------------------------------------------------

_HUMAN = _UAS[5][0]


def beacons(t):
    """Each driver event as a beacon; its number decides which rule it meets."""
    return t.raw("events").selectExpr(
        "event_id", "ts", "user_id", "event_type", "value",
        "CAST(floor(user_id / 9.0) AS BIGINT) AS person", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k",
    ).selectExpr(
        "event_id AS beacon_id", "ts AS received_at",
        f"""CASE event_id % 12 WHEN 0 THEN '{_UAS[0][0]}' WHEN 1 THEN 'curl/8.5.0' ELSE '{_HUMAN}' END AS user_agent""",
        """CASE event_id % 12 WHEN 4 THEN '52.3.4.5' WHEN 5 THEN '10.0.0.8'
             ELSE concat('1.2.3.4, 84.', person % 30, '.7.', person % 256) END AS x_forwarded_for""",
        "'127.0.0.1' AS peer_ip",
        """CASE WHEN event_id % 12 = 2 THEN '"https://chatgpt.com"' END AS signature_agent""",
        "CAST(NULL AS STRING) AS signature_input",
        """CASE WHEN event_id % 12 = 7 THEN '[1]' ELSE concat(
           '{"s":"', CASE WHEN event_id % 12 = 6 THEN 'nope' ELSE concat('pub', 1 + person % 2) END,
           '","n":"', CASE WHEN event_type IN ('view', 'click', 'error') THEN 'pageview' ELSE event_type END,
           '","p":"https://site.example/p/', k, '?q=', event_id, '","r":"https://www.google.com/search?q=x"',
           CASE WHEN event_id % 12 = 3 THEN ',"wd":1' ELSE '' END,
           CASE WHEN event_id % 5 = 0 THEN ',"us":" news ","um":""' ELSE '' END,
           CASE WHEN event_type = 'purchase' THEN concat(',"pm":"Vipps","it":[{"n":"Item ', k, '","q":2,"p":', CAST(round(value * 100) AS BIGINT), '}]') ELSE '' END,
           '}') END AS body""")


def dimensions(t):
    salts = t.raw("events").selectExpr("to_date(ts) AS day").distinct().withColumn(
        "salt", F.md5(F.col("day").cast("string")))
    return ig.Dimensions(t.sites.select("id", "public_id"), salts, asn_ranges(t), geo_ranges(t))


_BASE = f"""
WITH b AS (SELECT *, CAST(floor(user_id / 9.0) AS BIGINT) AS person, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  event_id % 12 AS m, CASE WHEN event_type IN ('view','click','error') THEN 'pageview' ELSE event_type END AS name FROM events),
g AS ({_GEO}),
ok AS (SELECT b.*, 1 + person % 2 AS site_id, concat('84.', CAST(person % 30 AS VARCHAR), '.7.', CAST(person % 256 AS VARCHAR)) AS ip,
  CASE WHEN event_type = 'purchase' THEN 2 * CAST(round(value * 100) AS BIGINT) END AS total FROM b WHERE m >= 8)"""


@query("ingest_hits", _BASE + f"""
SELECT event_id AS id, site_id, name, concat('/p/', CAST(k AS VARCHAR)) AS path, 'www.google.com' AS referrer_src, n_name AS country, r_name AS region,
  'mobil' AS device, 'Safari' AS browser, 'iOS' AS os, CASE WHEN event_id % 5 = 0 THEN 'news' END AS utm_source, CAST(NULL AS VARCHAR) AS utm_medium,
  sha256(concat(sha256(concat('pepper:', md5(strftime(ts, '%Y-%m-%d')))), '|', ip, '|{_HUMAN}|', CAST(site_id AS VARCHAR))) AS visitor_hash,
  CASE WHEN total BETWEEN 1 AND 100000000 THEN total END AS revenue_cents,
  CASE WHEN event_type = 'purchase' THEN 'NOK' END AS currency, CASE WHEN event_type = 'purchase' THEN 'vipps' END AS payment_method
FROM ok LEFT JOIN g ON n_nationkey = person % 30""")
def ingest_hits(t):
    return ig.ingest(beacons(t), dimensions(t), "pepper").hits.drop("ts", "utm_campaign")


@query("ingest_items", _BASE + """
SELECT event_id, site_id, concat('Item ', CAST(k AS VARCHAR)) AS name, CAST(2 AS INT) AS qty,
  CAST(round(value * 100) AS BIGINT) AS unit_price_cents, 'NOK' AS currency FROM ok WHERE event_type = 'purchase'""")
def ingest_items(t):
    return ig.ingest(beacons(t), dimensions(t), "pepper").items.drop("ts", "id")


@query("ingest_drops", _BASE + """
SELECT 1 + person % 2 AS site_id, CASE WHEN m <= 1 THEN 'bot' WHEN m <= 3 THEN 'agent' WHEN m = 4 THEN 'datacenter' ELSE 'private' END AS reason, count(*) AS n
FROM b WHERE m <= 5 GROUP BY ALL""")
def ingest_drops(t):
    return ig.ingest(beacons(t), dimensions(t), "pepper").drops


@query("ingest_bots", _BASE + """
SELECT 1 + person % 2 AS site_id, strftime(ts, '%Y-%m-%d') AS day,
  CASE m WHEN 0 THEN 'ai' WHEN 1 THEN 'script' WHEN 4 THEN 'datacenter' ELSE 'agent' END AS bot_class,
  CASE m WHEN 0 THEN 'GPTBot' WHEN 1 THEN 'curl' WHEN 2 THEN 'ChatGPT Agent' WHEN 3 THEN 'webdriver' ELSE 'AWS' END AS agent,
  CASE WHEN m IN (0, 2, 3) THEN concat('/p/', CAST(k AS VARCHAR)) ELSE '' END AS path, count(*) AS n FROM b WHERE m <= 4 GROUP BY ALL""")
def ingest_bots(t):
    return ig.ingest(beacons(t), dimensions(t), "pepper").bot_counts.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("ingest_rejects", _BASE + """
SELECT CASE m WHEN 6 THEN 'unknown_site' ELSE 'bad_json' END AS reject, count(*) AS n FROM b WHERE m IN (6, 7) GROUP BY ALL""")
def ingest_rejects(t):
    return ig.ingest(beacons(t), dimensions(t), "pepper").rejects


@query("rate_limit", ctes("hits") + """
SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY day, visitor_hash ORDER BY ts, id) AS r FROM (
  SELECT *, CAST(ts AS DATE) AS day FROM hits)) WHERE r <= 5""")
def rate_limit(t):
    # The hits of a visitor's day put into one minute, five of which pass.
    rows = t.hits.selectExpr("id", "site_id", "visitor_hash", "ts", "to_date(ts) AS day").selectExpr(
        "id", "site_id", "visitor_hash",
        "timestampadd(MICROSECOND, CAST((unix_micros(CAST(ts AS TIMESTAMP)) % 86400000000) / 1440 AS BIGINT), CAST(day AS TIMESTAMP_NTZ)) AS ts")
    return ig.rate_limit(rows, 5, "ts", "id")[0].select("id")


@query("rate_drops", ctes("hits") + """
SELECT site_id, CAST(sum(n - 5) AS BIGINT) AS n FROM (SELECT site_id, visitor_hash, CAST(ts AS DATE), count(*) AS n FROM hits GROUP BY ALL)
WHERE n > 5 GROUP BY site_id""")
def rate_drops(t):
    rows = t.hits.selectExpr("id", "site_id", "visitor_hash", "CAST(to_date(ts) AS TIMESTAMP_NTZ) AS ts")
    return ig.rate_limit(rows, 5, "ts", "id")[1]


@query("salts_kept", "SELECT strftime(max(ts), '%Y-%m-%d') AS day FROM events")
def salts_kept(t):
    return ig.purge_salts(dimensions(t).salts, date(2024, 1, 30)).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("opt_out", "SELECT event_id FROM events WHERE event_id % 4 NOT IN (1, 2)")
def opt_out(t):
    e = t.raw("events").selectExpr(
        "event_id", "event_id % 4 = 1 AS gpc", "CASE event_id % 4 WHEN 2 THEN 'yes' WHEN 3 THEN '0' END AS dnt")
    return respect_opt_out(e).select("event_id")


# --- bursts ---------------------------------------------------------------------------------------

# Customers as planted waves of 1 to 20 landings, 0.45 seconds apart, two hours between waves.
_WAVE = "c_custkey DIV 20 AS w, c_custkey % 20 AS j, 1 + ((c_custkey DIV 20) * 7) % 20 AS size"
_WAVE_SQL = "planted AS (SELECT c_custkey, c_custkey // 20 AS w, c_custkey % 20 AS j, 1 + ((c_custkey // 20) * 7) % 20 AS size FROM customer)"


def with_waves(t):
    planted = t.raw("customer").selectExpr("c_custkey", _WAVE.split(" AS w")[0] + " AS w", "c_custkey % 20 AS j",
                                           "1 + ((c_custkey DIV 20) * 7) % 20 AS size").where("j < size")
    at = "timestampadd(MICROSECOND, CAST(w * 7200000000 + j * 450000 AS BIGINT), TIMESTAMP_NTZ '2024-01-01 00:10:00')"
    landing = planted.selectExpr(
        "10000000000 + c_custkey * 2 AS id", "1 + w % 2 AS site_id", f"{at} AS ts", "'pageview' AS name",
        "concat('/deep/', c_custkey) AS path", "'Iceland' AS country", "sha2(concat('w', c_custkey), 256) AS visitor_hash")
    later = landing.selectExpr(
        "id + 1 AS id", "site_id", "ts + INTERVAL 1 SECOND AS ts", "'checkout_start' AS name", "path", "country", "visitor_hash")
    return t.hits.unionByName(landing, allowMissingColumns=True).unionByName(later, allowMissingColumns=True)


@query("burst_landings", ctes("hits") + """
SELECT site_id, visitor_hash, us, id, path, country, CASE WHEN tagged THEN 1 ELSE 0 END AS tagged FROM (
  SELECT *, epoch_us(ts) AS us, utm_source IS NOT NULL AS tagged, row_number() OVER (PARTITION BY site_id, visitor_hash ORDER BY ts, id) AS r
  FROM hits WHERE name = 'pageview') WHERE r = 1""")
def burst_landings(t):
    return bu.landings(t.hits).withColumn("tagged", F.col("tagged").cast("int"))


@query("burst_candidates", ctes("hits") + """
SELECT site_id, id FROM (SELECT *, row_number() OVER (PARTITION BY site_id, visitor_hash ORDER BY ts, id) AS r
  FROM hits WHERE name = 'pageview') WHERE r = 1 AND country IS NOT NULL AND path <> '/' AND utm_source IS NULL""")
def burst_candidates(t):
    return bu.candidates(bu.landings(t.hits)).select("site_id", "id")


@query("find_bursts", "WITH " + _WAVE_SQL + """
SELECT 1 + w % 2 AS site_id, 'Iceland' AS country, concat('/deep/', CAST(c_custkey AS VARCHAR)) AS path, 10000000000 + c_custkey * 2 AS id
FROM planted WHERE j < size AND (size >= 9 OR (size = 8)) AND (SELECT count(*) FROM planted p WHERE p.w = planted.w AND p.j < p.size) >= 8""")
def find_bursts(t):
    return bu.find_bursts(bu.landings(with_waves(t))).select("site_id", "country", "path", "id")


_FLAG = _WAVE_SQL + """,
fl AS (SELECT *, 1 + w % 2 AS site_id FROM planted WHERE j < size AND (SELECT count(*) FROM planted p WHERE p.w = planted.w AND p.j < p.size) >= 8)"""


@query("burst_move", ctes("hits", "bots", extra=_FLAG) + """
, added AS (SELECT site_id, CAST(TIMESTAMP '2024-01-01 00:10:00' + to_microseconds(CAST(w * 7200000000 + j * 450000 AS BIGINT)) AS DATE) AS day, 2 * count(*) AS n FROM fl GROUP BY ALL)
SELECT site_id, strftime(day, '%Y-%m-%d') AS day, bot_class, agent, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT site_id, day, bot_class, agent, n FROM bots UNION ALL SELECT site_id, day, 'script', 'burst', n FROM added) GROUP BY ALL""")
def burst_move(t):
    hits = with_waves(t)
    out = bu.move_to_bots(hits, t.items, t.bots, bu.find_bursts(bu.landings(hits)))
    return out["bots"].groupBy("site_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "bot_class", "agent").agg(
        F.sum("n").alias("n"))


@query("burst_rest", ctes("hits", extra=_FLAG) + """
SELECT id FROM hits UNION ALL SELECT 10000000000 + c_custkey * 2 + u.d FROM planted, (SELECT unnest([0, 1]) AS d) u
WHERE j < size AND c_custkey NOT IN (SELECT c_custkey FROM fl)""")
def burst_rest(t):
    hits = with_waves(t)
    return bu.move_to_bots(hits, t.items, t.bots, bu.find_bursts(bu.landings(hits)))["hits"].select("id")


@query("burst_report", "WITH " + _FLAG + """
SELECT site_id, 2 * count(*) AS events, count(*) AS visitors, count(*) AS paths, 'Iceland' AS countries FROM fl GROUP BY site_id""")
def burst_report(t):
    hits = with_waves(t)
    return bu.burst_report(hits, bu.find_bursts(bu.landings(hits))).drop("first_us", "last_us")


@query("burst_backfill", ctes("hits", extra=_FLAG) + """
SELECT site_id, 2 * count(*) AS events FROM fl WHERE w < 24 GROUP BY site_id""")
def burst_backfill(t):
    from footfall.schema import ROLLUPS

    window = (datetime(2024, 1, 1), datetime(2024, 1, 3))
    out = bu.burst_backfill(with_waves(t), t.items, t.bots, t.spark.createDataFrame([], ROLLUPS), window)
    return out["report"].select("site_id", "events")


# --- changes of stored tables --------------------------------------------------------------------

def _stored_hits(t, hits, name):
    """Hits as a stored table, files by site and month."""
    rows = hits.withColumn("month", F.date_format("ts", "yyyy-MM"))
    return StoredTable.create(rows, f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}", ["site_id", "month"])


def _per_file(table, changed):
    """(site_id, month, rewritten, n): files are told by their partition."""
    keys = sorted({re.search(r"site_id=(\d+)/month=([\d-]+)/", f).groups() for f in changed})
    hit = table.spark.createDataFrame([(int(a), b) for a, b in keys], "site_id long, month string").withColumn("hit", F.lit(1))
    rows = table.read().groupBy("site_id", "month").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(hit, ["site_id", "month"], "left").select(
        F.col("site_id").cast("long").alias("site_id"), "month", F.coalesce("hit", F.lit(0)).alias("rewritten"), "n")


@query("stored_burst_move", ctes("hits", extra=_FLAG) + """
, every AS (SELECT site_id, id, ts, false AS gone FROM hits UNION ALL
  SELECT 1 + w % 2, 10000000000 + c_custkey * 2 + u.d, TIMESTAMP '2024-01-01 00:10:00' + to_microseconds(CAST(w * 7200000000 + j * 450000 + u.d * 1000000 AS BIGINT)),
    c_custkey IN (SELECT c_custkey FROM fl) FROM planted, (SELECT unnest([0, 1]) AS d) u WHERE j < size)
SELECT site_id, strftime(ts, '%Y-%m') AS month, CASE WHEN bool_or(gone) THEN 1 ELSE 0 END AS rewritten, count(*) FILTER (NOT gone) AS n
FROM every GROUP BY 1, 2 HAVING count(*) FILTER (NOT gone) > 0""")
def stored_burst_move(t):
    """Flagged visitors leave a stored table; months without a burst keep their files."""
    hits = with_waves(t)
    flagged = cut_lineage(bu.find_bursts(bu.landings(hits)))
    table, files = _stored_hits(t, hits, "moved").change(
        flagged, lambda rows: bu.members(rows, flagged)[1], ["site_id", "visitor_hash"])
    return _per_file(table, files)


@query("stored_delete_visitors", ctes("hits") + """
, gone AS (SELECT DISTINCT site_id, visitor_hash FROM hits WHERE id % 7000 = 3)
SELECT h.site_id, strftime(ts, '%Y-%m') AS month, CASE WHEN bool_or(g.site_id IS NOT NULL) THEN 1 ELSE 0 END AS rewritten,
  count(*) FILTER (g.site_id IS NULL) AS n FROM hits h LEFT JOIN gone g ON h.site_id = g.site_id AND h.visitor_hash = g.visitor_hash
GROUP BY 1, 2 HAVING count(*) FILTER (g.site_id IS NULL) > 0""")
def stored_delete_visitors(t):
    """Visitors leave a stored table by key."""
    gone = t.hits.where("id % 7000 = 3").select("site_id", "visitor_hash")
    return _per_file(*_stored_hits(t, t.hits, "deleted").delete(gone, ["site_id", "visitor_hash"]))


@query("stored_blind", ctes("hits") + """
SELECT site_id, strftime(ts, '%Y-%m') AS month, CASE WHEN min(ts) < TIMESTAMP '2024-01-30' THEN 1 ELSE 0 END AS rewritten, count(*) AS n,
  count(*) FILTER (ts < TIMESTAMP '2024-01-30') AS blinded FROM hits GROUP BY 1, 2""")
def stored_blind(t):
    """Visitors of the days before a day get new keys; files of later days stay."""
    today = datetime(2024, 1, 30)
    table, files = _stored_hits(t, t.hits, "blinded").change(F.col("ts") < F.lit(today).cast("timestamp_ntz"), lambda rows: up.blind_hashes(rows, "key", today))
    old = t.hits.select(F.col("id").alias("_id"), F.col("visitor_hash").alias("_old"))
    new = table.read().join(old, F.col("id") == F.col("_id")).groupBy("site_id", "month").agg(
        F.count(F.when(F.col("visitor_hash") != F.col("_old"), 1)).alias("blinded"))
    return _per_file(table, files).join(new, ["site_id", "month"])


# --- live sweep --------------------------------------------------------------------------------

@query("burst_live", "WITH " + _WAVE_SQL + """
SELECT 1 + w % 2 AS site_id, 'Iceland' AS country, concat('/deep/', CAST(c_custkey AS VARCHAR)) AS path, 10000000000 + c_custkey * 2 AS id
FROM planted WHERE j < size AND (SELECT count(*) FROM planted p WHERE p.w = planted.w AND p.j < p.size) >= 8""")
def burst_live(t):
    """The burst rule as a stream with keyed state over the stored hits, to its end."""
    use_state_store(t.spark)
    root = f"{shared_dir(t.spark)}/live-{uuid.uuid4().hex}"
    hits = with_waves(t)
    # A last row, days later, lets the watermark pass all others.
    end = hits.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts")).select("ts", F.lit(0).alias("site_id"), F.lit("pageview").alias("name"), F.lit("end").alias("visitor_hash"))
    hits.unionByName(end.withColumn("site_id", F.col("site_id").cast("long")), allowMissingColumns=True).write.parquet(f"{root}/hits")
    stream = t.spark.readStream.schema(hits.schema).parquet(f"{root}/hits")
    live_bursts(stream).writeStream.format("parquet").option("path", f"{root}/flagged").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("site_id long, country string, path string, id long").parquet(f"{root}/flagged")
