"""Goals, funnels, orders, robots and AI referrals."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions.timewin import bot_days
from footfall.operators import commerce as c
from footfall.operators import funnels as fn
from footfall.operators import robots as r
from footfall.workload.metrics import PV, WHOLE
from footfall.workload.registry import query
from footfall.workload.views import AS_OF, ctes


def funnel_sql(digits: int) -> str:
    rate = "CAST(round_even(visitors / base * 100, 0) AS BIGINT)" if digits == 0 else (
        f"round_even(visitors / base * 100, {digits})")
    zero = "CAST(0 AS BIGINT)" if digits == 0 else "CAST(0 AS DOUBLE)"
    return f"""
, steps AS (SELECT f.site_id, f.id AS funnel_id, f.name AS funnel, i.i AS pos,
  f.steps->i.i->>'type' AS type, f.steps->i.i->>'value' AS value
  FROM (SELECT site_id, id, name, CAST(steps AS JSON) AS steps FROM funnels) f,
       (SELECT unnest(range(0, 10)) AS i) i WHERE i.i < json_array_length(f.steps)),
m AS (SELECT s.funnel_id, s.pos, h.site_id, h.visitor_hash, epoch_us(h.ts) AS us, h.id FROM steps s JOIN hits h
  ON h.site_id = s.site_id AND ((s.type = 'event' AND h.name = s.value) OR (s.type <> 'event' AND h.name = 'pageview' AND h.path = s.value))),
s0 AS (SELECT funnel_id, site_id, visitor_hash, min(us) AS us FROM m WHERE pos = 0 GROUP BY ALL),
s1 AS (SELECT m.funnel_id, m.site_id, m.visitor_hash, min(m.us) AS us FROM m JOIN s0 USING (funnel_id, site_id, visitor_hash)
  WHERE m.pos = 1 AND m.us > s0.us GROUP BY ALL),
s2 AS (SELECT m.funnel_id, m.site_id, m.visitor_hash, min(m.us) AS us FROM m JOIN s1 USING (funnel_id, site_id, visitor_hash)
  WHERE m.pos = 2 AND m.us > s1.us GROUP BY ALL),
c AS (SELECT funnel_id, 0 AS pos, count(*) AS visitors FROM s0 GROUP BY ALL UNION ALL
  SELECT funnel_id, 1, count(*) FROM s1 GROUP BY ALL UNION ALL SELECT funnel_id, 2, count(*) FROM s2 GROUP BY ALL),
o AS (SELECT s.*, coalesce(c.visitors, 0) AS visitors,
  first_value(coalesce(c.visitors, 0)) OVER w AS base, lag(coalesce(c.visitors, 0)) OVER w AS prev
  FROM steps s LEFT JOIN c ON c.funnel_id = s.funnel_id AND c.pos = s.pos WINDOW w AS (PARTITION BY s.funnel_id ORDER BY s.pos))
SELECT site_id, funnel_id, funnel, CAST(pos + 1 AS INT) AS step, type, value, visitors,
  CASE WHEN base = 0 THEN {zero} ELSE {rate} END AS rate, coalesce(prev, visitors) - visitors AS dropped FROM o"""


@query("funnel", ctes("hits", "funnels") + funnel_sql(0))
def funnel(t):
    return fn.funnel(t.hits, t.funnels, WHOLE)


@query("funnel_export", ctes("hits", "funnels") + funnel_sql(1))
def funnel_export(t):
    return fn.funnel(t.hits, t.funnels, None, digits=1)


@query("definitions_merge", ctes("hits", "goals") + """
SELECT site_id, name, match_type, match_value FROM goals UNION ALL
SELECT DISTINCT site_id, concat('Event ', name), 'event', name FROM hits
WHERE (site_id, concat('Event ', name)) NOT IN (SELECT (site_id, name) FROM goals)""")
def definitions_merge(t):
    seeds = t.hits.selectExpr("site_id", "concat('Event ', name) AS name", "'event' AS match_type", "name AS match_value")
    once = fn.merge_definitions(t.goals, seeds)
    return fn.merge_definitions(once, seeds).select("site_id", "name", "match_type", "match_value")


ORDERS = "o AS (SELECT *, coalesce(currency, 'NOK') AS cur, coalesce(payment_method, 'ukjent') AS method FROM hits WHERE revenue_cents IS NOT NULL)"
SOURCED = ORDERS + """,
f AS (SELECT site_id, visitor_hash, min(ts) AS ts, arg_min(coalesce(utm_source, referrer_src, 'direkte'), (ts, id)) AS src
  FROM hits WHERE name = 'pageview' GROUP BY ALL),
os AS (SELECT o.*, CASE WHEN f.ts <= o.ts AND f.src <> 'checkout.vipps.no' THEN f.src ELSE 'direkte' END AS source
  FROM o LEFT JOIN f USING (site_id, visitor_hash))"""


def _ranked(select: str, part: str, order: str, k: int, cols: str) -> str:
    return f"""SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rk
  FROM ({select})) WHERE rk <= {k}"""


_CUR = "SELECT site_id, cur AS currency, count(*) AS orders, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents FROM o GROUP BY ALL"
_SRC = "SELECT site_id, cur AS currency, source, count(*) AS orders, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents FROM os GROUP BY ALL"
_PAY = "SELECT site_id, cur AS currency, method, count(*) AS orders, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents FROM o GROUP BY ALL"
_PROD = """SELECT site_id, coalesce(currency, 'NOK') AS currency, name AS product, CAST(sum(qty) AS BIGINT) AS qty,
  CAST(sum(qty * unit_price_cents) AS BIGINT) AS revenue_cents FROM items GROUP BY ALL"""


@query("orders_by_currency", ctes("hits", extra=ORDERS) + _CUR)
def orders_by_currency(t):
    return c.orders_by_currency(t.hits, WHOLE)


@query("dominant_currency", ctes("hits", "sites", extra=ORDERS) + f"""
SELECT s.id AS site_id, coalesce(x.currency, 'NOK') AS currency FROM sites s LEFT JOIN (
  {_ranked(_CUR, 'site_id', 'orders DESC, currency', 1, 'site_id, currency')}) x ON x.site_id = s.id""")
def dominant_currency(t):
    return c.dominant_currency(t.hits, t.sites, WHOLE)


@query("top_products", ctes("items") + _ranked(
    _PROD, "site_id, currency", "revenue_cents DESC, product", 10, "site_id, currency, product, qty, revenue_cents"))
def top_products(t):
    return c.top_products(t.items, None, None)


@query("revenue_by_source", ctes("hits", extra=SOURCED) + _ranked(
    f"SELECT * FROM ({_SRC}) WHERE currency = 'NOK'", "site_id", "revenue_cents DESC, source", 10,
    "site_id, currency, source, orders, revenue_cents"))
def revenue_by_source(t):
    return c.revenue_by_source(t.hits, WHOLE)


@query("revenue_by_source_all", ctes("hits", extra=SOURCED) + _SRC)
def revenue_by_source_all(t):
    return c.revenue_by_source(t.hits, None, None, None)


@query("revenue_by_payment", ctes("hits", extra=ORDERS) + f"SELECT * FROM ({_PAY}) WHERE currency = 'NOK'")
def revenue_by_payment(t):
    return c.revenue_by_payment(t.hits, WHOLE)


@query("revenue_by_payment_all", ctes("hits", extra=ORDERS) + _PAY)
def revenue_by_payment_all(t):
    return c.revenue_by_payment(t.hits, None, None, None)


@query("ecommerce_report", ctes("hits", "items", extra=SOURCED) + f"""
, dom AS ({_ranked(_CUR, 'site_id', 'orders DESC, currency', 1, 'site_id, currency')})
SELECT site_id, 'revenue' AS section, currency AS key, currency, orders AS n, revenue_cents FROM ({_CUR})
UNION ALL SELECT x.site_id, 'products', x.product, x.currency, x.qty, x.revenue_cents FROM (
  {_ranked(_PROD, 'site_id, currency', 'revenue_cents DESC, product', 100, '*')}) x JOIN dom USING (site_id, currency)
UNION ALL SELECT x.site_id, 'sources', x.source, x.currency, x.orders, x.revenue_cents FROM ({_SRC}) x JOIN dom USING (site_id, currency)
UNION ALL SELECT x.site_id, 'payment_methods', x.method, x.currency, x.orders, x.revenue_cents FROM ({_PAY}) x JOIN dom USING (site_id, currency)""")
def ecommerce_report(t):
    return c.ecommerce_report(t.hits, t.items, t.sites)


@query("bot_summary", ctes("bots") + """
, a AS (SELECT site_id, 'agents' AS section, bot_class, agent AS key, CAST(sum(n) AS BIGINT) AS n FROM bots GROUP BY ALL),
p AS (SELECT site_id, 'ai_paths' AS section, 'ai' AS bot_class, path AS key, CAST(sum(n) AS BIGINT) AS n FROM bots
  WHERE bot_class = 'ai' AND path <> '' GROUP BY ALL),
u AS (SELECT * FROM a UNION ALL SELECT * FROM p)
SELECT site_id, 'total' AS section, '' AS bot_class, '' AS key, CAST(sum(n) AS BIGINT) AS n FROM bots GROUP BY ALL
UNION ALL SELECT site_id, 'classes', bot_class, bot_class, CAST(sum(n) AS BIGINT) FROM bots GROUP BY ALL
UNION ALL SELECT site_id, section, bot_class, key, n FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, section ORDER BY n DESC, key, bot_class) AS r FROM u) WHERE r <= 10""")
def bot_summary(t):
    return r.bot_summary(t.bots, *bot_days(30, AS_OF))


AI = """
hosts AS (SELECT unnest(['chatgpt.com','chat.openai.com','perplexity.ai','claude.ai','gemini.google.com','bard.google.com',
  'copilot.microsoft.com','you.com','poe.com','phind.com','chat.mistral.ai','grok.com','chat.deepseek.com']) AS h),
refs AS (SELECT h FROM hosts UNION ALL SELECT concat('www.', h) FROM hosts),
ai AS (SELECT *, CASE WHEN referrer_src IN (SELECT h FROM refs) THEN regexp_replace(referrer_src, '^www\\.', '')
  WHEN lower(utm_source) = 'chatgpt' THEN 'chatgpt.com' ELSE lower(utm_source) END AS assistant
  FROM pv WHERE referrer_src IN (SELECT h FROM refs) OR lower(utm_source) IN (SELECT h FROM refs) OR lower(utm_source) = 'chatgpt')"""


@query("ai_referrals", ctes("hits", extra=PV + "," + AI) + """
SELECT site_id, count(DISTINCT visitor_hash) AS visitors, count(*) AS views FROM ai GROUP BY site_id""")
def ai_referrals(t):
    return r.ai_referrals(t.hits, WHOLE)


@query("ai_sources", ctes("hits", extra=PV + "," + AI) + """
SELECT site_id, assistant, CASE assistant WHEN 'chatgpt.com' THEN 'ChatGPT' WHEN 'perplexity.ai' THEN 'Perplexity' END AS name,
  count(DISTINCT visitor_hash) AS visitors, count(*) AS views FROM ai GROUP BY ALL""")
def ai_sources(t):
    return r.ai_sources(t.hits, WHOLE)


@query("bot_counts_merge", ctes("bots", "hits") + """
, old AS (SELECT * FROM bots WHERE day < DATE '2024-01-20'),
new AS (SELECT site_id, CAST(ts AS DATE) AS day, CASE WHEN id % 3 = 0 THEN 'ai' WHEN id % 3 = 1 THEN 'search' ELSE 'other' END AS bot_class,
  concat('agent', CAST(id % 5 AS VARCHAR)) AS agent,
  CASE WHEN id % 3 = 2 THEN '' ELSE concat('/deep/', CAST(id % 40 AS VARCHAR)) END AS path, count(*) AS n FROM hits GROUP BY ALL),
fresh AS (SELECT n.* FROM new n ANTI JOIN old o USING (site_id, day, bot_class, agent, path) WHERE n.path <> ''),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY site_id, day ORDER BY bot_class, agent, path) AS r,
  (SELECT count(*) FROM old o WHERE o.site_id = f.site_id AND o.day = f.day AND o.path <> '') AS have FROM fresh f),
folded AS (SELECT n.site_id, n.day, n.bot_class, n.agent,
  CASE WHEN o.n IS NOT NULL OR k.n IS NOT NULL THEN n.path ELSE '' END AS path, n.n
  FROM new n LEFT JOIN old o USING (site_id, day, bot_class, agent, path)
  LEFT JOIN (SELECT * FROM ranked WHERE r <= 50 - have) k USING (site_id, day, bot_class, agent, path))
SELECT site_id, strftime(day, '%Y-%m-%d') AS day, bot_class, agent, path, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT * FROM old UNION ALL SELECT * FROM folded) GROUP BY ALL""")
def bot_counts_merge(t):
    return r.merge_bot_counts(*_bot_counts(t), cap=50).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _bot_counts(t):
    old = t.bots.where("day < DATE '2024-01-20'")
    new = t.hits.selectExpr(
        "site_id", "to_date(ts) AS day",
        "CASE WHEN id % 3 = 0 THEN 'ai' WHEN id % 3 = 1 THEN 'search' ELSE 'unheard-of' END AS bot_class",
        "concat('agent', CAST(id % 5 AS STRING)) AS agent",
        "concat('/deep/', CAST(id % 40 AS STRING)) AS path", "1L AS n")
    return old, new


@query("bot_counts_merge_all", ctes("bots", "hits") + """
SELECT site_id, strftime(day, '%Y-%m-%d') AS day, bot_class, agent, path, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT site_id, day, bot_class, agent, path, n FROM bots WHERE day < DATE '2024-01-20' UNION ALL
  SELECT site_id, CAST(ts AS DATE), CASE WHEN id % 3 = 0 THEN 'ai' WHEN id % 3 = 1 THEN 'search' ELSE 'other' END, concat('agent', CAST(id % 5 AS VARCHAR)),
    CASE WHEN id % 3 = 2 THEN '' ELSE concat('/deep/', CAST(id % 40 AS VARCHAR)) END, 1 FROM hits) GROUP BY ALL""")
def bot_counts_merge_all(t):
    """All paths, without a limit."""
    return r.merge_bot_counts(*_bot_counts(t)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
