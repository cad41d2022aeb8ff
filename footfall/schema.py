"""Table schemas and fixed constants."""

from __future__ import annotations

from pyspark.sql import types as T

HITS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("site_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("referrer_src", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("browser", T.StringType()),
    T.StructField("os", T.StringType()),
    T.StructField("utm_source", T.StringType()),
    T.StructField("utm_medium", T.StringType()),
    T.StructField("utm_campaign", T.StringType()),
    T.StructField("visitor_hash", T.StringType()),
    T.StructField("revenue_cents", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("payment_method", T.StringType()),
])

ITEMS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("site_id", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("name", T.StringType()),
    T.StructField("qty", T.IntegerType()),
    T.StructField("unit_price_cents", T.LongType()),
    T.StructField("currency", T.StringType()),
])

SITES = "id long, tenant_id long, domain string, public_id string, public_dash int, created_at timestamp_ntz"
TENANTS = (
    "id long, name string, plan string, trial_ends_at timestamp_ntz, trial_reminded_at timestamp_ntz, "
    "plan_ends_at timestamp_ntz, email_optout int, overage_notified_month string, "
    "stripe_subscription_id string, vipps_agreement_id string, vipps_pending_plan string, "
    "invoice_details string, cancelled_at timestamp_ntz, deletion_warned_at timestamp_ntz, "
    "created_at timestamp_ntz"
)
USERS = "id long, tenant_id long, email string, email_verified int, created_at timestamp_ntz"
GOALS = "id long, site_id long, name string, match_type string, match_value string"
FUNNELS = "id long, site_id long, name string, steps string"
ROLLUPS = (
    "site_id long, day date, pageviews long, visitors long, sessions long, bounce_rate double, "
    "rollup_hash string, merkle_root string, merkle_proof string, txid string, anchored_at timestamp_ntz"
)
BREAKDOWNS = (
    "site_id long, day date, dim string, key string, currency string, n long, visitors long, "
    "revenue_cents long"
)
BOT_DAILY = "site_id long, day date, bot_class string, agent string, path string, n long"
SEARCH_STATS = (
    "site_id long, day date, source string, dim string, key string, clicks long, impressions long, "
    "position double"
)
BEACONS = (
    "beacon_id long, received_at timestamp_ntz, body string, user_agent string, x_forwarded_for string, "
    "peer_ip string, signature_agent string, signature_input string"
)

# Limits and display defaults of the stored data model.
SESSION_GAP_SECONDS = 1800
RAW_DAYS = 90
SEARCH_LAG_DAYS = 2
MAX_EVENT_BYTES = 16384
EVENTS_PER_MINUTE = 120
MAX_MONEY = 100_000_000
DIRECT = "direkte"
UNKNOWN = "ukjent"
DEFAULT_CURRENCY = "NOK"
