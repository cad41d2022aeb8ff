"""Beacons to hits, product lines, robot counts and drop counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions import agents, cleaning, network
from footfall.functions.timewin import day_of, micros
from footfall.operators.robots import PATH_CLASSES, tidy_counts
from footfall.schema import EVENTS_PER_MINUTE, MAX_EVENT_BYTES
from footfall.sources.beacons import parse, respect_opt_out
from footfall.session import stored


@dataclass
class Dimensions:
    """Lookup tables of the ingest: sites(id, public_id), salts(day, salt), range tables and
    the visitors flagged by the burst job (site_id, visitor_hash), which may be absent."""

    sites: DataFrame
    salts: DataFrame
    asn_ranges: DataFrame
    geo_ranges: DataFrame
    flagged: DataFrame | None = None


@dataclass
class Ingested:
    hits: DataFrame
    items: DataFrame
    bot_counts: DataFrame
    drops: DataFrame
    rejects: DataFrame
    judged: DataFrame


def with_daily_salt(df: DataFrame, salts: DataFrame, ts: str = "received_at") -> DataFrame:
    """Adds the salt of the row's day; null when that day has none any more."""
    s = salts.select(F.col("day").alias("_day"), F.col("salt").alias("day_salt"))
    return df.withColumn("_at", day_of(ts)).join(s, F.col("_at") == F.col("_day"), "left").drop("_at", "_day")


def purge_salts(salts: DataFrame, today) -> DataFrame:
    """Only today's salt is kept."""
    return salts.where(F.col("day") == F.lit(today))


def ensure_salt(salts: DataFrame, day) -> DataFrame:
    """Adds a random salt for `day` when there is none, and drops all others. Write the
    result once and read it back: the salt is random."""
    import secrets

    spark = salts.sparkSession
    fresh = spark.createDataFrame([(day, secrets.token_hex(32))], "day date, salt string")
    today = purge_salts(salts, day).select("day", "salt")
    return today.unionByName(fresh.join(today, "day", "left_anti"))


def judge(beacons: DataFrame, dims: Dimensions, secret: str, count_private: bool = False) -> DataFrame:
    """Every beacon with its `verdict` (null for a person, so far), `reason` of a drop and, for
    robots, bot_class, agent and path. The rate limit comes after, since it needs the rows
    that passed everything else."""
    b = parse(respect_opt_out(beacons))
    s = dims.sites.select(F.col("id").alias("site_id"), F.col("public_id").alias("_pid"))
    b = b.join(s, (F.col("public_id") == F.col("_pid")) & (F.length("public_id") <= 64), "left").drop("_pid")
    b = b.withColumn("reject", F.coalesce(F.col("reject"), F.when(F.col("site_id").isNull(), "unknown_site")))
    ua = F.coalesce(F.col("user_agent"), F.lit(""))
    b = b.withColumn("ip", network.client_ip(F.col("x_forwarded_for"), F.col("peer_ip"))).withColumn(
        "ip_key", network.ip_key(F.col("ip")))
    b = b.withColumn("ref_host", cleaning.referrer_host(cleaning.text_field(F.col("payload"), "$.r")))
    b = b.withColumn("wd", _webdriver(F.col("payload")))
    b = agents.with_robot(b, "user_agent", "signature_agent", "signature_input", "wd", "ref_host")
    b = network.with_datacenter(b, "ip_key", dims.asn_ranges)
    b = with_daily_salt(b, dims.salts)
    b = b.withColumn("visitor_hash", network.visitor_hash(
        F.col("ip"), ua, F.col("site_id"), F.col("day_salt"), secret)).drop("day_salt")
    if dims.flagged is not None:
        f = dims.flagged.select("site_id", "visitor_hash").distinct().withColumn("_burst", F.lit(True))
        b = b.join(f, ["site_id", "visitor_hash"], "left")
    else:
        b = b.withColumn("_burst", F.lit(None).cast("boolean"))
    private = F.lit(False) if count_private else network.is_private_key(F.col("ip_key"))
    network_robot = F.struct(
        F.lit("datacenter").alias("bot_class"), network.datacenter_name(F.col("dc_asn")).alias("agent"))
    burst_robot = F.struct(F.lit("script").alias("bot_class"), F.lit("burst").alias("agent"))
    named = F.col("robot").isNotNull()
    from_dc = F.col("dc_asn").isNotNull()
    reason = (
        F.when(F.col("reject").isNotNull(), F.col("reject"))
        .when(named, F.when(F.col("robot.bot_class") == "agent", "agent").otherwise("bot"))
        .when(from_dc, "datacenter")
        .when(private, "private")
        .when(F.col("visitor_hash").isNull(), "no_salt")
        .when(F.col("_burst"), "bot")
    )
    robot_of = F.when(F.col("reject").isNull(), F.when(named, F.col("robot")).when(
        from_dc, network_robot).when(~private & F.coalesce("_burst", F.lit(False)), burst_robot))
    return b.withColumn("reason", reason).withColumn("robot", robot_of).drop("_burst")


def _webdriver(payload: Column) -> Column:
    """wd is 1, 1.0, true or "1"."""
    raw = F.try_variant_get(payload, "$.wd", "variant")
    kind = F.schema_of_variant(raw)
    text = F.try_variant_get(payload, "$.wd", "string")
    number = F.try_variant_get(payload, "$.wd", "double")
    yes = F.when(kind == "STRING", text == "1").when(kind == "BOOLEAN", text == "true").otherwise(number == 1)
    return F.coalesce(yes, F.lit(False))


def minute_of(ts: str = "received_at") -> Column:
    return F.floor(micros(ts) / 60_000_000)


def minute_counts(rows: DataFrame, ts: str = "received_at") -> DataFrame:
    """(site_id, visitor_hash, minute, n)."""
    return rows.groupBy("site_id", "visitor_hash", minute_of(ts).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


def rate_limit(
    rows: DataFrame, per_minute: int = EVENTS_PER_MINUTE, ts: str = "received_at", order: str = "beacon_id",
    used: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(first `per_minute` rows of each visitor minute, (site_id, n) dropped). `used` holds
    (visitor_hash, minute, used) of rows seen before this batch.

    The rank is cut per task before the shuffle, so a looping script sends at most
    `per_minute` rows per task; what was dropped is the difference of two counts."""
    m = rows.withColumn("minute", minute_of(ts))
    w = Window.partitionBy("visitor_hash", "minute").orderBy(ts, order)
    kept = m.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_minute)
    seen = minute_counts(rows, ts)
    before = F.lit(0)
    if used is not None:
        u = used.select("visitor_hash", "minute", "used")
        kept = kept.join(u, ["visitor_hash", "minute"], "left")
        seen = seen.join(u, ["visitor_hash", "minute"], "left")
        before = F.coalesce("used", F.lit(0))
    kept = kept.where(F.col("_n") + before <= per_minute).drop("_n", "minute", "used")
    room = F.greatest(F.lit(per_minute) - before, F.lit(0))
    dropped = seen.withColumn("_over", F.col("n") - room).where("_over > 0").groupBy("site_id").agg(
        F.sum("_over").alias("n"))
    return kept, dropped


def clean(rows: DataFrame, dims: Dimensions) -> DataFrame:
    """Accepted beacons as hit columns plus `lines`, the product lines."""
    p = F.col("payload")
    got = network.with_geo(rows, "ip_key", dims.geo_ranges)
    ua = agents.parse_ua(F.coalesce(F.col("user_agent"), F.lit("")))
    raw = lambda k: F.try_variant_get(p, f"$.{k}", "variant")
    text = lambda k: cleaning.text_field(p, f"$.{k}")
    base = got.select(
        F.col("beacon_id").alias("id"), "site_id", F.col("received_at").alias("ts"),
        cleaning.clean_name(text("n")).alias("name"), clean_beacon_path(p).alias("path"),
        F.col("ref_host").alias("referrer_src"), "country", "region",
        ua["device"].alias("device"), ua["browser"].alias("browser"), ua["os"].alias("os"),
        cleaning.clean_utm(text("us")).alias("utm_source"),
        cleaning.clean_utm(text("um")).alias("utm_medium"),
        cleaning.clean_utm(text("uc")).alias("utm_campaign"), "visitor_hash",
        cleaning.clean_money(raw("rv")).alias("rv"), cleaning.clean_currency(raw("cur")).alias("cur"),
        cleaning.clean_payment(text("pm")).alias("pm"), cleaning.clean_items(raw("it")).alias("it"),
    )
    order = cleaning.reconcile_order(F.col("name"), F.col("rv"), F.col("cur"), F.col("pm"), F.col("it"))
    return base.withColumn("o", order).select(
        *[c for c in base.columns if c not in ("rv", "cur", "pm", "it")],
        "o.revenue_cents", "o.currency", "o.payment_method", F.col("o.items").alias("lines"))


def clean_beacon_path(payload: Column) -> Column:
    return cleaning.clean_path(cleaning.text_field(payload, "$.p"))


def split_lines(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, product lines): one row per line, numbered within its hit. A body of at most
    MAX_EVENT_BYTES holds fewer lines than that."""
    lines = cleaned.select(
        F.col("id").alias("event_id"), "site_id", "ts", "currency", F.posexplode("lines").alias("pos", "line")
    ).select(
        (F.col("event_id") * MAX_EVENT_BYTES + F.col("pos")).alias("id"), "site_id", "event_id", "ts",
        "line.name", "line.qty", "line.unit_price_cents", "currency")
    return cleaned.drop("lines"), lines


def drop_counts(judged: DataFrame, over_rate: DataFrame | None = None) -> DataFrame:
    """(site_id, reason, n)."""
    by_reason = judged.where("reason IS NOT NULL AND reject IS NULL").groupBy("site_id", "reason").agg(
        F.count(F.lit(1)).alias("n"))
    if over_rate is None:
        return by_reason
    return by_reason.unionByName(over_rate.select("site_id", F.lit("rate").alias("reason"), "n"))


def robot_counts(judged: DataFrame) -> DataFrame:
    """(site_id, day, bot_class, agent, path, n) of the batch."""
    keeps_path = F.col("robot.bot_class").isin(*PATH_CLASSES)
    rows = judged.where("robot IS NOT NULL").select(
        "site_id", day_of("received_at").alias("day"), "robot.bot_class", "robot.agent",
        F.when(keeps_path, clean_beacon_path(F.col("payload"))).otherwise("").alias("path"),
        F.lit(1).cast("long").alias("n"))
    return tidy_counts(rows)


def ingest(
    beacons: DataFrame, dims: Dimensions, secret: str, count_private: bool = False, used: DataFrame | None = None
) -> Ingested:
    """The whole write path over a batch of beacons (or one micro-batch). `used` carries the
    visitor minutes of earlier micro-batches."""
    # Five outputs read the verdicts, and a filter on a verdict would be pushed down as its
    # whole expression: the batch is judged once and written to the shared folder.
    judged = stored(judge(beacons, dims, secret, count_private).select(
        "beacon_id", "received_at", "site_id", "visitor_hash", "payload", "user_agent", "ip_key", "ref_host",
        "reject", "reason", "robot"), "judged")
    kept, over = rate_limit(judged.where("reason IS NULL"), used=used)
    hits, items = split_lines(clean(kept, dims))
    rejects = judged.where("reject IS NOT NULL").groupBy("reject").agg(F.count(F.lit(1)).alias("n"))
    return Ingested(hits, items, robot_counts(judged), drop_counts(judged, over), rejects, judged)
