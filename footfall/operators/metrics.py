"""Core reports over the hit table. Every operator answers for all sites at once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.numbers import percent, usage_share
from footfall.functions.referrers import not_self_referral, with_site_domain
from footfall.functions.timewin import (
    day_of, day_text, month_window, ntz, pageviews, period_window, within,
)
from footfall.operators.frames import calendar, top_per, union_all, zero_fill
from footfall.operators.sessions import sessionize, visit_totals, with_rates
from footfall.schema import DIRECT, UNKNOWN

# Breakdown name -> dimension, and what shows for a missing value.
PAGEVIEW_DIMS = {
    "page": ("path", None),
    "source": ("referrer_src", DIRECT),
    "country": ("country", UNKNOWN),
    "region": ("region", UNKNOWN),
    "device": ("device", UNKNOWN),
    "browser": ("browser", UNKNOWN),
    "os": ("os", UNKNOWN),
}
API_PROPS = {
    "pages": "page", "sources": "source", "countries": "country", "regions": "region",
    "devices": "device", "browsers": "browser", "os": "os",
}
# Plan -> (page views per month, sites); None is unlimited.
PLAN_LIMITS = {
    "trial": (100_000, 5),
    "liten": (10_000, 1),
    "vekst": (100_000, 10),
    "pro": (1_000_000, 15),
    "byra": (None, None),
    "owner": (None, None),
    "cancelled": (0, 0),
}


def dim_value(dim: str) -> Column:
    col, missing = PAGEVIEW_DIMS[dim]
    return F.col(col) if missing is None else F.coalesce(F.col(col), F.lit(missing))


def dim_entries(dims: list[str]) -> list[Column]:
    """One struct<dim, key> per page-view dimension of a row with site_domain; null when the
    row does not count for that dimension."""
    out = []
    for dim in dims:
        entry = F.struct(F.lit(dim).alias("dim"), dim_value(dim).alias("key"))
        if dim == "source":
            entry = F.when(not_self_referral(F.col("referrer_src"), F.col("site_domain")), entry)
        out.append(entry)
    return out


def exploded(rows: DataFrame, keys: list[str], entries: list[Column]) -> DataFrame:
    """(keys, visitor_hash, dim, key): the hit table is read once for all dimensions."""
    present = F.filter(F.array(*entries), lambda e: e.isNotNull() & e["key"].isNotNull())
    return rows.select(*keys, "visitor_hash", F.inline(present))


def count_keys(entries: DataFrame, keys: list[str]) -> DataFrame:
    """n and distinct visitors. The distinct count runs as two partial aggregations, first on
    (keys, visitor), so a hot key is spread over its visitors before it meets in one group."""
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("visitor_hash").alias("visitors")
    )


# --- A1, A2, A3, A4, A5 ------------------------------------------------------------------

def kpis(hits: DataFrame, window=None) -> DataFrame:
    """site_id, pageviews, visitors, sessions, bounce_rate, views_per_session."""
    return with_rates(visit_totals(sessionize(hits, window), ["site_id"])).drop("bounces")


def breakdown(
    hits: DataFrame, sites: DataFrame, prop: str, window=None, limit: int | None = 100
) -> DataFrame:
    """(site_id, value, pageviews, visitors) of one whitelisted dimension."""
    dim = API_PROPS[prop]
    rows = pageviews(hits, window)
    if dim == "source":
        rows = with_site_domain(rows, sites).where(
            not_self_referral(F.col("referrer_src"), F.col("site_domain")))
    counted = count_keys(
        rows.select("site_id", "visitor_hash", dim_value(dim).alias("value")), ["site_id", "value"]
    ).withColumnRenamed("n", "pageviews")
    return top_per(counted, ["site_id"], [F.desc("pageviews"), F.asc("value")], limit)


def all_breakdowns(hits: DataFrame, sites: DataFrame, window=None, limit: int | None = 10) -> DataFrame:
    """The seven dimensions in one pass: (site_id, dim, key, n, visitors)."""
    rows = with_site_domain(pageviews(hits, window), sites)
    entries = exploded(rows, ["site_id"], dim_entries(list(PAGEVIEW_DIMS)))
    counted = count_keys(entries, ["site_id", "dim", "key"])
    return top_per(counted, ["site_id", "dim"], [F.desc("n"), F.asc("key")], limit)


def campaigns(hits: DataFrame, window=None, limit: int | None = 10) -> DataFrame:
    """(site_id, source, medium, campaign, n, visitors); a medium alone is no campaign."""
    rows = pageviews(hits, window).where("utm_source IS NOT NULL OR utm_campaign IS NOT NULL")
    named = rows.select(
        "site_id", "visitor_hash",
        *[F.coalesce(F.col(f"utm_{c}"), F.lit("")).alias(c) for c in ("source", "medium", "campaign")],
    )
    keys = ["site_id", "source", "medium", "campaign"]
    order = [F.desc("n"), F.asc("source"), F.asc("medium"), F.asc("campaign")]
    return top_per(count_keys(named, keys), ["site_id"], order, limit)


def stats(hits: DataFrame, sites: DataFrame, window=None, limit: int = 10) -> DataFrame:
    """One row per site with totals and its top lists as arrays of structs (at most `limit`
    entries each, so the arrays are bounded)."""
    totals = kpis(hits, window)
    lists = all_breakdowns(hits, sites, window, limit)

    def by_rank(*cols: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), *cols)))
        return F.transform(ordered, lambda e: e.dropFields("neg"))

    wide = lists.groupBy("site_id").agg(by_rank("key", "n", "visitors", "dim").alias("entries"))

    def entries_of(dim: str) -> Column:
        return F.transform(F.filter("entries", lambda e: e["dim"] == dim), lambda e: e.dropFields("dim"))

    wide = wide.select("site_id", *[entries_of(dim).alias(f"top_{dim}") for dim in PAGEVIEW_DIMS])
    camp = campaigns(hits, window, limit).groupBy("site_id").agg(
        by_rank("source", "medium", "campaign", "n", "visitors").alias("campaigns"))
    return totals.join(wide, "site_id", "left").join(camp, "site_id", "left")


def stats_with_previous(hits: DataFrame, sites: DataFrame, days: int, as_of: datetime) -> DataFrame:
    """Totals of a period next to those of the equal period before it, for every site."""
    return side_by_side(hits, sites, period_window(days, as_of), period_window(days, as_of, 1))


def month_with_previous(hits: DataFrame, sites: DataFrame, label: str) -> DataFrame:
    return side_by_side(hits, sites, month_window(label), month_window(label, 1))


def side_by_side(hits: DataFrame, sites: DataFrame, now, before) -> DataFrame:
    """One scan: the two windows are a key of the session operator, not two jobs."""
    start, end = min(now[0], before[0]), max(now[1], before[1])
    rows = within(hits, (start, end))
    flags = [(F.col("ts") >= ntz(w[0])) & (F.col("ts") < ntz(w[1])) for w in (now, before)]
    parts = F.array_compact(F.array(F.when(flags[0], "now"), F.when(flags[1], "before")))
    tagged = rows.withColumn("part", F.explode(parts)).withColumn(
        "visitor_hash", F.concat_ws("|", "part", "visitor_hash"))
    s = sessionize(tagged).withColumn("part", F.substring_index("visitor_hash", "|", 1))
    t = with_rates(visit_totals(s, ["site_id", "part"]))
    cols = ["pageviews", "visitors", "sessions", "bounce_rate"]
    wide = t.groupBy("site_id").agg(*[
        F.max(F.when(F.col("part") == p, F.col(c))).alias(pre + c)
        for p, pre in (("now", ""), ("before", "previous_")) for c in cols
    ])
    out = sites.select(F.col("id").alias("site_id")).join(wide, "site_id", "left")
    return zero_fill(out, [pre + c for pre in ("", "previous_") for c in cols])


# --- A6 ---------------------------------------------------------------------------------

def timeseries(
    hits: DataFrame, sites: DataFrame, days: int, as_of: datetime, unit: str | None = None,
    pageviews_only: bool = False,
) -> DataFrame:
    """(site_id, bucket, pageviews, visitors) with empty buckets as 0: hours for one day,
    else days, else weeks (from 60 days, labelled with their Monday). Weekly visitors are
    the sum of daily ones, which is exact since visitor keys change every day."""
    grain = unit or ("hour" if days == 1 else "day")
    weekly = unit is None and days >= 60
    window = period_window(days, as_of)
    rows = pageviews(hits, window) if pageviews_only else within(hits, window)
    found = rows.withColumn("bucket_ts", F.date_trunc(grain, "ts").cast("timestamp_ntz")).groupBy(
        "site_id", "bucket_ts"
    ).agg(F.count(F.lit(1)).alias("pageviews"), F.count_distinct("visitor_hash").alias("visitors"))
    last = as_of.replace(minute=0, second=0, microsecond=0) if grain == "hour" else (
        window[1] - timedelta(days=1))
    cal = calendar(sites, f"{window[0]}", f"{last}", f"1 {grain.upper()}")
    series = zero_fill(
        cal.join(found, ["site_id", "bucket_ts"], "left"), ["pageviews", "visitors"]
    )
    if weekly:
        series = series.withColumn("bucket_ts", F.date_trunc("week", "bucket_ts")).groupBy(
            "site_id", "bucket_ts"
        ).agg(F.sum("pageviews").alias("pageviews"), F.sum("visitors").alias("visitors"))
    fmt = "yyyy-MM-dd HH" if grain == "hour" else "yyyy-MM-dd"
    return series.select(
        "site_id", F.date_format("bucket_ts", fmt).alias("bucket"), "pageviews", "visitors"
    )


# --- A8, A9, A10, A12-A16, A18, A19 -------------------------------------------------------

def daily_uniques(hits: DataFrame, window=None) -> DataFrame:
    """(site_id, day, pageviews, visitors, last_ts). last_ts is over all events of the window."""
    is_pv = F.col("name") == "pageview"
    return within(hits, window).withColumn("day", day_of("ts")).groupBy("site_id", "day").agg(
        F.count(F.when(is_pv, 1)).alias("pageviews"),
        F.count_distinct(F.when(is_pv, F.col("visitor_hash"))).alias("visitors"),
        F.max("ts").alias("last_ts"),
    )


def overview(hits: DataFrame, sites: DataFrame, days: int, as_of: datetime) -> DataFrame:
    """Every site of every tenant: this and the previous window, a daily sparkline, the time
    of the last event, and a rank within the tenant. One grouping by (site, day) feeds all:
    visitor keys change daily, so a window's visitors are the sum of its days."""
    now, before = period_window(days, as_of), period_window(days, as_of, 1)
    d = daily_uniques(hits, (before[0], now[1]))
    in_now = (F.col("day") >= F.lit(now[0].date())) & (F.col("day") < F.lit(now[1].date()))
    in_before = (F.col("day") >= F.lit(before[0].date())) & (F.col("day") < F.lit(before[1].date()))

    def total(cond: Column, c: str) -> Column:
        return F.sum(F.when(cond, F.col(c)).otherwise(0))

    per_site = d.groupBy("site_id").agg(
        total(in_now, "pageviews").alias("pageviews"),
        total(in_now, "visitors").alias("visitors"),
        total(in_before, "pageviews").alias("prev_pageviews"),
        total(in_before, "visitors").alias("prev_visitors"),
        F.map_from_entries(F.collect_list(
            F.when(in_now, F.struct("day", "visitors")))).alias("by_day"),
    )
    labels = F.expr(
        f"sequence(DATE '{now[0]:%Y-%m-%d}', DATE '{now[1] - timedelta(days=1):%Y-%m-%d}')")
    zero = F.lit(0).cast("long")
    out = sites.select("tenant_id", F.col("id").alias("site_id"), "public_id", "domain").join(
        per_site, "site_id", "left"
    ).withColumn(
        "spark", F.transform(labels, lambda x: F.coalesce(F.col("by_day")[x], zero))
    ).drop("by_day").join(last_event(hits), "site_id", "left")
    out = zero_fill(out, ["pageviews", "visitors", "prev_pageviews", "prev_visitors"])
    rank = Window.partitionBy("tenant_id").orderBy(F.desc("visitors"), F.asc("domain"))
    return out.withColumn("rank", F.row_number().over(rank))


def site_list(hits: DataFrame, sites: DataFrame, tenants: DataFrame, as_of: datetime) -> DataFrame:
    """Today's events (all kinds) and visitors per site, time of the last event; empty sites stay."""
    start, end = period_window(1, as_of)
    today = (F.col("ts") >= ntz(start)) & (F.col("ts") < ntz(end))
    per = hits.where(today).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("pageviews"), F.count_distinct("visitor_hash").alias("visitors"))
    per = last_event(hits).join(per, "site_id", "left")
    s = sites.join(
        tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant")), "tenant_id"
    ).select("tenant_id", "tenant", F.col("id").alias("site_id"), "public_id", "domain")
    return zero_fill(s.join(per, "site_id", "left"), ["pageviews", "visitors"])


def top_events(hits: DataFrame, window=None, limit: int | None = 10) -> DataFrame:
    rows = within(hits, window).where(F.col("name") != "pageview")
    counted = count_keys(
        rows.select("site_id", "visitor_hash", F.col("name").alias("event")), ["site_id", "event"])
    return top_per(counted, ["site_id"], [F.desc("n"), F.asc("event")], limit)


def first_user(users: DataFrame) -> DataFrame:
    return users.groupBy("tenant_id").agg(F.min_by("email", "id").alias("email"))


def monthly_usage(hits: DataFrame, sites: DataFrame, as_of: datetime) -> DataFrame:
    """(tenant_id, pageviews this calendar month, sites). Hits are reduced to one row per
    site before they meet the sites."""
    start = month_window(f"{as_of:%Y-%m}")[0]
    rows = hits.where((F.col("ts") >= ntz(start)) & (F.col("name") == "pageview"))
    per_site = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    return sites.select("tenant_id", F.col("id").alias("site_id")).join(
        per_site, "site_id", "left"
    ).groupBy("tenant_id").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("pageviews"), F.count(F.lit(1)).alias("sites"))


def plan_limit(plan: Column, which: int) -> Column:
    fallback = PLAN_LIMITS["trial"][which]
    out = F.when(F.coalesce(plan, F.lit("")) == "", F.lit(fallback).cast("long"))
    for name, limits in PLAN_LIMITS.items():
        out = out.when(plan == name, F.lit(limits[which]).cast("long"))
    return out.otherwise(F.lit(fallback).cast("long"))


def usage_report(hits: DataFrame, sites: DataFrame, tenants: DataFrame, as_of: datetime) -> DataFrame:
    """Use of the plan per tenant: percent of the limit (at most 100), over and warn flags."""
    u = tenants.select(F.col("id").alias("tenant_id"), "plan").join(
        monthly_usage(hits, sites, as_of), "tenant_id", "left")
    u = zero_fill(u, ["pageviews", "sites"]).withColumn("page_limit", plan_limit(F.col("plan"), 0))
    share = usage_share(F.col("pageviews"), F.col("page_limit"))
    return u.withColumn("share", share).withColumn(
        "over", (F.col("pageviews") > F.col("page_limit")) & (F.col("page_limit") > 0)
    ).withColumn("warn", F.col("share") >= 80)


def overage(
    hits: DataFrame, sites: DataFrame, tenants: DataFrame, users: DataFrame, as_of: datetime
) -> DataFrame:
    """Tenants above their monthly limit that still have to be told this month."""
    month = f"{as_of:%Y-%m}"
    t = tenants.where(F.coalesce("email_optout", F.lit(0)) == 0).where(
        F.col("overage_notified_month").isNull() | (F.col("overage_notified_month") != month)
    ).where(~F.col("plan").eqNullSafe("cancelled")).withColumn("page_limit", plan_limit(F.col("plan"), 0))
    t = t.where(F.col("page_limit") > 0).select(F.col("id").alias("tenant_id"), "plan", "page_limit")
    return t.join(first_user(users), "tenant_id").where(F.col("email") != "").join(
        monthly_usage(hits, sites, as_of), "tenant_id"
    ).where(F.col("pageviews") > F.col("page_limit"))


def weekly_report(
    hits: DataFrame, sites: DataFrame, tenants: DataFrame, users: DataFrame, as_of: datetime,
    days: int = 7,
) -> DataFrame:
    """(tenant_id, email, site_id, domain, pageviews, visitors) of tenants that want the mail,
    have an address and had traffic."""
    per = pageviews(hits, period_window(days, as_of)).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("pageviews"), F.count_distinct("visitor_hash").alias("visitors"))
    t = tenants.where(F.coalesce("email_optout", F.lit(0)) == 0).select(F.col("id").alias("tenant_id"))
    s = sites.select("tenant_id", F.col("id").alias("site_id"), "domain").join(per, "site_id", "left")
    s = zero_fill(s, ["pageviews", "visitors"])
    busy = s.groupBy("tenant_id").agg(F.sum("pageviews").alias("total")).where("total > 0")
    return t.join(first_user(users).where(F.col("email") != ""), "tenant_id").join(
        s, "tenant_id").join(busy.select("tenant_id"), "tenant_id", "left_semi")


def last_event(hits: DataFrame) -> DataFrame:
    return hits.groupBy("site_id").agg(F.max("ts").alias("last_ts"))


def stalled_sites(
    hits: DataFrame, sites: DataFrame, as_of: datetime, quiet_hours: int = 30, active_days: int = 9
) -> DataFrame:
    """Sites with events in [now - active_days, now - quiet_hours) and none since."""
    quiet, active = as_of - timedelta(hours=quiet_hours), as_of - timedelta(days=active_days)
    per = hits.where(F.col("ts") >= ntz(active)).groupBy("site_id").agg(F.max("ts").alias("last_ts"))
    # The last event decides both: it is old enough to be quiet and recent enough to count.
    gone = per.where((F.col("last_ts") < ntz(quiet)) & (F.col("last_ts") >= ntz(active)))
    return sites.select(F.col("id").alias("site_id"), "domain", "tenant_id").join(gone, "site_id")


def headline(hits: DataFrame, as_of: datetime, min_week_visitors: int = 100) -> DataFrame:
    """Seven days with bounce rate when a site had enough visitors, else thirty days with
    page views: (site_id, period, visitors, bounce, pageviews). The visitors-per-day series
    that goes with it is `timeseries` for the chosen period."""
    week, month = period_window(7, as_of), period_window(30, as_of)
    rows = within(hits, month)
    parts = F.array_compact(F.array(F.when(F.col("ts") >= ntz(week[0]), "7"), F.lit("30")))
    tagged = rows.withColumn("part", F.explode(parts)).withColumn(
        "visitor_hash", F.concat_ws("|", "part", "visitor_hash"))
    s = sessionize(tagged).withColumn("part", F.substring_index("visitor_hash", "|", 1))
    t = with_rates(visit_totals(s, ["site_id", "part"]))
    wide = t.groupBy("site_id").agg(*[
        F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{c}_{p}")
        for p in ("7", "30") for c in ("visitors", "bounce_rate", "pageviews")
    ])
    busy = F.coalesce(F.col("visitors_7"), F.lit(0)) >= min_week_visitors
    return wide.select(
        "site_id",
        F.when(busy, 7).otherwise(30).cast("int").alias("period"),
        F.when(busy, F.col("visitors_7")).otherwise(F.col("visitors_30")).alias("visitors"),
        F.when(busy, F.col("bounce_rate_7")).alias("bounce"),
        F.when(~busy, F.col("pageviews_30")).alias("pageviews"),
    )


def site_gates(
    sites: DataFrame, hits: DataFrame, breakdowns: DataFrame, search: DataFrame, bots: DataFrame
) -> DataFrame:
    """Which report sections a site has: has_ecommerce, has_search, first_bot_day."""
    orders = hits.where("revenue_cents IS NOT NULL").select("site_id").unionByName(
        breakdowns.where("dim = 'ecom'").select("site_id")
    ).distinct().withColumn("has_ecommerce", F.lit(1))
    searched = search.select("site_id").distinct().withColumn("has_search", F.lit(1))
    robots = bots.groupBy("site_id").agg(day_text(F.min("day")).alias("first_bot_day"))
    out = sites.select(F.col("id").alias("site_id"))
    for part in (orders, searched, robots):
        out = out.join(part, "site_id", "left")
    return out.select(
        "site_id", F.coalesce("has_ecommerce", F.lit(0)).alias("has_ecommerce"),
        F.coalesce("has_search", F.lit(0)).alias("has_search"), "first_bot_day",
    )


def goal_stats(hits: DataFrame, goals: DataFrame, window=None) -> DataFrame:
    """(site_id, id, name, match_type, match_value, completions, rate). A hit is turned into
    its one or two match keys, so goals are found by an equi-join."""
    rows = within(hits, window)
    keys = F.array_compact(F.array(
        F.struct(F.lit("event").alias("kind"), F.col("name").alias("match_value")),
        F.when(F.col("name") == "pageview",
               F.struct(F.lit("path").alias("kind"), F.col("path").alias("match_value"))),
    ))
    wanted = goals.withColumn("kind", F.when(F.col("match_type") == "event", "event").otherwise("path"))
    hit_keys = rows.select("site_id", "visitor_hash", F.inline(keys))
    done = hit_keys.join(
        wanted.select("site_id", "id", "kind", "match_value"), ["site_id", "kind", "match_value"]
    ).groupBy("site_id", "id").agg(F.count_distinct("visitor_hash").alias("completions"))
    total = pageviews(hits, window).groupBy("site_id").agg(
        F.count_distinct("visitor_hash").alias("base"))
    out = goals.join(done, ["site_id", "id"], "left").join(total, "site_id", "left")
    out = zero_fill(out, ["completions", "base"])
    return out.withColumn("rate", percent(F.col("completions"), F.col("base"), 1)).drop("base")
