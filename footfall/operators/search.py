"""Reports over search statistics, and the search overview of all sites."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.timewin import day_lit, ntz, period_window, search_days
from footfall.operators.frames import top_per, zero_fill
from footfall.operators.robots import ai_visits


def _in_days(search: DataFrame, span) -> DataFrame:
    return search.where((F.col("day") >= day_lit(span[0])) & (F.col("day") <= day_lit(span[1])))


def _position(weighted, impressions):
    """Impression-weighted position; null without impressions or positions."""
    ok = (impressions > 0) & (weighted != 0)
    return F.when(ok, F.bround(weighted / impressions, 1))


def search_kpis(search: DataFrame, days: int, as_of: datetime, offset: int = 0) -> DataFrame:
    """(site_id, source, clicks, impressions, position) per provider."""
    rows = _in_days(search, search_days(days, as_of, offset)).where("dim = 'total'").where(
        F.col("source").isin("google", "bing", "gmc"))
    g = rows.groupBy("site_id", "source").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.sum(F.col("position") * F.col("impressions")).alias("w"))
    position = F.when(F.col("source") == "google", _position(F.col("w"), F.col("impressions")))
    return g.withColumn("position", position).drop("w")


def search_top(search: DataFrame, dim: str, days: int, as_of: datetime, limit: int = 10) -> DataFrame:
    """(site_id, key, clicks, impressions, position): top queries or pages."""
    rows = _in_days(search, search_days(days, as_of)).where((F.col("source") == "google") & (F.col("dim") == dim))
    g = rows.groupBy("site_id", "key").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.sum(F.col("position") * F.col("impressions")).alias("w"))
    g = g.withColumn("position", _position(F.col("w"), F.col("impressions"))).drop("w")
    return top_per(g, ["site_id"], [F.desc("clicks"), F.desc("impressions"), F.asc("key")], limit)


def seo_overview(search: DataFrame, hits: DataFrame, sites: DataFrame, days: int, as_of: datetime) -> DataFrame:
    """One row per site: Google clicks now and before, impressions, position, Bing clicks, and
    visitors from AI assistants now and before. One pass over each source."""
    now, before = search_days(days, as_of), search_days(days, as_of, 1)
    in_now = F.col("day") >= day_lit(now[0])
    google, bing = F.col("source") == "google", F.col("source") == "bing"
    s = _in_days(search, (before[0], now[1])).where("dim = 'total'").groupBy("site_id").agg(
        F.sum(F.when(in_now & google, F.col("clicks"))).alias("clicks"),
        F.sum(F.when(in_now & google, F.col("impressions"))).alias("impressions"),
        F.sum(F.when(in_now & google, F.col("position") * F.col("impressions"))).alias("w"),
        F.sum(F.when(~in_now & google, F.col("clicks"))).alias("prev_clicks"),
        F.sum(F.when(in_now & bing, F.col("clicks"))).alias("bing_clicks"))
    s = s.withColumn("position", _position(F.col("w"), F.col("impressions"))).drop("w")
    w_now, w_before = period_window(days, as_of), period_window(days, as_of, 1)
    visits = ai_visits(hits, (w_before[0], w_now[1]))
    recent = F.col("ts") >= ntz(w_now[0])
    # Visitor keys change daily, so a key is in one of the two windows only.
    per = visits.groupBy("site_id", recent.alias("recent")).agg(F.count_distinct("visitor_hash").alias("u"))
    ai = per.groupBy("site_id").agg(
        F.max(F.when(F.col("recent"), F.col("u"))).alias("ai"),
        F.max(F.when(~F.col("recent"), F.col("u"))).alias("prev_ai"))
    out = sites.select(F.col("id").alias("site_id"), "tenant_id", "public_id", "domain").join(
        s, "site_id", "left").join(ai, "site_id", "left")
    return zero_fill(out, ["clicks", "impressions", "prev_clicks", "bing_clicks", "ai", "prev_ai"])
