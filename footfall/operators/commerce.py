"""Orders: events that carry an amount, in minor units, never mixed across currencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.referrers import first_touch, settle_payment_source
from footfall.functions.timewin import micros, pageviews, within
from footfall.operators.frames import top_per
from footfall.schema import DEFAULT_CURRENCY, DIRECT, UNKNOWN


def orders(hits: DataFrame, window=None) -> DataFrame:
    return within(hits, window).where(F.col("revenue_cents").isNotNull()).withColumn(
        "currency", F.coalesce("currency", F.lit(DEFAULT_CURRENCY)))


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue_cents").alias("revenue_cents"))


def orders_by_currency(hits: DataFrame, window=None) -> DataFrame:
    return _sums(orders(hits, window), "site_id", "currency")


def dominant_currency(hits: DataFrame, sites: DataFrame, window=None) -> DataFrame:
    """(site_id, currency) with most orders; NOK for a site without any."""
    best = top_per(
        orders_by_currency(hits, window), ["site_id"], [F.desc("orders"), F.asc("currency")], 1)
    return sites.select(F.col("id").alias("site_id")).join(best, "site_id", "left").select(
        "site_id", F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"))


def products(items: DataFrame, window=None) -> DataFrame:
    rows = within(items, window).withColumn("currency", F.coalesce("currency", F.lit(DEFAULT_CURRENCY)))
    return rows.groupBy("site_id", "currency", F.col("name").alias("product")).agg(
        F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("unit_price_cents")).alias("revenue_cents"))


def top_products(items: DataFrame, window=None, currency: str | None = DEFAULT_CURRENCY, limit: int | None = 10) -> DataFrame:
    """(site_id, currency, product, qty, revenue_cents); currency None ranks each currency."""
    p = products(items, window)
    if currency is not None:
        p = p.where(F.col("currency") == currency)
    return top_per(p, ["site_id", "currency"], [F.desc("revenue_cents"), F.asc("product")], limit)


def first_views(hits: DataFrame, window=None, by_day: bool = False) -> DataFrame:
    """First page view per (site, visitor): first_us and its source. One partial minimum per
    task, so a visitor with very many views is no burden."""
    v = pageviews(hits, window).select(
        "site_id", "visitor_hash",
        F.struct(
            micros("ts").alias("us"), F.col("id").alias("id"),
            first_touch(F.col("utm_source"), F.col("referrer_src")).alias("source"),
        ).alias("first"),
    )
    return v.groupBy("site_id", "visitor_hash").agg(F.min("first").alias("first")).select(
        "site_id", "visitor_hash", F.col("first.us").alias("first_us"), F.col("first.source").alias("source"))


def with_source(order_rows: DataFrame, hits: DataFrame, window=None) -> DataFrame:
    """Adds the buyer's first source in the window at or before the order. The first view of
    the window does not depend on the order, only whether it came earlier does."""
    first = first_views(hits, window)
    joined = order_rows.withColumn("_us", micros("ts")).join(first, ["site_id", "visitor_hash"], "left")
    before = F.when(F.col("first_us") <= F.col("_us"), F.col("source"))
    return joined.withColumn(
        "source", settle_payment_source(F.coalesce(before, F.lit(DIRECT)))).drop("_us", "first_us")


def revenue_by_source(hits: DataFrame, window=None, currency: str | None = DEFAULT_CURRENCY, limit: int | None = 10) -> DataFrame:
    """(site_id, currency, source, orders, revenue_cents)."""
    o = orders(hits, window).select("site_id", "visitor_hash", "ts", "currency", "revenue_cents")
    if currency is not None:
        o = o.where(F.col("currency") == currency)
    sums = _sums(with_source(o, hits, window), "site_id", "currency", "source")
    return top_per(sums, ["site_id", "currency"], [F.desc("revenue_cents"), F.asc("source")], limit)


def revenue_by_payment(hits: DataFrame, window=None, currency: str | None = DEFAULT_CURRENCY, limit: int | None = 10) -> DataFrame:
    """(site_id, currency, method, orders, revenue_cents)."""
    o = orders(hits, window).withColumn("method", F.coalesce("payment_method", F.lit(UNKNOWN)))
    if currency is not None:
        o = o.where(F.col("currency") == currency)
    sums = _sums(o, "site_id", "currency", "method")
    return top_per(sums, ["site_id", "currency"], [F.desc("revenue_cents"), F.asc("method")], limit)


def ecommerce_report(
    hits: DataFrame, items: DataFrame, sites: DataFrame, window=None, limit: int = 100
) -> DataFrame:
    """All order tables of every site in its dominant currency, in long form:
    (site_id, section, key, currency, n, revenue_cents)."""
    dom = dominant_currency(hits, sites, window)
    by_cur = orders_by_currency(hits, window).select(
        "site_id", F.lit("revenue").alias("section"), F.col("currency").alias("key"), "currency",
        F.col("orders").alias("n"), "revenue_cents")

    def part(df: DataFrame, section: str, key: str, n: str) -> DataFrame:
        return df.join(dom, ["site_id", "currency"], "left_semi").select(
            "site_id", F.lit(section).alias("section"), F.col(key).alias("key"), "currency",
            F.col(n).alias("n"), "revenue_cents")

    return (
        by_cur
        .unionByName(part(top_products(items, window, None, limit), "products", "product", "qty"))
        .unionByName(part(revenue_by_source(hits, window, None, limit), "sources", "source", "orders"))
        .unionByName(part(revenue_by_payment(hits, window, None, limit), "payment_methods", "method", "orders"))
    )
