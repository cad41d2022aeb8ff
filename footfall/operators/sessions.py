"""Sessions and navigation.

A session ends when more than 30 minutes pass between two page views of one visitor.
Page views of a visitor that fall in the same half hour can never be split by that rule, so
they are first combined per (site, visitor, half hour). This combination happens before the
shuffle, and what is left per visitor is bounded by time (48 rows a day), not by traffic: a
visitor who makes a third of all hits costs no more than another. The session rule then runs
over these few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.numbers import percent, ratio
from footfall.functions.timewin import day_of, micros, pageviews
from footfall.operators.frames import top_per
from footfall.schema import SESSION_GAP_SECONDS

GAP_US = SESSION_GAP_SECONDS * 1_000_000
MINUTE_US = 60_000_000


def half_hours(hits: DataFrame, window=None, paths: bool = False, by_day: bool = False) -> DataFrame:
    """Page views combined per (site, [day], visitor, half hour)."""
    keys = ["site_id", "visitor_hash"] + (["day"] if by_day else [])
    pv = pageviews(hits, window)
    if by_day:
        pv = pv.withColumn("day", day_of("ts"))
    us = micros("ts")
    cols = keys + ["us"] + (["id", "path"] if paths else [])
    rows = pv.withColumn("us", us).select(*cols, F.floor(us / GAP_US).alias("slot"))
    aggs = [
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count(F.lit(1)).alias("views"),
    ]
    if paths:
        # The path of the first and the last row by (time, id), as parts of one struct, so
        # each aggregate keeps a single value per group.
        aggs += [
            F.min(F.struct("us", "id", "path")).alias("head"),
            F.max(F.struct("us", "id", "path")).alias("tail"),
        ]
    return rows.groupBy(*keys, "slot").agg(*aggs)


def sessionize(hits: DataFrame, window=None, paths: bool = False, by_day: bool = False) -> DataFrame:
    """One row per session: site_id, [day], visitor_hash, visit_no, first_us, last_us, views,
    [entry_path, exit_path]."""
    keys = ["site_id", "visitor_hash"] + (["day"] if by_day else [])
    slots = half_hours(hits, window, paths, by_day)
    w = Window.partitionBy(*keys).orderBy("slot")
    prev = F.lag("last_us").over(w)
    starts = (prev.isNull() | (F.col("first_us") - prev > GAP_US)).cast("int")
    numbered = slots.withColumn("_start", starts).withColumn("visit_no", F.sum("_start").over(w))
    aggs = [
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.sum("views").alias("views"),
    ]
    if paths:
        aggs += [F.min("head").alias("head"), F.max("tail").alias("tail")]
    out = numbered.groupBy(*keys, "visit_no").agg(*aggs)
    if paths:
        out = out.withColumn("entry_path", F.col("head.path")).withColumn(
            "exit_path", F.col("tail.path")).drop("head", "tail")
    return out


def visit_totals(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """pageviews, visitors, sessions, bounces per `keys`. Every visitor has exactly one first
    session, so no distinct count is needed."""
    return sessions.groupBy(*keys).agg(
        F.sum("views").alias("pageviews"),
        F.sum((F.col("visit_no") == 1).cast("long")).alias("visitors"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum((F.col("views") == 1).cast("long")).alias("bounces"),
    )


def with_rates(totals: DataFrame) -> DataFrame:
    return totals.withColumn("bounce_rate", percent(F.col("bounces"), F.col("sessions"))).withColumn(
        "views_per_session", ratio(F.col("pageviews"), F.col("sessions"))
    )


def entry_exit(hits: DataFrame, window=None, limit: int | None = 10) -> DataFrame:
    """(site_id, kind, path, n): first and last pages of sessions, top `limit` of each."""
    s = sessionize(hits, window, paths=True)
    ends = s.select(
        "site_id",
        F.inline(F.array(
            F.struct(F.lit("entry").alias("kind"), F.col("entry_path").alias("path")),
            F.struct(F.lit("exit").alias("kind"), F.col("exit_path").alias("path")),
        )),
    )
    counted = ends.groupBy("site_id", "kind", "path").agg(F.count(F.lit(1)).alias("n"))
    return top_per(counted, ["site_id", "kind"], [F.desc("n"), F.asc("path")], limit)


def transitions(hits: DataFrame, window=None, limit: int | None = 12) -> DataFrame:
    """(site_id, from_path, to_path, n) within sessions, without reloads.

    Neighbours inside one minute of one visitor are found in a window over that minute; the
    first and last row of every minute then meet in a second, much smaller window. Neither
    window holds more than a minute's hits or a day's minutes of one visitor."""
    us = micros("ts")
    rows = pageviews(hits, window).select(
        "site_id", "visitor_hash", "id", "path", us.alias("us"), F.floor(us / MINUTE_US).alias("minute")
    )
    near = Window.partitionBy("site_id", "visitor_hash", "minute").orderBy("us", "id")
    rows = rows.withColumn("from_path", F.lag("path").over(near)).withColumn(
        "is_last", F.lead("us").over(near).isNull()
    ).withColumn("is_first", F.lag("us").over(near).isNull())
    inside = rows.where(~F.col("is_first")).select("site_id", "from_path", F.col("path").alias("to_path"))
    far = Window.partitionBy("site_id", "visitor_hash").orderBy("us", "id")
    edges = rows.where("is_first OR is_last").withColumn("from_path", F.lag("path").over(far)).withColumn(
        "gap", F.col("us") - F.lag("us").over(far)
    )
    across = edges.where(F.col("is_first") & (F.col("gap") <= GAP_US)).select(
        "site_id", "from_path", F.col("path").alias("to_path")
    )
    steps = inside.unionByName(across).where(F.col("from_path") != F.col("to_path"))
    counted = steps.groupBy("site_id", "from_path", "to_path").agg(F.count(F.lit(1)).alias("n"))
    return top_per(
        counted, ["site_id"], [F.desc("n"), F.asc("from_path"), F.asc("to_path")], limit
    )


def without_reloads(navigation: DataFrame, client: list[str]) -> DataFrame:
    """Raw navigation log (client columns, ts, id, page, origin, referrer) as the browser
    script reports it: a page view is sent only when the path changed, and its referrer is
    the previous own page. Windows are split by minute as in `transitions`."""
    us = micros("ts")
    n = navigation.withColumn("us", us).withColumn("minute", F.floor(us / MINUTE_US))
    near = Window.partitionBy(*client, "minute").orderBy("us", "id")
    n = n.withColumn("_prev", F.lag("page").over(near)).withColumn(
        "_last", F.lead("us").over(near).isNull()).withColumn("_first", F.lag("us").over(near).isNull())
    far = Window.partitionBy(*client).orderBy("us", "id")
    edge = n.where("_first OR _last").select(
        *client, "id", "_first", F.lag("page").over(far).alias("_before")
    ).where("_first").select(*client, "id", "_before")
    n = n.join(edge, client + ["id"], "left").withColumn("_prev", F.coalesce("_prev", "_before"))
    kept = n.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("page")))
    ref = F.when(F.col("_prev").isNotNull(), F.concat("origin", "_prev")).otherwise(F.col("referrer"))
    return kept.withColumn("referrer", ref).drop("_prev", "_before", "_last", "_first", "us", "minute")
