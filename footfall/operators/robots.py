"""Robot counts and visits from AI assistants."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.agents import BOT_CLASSES
from footfall.functions.referrers import ai_key, ai_name, is_ai_referral
from footfall.functions.timewin import pageviews
from footfall.operators.frames import top_per, union_all

PATH_CLASSES = ("ai", "search", "agent")
KEY = ["site_id", "day", "bot_class", "agent", "path"]


def bot_summary(bots: DataFrame, first: date | None = None, last: date | None = None, limit: int = 10) -> DataFrame:
    """(site_id, section, bot_class, key, n): total, per class, top agents and the pages AI
    crawlers read. The daily rows are first reduced to one per (site, class, agent, path)."""
    rows = bots
    if first is not None:
        rows = rows.where((F.col("day") >= F.lit(first)) & (F.col("day") <= F.lit(last)))
    base = rows.groupBy("site_id", "bot_class", "agent", "path").agg(F.sum("n").alias("n"))

    def section(df: DataFrame, name: str, cls, key) -> DataFrame:
        return df.groupBy("site_id", F.lit(name).alias("section"), cls.alias("bot_class"), key.alias("key")).agg(
            F.sum("n").alias("n"))

    agents = section(base, "agents", F.col("bot_class"), F.col("agent"))
    paths = section(base.where("bot_class = 'ai' AND path <> ''"), "ai_paths", F.lit("ai"), F.col("path"))
    order = [F.desc("n"), F.asc("key"), F.asc("bot_class")]
    return union_all([
        section(base, "total", F.lit(""), F.lit("")),
        section(base, "classes", F.col("bot_class"), F.col("bot_class")),
        top_per(agents, ["site_id"], order, limit),
        top_per(paths, ["site_id"], order, limit),
    ])


def ai_visits(hits: DataFrame, window=None) -> DataFrame:
    ref, utm = F.col("referrer_src"), F.col("utm_source")
    return pageviews(hits, window).where(is_ai_referral(ref, utm)).select(
        "site_id", "visitor_hash", "ts", ai_key(ref, utm).alias("assistant"))


def ai_referrals(hits: DataFrame, window=None) -> DataFrame:
    return ai_visits(hits, window).groupBy("site_id").agg(
        F.count_distinct("visitor_hash").alias("visitors"), F.count(F.lit(1)).alias("views"))


def ai_sources(hits: DataFrame, window=None, limit: int | None = 8) -> DataFrame:
    """(site_id, assistant, name, visitors, views); a visitor seen under two spellings of one
    assistant counts once."""
    c = ai_visits(hits, window).groupBy("site_id", "assistant").agg(
        F.count_distinct("visitor_hash").alias("visitors"), F.count(F.lit(1)).alias("views"))
    order = [F.desc("visitors"), F.desc("views"), F.asc("assistant")]
    return top_per(c, ["site_id"], order, limit).withColumn("name", ai_name(F.col("assistant")))


def tidy_counts(counts: DataFrame) -> DataFrame:
    """Class, agent and path rules of one robot hit, summed by key."""
    known = F.when(F.col("bot_class").isin(*BOT_CLASSES), F.col("bot_class")).otherwise("other")
    c = counts.withColumn("bot_class", known).withColumn(
        "agent", F.substring(F.coalesce("agent", F.lit("")), 1, 64)
    ).withColumn("path", F.when(
        F.col("bot_class").isin(*PATH_CLASSES), F.substring(F.coalesce("path", F.lit("")), 1, 512)
    ).otherwise(""))
    return c.groupBy(*KEY).agg(F.sum("n").alias("n"))


def merge_bot_counts(old: DataFrame, counts: DataFrame, cap: int | None = None) -> DataFrame:
    """The robot table after adding `counts`. With a `cap`, rows with a path that exist keep counting; new
    ones are admitted in key order until a site day has `cap` of them, and the rest count
    under the empty path.

    Admission needs only the first `cap` new keys of a site day, so the rank is cut before the
    shuffle; everything else is sums."""
    new = tidy_counts(counts)
    if cap is None:
        return old.select(*KEY, "n").unionByName(new.select(*KEY, "n")).groupBy(*KEY).agg(F.sum("n").alias("n"))
    have = old.where("path <> ''").groupBy("site_id", "day").agg(F.count(F.lit(1)).alias("_have"))
    fresh = new.where("path <> ''").join(old.select(*KEY), KEY, "left_anti")
    order = Window.partitionBy("site_id", "day").orderBy("bot_class", "agent", "path")
    ranked = fresh.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap)
    admitted = ranked.join(have, ["site_id", "day"], "left").where(
        F.col("_rank") <= cap - F.coalesce("_have", F.lit(0))).select(*KEY)
    allowed = old.select(*KEY).unionByName(admitted).withColumn("_ok", F.lit(1))
    folded = new.join(allowed, KEY, "left").withColumn(
        "path", F.when(F.col("_ok").isNotNull(), F.col("path")).otherwise("")).drop("_ok")
    return old.select(*KEY, "n").unionByName(folded.select(*KEY, "n")).groupBy(*KEY).agg(
        F.sum("n").alias("n"))
