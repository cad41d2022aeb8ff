"""Ordered funnels.

A visitor goes through a funnel greedily in time order: each hit advances at most one step.
What a stretch of hits does to a visitor is a small table "at step i on entry -> at step j on
exit". Such tables can be composed, so the match runs in levels: blocks of BLOCK hits make one
table each, the blocks of a visitor minute are composed in order, and then a visitor's minutes
(at most 1440 a day, since keys change daily). Hits that match no step are dropped before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.numbers import percent
from footfall.functions.timewin import micros, within

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
BLOCK = 256
STEPS = "array<struct<type:string,value:string>>"


def read_steps(funnels: DataFrame) -> DataFrame:
    """Adds `step_list`; unreadable step text becomes an empty list."""
    parsed = F.from_json("steps", STEPS, {"mode": "PERMISSIVE"})
    return funnels.withColumn("step_list", F.coalesce(parsed, F.array().cast(STEPS)))


def step_rows(funnels: DataFrame) -> DataFrame:
    """One row per step: site_id, funnel_id, funnel, steps_total, pos (from 0), type, value."""
    f = read_steps(funnels)
    return f.select(
        "site_id", F.col("id").alias("funnel_id"), F.col("name").alias("funnel"),
        F.size("step_list").alias("steps_total"), F.posexplode("step_list").alias("pos", "step"),
    ).select("site_id", "funnel_id", "funnel", "steps_total", "pos", "step.type", "step.value")


def _advance(at: Column, matched: Column) -> Column:
    return F.when(F.array_contains(matched, at), at + 1).otherwise(at)


def reached(hits: DataFrame, funnels: DataFrame, window=None) -> DataFrame:
    """(site_id, funnel_id, steps_total, visitor_hash, reached): how many steps each visitor
    who matched any step got through."""
    steps = step_rows(funnels)
    kinds = steps.select(
        "site_id", "funnel_id", "steps_total", "pos",
        F.when(F.col("type") == "event", "event").otherwise("path").alias("kind"), "value",
    ).groupBy("site_id", "kind", "value", "funnel_id", "steps_total").agg(
        F.collect_list("pos").alias("matched"))
    us = micros("ts")
    keys = F.array_compact(F.array(
        F.struct(F.lit("event").alias("kind"), F.col("name").alias("value")),
        F.when(F.col("name") == "pageview",
               F.struct(F.lit("path").alias("kind"), F.col("path").alias("value"))),
    ))
    rows = within(hits, window).select("site_id", "visitor_hash", "id", us.alias("us"), F.inline(keys))
    found = rows.join(kinds, ["site_id", "kind", "value"]).select(
        "site_id", "funnel_id", "steps_total", "visitor_hash", "us", "id", "matched")
    who = ["site_id", "funnel_id", "steps_total", "visitor_hash"]
    # A hit can match by its event name and by its path: both lists belong to one hit.
    hit = found.groupBy(*who, "us", "id").agg(F.flatten(F.collect_list("matched")).alias("matched"))
    # Hits are numbered by second and cut into blocks, so no list grows with a visitor's traffic
    # but the list of blocks, which is BLOCK times shorter.
    hit = hit.withColumn("second", F.floor(F.col("us") / SECOND_US))
    order = Window.partitionBy(*who, "second").orderBy("us", "id")
    hit = hit.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
    ordered = F.sort_array(F.collect_list(F.struct("us", "id", "matched")))
    start = F.sequence(F.lit(0), F.col("steps_total"))
    table = F.transform(start, lambda at: F.aggregate("seq", at, lambda a, x: _advance(a, x["matched"])))
    blocks = hit.groupBy(*who, "second", "block").agg(ordered.alias("seq")).select(
        *who, F.floor(F.col("second") * SECOND_US / MINUTE_US).alias("minute"), "second", "block", table.alias("table"))
    inside = F.transform(F.sort_array(F.collect_list(F.struct("second", "block", "table"))), lambda b: b["table"])
    composed = F.transform(start, lambda at: F.aggregate("blocks", at, lambda a, t: F.get(t, a)))
    tables = blocks.groupBy(*who, "minute").agg(inside.alias("blocks")).select(*who, "minute", composed.alias("table"))
    chain = F.transform(F.sort_array(F.collect_list(F.struct("minute", "table"))), lambda m: m["table"])
    per_visitor = tables.groupBy(*who).agg(chain.alias("chain"))
    final = F.aggregate("chain", F.lit(0), lambda at, t: F.get(t, at))
    return per_visitor.select(*who, final.alias("reached"))


def funnel(hits: DataFrame, funnels: DataFrame, window=None, digits: int = 0) -> DataFrame:
    """(site_id, funnel_id, funnel, step, type, value, visitors, rate, dropped): visitors who
    reached each step, the share of the first step, and how many were lost since the step
    before."""
    steps = step_rows(funnels)
    got = reached(hits, funnels, window).where("reached > 0").groupBy(
        "site_id", "funnel_id", "reached").agg(F.count(F.lit(1)).alias("n"))
    counts = got.select(
        "site_id", "funnel_id", F.explode(F.sequence(F.lit(0), F.col("reached") - 1)).alias("pos"), "n"
    ).groupBy("site_id", "funnel_id", "pos").agg(F.sum("n").alias("visitors"))
    out = steps.join(counts, ["site_id", "funnel_id", "pos"], "left").withColumn(
        "visitors", F.coalesce("visitors", F.lit(0).cast("long")))
    w = Window.partitionBy("site_id", "funnel_id").orderBy("pos")
    base = F.first("visitors").over(w)
    return out.select(
        "site_id", "funnel_id", "funnel", (F.col("pos") + 1).alias("step"), "type", "value", "visitors",
        percent(F.col("visitors"), base, digits).alias("rate"),
        (F.coalesce(F.lag("visitors").over(w), F.col("visitors")) - F.col("visitors")).alias("dropped"),
    )


def merge_definitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds goals or funnels whose name the site does not have yet; running it twice changes
    nothing."""
    fresh = new.dropDuplicates(["site_id", "name"]).join(old, ["site_id", "name"], "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def drop_definitions(old: DataFrame, gone: DataFrame) -> DataFrame:
    """Removes definitions by (site_id, id)."""
    return old.join(gone, ["site_id", "id"], "left_anti")
