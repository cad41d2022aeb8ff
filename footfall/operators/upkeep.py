"""Maintenance of stored rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.masking import mask_label, mask_path
from footfall.functions.timewin import day_of, day_text, ntz
from footfall.operators.frames import union_all
from footfall.operators.funnels import STEPS


def _mask_value(kind: Column, value: Column) -> Column:
    return F.when(kind == "path", mask_path(value)).otherwise(mask_label(value))


def _mask_steps(steps: Column) -> Column:
    """Funnel step text with masked values, null when unreadable or unchanged."""
    parsed = F.from_json(steps, STEPS, {"mode": "PERMISSIVE"})
    masked = F.transform(parsed, lambda s: F.struct(
        s["type"].alias("type"), _mask_value(s["type"], s["value"]).alias("value")))
    return F.when(masked != parsed, F.to_json(masked))


def mask_changes(hits: DataFrame, goals: DataFrame, funnels: DataFrame) -> DataFrame:
    """(table, id, column, old_value, new_value) of every stored value masking would change."""
    def changed(df: DataFrame, table: str, column: str, new: Column) -> DataFrame:
        return df.select(
            F.lit(table).alias("table"), "id", F.lit(column).alias("column"),
            F.col(column).alias("old_value"), new.alias("new_value"),
        ).where("new_value IS NOT NULL AND old_value <> new_value")

    # Paths and names in one read of the hit table.
    both = hits.select("id", F.inline(F.array(
        F.struct(F.lit("path").alias("column"), F.col("path").alias("old_value"), mask_path(F.col("path")).alias("new_value")),
        F.struct(F.lit("name").alias("column"), F.col("name").alias("old_value"), mask_label(F.col("name")).alias("new_value")),
    ))).where("old_value <> new_value").select(F.lit("events").alias("table"), "id", "column", "old_value", "new_value")
    return union_all([
        both,
        changed(goals, "goals", "match_value", _mask_value(F.col("match_type"), F.col("match_value"))),
        changed(funnels, "funnels", "steps", _mask_steps(F.col("steps"))),
    ])


def mask_summary(changes: DataFrame, examples: int = 5) -> DataFrame:
    """(section, key, n): changed rows per column, and the most common new paths."""
    per = changes.groupBy(F.concat("table", F.lit("."), "column").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    paths = changes.where("table = 'events' AND column = 'path'").groupBy(F.col("new_value").alias("key")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("key")).limit(examples)
    return per.select(F.lit("rows").alias("section"), "key", "n").unionByName(
        paths.select(F.lit("example").alias("section"), "key", "n"))


def mask_stored(hits: DataFrame, goals: DataFrame, funnels: DataFrame) -> dict[str, DataFrame]:
    """Masked tables and `backup`, the old values of the rows that change (write that first)."""
    changes = mask_changes(hits, goals, funnels)
    return {
        "backup": changes.select("table", "id", "column", "old_value"),
        "events": hits.withColumn("path", mask_path(F.col("path"))).withColumn("name", mask_label(F.col("name"))),
        "goals": goals.withColumn("match_value", _mask_value(F.col("match_type"), F.col("match_value"))),
        "funnels": funnels.withColumn("steps", F.coalesce(_mask_steps(F.col("steps")), F.col("steps"))),
    }


def blind_hashes(hits: DataFrame, key: str, today: datetime) -> DataFrame:
    """Re-keys visitors of the days before `today` with a throwaway key. Equal stays equal
    within a day, so every count reads as before; today is left alone."""
    new = F.sha2(F.concat(F.lit(key), "visitor_hash"), 256)
    return hits.withColumn("visitor_hash", F.when(F.col("ts") < ntz(today), new).otherwise(F.col("visitor_hash")))


def blind_plan(hits: DataFrame, today: datetime) -> DataFrame:
    """(day, events) that blinding would touch."""
    return hits.where(F.col("ts") < ntz(today)).groupBy(day_text(day_of("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("events"))


def reassign_sites(sites: DataFrame, moves: DataFrame) -> DataFrame:
    """Applies (public_id, new_tenant_id)."""
    return sites.join(moves, "public_id", "left").withColumn(
        "tenant_id", F.coalesce("new_tenant_id", "tenant_id")).drop("new_tenant_id")


def set_public(sites: DataFrame, switches: DataFrame) -> DataFrame:
    """Applies (public_id, tenant_id, on) to a site's public flag, only for its own tenant."""
    s = switches.select("public_id", "tenant_id", F.col("on").cast("int").alias("_on"))
    return sites.join(s, ["public_id", "tenant_id"], "left").withColumn(
        "public_dash", F.coalesce("_on", "public_dash")).drop("_on")
