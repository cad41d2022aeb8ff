"""Live forms: the same operators per micro-batch, and true stateful aggregates.

Outputs of a micro-batch go to a folder of that batch, written in overwrite mode, so a batch
that is replayed after a failure leaves the same files. What one batch must know of earlier
ones (visitor minutes, bursts still on, flagged visitors) is a small table written the same
way, never executor memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from footfall.functions.timewin import ntz
from footfall.operators.accounts import ATTEMPT_CAPS
from footfall.operators.bursts import RULE, S, BurstRule, burst_pass, landings, move_to_bots
from footfall.plans.ingest import Dimensions, ingest, minute_counts, minute_of

SWEEP_LOOKBACK = timedelta(seconds=90)
FLAG_TTL = timedelta(hours=1)


def hour_of(at: datetime) -> int:
    return int((at - datetime(1970, 1, 1)).total_seconds() // 3600)


def write_batch(df: DataFrame, root: str, batch_id: int, hour: int | None = None) -> None:
    under = root if hour is None else f"{root}/hour={hour}"
    df.write.mode("overwrite").parquet(f"{under}/batch={batch_id}")


def read_batches(spark: SparkSession, root: str, schema: str, before: int, hours: range) -> DataFrame:
    """Rows of earlier batches written under `hours`; empty when there are none. Only the folders
    of these hours are listed, so a look back costs the same however long the stream runs."""
    out = spark.createDataFrame([], f"{schema}, batch long")
    for hour in hours:
        try:
            part = spark.read.schema(f"{schema}, batch long").parquet(f"{root}/hour={hour}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = out.unionByName(part.where(F.col("batch") < before))
    return out


@dataclass
class LiveIngest:
    """Beacon stream -> hits, items, bots, drops, one folder per micro-batch."""

    dims: Dimensions
    secret: str
    root: str

    def process(self, beacons: DataFrame, batch_id: int) -> None:
        spark = beacons.sparkSession
        first, now = beacons.agg(F.min("received_at"), F.max("received_at")).first()
        if now is None:
            return
        minutes = f"{self.root}/minutes"
        # A batch lies under the hour of its newest row; its oldest may be of an earlier one.
        hours = range(hour_of(first), hour_of(now) + 2)
        seen = read_batches(spark, minutes, "visitor_hash string, minute long, n long", batch_id, hours)
        # Only the minutes this batch touches; the earlier counts of a minute are added up.
        touched = beacons.select(minute_of().alias("minute")).distinct()
        used = seen.join(touched, "minute", "left_semi").groupBy("visitor_hash", "minute").agg(F.sum("n").alias("used"))
        out = ingest(beacons, self.dims, self.secret, used=used)
        write_batch(out.hits, f"{self.root}/hits", batch_id)
        write_batch(out.items, f"{self.root}/items", batch_id)
        write_batch(out.bot_counts, f"{self.root}/bots", batch_id)
        write_batch(out.drops, f"{self.root}/drops", batch_id)
        passed = out.judged.where("reason IS NULL")
        write_batch(minute_counts(passed).drop("site_id"), minutes, batch_id, hour_of(now))

    def start(self, beacons: DataFrame, checkpoint: str, **trigger) -> DataStreamWriter:
        return beacons.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", checkpoint).trigger(**trigger).start()


def sweep(
    hits: DataFrame, now: datetime, carry: DataFrame | None = None, rule: BurstRule = RULE
) -> tuple[DataFrame, DataFrame]:
    """One look at the last minute and a half of stored hits: (flagged landings, bursts still
    on). Landings are judged a few seconds late, so that a page two people open a moment apart
    is seen as shared. Visitor keys change daily: first views need the current day only."""
    start = now - SWEEP_LOOKBACK
    day = datetime(start.year, start.month, start.day)
    horizon = now - timedelta(seconds=rule.lookahead)
    return burst_pass(
        landings(hits.where(F.col("ts") >= ntz(day))), rule, (start, now + timedelta(seconds=1)),
        int((horizon - datetime(1970, 1, 1)).total_seconds() * S), carry)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "batch")


@dataclass
class BurstSweep:
    """Hit stream -> flagged visitors, one folder per micro-batch. Hits of visitors flagged
    before are diverted (`diverted`) for an hour instead of being stored with the people.
    settle() moves what was stored before its visitor was flagged, and counts all robots."""

    root: str
    rule: BurstRule = RULE

    _FLAGGED = "site_id long, country string, visitor_hash string, us long, id long, path string"

    def process(self, hits: DataFrame, batch_id: int) -> None:
        spark = hits.sparkSession
        now = hits.agg(F.max("ts")).first()[0]
        if now is None:
            return
        hour = hour_of(now)
        day = range(hour_of(now - SWEEP_LOOKBACK) // 24 * 24, hour + 1)
        flagged = read_batches(spark, f"{self.root}/flagged", self._FLAGGED, batch_id, day)
        since = int((now - FLAG_TTL - datetime(1970, 1, 1)).total_seconds() * S)
        known = flagged.where(F.col("us") >= since).select("site_id", "visitor_hash").distinct()
        key = ["site_id", "visitor_hash"]
        write_batch(hits.join(known, key, "left_semi"), f"{self.root}/diverted", batch_id, hour)
        write_batch(hits.join(known, key, "left_anti"), f"{self.root}/stored", batch_id, hour)
        stored = read_batches(spark, f"{self.root}/stored", _ddl(hits), batch_id + 1, day)
        people = stored.join(flagged.select(*key).distinct(), key, "left_anti")
        on = read_batches(spark, f"{self.root}/active", "site_id long, country string, active long", batch_id, range(hour - 1, hour + 1))
        carry = on.groupBy("site_id", "country").agg(F.max("active").alias("active"))
        found, still = sweep(people, now, carry, self.rule)
        write_batch(found, f"{self.root}/flagged", batch_id, hour)
        write_batch(still, f"{self.root}/active", batch_id, hour)

    def settle(self, hits: DataFrame, items: DataFrame, bots: DataFrame, day: date) -> dict[str, DataFrame]:
        """Tables after a day: `hits` gives the columns of the stream, `items` and `bots` are the tables
        of the day so far. Events of flagged visitors leave hits and items, and they and the
        diverted rows are counted as robots, as the batch form does. Write the results by day
        (sources.tables.replace_days), so that a second run replaces the first."""
        spark = hits.sparkSession
        first = hour_of(datetime(day.year, day.month, day.day))
        hours, last = range(first, first + 25), 2**62
        schema = _ddl(hits)
        stored = read_batches(spark, f"{self.root}/stored", schema, last, hours).drop("batch")
        diverted = read_batches(spark, f"{self.root}/diverted", schema, last, hours).drop("batch")
        flagged = read_batches(spark, f"{self.root}/flagged", self._FLAGGED, last, hours).drop("batch")
        out = move_to_bots(stored.where(F.to_date("ts") == F.lit(day)), items, bots, flagged, self.rule)
        more = diverted.where(F.to_date("ts") == F.lit(day)).groupBy("site_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
        more = more.select("site_id", "day", F.lit("script").alias("bot_class"), F.lit("burst").alias("agent"), F.lit("").alias("path"), "n")
        key = ["site_id", "day", "bot_class", "agent", "path"]
        out["bots"] = out["bots"].unionByName(more).groupBy(*key).agg(F.sum("n").alias("n"))
        return out

    def start(self, hits: DataFrame, checkpoint: str, **trigger) -> DataStreamWriter:
        return hits.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", checkpoint).trigger(**trigger).start()


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; stored ones are zone-less UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def live_sessions(hits: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions as they close: (site_id, visitor_hash, started, ended, views, entry_path,
    exit_path). A gap of exactly `gap` stays in the session. Rows of one visitor are merged
    inside each task before the shuffle when
    spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition is on."""
    pv = _timed(hits.where(F.col("name") == "pageview"), "ts").withWatermark("ts", late)
    g = pv.groupBy("site_id", "visitor_hash", F.session_window("ts", gap).alias("w"))
    return g.agg(
        F.count(F.lit(1)).alias("views"), F.min(F.struct("ts", "id", "path")).alias("head"),
        F.max(F.struct("ts", "id", "path")).alias("tail"),
    ).select(
        "site_id", "visitor_hash", F.col("head.ts").alias("started"), F.col("tail.ts").alias("ended"), "views",
        F.col("head.path").alias("entry_path"), F.col("tail.path").alias("exit_path"))


def live_drops(verdicts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(site_id, reason, minute, n) of dropped beacons (received_at, site_id, reason)."""
    return _timed(verdicts.where("reason IS NOT NULL"), "received_at").withWatermark("received_at", late).groupBy(
        "site_id", "reason", F.window("received_at", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "site_id", "reason", F.col("w.start").alias("minute"), "n")


def live_attempts(attempts: DataFrame, late: str = "10 minutes", caps=ATTEMPT_CAPS, unit: str = "1 hour") -> DataFrame:
    """(bucket, kind, key, used, blocked) per tumbling window, updated as attempts arrive."""
    cap = F.lit(None).cast("int")
    for kind, (per_key, _) in caps.items():
        cap = F.when(F.col("kind") == kind, per_key).otherwise(cap)
    return _timed(attempts, "ts").withWatermark("ts", late).groupBy(F.window("ts", unit).alias("w"), "kind", "key").agg(
        F.count(F.lit(1)).alias("used")).select(
        F.col("w.start").alias("bucket"), "kind", "key", "used", F.coalesce(F.col("used") > cap, F.lit(False)).alias("blocked"))


def live_attempt_totals(attempts: DataFrame, late: str = "10 minutes", caps=ATTEMPT_CAPS, unit: str = "1 hour") -> DataFrame:
    """(bucket, kind, total, blocked): attempts of everyone together per tumbling window. An attempt
    is refused if this or its key's row of live_attempts() is blocked."""
    cap = F.lit(None).cast("int")
    for kind, (_, everyone) in caps.items():
        cap = F.when(F.col("kind") == kind, everyone).otherwise(cap)
    return _timed(attempts, "ts").withWatermark("ts", late).groupBy(F.window("ts", unit).alias("w"), "kind").agg(
        F.count(F.lit(1)).alias("total")).select(
        F.col("w.start").alias("bucket"), "kind", "total", F.coalesce(F.col("total") > cap, F.lit(False)).alias("blocked"))
