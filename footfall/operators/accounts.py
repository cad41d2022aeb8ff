"""Account life cycle: trials, dormant accounts, warnings, purges, deletion, throttling."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.timewin import micros, ntz
from footfall.operators.frames import union_all
from footfall.operators.metrics import first_user

# Fixed values, in days: when accounts go, and how the warning before it works.
ENDED_DAYS = 84
UNVERIFIED_DAYS = 14
WARN_DAYS = 14
MIN_NOTICE_DAYS = 7
HARD_DAYS = 89
WARNED = ("trial_expired", "cancelled")

# Tables with rows of one site, lines before their events.
SITE_TABLES = (
    "event_items", "events", "goals", "funnels", "daily_rollups", "daily_breakdowns",
    "search_stats", "search_connections", "anchors", "bot_daily",
)
# Caps per hour (or day) for one key and for everyone; None is no cap.
ATTEMPT_CAPS = {
    "signup": (5, 40), "forgot_ip": (5, 40), "forgot_email": (3, None), "login_ip": (30, None),
    "login_email": (10, None), "invite_tenant": (10, None), "invite_email": (3, None),
    "invoice_tenant": (5, None), "invoice_email": (2, None), "assist": (25, 500),
}


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def cutoffs(as_of: datetime) -> dict[str, datetime]:
    ended = as_of - timedelta(days=ENDED_DAYS)
    return {
        "unverified": as_of - timedelta(days=UNVERIFIED_DAYS), "trial_expired": ended,
        "cancelled": ended, "expired_links": as_of,
    }


def trials_ending(tenants: DataFrame, users: DataFrame, as_of: datetime, within_days: int = 3) -> DataFrame:
    end = F.col("trial_ends_at")
    due = tenants.where("plan = 'trial' AND trial_reminded_at IS NULL").where(
        (end > ntz(as_of)) & (end <= ntz(as_of + timedelta(days=within_days))))
    return due.select(F.col("id").alias("tenant_id"), "trial_ends_at").join(first_user(users), "tenant_id", "left")


def _no_money() -> Column:
    return F.expr("vipps_agreement_id IS NULL AND vipps_pending_plan IS NULL AND invoice_details IS NULL")


def _ended_conditions(cutoff_of: dict[str, datetime]) -> dict[str, Column]:
    trial = F.expr("plan = 'trial' AND stripe_subscription_id IS NULL") & _no_money()
    return {
        "trial_expired": trial & (F.col("trial_ends_at") < ntz(cutoff_of["trial_expired"])),
        "cancelled": F.expr("plan = 'cancelled'") & _no_money() & (
            F.col("cancelled_at") < ntz(cutoff_of["cancelled"])),
    }


def dormant(
    tenants: DataFrame, users: DataFrame, sites: DataFrame, hits: DataFrame, rollups: DataFrame, as_of: datetime
) -> DataFrame:
    """(tenant_id, category): accounts that have to go now, under their first category."""
    cut = cutoffs(as_of)
    conds = _ended_conditions(cut)
    people = users.groupBy(F.col("tenant_id").alias("id")).agg(F.max("email_verified").alias("_verified"))
    # Hits are reduced to the set of sites before anything is joined.
    used_sites = hits.select("site_id").distinct().unionByName(rollups.select("site_id").distinct()).distinct()
    used = sites.select("tenant_id", F.col("id").alias("site_id")).join(
        used_sites, "site_id", "left_semi").select(F.col("tenant_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    t = tenants.join(people, "id", "left").join(used, "id", "left")
    unverified = (
        F.expr("plan = 'trial' AND stripe_subscription_id IS NULL") & _no_money()
        & (F.col("created_at") < ntz(cut["unverified"]))
        & (F.col("_verified") == 0) & F.col("_used").isNull())
    category = F.when(unverified, "unverified").when(conds["trial_expired"], "trial_expired").when(
        conds["cancelled"], "cancelled")
    return t.select(F.col("id").alias("tenant_id"), category.alias("category")).where("category IS NOT NULL")


def deletion_date(ended: Column, now: Column, warned: Column) -> Column:
    """Not before the cutoff nor the notice after the warning, and never past the hard limit."""
    eligible = ended + _days(ENDED_DAYS)
    notice = F.coalesce(warned, now) + _days(MIN_NOTICE_DAYS)
    return F.least(F.greatest(eligible, notice), ended + _days(HARD_DAYS))


def _ended(tenants: DataFrame, cutoff: datetime) -> DataFrame:
    """Ended accounts with category, ended_at, and the warning of this ending."""
    conds = _ended_conditions({"trial_expired": cutoff, "cancelled": cutoff})
    category = F.when(conds["trial_expired"], "trial_expired").when(conds["cancelled"], "cancelled")
    ended = F.when(F.col("category") == "trial_expired", F.col("trial_ends_at")).otherwise(F.col("cancelled_at"))
    warned = F.when(F.col("deletion_warned_at") >= F.col("ended_at"), F.col("deletion_warned_at"))
    return tenants.withColumn("category", category).where("category IS NOT NULL").withColumn(
        "ended_at", ended).withColumn("warned_at", warned).select(
        F.col("id").alias("tenant_id"), "name", "category", "ended_at", "warned_at")


def to_warn(tenants: DataFrame, users: DataFrame, as_of: datetime) -> DataFrame:
    """(tenant_id, name, email, category, ended_at, delete_on) of accounts to warn now."""
    near = _ended(tenants, as_of - timedelta(days=ENDED_DAYS - WARN_DAYS)).where("warned_at IS NULL")
    out = near.join(first_user(users), "tenant_id").where("email <> ''")
    none = F.lit(None).cast("timestamp_ntz")
    return out.select(
        "tenant_id", "name", "email", "category", "ended_at",
        deletion_date(F.col("ended_at"), ntz(as_of), none).alias("delete_on"))


def held_for_notice(tenants: DataFrame, users: DataFrame, due: DataFrame, as_of: datetime) -> DataFrame:
    """The due accounts whose deletion must wait for the warning."""
    w = due.where(F.col("category").isin(*WARNED)).join(
        tenants.select(F.col("id").alias("tenant_id"), "trial_ends_at", "cancelled_at", "deletion_warned_at"),
        "tenant_id").join(first_user(users), "tenant_id").where("email <> ''")
    ended = F.when(F.col("category") == "trial_expired", F.col("trial_ends_at")).otherwise(F.col("cancelled_at"))
    w = w.withColumn("ended_at", ended).where("ended_at IS NOT NULL")
    told = F.when(F.col("deletion_warned_at") >= F.col("ended_at"), F.col("deletion_warned_at"))
    hard = ntz(as_of) >= F.col("ended_at") + _days(HARD_DAYS)
    noticed = F.coalesce(ntz(as_of) >= told + _days(MIN_NOTICE_DAYS), F.lit(False))
    return w.where(~hard & ~noticed).select("tenant_id", "category")


def deletion_notice(tenants: DataFrame, as_of: datetime) -> DataFrame:
    """(tenant_id, category, ended_at, delete_on) of every ended account."""
    return _ended(tenants, as_of).select(
        "tenant_id", "category", "ended_at",
        deletion_date(F.col("ended_at"), ntz(as_of), F.col("warned_at")).alias("delete_on"))


# --- deletion ---------------------------------------------------------------------------

def delete_sites(tables: dict[str, DataFrame], sites: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the rows of `sites` (column id), deleted rows per table)."""
    gone = sites.select(F.col("id").alias("site_id")).distinct()
    out, counts = dict(tables), []
    for name in SITE_TABLES:
        if name in tables:
            out[name] = tables[name].join(gone, "site_id", "left_anti")
            counts.append(_count(name, tables[name].join(gone, "site_id", "left_semi")))
    own = gone.withColumnRenamed("site_id", "id")
    out["sites"] = tables["sites"].join(own, "id", "left_anti")
    counts.append(_count("sites", tables["sites"].join(own, "id", "left_semi")))
    return out, union_all(counts)


def _count(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")


def delete_tenants(tables: dict[str, DataFrame], tenants: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The same for whole accounts (column tenant_id): sites, users with their logins and
    links, keys, invites and the account row."""
    gone = tenants.select("tenant_id").distinct()
    sites = tables["sites"].join(gone, "tenant_id", "left_semi")
    out, counts = delete_sites(tables, sites)
    users = tables["users"].join(gone, "tenant_id", "left_semi")
    by = {
        "user_identities": (users.select(F.col("id").alias("user_id")), "user_id"),
        "reset_tokens": (users.select("email"), "email"),
        "api_keys": (gone, "tenant_id"), "invites": (gone, "tenant_id"), "users": (gone, "tenant_id"),
        "tenants": (gone.withColumnRenamed("tenant_id", "id"), "id"),
    }
    parts = [counts]
    for name, (key_rows, key) in by.items():
        if name in tables:
            out[name] = tables[name].join(key_rows.distinct(), key, "left_anti")
            parts.append(_count(name, tables[name].join(key_rows.distinct(), key, "left_semi")))
    return out, union_all(parts)


def purge_dormant(
    tables: dict[str, DataFrame], as_of: datetime, enforce: bool = False, batch: int | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after the run, counts (measure, n)). A dry run changes nothing. All due accounts that
    are not held go, or with `batch` so many, unverified ones first; remaining_accounts tells
    how many are left. Expired links go too."""
    due = dormant(
        tables["tenants"], tables["users"], tables["sites"], tables["events"], tables["daily_rollups"], as_of)
    held = held_for_notice(tables["tenants"], tables["users"], due, as_of)
    counts = [
        due.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(
            F.concat(F.lit("accounts."), "category").alias("measure"), "n"),
        held.agg(F.count(F.lit(1)).alias("n")).select(F.lit("held_for_notice").alias("measure"), "n"),
    ]
    out = dict(tables)
    expired = [n for n in ("reset_tokens", "invites") if n in tables]
    for n in expired:
        old = tables[n].where(F.col("expires_at") <= ntz(as_of))
        counts.append(old.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(f"expired_links.{n}").alias("measure"), "n"))
    if enforce:
        order = F.when(F.col("category") == "unverified", 0).when(F.col("category") == "trial_expired", 1).otherwise(2)
        free = due.join(held, "tenant_id", "left_anti")
        chosen = free if batch is None else free.orderBy(order, "tenant_id").limit(batch)
        done = chosen.agg(F.count(F.lit(1)).alias("n"))
        counts.append(done.select(F.lit("deleted_accounts").alias("measure"), "n"))
        counts.append(due.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("remaining_accounts").alias("measure"), (F.col("n") - done.scalar()).alias("n")))
        out, deleted = delete_tenants(tables, chosen)
        for n in expired:
            out[n] = out[n].where(F.col("expires_at") > ntz(as_of))
        counts.append(deleted.select(
            F.concat(F.lit("deleted_rows."), "table").alias("measure"), F.col("deleted").alias("n")))
    return out, union_all(counts)


def audit_row(counts: DataFrame, as_of: datetime, enforce: bool) -> DataFrame:
    """One row of the retention log: ran_at, enforce, cutoffs and counts as JSON."""
    entries = F.sort_array(F.collect_list(F.struct("measure", "n")))
    cut = F.create_map(*[F.lit(x) for k, v in sorted(cutoffs(as_of).items()) for x in (k, f"{v:%Y-%m-%d %H:%M:%S}")])
    return counts.agg(F.map_from_entries(entries).alias("m")).select(
        F.lit(f"{as_of:%Y-%m-%d %H:%M:%S}").alias("ran_at"), F.lit(int(enforce)).alias("enforce"),
        F.to_json(cut).alias("cutoffs"), F.to_json("m").alias("counts"))


# --- sign-up robots ---------------------------------------------------------------------

def select_signups(users: DataFrame, id_range: tuple[int, int], first: date, last: date) -> DataFrame:
    """Never verified users of an id range, created on the given days (both included)."""
    end = datetime(last.year, last.month, last.day) + timedelta(days=1)
    return users.where(F.col("id").between(*id_range) & (F.col("email_verified") == 0)).where(
        (F.col("created_at") >= ntz(datetime(first.year, first.month, first.day))) & (F.col("created_at") < ntz(end)))


def unsafe_reasons(chosen: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(reason, n) for everything that forbids deleting the selection; empty when it is safe."""
    tenants = chosen.select("tenant_id").distinct()
    used = tables["sites"].join(tenants, "tenant_id", "left_semi").select(F.col("id").alias("site_id")).join(
        tables["events"].select("site_id").distinct(), "site_id", "left_semi")
    parts = [
        ("first user", chosen.where("id = 1")),
        ("verified", chosen.where("email_verified <> 0")),
        ("has events", used),
        ("shared tenant", tables["users"].join(tenants, "tenant_id", "left_semi").join(
            chosen.select("id"), "id", "left_anti").select("tenant_id").distinct()),
    ]
    if "api_keys" in tables:
        parts.append(("used key", tables["api_keys"].where("last_used_at IS NOT NULL").join(tenants, "tenant_id", "left_semi")))
    return union_all([
        rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("reason"), "n") for r, rows in parts
    ]).where("n > 0")


def delete_counts(chosen: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    return delete_tenants(tables, chosen.select("tenant_id"))[1]


def email_digest(chosen: DataFrame) -> DataFrame:
    """sha256 over the sorted addresses of the (id-bounded) selection, independent of order."""
    mails = F.sort_array(F.collect_list(F.lower(F.trim("email"))))
    return chosen.agg(F.sha2(F.array_join(mails, "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("users"))


# --- throttling -------------------------------------------------------------------------

def attempt_counts(attempts: DataFrame, unit: str = "hour") -> DataFrame:
    """(bucket, kind, key, used, total): attempts of each key and of everyone per bucket."""
    per = attempts.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket"), "kind", "key").agg(
        F.count(F.lit(1)).alias("used"))
    total = per.groupBy("bucket", "kind").agg(F.sum("used").alias("total"))
    return per.join(total, ["bucket", "kind"])


def throttled(attempts: DataFrame, caps: dict[str, tuple[int, int | None]] = ATTEMPT_CAPS, unit: str = "hour") -> DataFrame:
    """Attempts with `nth`, `nth_all` and `blocked`: in their bucket the key, or everyone together,
    already used the cap (None: no cap for everyone). Both numbers are the count of the minutes
    before plus the rank inside a part of a minute, so neither one hammering key nor everyone's
    attempts of a bucket are one task: minutes are cut into tenths of a second for the ranks."""
    mine, total = F.lit(None).cast("int"), F.lit(None).cast("int")
    for kind, (per_key, everyone) in caps.items():
        mine = F.when(F.col("kind") == kind, per_key).otherwise(mine)
        total = F.when(F.col("kind") == kind, everyone).otherwise(total)
    bucket = F.date_trunc(unit, "ts").cast("timestamp_ntz")
    out = attempts.withColumn("bucket", bucket).withColumn("_min", F.floor(micros("ts") / 60_000_000)).withColumn(
        "_part", F.floor(micros("ts") / 100_000))

    def numbered(rows: DataFrame, k: list[str], name: str) -> DataFrame:
        parts = rows.groupBy(*k, "_min", "_part").agg(F.count(F.lit(1)).alias("_n"))
        minutes = parts.groupBy(*k, "_min").agg(F.sum("_n").alias("_m"))
        rest = (Window.unboundedPreceding, -1)
        minutes = minutes.select(*k, "_min", F.coalesce(F.sum("_m").over(
            Window.partitionBy(*k).orderBy("_min").rowsBetween(*rest)), F.lit(0)).alias("_a"))
        inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*k, "_min").orderBy("_part").rowsBetween(*rest)), F.lit(0))
        before = parts.select(*k, "_min", "_part", inside.alias("_b")).join(minutes, [*k, "_min"]).select(
            *k, "_part", (F.col("_a") + F.col("_b")).alias("_before"))
        rank = F.row_number().over(Window.partitionBy(*k, "_part").orderBy("ts", "id"))
        return rows.withColumn("_rank", rank).join(before, [*k, "_part"]).withColumn(
            name, F.col("_before") + F.col("_rank")).drop("_rank", "_before")

    out = numbered(out, ["bucket", "kind", "key"], "nth")
    out = numbered(out, ["bucket", "kind"], "nth_all")
    over = F.coalesce(F.col("nth") > mine, F.lit(False)) | F.coalesce(F.col("nth_all") > total, F.lit(False))
    return out.withColumn("blocked", over).drop("_min", "_part")
