"""Nightly tables: sealed daily totals and the long breakdown table that outlives raw hits."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.numbers import percent
from footfall.functions.referrers import ai_key, first_touch, is_ai_referral, settle_payment_source, with_site_domain
from footfall.functions.timewin import day_lit, day_of, day_text, micros, ntz, within
from footfall.operators.frames import top_per, union_all, zero_fill
from footfall.operators.metrics import PAGEVIEW_DIMS, dim_entries
from footfall.operators.sessions import sessionize, visit_totals
from footfall.session import cut_lineage
from footfall.schema import DEFAULT_CURRENCY, DIRECT, UNKNOWN

HIT_DIMS = (*PAGEVIEW_DIMS, "campaign", "event", "ai", "ai_total")
SESSION_DIMS = ("kpi", "entry", "exit")
ORDER_DIMS = ("ecom", "ecom_source", "ecom_payment")
PRODUCT_DIMS = ("product",)
BOT_DIMS = ("bot", "bot_ai_path")
ALL_DIMS = HIT_DIMS + SESSION_DIMS + ORDER_DIMS + PRODUCT_DIMS + BOT_DIMS
COLUMNS = ["dim", "key", "currency", "n", "visitors", "revenue_cents"]
KPIS = ("pageviews", "visitors", "sessions", "bounces")


def site_days(sites: DataFrame, first: date, last: date) -> DataFrame:
    """Every site on every day of an inclusive range."""
    return sites.select(
        F.col("id").alias("site_id"),
        F.explode(F.expr(f"sequence(DATE '{first}', DATE '{last}')")).alias("day"))


def seal(r: DataFrame) -> Column:
    """sha256 of the canonical JSON of one day's totals."""
    return F.sha2(seal_payload(), 256)


def seal_payload() -> Column:
    return F.format_string(
        '{"bounce_rate": %d, "day": "%s", "pageviews": %d, "sessions": %d, "site_id": %d, "visitors": %d}',
        F.col("bounce_rate").cast("long"), day_text("day"), F.col("pageviews"), F.col("sessions"),
        F.col("site_id"), F.col("visitors"),
    )


def daily_rollup(hits: DataFrame, targets: DataFrame, window=None) -> DataFrame:
    """Totals of each target (site_id, day) with their seal; a day without hits is a zero row."""
    totals = visit_totals(sessionize(hits, window, by_day=True), ["site_id", "day"])
    t = zero_fill(targets.join(totals, ["site_id", "day"], "left"), list(KPIS))
    t = t.withColumn("bounce_rate", percent(F.col("bounces"), F.col("sessions"))).drop("bounces")
    return t.withColumn("rollup_hash", seal(t)).withColumn("bounce_rate", F.col("bounce_rate").cast("double"))


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """New totals replace stored ones, except on anchored days (txid set)."""
    fields = ["pageviews", "visitors", "sessions", "bounce_rate", "rollup_hash"]
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, ["site_id", "day"], "full_outer")
    keep = F.col("o.txid").isNotNull() | F.col("n.rollup_hash").isNull()
    return j.select(
        "site_id", "day",
        *[F.when(keep, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in fields],
        *[F.col(f"o.{c}") for c in ("merkle_root", "merkle_proof", "txid", "anchored_at")],
    )


# --- the breakdown cube -----------------------------------------------------------------

def json_text(*cols: str) -> Column:
    """A JSON array of strings with ", " between the elements."""
    quoted = [F.regexp_replace(F.to_json(F.array(F.col(c))), r"\A\[|\]\z", "") for c in cols]
    return F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]"))


def _entry(dim: str, key: Column) -> Column:
    return F.struct(F.lit(dim).alias("dim"), key.alias("key"))


def _long(df: DataFrame, keys: list[str]) -> DataFrame:
    types = {"currency": "string", "n": "long", "visitors": "long", "revenue_cents": "long"}
    out = df
    for c, t in types.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit("" if c == "currency" else None).cast(t))
        else:
            out = out.withColumn(c, F.col(c).cast(t))
    return out.select(*keys, *COLUMNS)


def hit_dims(hits: DataFrame, sites: DataFrame, keys: list[str], dims=HIT_DIMS) -> DataFrame:
    """Page-view dimensions, campaigns, assistants and events: the hit table is read once and
    each row fans out into its dimension keys inside the map task, where partial counting
    folds them again before the shuffle."""
    rows = with_site_domain(hits, sites)
    rows = rows.select(
        "*", *[F.coalesce(F.col(f"utm_{c}"), F.lit("")).alias(f"_{c}") for c in ("source", "medium", "campaign")])
    ref, utm = F.col("referrer_src"), F.col("utm_source")
    tagged = utm.isNotNull() | F.col("utm_campaign").isNotNull()
    from_ai = is_ai_referral(ref, utm)
    is_view = F.col("name") == "pageview"
    extra = {
        "campaign": F.when(is_view & tagged, _entry("campaign", json_text("_source", "_medium", "_campaign"))),
        "ai": F.when(is_view & from_ai, _entry("ai", ai_key(ref, utm))),
        "ai_total": F.when(is_view & from_ai, _entry("ai_total", F.lit(""))),
        "event": F.when(~is_view, _entry("event", F.col("name"))),
    }
    plain = dim_entries([d for d in PAGEVIEW_DIMS if d in dims])
    entries = F.filter(
        F.array(*[F.when(is_view, e) for e in plain], *[e for d, e in extra.items() if d in dims]),
        lambda e: e.isNotNull() & e["key"].isNotNull())
    return rows.select(*keys, "visitor_hash", F.inline(entries)).groupBy(*keys, "dim", "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("visitor_hash").alias("visitors"))


def session_dims(hits: DataFrame, keys: list[str], dims=SESSION_DIMS) -> DataFrame:
    """kpi, entry and exit rows from one session frame. A day with events but without page
    views keeps its four zero rows."""
    paths = bool({"entry", "exit"} & set(dims))
    s = sessionize(hits, paths=paths, by_day="day" in keys)

    def entry(dim: str, key: Column, n: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), key.alias("key"), n.cast("long").alias("n"))

    one = F.lit(1)
    entries = [entry(d, F.col(f"{d}_path"), one) for d in ("entry", "exit") if d in dims]
    if "kpi" in dims:
        entries += [
            entry("kpi", F.lit("pageviews"), F.col("views")),
            entry("kpi", F.lit("visitors"), F.col("visit_no") == 1),
            entry("kpi", F.lit("sessions"), one),
            entry("kpi", F.lit("bounces"), F.col("views") == 1),
        ]
    parts = s.select(*keys, F.inline(F.array(*entries)))
    if "kpi" not in dims:
        return parts.groupBy(*keys, "dim", "key").agg(F.sum("n").alias("n"))
    zeros = hits.select(*keys).distinct().select(
        *keys, F.inline(F.array(*[entry("kpi", F.lit(k), F.lit(0)) for k in KPIS])))
    return parts.unionByName(zeros).groupBy(*keys, "dim", "key").agg(F.sum("n").alias("n"))


def order_dims(hits: DataFrame, keys: list[str], dims=ORDER_DIMS) -> DataFrame:
    """ecom, ecom_source and ecom_payment rows from one pass over the orders."""
    who = [*keys, "visitor_hash"]
    o = hits.where("revenue_cents IS NOT NULL").select(
        *who, micros("ts").alias("us"), "revenue_cents", "payment_method",
        F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"))
    entries = []
    if "ecom" in dims:
        entries.append(_entry("ecom", F.lit("")))
    if "ecom_payment" in dims:
        entries.append(_entry("ecom_payment", F.coalesce("payment_method", F.lit(UNKNOWN))))
    if "ecom_source" in dims:
        first = F.struct(
            micros("ts").alias("us"), F.col("id").alias("id"),
            first_touch(F.col("utm_source"), F.col("referrer_src")).alias("source"))
        views = hits.where("name = 'pageview'").select(*who, first.alias("first")).groupBy(*who).agg(
            F.min("first").alias("first"))
        o = o.join(views, who, "left")
        source = F.when(F.col("first.us") <= F.col("us"), F.col("first.source"))
        entries.append(_entry("ecom_source", settle_payment_source(F.coalesce(source, F.lit(DIRECT)))))
    parts = o.select(*keys, "currency", "revenue_cents", F.inline(F.array(*entries)))
    return parts.groupBy(*keys, "dim", "key", "currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue_cents").alias("revenue_cents"))


def product_dims(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(
        *keys, F.lit("product").alias("dim"), F.col("name").alias("key"),
        F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
    ).agg(F.sum("qty").alias("n"), F.sum(F.col("qty") * F.col("unit_price_cents")).alias("revenue_cents"))


def robot_dims(bots: DataFrame, keys: list[str], dims=BOT_DIMS) -> DataFrame:
    of_ai = (F.col("bot_class") == "ai") & (F.col("path") != "")
    made = {
        "bot": _entry("bot", json_text("bot_class", "agent")),
        "bot_ai_path": F.when(of_ai, _entry("bot_ai_path", F.col("path"))),
    }
    entries = F.filter(F.array(*[e for d, e in made.items() if d in dims]), lambda e: e.isNotNull())
    return bots.select(*keys, "n", F.inline(entries)).groupBy(*keys, "dim", "key").agg(F.sum("n").alias("n"))


def breakdown_cube(
    hits: DataFrame, items: DataFrame, bots: DataFrame, sites: DataFrame, window=None,
    by_day: bool = True, cap: int | None = None, dims=None,
) -> DataFrame:
    """(site_id, [day], dim, key, currency, n, visitors, revenue_cents) of all dimensions, or
    of `dims` only: families without a wanted dimension are left out of the plan."""
    dims = set(dims or ALL_DIMS)
    keys = ["site_id", "day"] if by_day else ["site_id"]
    h, i, b = within(hits, window), within(items, window), bots
    if window is not None:
        b = b.where((F.col("day") >= day_lit(window[0])) & (F.col("day") < day_lit(window[1])))
    if by_day:
        h, i = h.withColumn("day", day_of("ts")), i.withColumn("day", day_of("ts"))
    frames = []
    if dims & set(HIT_DIMS):
        frames.append(hit_dims(h, sites, keys, dims))
    if dims & set(SESSION_DIMS):
        frames.append(session_dims(h, keys, dims))
    if dims & set(ORDER_DIMS):
        frames.append(order_dims(h, keys, dims))
    if dims & set(PRODUCT_DIMS):
        frames.append(product_dims(i, keys))
    if dims & set(BOT_DIMS):
        frames.append(robot_dims(b, keys, dims))
    cube = union_all([_long(f, keys) for f in frames])
    return cap_keys(cube, keys, cap)


def cap_keys(cube: DataFrame, keys: list[str], cap: int | None = None) -> DataFrame:
    """All keys, or at most `cap` keys per group and dimension: by revenue for order dimensions, else by
    count, ties by key. Totals (kpi, ecom, ai_total) hold a few keys and stay whole."""
    if cap is None:
        return cube
    by_money = F.col("dim").isin("ecom_source", "ecom_payment", "product")
    weight = F.when(by_money, F.coalesce("revenue_cents", F.lit(0))).otherwise(F.col("n"))
    whole = F.col("dim").isin("kpi", "ecom", "ai_total")
    listed = top_per(
        cube.where(~whole).withColumn("_w", weight), [*keys, "dim"],
        [F.desc("_w"), F.asc("key"), F.asc("currency")], cap).drop("_w")
    return cube.where(whole).unionByName(listed)


def cut_keys(cube: DataFrame, capped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dim, keys_cut, n_cut): what cap_keys() left out of each group and dimension, if anything."""
    by = [*keys, "dim"]
    left = capped.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"))
    all_of = cube.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).join(left, by, "left")
    return all_of.select(
        *by, (F.col("k") - F.coalesce("_k", F.lit(0))).alias("keys_cut"), (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n_cut")
    ).where("keys_cut > 0")


# --- storing it -------------------------------------------------------------------------

def family(dim: Column) -> Column:
    return F.when(dim.isin(*BOT_DIMS), "bot").otherwise("event")


def source_families(hits: DataFrame, bots: DataFrame, since: date | None = None, before: date | None = None) -> DataFrame:
    """(site_id, day, family) that still have raw rows."""
    h, b = hits, bots
    if before is not None:
        h = h.where(F.col("ts") < ntz(datetime(before.year, before.month, before.day)))
        b = b.where(F.col("day") < day_lit(before))
    if since is not None:
        h = h.where(F.col("ts") >= ntz(datetime(since.year, since.month, since.day)))
        b = b.where(F.col("day") >= day_lit(since))
    return h.select("site_id", day_of("ts").alias("day"), F.lit("event").alias("family")).distinct().unionByName(
        b.select("site_id", "day", F.lit("bot").alias("family")).distinct())


def source_days(hits: DataFrame, bots: DataFrame, since: date | None = None, before: date | None = None) -> DataFrame:
    return source_families(hits, bots, since, before).select("site_id", "day").distinct()


def merge_breakdowns(old: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """Replaces the dimensions of each (site, day) that has raw rows. A day whose raw rows are
    gone is not in `sources`, so it is never replaced with nothing."""
    fam = ["site_id", "day", "family"]
    kept = old.withColumn("family", family(F.col("dim"))).join(sources.select(*fam), fam, "left_anti")
    fresh = new.withColumn("family", family(F.col("dim"))).join(sources.select(*fam), fam, "left_semi")
    cols = ["site_id", "day", *COLUMNS]
    return kept.select(*cols).unionByName(fresh.select(*cols))


def backfill(
    hits: DataFrame, items: DataFrame, bots: DataFrame, sites: DataFrame, old: DataFrame, today: date,
) -> tuple[DataFrame, DataFrame]:
    """(summary row, breakdown table after recomputing every past day with raw rows). Using the
    first without the second is the dry run."""
    end = datetime(today.year, today.month, today.day)
    days = source_days(hits, bots, before=today)
    have = old.select("site_id", "day").distinct().withColumn("_have", F.lit(1))
    summary = days.join(have, ["site_id", "day"], "left").agg(
        F.count(F.lit(1)).alias("site_days"), F.count_distinct("site_id").alias("sites"),
        day_text(F.min("day")).alias("first_day"), day_text(F.max("day")).alias("last_day"),
        F.count("_have").alias("already_present"))
    past = (datetime(1970, 1, 1), end)
    cube = breakdown_cube(hits, items, bots, sites, past)
    return summary, merge_breakdowns(old, cube, source_families(hits, bots, before=today))


def retention(
    hits: DataFrame, items: DataFrame, bots: DataFrame, sites: DataFrame, rollups: DataFrame,
    breakdowns: DataFrame, as_of: datetime, days: int = 90,
) -> dict[str, DataFrame]:
    """The tables after the sweep: days about to lose raw rows are sealed and broken down
    first, then hits, product lines and robot rows before the cutoff go. On a table
    partitioned by day the last step is a partition drop. `summary` counts deleted hits and
    sealed days."""
    cut = (as_of - timedelta(days=days)).date()
    cut_ts = datetime(cut.year, cut.month, cut.day)
    old_window = (datetime(1970, 1, 1), cut_ts)
    doomed_hits = within(hits, old_window)
    event_days = doomed_hits.groupBy("site_id", day_of("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    missing = event_days.join(rollups.select("site_id", "day"), ["site_id", "day"], "left_anti")
    sealed = merge_rollups(rollups, daily_rollup(hits, missing.select("site_id", "day"), old_window))
    have = breakdowns.select("site_id", "day").distinct()
    doomed = source_days(hits, bots, before=cut)
    # A small list of days that several branches below need: computed once.
    todo = cut_lineage(doomed.join(have, ["site_id", "day"], "left_anti").unionByName(
        missing.select("site_id", "day")).distinct())
    pairs = ["site_id", "day"]
    cube = breakdown_cube(
        doomed_hits.join(
            todo.select(F.col("site_id").alias("_site"), F.col("day").alias("_day")),
            (F.col("site_id") == F.col("_site")) & (F.to_date("ts") == F.col("_day")), "left_semi"),
        within(items, old_window), bots.join(todo, pairs, "left_semi"), sites, old_window)
    cube = cube.join(todo, pairs, "left_semi")
    sources = source_families(hits, bots, before=cut).join(todo, pairs, "left_semi")
    summary = event_days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("deleted")).withColumn(
        "sealed", missing.agg(F.count(F.lit(1)).alias("sealed")).scalar())
    return {
        "hits": hits.where(F.col("ts") >= ntz(cut_ts)),
        "items": items.where(F.col("ts") >= ntz(cut_ts)),
        "bots": bots.where(F.col("day") >= day_lit(cut)),
        "rollups": sealed,
        "breakdowns": merge_breakdowns(breakdowns, cube, sources),
        "summary": summary,
    }


def recent_rollups(rollups: DataFrame, limit: int = 14) -> DataFrame:
    return top_per(
        rollups.select("site_id", "day", "pageviews", "visitors", "rollup_hash", "txid"),
        ["site_id"], [F.desc("day")], limit)


def seal_audit(rollups: DataFrame) -> DataFrame:
    """(site_id, day, rollup_hash, expected, intact): the seal recomputed from the stored totals."""
    sealed = rollups.where("rollup_hash IS NOT NULL")
    expected = seal(sealed)
    return sealed.select("site_id", "day", "rollup_hash", expected.alias("expected")).withColumn(
        "intact", F.col("rollup_hash") == F.col("expected"))
