"""Scraper bursts: many new visitors of one country, each on a page of their own, in seconds.

A landing is a visitor's first page view. A landing with a country, not on "/" and without
campaign tags is a candidate. At candidate t, the candidates of the last WINDOW seconds whose
page occurs once in [t - WINDOW, t + LOOKAHEAD] are counted; a burst fires when there are at
least MIN_UNIQUE and at least RATE_FACTOR times the usual number of landings per window over
the BASELINE before it, and then stays on while the next candidate comes within EXTEND
seconds. Flagged landings leave every later count.

Only that last rule makes the order of events matter, and only after a fire. So:

* landings are cut into parts of WINDOW + BASELINE seconds per (site, country); with the part
  before and a few seconds of the part after, every count of a part can be made inside it;
* window counts in the JVM find trigger points, where a fire is possible at all if nothing was
  flagged shortly before: a busy site with its usual traffic has none;
* only parts with a trigger go to Python, each on its own, in one ordered pass;
* a part that ends with a burst on, or with flagged landings still inside the look-back, hands
  that state to the next part, which runs (again) with it. Rounds end when no state changes.

No part is larger than half an hour of one country on one site, and the result is the same as
that of one ordered pass over everything.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from footfall.functions.timewin import micros, pageviews, within
from footfall.operators.frames import union_all
from footfall.session import cut_lineage

S = 1_000_000
_EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class BurstRule:
    """Seconds and counts of the rule (fixed values by default)."""

    window: int = 15
    lookahead: int = 5
    min_unique: int = 8
    rate_factor: int = 5
    baseline: int = 30 * 60
    extend: int = 30
    grace: int = 10 * 60

    @property
    def part_us(self) -> int:
        return (self.window + self.baseline) * S


RULE = BurstRule()
KEY = ["site_id", "country", "part"]
_OUT = (
    "kind string, site_id long, country string, part long, us long, id long, visitor_hash string, "
    "path string, active long, flag_us array<long>, flag_id array<long>, digest string"
)


def landings(hits: DataFrame) -> DataFrame:
    """(site_id, visitor_hash, us, id, path, country, tagged): the first page view of each
    visitor over all time, as a partial minimum."""
    tagged = F.lit(False)
    for c in ("utm_source", "utm_medium", "utm_campaign"):
        tagged = tagged | (F.coalesce(F.col(c), F.lit("")) != "")
    rows = pageviews(hits).select("site_id", "visitor_hash", F.struct(
        micros("ts").alias("us"), "id", "path", "country", tagged.alias("tagged")).alias("first"))
    return rows.groupBy("site_id", "visitor_hash").agg(F.min("first").alias("first")).select(
        "site_id", "visitor_hash", "first.*")


def candidates(found: DataFrame) -> DataFrame:
    return found.where("country <> '' AND path <> '/' AND NOT tagged")


def _features(found: DataFrame, rule: BurstRule, window=None) -> DataFrame:
    """Candidate rows per part with `base` (landings in the baseline before) and `trigger`."""
    rows = found.where("country <> ''").withColumn("cand", (F.col("path") != "/") & ~F.col("tagged"))
    if window is not None:
        lo, hi = (F.lit(int((t - _EPOCH).total_seconds() * S)) for t in window)
        rows = rows.withColumn("cand", F.col("cand") & (F.col("us") >= lo) & (F.col("us") < hi))
    size = rule.part_us
    home = F.floor(F.col("us") / size)
    early = F.col("us") - home * size <= rule.lookahead * S
    spread = rows.withColumn("home", home).withColumn("part", F.explode(F.array_compact(F.array(
        home, home + 1, F.when(early, home - 1)))))
    w = Window.partitionBy(*KEY).orderBy("us")
    base = F.count(F.lit(1)).over(w.rangeBetween(-(rule.window + rule.baseline) * S, -rule.window * S - 1))
    near = F.count(F.when(F.col("cand"), 1)).over(w.rangeBetween(-rule.window * S, 0))
    own = F.col("home") == F.col("part")
    need = F.greatest(
        F.lit(float(rule.min_unique)), F.col("base") * (rule.rate_factor * rule.window / rule.baseline))
    f = spread.withColumn("base", base).withColumn("near", near).where("cand").withColumn("own", own)
    # Of the part before, only the last window matters to the pass.
    tail = F.col("own") | (F.col("home") > F.col("part")) | (
        F.col("us") >= F.col("part") * size - rule.window * S)
    return f.withColumn("trigger", own & (F.col("near") >= need)).where(tail).select(
        *KEY, "us", "id", "visitor_hash", "path", "base", "own", "trigger")


def _pass(rows: pd.DataFrame, active: int, flag_us: list, flag_id: list, rule: BurstRule, horizon):
    """One ordered pass over a part; sliding counts, so the work is linear in its rows."""
    us, ids = rows["us"].tolist(), rows["id"].tolist()
    paths, base, own = rows["path"].tolist(), rows["base"].tolist(), rows["own"].tolist()
    w, a = rule.window * S, rule.lookahead * S
    done = set(flag_id)
    flagged_at = sorted(flag_us)
    seen: Counter = Counter()
    pool: Counter = Counter()
    in_seen, in_pool = [False] * len(us), [False] * len(us)
    lone = 0
    lo = mid = hi = 0
    out = []

    def bump(i: int, counts: Counter, marks: list, by: int) -> None:
        nonlocal lone
        p = paths[i]
        lone -= seen[p] == 1 and pool[p] == 1
        counts[p] += by
        marks[i] = by > 0
        lone += seen[p] == 1 and pool[p] == 1

    def drop(i: int) -> None:
        if in_pool[i]:
            bump(i, pool, in_pool, -1)
        if in_seen[i]:
            bump(i, seen, in_seen, -1)

    def flag(i: int) -> None:
        done.add(ids[i])
        bisect.insort(flagged_at, us[i])
        drop(i)
        out.append(i)

    for i, t in enumerate(us):
        if not own[i] or ids[i] in done or (horizon is not None and t > horizon):
            continue
        if active >= t:
            flag(i)
            active = t + rule.extend * S
            continue
        while hi < len(us) and us[hi] <= t + a:
            if ids[hi] not in done:
                bump(hi, seen, in_seen, 1)
            hi += 1
        while mid < len(us) and us[mid] <= t:
            if ids[mid] not in done:
                bump(mid, pool, in_pool, 1)
            mid += 1
        while us[lo] < t - w:
            drop(lo)
            lo += 1
        if lone < rule.min_unique:
            continue
        before = bisect.bisect_left(flagged_at, t - w)
        gone = before - bisect.bisect_left(flagged_at, t - w - rule.baseline * S)
        usual = (base[i] - gone) * rule.window / rule.baseline
        if lone < rule.rate_factor * usual:
            continue
        for j in [j for j in range(lo, mid) if in_pool[j] and seen[paths[j]] == 1]:
            flag(j)
        active = t + rule.extend * S
    return out, active


def _digest(active: int, us: list, ids: list) -> str:
    if not active and not ids:
        return ""
    return hashlib.sha1(repr((active, sorted(zip(us, ids)))).encode()).hexdigest()


def _run_part(rule: BurstRule, horizon):
    def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        s = state.iloc[0]
        active, f_us, f_id = int(s["active"]), list(s["flag_us"]), list(s["flag_id"])
        rows = rows.sort_values(["us", "id"], kind="stable").reset_index(drop=True)
        hit, active_out = _pass(rows, active, f_us, f_id, rule, horizon)
        got = rows.iloc[hit]
        end = (int(s["part"]) + 1) * rule.part_us
        all_us, all_id = f_us + got["us"].tolist(), f_id + got["id"].tolist()
        keep = [(u, i) for u, i in zip(all_us, all_id) if u >= end - rule.part_us]
        last_on = active_out
        active_out = active_out if active_out >= end else 0
        k_us, k_id = [u for u, _ in keep], [i for _, i in keep]
        site, country, part = int(s["site_id"]), s["country"], int(s["part"])
        recs = [
            ("flag", site, country, part, int(r.us), int(r.id), r.visitor_hash, r.path, 0, [], [], "")
            for r in got.itertuples()
        ]
        recs.append(("run", site, country, part, 0, 0, "", "", last_on, [], [], s["digest"]))
        recs.append(("next", site, country, part + 1, 0, 0, "", "", active_out, k_us, k_id,
                     _digest(active_out, k_us, k_id)))
        return pd.DataFrame(recs, columns=[c.split()[0] for c in _OUT.split(", ")])

    return run


def find_bursts(
    found: DataFrame, rule: BurstRule = RULE, window=None, horizon: int | None = None
) -> DataFrame:
    """(site_id, country, visitor_hash, us, id, path) of the landings that belong to a burst.

    `window` limits which landings are judged (the baseline always counts all of them);
    `horizon` (microseconds) leaves later landings as look-ahead only."""
    return burst_pass(found, rule, window, horizon)[0]


def burst_pass(
    found: DataFrame, rule: BurstRule = RULE, window=None, horizon: int | None = None, carry: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """find_bursts and the bursts still on: (flagged landings, (site_id, country, active)).
    `carry` is the second result of an earlier pass; it needs `window`, where it takes effect."""
    spark = found.sparkSession
    feats = cut_lineage(_features(found, rule, window))
    none = F.array().cast("array<long>")
    pending = feats.where("trigger").select(*KEY).distinct().select(
        *KEY, F.lit(0).cast("long").alias("active"), none.alias("flag_us"), none.alias("flag_id"),
        F.lit("").alias("digest"))
    if carry is not None:
        start = int((window[0] - _EPOCH).total_seconds() * S)
        on = carry.where(F.col("active") >= start).select(
            "site_id", "country", F.lit(start // rule.part_us).alias("part"), F.col("active").alias("_on"))
        pending = pending.join(on, KEY, "full_outer").select(
            *KEY, F.coalesce("_on", "active").alias("active"), none.alias("flag_us"), none.alias("flag_id"),
            F.when(F.col("_on").isNotNull(), "carried").otherwise("").alias("digest"))
    # A part without candidates flags nothing, and no state outlives it.
    judged = feats.where("own").select(*KEY).distinct()
    pending = pending.join(judged, KEY, "left_semi")
    rounds: list[DataFrame] = []
    last_in = None
    while True:
        pending = cut_lineage(pending)
        if pending.isEmpty():
            break
        # A fixed number of tasks: the groups are small in bytes but not in work, so they must
        # not be coalesced by size.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = feats.join(pending.select(*KEY), KEY, "left_semi").repartition(tasks, *KEY)
        # Fresh column identities: both sides stem from the same feature table.
        state = pending.select(*[F.col(c).alias(c) for c in pending.columns]).repartition(tasks, *KEY)
        out = cut_lineage(rows.groupBy(*KEY).cogroup(state.groupBy(*KEY)).applyInPandas(
            _run_part(rule, horizon), _OUT))
        rounds.append(out.withColumn("round", F.lit(len(rounds))))
        ran = out.where("kind = 'run'").select(*KEY, F.col("digest").alias("used"))
        # The state each part last ran with; a part that never ran counts as run with none.
        last_in = ran if last_in is None else ran.unionByName(last_in.join(ran, KEY, "left_anti"))
        last_in = cut_lineage(last_in)
        pending = out.where("kind = 'next'").join(last_in, KEY, "left").where(
            F.col("digest") != F.coalesce("used", F.lit(""))
        ).select(*KEY, "active", "flag_us", "flag_id", "digest").join(judged, KEY, "left_semi")
    cols = ["site_id", "country", "visitor_hash", "us", "id", "path"]
    if not rounds:
        return (
            spark.createDataFrame([], "site_id long, country string, visitor_hash string, us long, id long, path string"),
            spark.createDataFrame([], "site_id long, country string, active long"))
    everything = union_all(rounds)
    latest = everything.where("kind = 'run'").groupBy(*KEY).agg(F.max("round").alias("round"))
    final = everything.join(latest, KEY + ["round"], "left_semi")
    still = final.where("kind = 'run' AND active > 0").groupBy("site_id", "country").agg(F.max("active").alias("active"))
    return final.where("kind = 'flag'").select(*cols), still


def burst_spans(flagged: DataFrame, rule: BurstRule = RULE) -> DataFrame:
    """Per site the time range whose events go along: first landing to last + grace."""
    return flagged.groupBy("site_id").agg(
        F.min("us").alias("from_us"), (F.max("us") + rule.grace * S).alias("to_us"))


def members(hits: DataFrame, flagged: DataFrame, rule: BurstRule = RULE) -> tuple[DataFrame, DataFrame]:
    """(hits of flagged visitors inside the site's span, the other hits)."""
    who = flagged.select("site_id", "visitor_hash").distinct().join(burst_spans(flagged, rule), "site_id")
    h, f = hits.alias("h"), who.alias("f")
    us = micros(F.col("h.ts"))
    cond = (
        (F.col("h.site_id") == F.col("f.site_id")) & (F.col("h.visitor_hash") == F.col("f.visitor_hash"))
        & us.between(F.col("f.from_us"), F.col("f.to_us")))
    return h.join(f, cond, "left_semi"), h.join(f, cond, "left_anti")


def move_to_bots(
    hits: DataFrame, items: DataFrame, bots: DataFrame, flagged: DataFrame, rule: BurstRule = RULE
) -> dict[str, DataFrame]:
    """Tables after moving the flagged visitors' events to the robot count. A second run finds
    nothing left to move."""
    moved, rest = members(hits, flagged, rule)
    added = moved.groupBy("site_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).select(
        "site_id", "day", F.lit("script").alias("bot_class"), F.lit("burst").alias("agent"),
        F.lit("").alias("path"), "n")
    key = ["site_id", "day", "bot_class", "agent", "path"]
    return {
        "hits": rest,
        "items": items.join(moved.select(F.col("id").alias("event_id")), "event_id", "left_anti"),
        "bots": bots.select(*key, "n").unionByName(added).groupBy(*key).agg(F.sum("n").alias("n")),
        "touched": added.select("site_id", "day").distinct(),
    }


def burst_report(hits: DataFrame, flagged: DataFrame, rule: BurstRule = RULE) -> DataFrame:
    """(site_id, events, visitors, paths, countries, first_us, last_us) per site."""
    moved, _ = members(hits, flagged, rule)
    n = moved.groupBy("site_id").agg(F.count(F.lit(1)).alias("events"))
    per = flagged.groupBy("site_id").agg(
        F.count_distinct("visitor_hash").alias("visitors"), F.count_distinct("path").alias("paths"),
        F.array_join(F.sort_array(F.collect_set("country")), "/").alias("countries"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return per.join(n, "site_id")


def burst_backfill(
    hits: DataFrame, items: DataFrame, bots: DataFrame, rollups: DataFrame, window=None, rule: BurstRule = RULE
) -> dict[str, DataFrame]:
    """The rule over any time range of all sites: report, moved tables, and rollups of the
    touched days recomputed (anchored days stay). Using only `report` is the dry run."""
    from footfall.operators.rollup import daily_rollup, merge_rollups

    near = hits
    if window is not None:  # visitor keys live one day, and no burst reaches further
        first, end = (datetime(t.year, t.month, t.day) for t in window)
        near = within(hits, (first - timedelta(days=1), end + timedelta(days=2)))
    flagged = find_bursts(landings(near), rule, window)
    out = move_to_bots(hits, items, bots, flagged, rule)
    touched = cut_lineage(out.pop("touched"))
    days = touched.select(F.col("site_id").alias("_site"), F.col("day").alias("_day"))
    redo = out["hits"].join(
        days, (F.col("site_id") == F.col("_site")) & (F.to_date("ts") == F.col("_day")), "left_semi")
    out["rollups"] = merge_rollups(rollups, daily_rollup(redo, touched))
    out["report"] = burst_report(hits, flagged, rule)
    out["flagged"] = flagged
    return out
