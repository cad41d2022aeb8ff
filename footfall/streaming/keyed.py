"""Burst sweep with keyed state: what a batch costs follows its rows, not the day so far.

Two stateful operators in one query. The first, keyed by site and part of its visitors (by hash,
a few hundred of a day at a million a site), gives out each visitor's first page view (a landing)
once the watermark has passed it, and forgets the visitor when its key can no longer come. A batch
moves the state of the parts that its rows touch, as a whole. The second, keyed by site and country, holds

* the landings of the last seconds, which the window and the look-ahead of the rule need;
* the times of earlier landings in slices of a minute and the count of each slice, so that a
  baseline is a sum of about thirty counts and reads only the slices at its two ends;
* the burst that is on and the landings flagged within the look-back.

A timer judges a landing when the watermark has passed its look-ahead; the rule is the ordered
pass of the batch form. Slices and flags behind the look-back are dropped at every timer, and
the key's state is gone when its last landing is. State lies in the checkpoint, so a restarted
query goes on where the last batch ended.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from footfall.functions.timewin import micros, pageviews
from footfall.operators.bursts import RULE, S, BurstRule, _pass

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
SLICE = 60 * S
VISITOR_PARTS = 4096  # of a site: every read or write of state is a message to the JVM, so visitors share them
LANDING = "us long, id long, path string, visitor_hash string, cand boolean"
FLAGGED = "site_id long, country string, visitor_hash string, us long, id long, path string"


def use_state_store(spark: SparkSession) -> None:
    """Lists, maps and timers need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class FirstViews(StatefulProcessor):
    """Per (site, part of the visitors): each visitor's first page view, when no earlier one can come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState(
            "open", "visitor array<string>, us array<long>, id array<long>, path array<string>, country array<string>, cand array<boolean>")
        self.told = handle.getValueState("told", "visitor array<string>, until array<long>")
        self.timer = handle.getValueState("timer", "at long")

    def _open(self) -> dict[str, tuple]:
        """(us, id, path, country, cand) of the first views not given out yet."""
        held = self.open.get()
        return {} if held is None else {v: tuple(x) for v, *x in zip(*held, strict=True)}

    def _told(self) -> dict[str, int]:
        """Until when, in ms, a visitor that was given out is known."""
        held = self.told.get()
        return {} if held is None else dict(zip(*held, strict=True))

    def _keep(self, first: dict[str, tuple]) -> None:
        if first:
            self.open.update((list(first), *map(list, zip(*first.values(), strict=True))))
        else:
            self.open.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, told = self._open(), self._told()
        earliest = None
        for r in rows:
            if r.visitor_hash in told:
                continue
            now = first.get(r.visitor_hash)
            if now is None or (r.us, r.id) < now[:2]:
                first[r.visitor_hash] = (r.us, r.id, r.path, r.country, r.cand)
                earliest = r.us if earliest is None else min(earliest, r.us)
        if earliest is not None:
            self._keep(first)
            at, held = earliest // 1000 + 1, self.timer.get()
            if held is None or at < held[0]:
                if held is not None:
                    self.handle.deleteTimer(held[0])
                self.handle.registerTimer(at)
                self.timer.update((at,))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        first = self._open()
        # A visitor's key was valid for its day; rows of it are late from then on.
        told = {v: until for v, until in self._told().items() if until > mark}
        out = {v: x for v, x in first.items() if x[0] // 1000 + 1 <= mark}
        for v, x in out.items():
            del first[v]
            told[v] = (x[0] // 1000 // DAY_MS + 1) * DAY_MS
        if out:
            self._keep(first)
        if told:
            self.told.update((list(told), list(told.values())))
        else:
            self.told.clear()
        wake = min([*told.values(), *(x[0] // 1000 + 1 for x in first.values())], default=None)
        if wake is None:
            self.timer.clear()
        else:
            wake = max(wake, mark + 1)  # never the timer that is just expiring
            self.handle.registerTimer(wake)
            self.timer.update((wake,))
        # A row is as old as its view; downstream it counts as said now.
        said = pd.Timestamp(mark + 1, unit="ms", tz="UTC").to_pydatetime()
        for v, (us, i, path, country, cand) in out.items():
            yield Row(site_id=key[0], visitor_hash=v, us=us, id=i, path=path, country=country, cand=cand, said=said)

    def close(self) -> None:
        pass


class Bursts(StatefulProcessor):
    """Per (site, country): flagged landings."""

    def __init__(self, rule: BurstRule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.near = handle.getListState("near", LANDING)
        self.times = handle.getMapState("times", "slice long", "us array<long>")
        self.counts = handle.getValueState("counts", "slices array<long>, n array<long>")
        self.on = handle.getValueState("on", "active long, flag_us array<long>, flag_id array<long>, done_us long, done_id long, timer long")

    def _on(self) -> tuple:
        return tuple(self.on.get()) if self.on.exists() else (0, [], [], -1, -1, 0)

    def _wake(self, first_us: int, old: int) -> int:
        """Sets the one timer of the key to when `first_us` can be judged."""
        at = -(-(first_us + self.rule.lookahead * S) // 1000)
        if at != old:
            if old:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = sorted((r.us, r.id, r.path, r.visitor_hash, r.cand) for r in rows)
        self.near.appendList(new)
        known = dict(zip(*self.counts.get(), strict=True)) if self.counts.exists() else {}
        fresh: dict[int, list[int]] = {}
        for r in new:
            fresh.setdefault(r[0] // SLICE, []).append(r[0])
        for s, us in fresh.items():
            held = list(self.times.getValue((s,))[0]) if known.get(s) else []
            self.times.updateValue((s,), (sorted(held + us),))
            known[s] = known.get(s, 0) + len(us)
        order = sorted(known)
        self.counts.update((order, [known[s] for s in order]))
        *rest, timer = self._on()
        at = -(-(new[0][0] + self.rule.lookahead * S) // 1000)
        if not timer or at < timer:
            timer = self._wake(new[0][0], timer)
        self.on.update((*rest, timer))
        return iter(())

    def _base(self, us: int, slices: list[int], upto: list[int], held: dict[int, list[int]]) -> int:
        """Landings in [us - window - baseline, us - window)."""

        def before(t: int) -> int:
            s = t // SLICE
            i = bisect.bisect_left(slices, s)
            if i == len(slices) or slices[i] != s:
                return upto[i]
            if s not in held:
                held[s] = list(self.times.getValue((s,))[0])
            return upto[i] + bisect.bisect_left(held[s], t)

        end = us - self.rule.window * S
        return before(end) - before(end - self.rule.baseline * S)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        rule = self.rule
        back = (rule.window + rule.baseline) * S
        active, flag_us, flag_id, done_us, done_id, _ = self._on()
        done = (done_us, done_id)
        horizon = timerValues.getCurrentWatermarkInMs() * 1000 - rule.lookahead * S
        near = sorted(tuple(r) for r in self.near.get())
        slices, n = (list(x) for x in self.counts.get())
        upto = [0]
        for k in n:
            upto.append(upto[-1] + k)
        held: dict[int, list[int]] = {}
        judged = [r for r in near if done < r[:2] and r[0] <= horizon]
        cand = [r for r in near if r[4]]
        own = [done < r[:2] and r[0] <= horizon for r in cand]
        table = pd.DataFrame({
            "us": [r[0] for r in cand], "id": [r[1] for r in cand], "path": [r[2] for r in cand], "own": own,
            "base": [self._base(r[0], slices, upto, held) if o else 0 for r, o in zip(cand, own, strict=True)]})
        hit, active = _pass(table, active, list(flag_us), list(flag_id), rule, None)
        out = [cand[i] for i in hit]
        if judged:
            done = judged[-1][:2]
        waiting = [r for r in near if r[:2] > done]
        # The next to be judged looks back from its own time, which is at least the horizon.
        oldest = min(horizon, waiting[0][0]) if waiting else horizon
        gone = [s for s in slices if (s + 1) * SLICE <= oldest - back]
        if len(gone) == len(slices):
            self.times.clear()
        else:
            for s in gone:
                self.times.removeKey((s,))
        slices, n = slices[len(gone):], n[len(gone):]
        flags = [(u, i) for u, i in [*zip(flag_us, flag_id, strict=True), *((r[0], r[1]) for r in out)] if u >= oldest - back]
        keep = [r for r in near if r[:2] > done or r[0] >= oldest - rule.window * S]
        if keep:
            self.near.put(keep)
        else:
            self.near.clear()
        if not slices and not waiting:
            for state in (self.counts, self.on):
                state.clear()
        else:
            self.counts.update((slices, n))
            # Without anything to judge the key wakes once more, when its last slice is behind the look-back.
            wake = waiting[0][0] if waiting else (slices[-1] + 1) * SLICE + back
            self.on.update((active, [u for u, _ in flags], [i for _, i in flags], *done, self._wake(wake, 0)))
        for us, i, path, visitor, _ in out:
            yield Row(site_id=key[0], country=key[1], visitor_hash=visitor, us=us, id=i, path=path)

    def close(self) -> None:
        pass


def live_bursts(hits: DataFrame, late: str = "10 seconds", rule: BurstRule = RULE) -> DataFrame:
    """Stream of flagged landings (site_id, country, visitor_hash, us, id, path) of a hit stream: those
    that bursts.find_bursts(bursts.landings(...)) flags over the same rows.

    `late` is how far rows may come out of order; later ones are left out. A visitor's key is valid
    for one day. Rows of one batch and key are sorted in one task; needs use_state_store()."""
    tagged = F.lit(False)
    for c in ("utm_source", "utm_medium", "utm_campaign"):
        tagged = tagged | (F.coalesce(F.col(c), F.lit("")) != "")
    rows = pageviews(hits).select(
        "site_id", "visitor_hash", micros("ts").alias("us"), "id", "path", "country",
        ((F.col("path") != "/") & ~tagged).alias("cand"), F.col("ts").cast("timestamp").alias("at"),
        F.pmod(F.xxhash64("visitor_hash"), F.lit(VISITOR_PARTS)).alias("part")).withWatermark("at", late)
    first = rows.groupBy("site_id", "part").transformWithState(
        FirstViews(), "site_id long, visitor_hash string, us long, id long, path string, country string, cand boolean, said timestamp",
        "Append", "EventTime", eventTimeColumnName="said")
    return first.where("country <> ''").groupBy("site_id", "country").transformWithState(Bursts(rule), FLAGGED, "Append", "EventTime")
