"""Burst sweep with keyed state against the batch form, with restarts and rows out of order."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import Row, functions as F

from footfall.operators.bursts import find_bursts, landings
from footfall.streaming.keyed import DAY_MS, FirstViews, live_bursts, use_state_store

T0 = datetime(2026, 10, 27, 11, 0)
SCHEMA = ("id long, site_id long, ts timestamp_ntz, name string, path string, country string, visitor_hash string, "
          "utm_source string, utm_medium string, utm_campaign string")


def traffic(seed):
    """Waves of one-page visitors, steady traffic in the same country, shared pages, second views."""
    rng, rows = random.Random(seed), []

    def add(at, path, visitor, country="US", name="pageview", site=1, tag=None):
        rows.append((len(rows), site, T0 + timedelta(seconds=at), name, path, country, visitor, tag, None, None))

    for w in range(8):
        at, step = 200 + w * 330, rng.choice([0.3, 0.9, 1.6, 2.5])
        for i in range(rng.choice([7, 9, 25, 40])):
            add(at + i * step, f"/p/{w}/{i if rng.random() < 0.9 else 0}", f"bot{w}-{i}", rng.choice(["US", "US", "US", "NO"]), site=1 + w % 2)
            if rng.random() < 0.3:
                add(at + i * step + 2, "/p/again", f"bot{w}-{i}", "US", site=1 + w % 2)
    for i in range(250):
        add(rng.uniform(0, 3000), rng.choice(["/", "/guide", f"/deep/{i}"]), f"human{i}", rng.choice(["US", "NO", ""]), tag=rng.choice([None, "mail"]))
        add(rng.uniform(0, 3000), "/guide", f"human{i}", "US", rng.choice(["pageview", "scroll"]))
    return rows


def run(spark, src, out, ck):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    live_bursts(stream, "40 seconds").writeStream.format("parquet").option("path", str(out)).option(
        "checkpointLocation", str(ck)).trigger(availableNow=True).start().awaitTermination(400)


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    use_state_store(spark)
    rows = sorted(traffic(5), key=lambda r: r[2])
    # Rows come up to 30 seconds out of order, in batches of their own files.
    rng = random.Random(6)
    moved = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=rng.uniform(0, 30))))
    want = {(r.site_id, r.country, r.visitor_hash, r.id) for r in find_bursts(landings(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert 30 < len(want)
    end = [(10**6, 9, T0 + timedelta(days=2), "scroll", "/", "", "end", None, None, None), (10**6 + 1, 9, T0 + timedelta(days=2), "pageview", "/", "", "end", None, None, None)]
    parts = [moved[i * len(moved) // 6:(i + 1) * len(moved) // 6] for i in range(6)] + [end]
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        if i % 3 == 2 or i == len(parts) - 1:  # the query is started anew and goes on from its checkpoint
            run(spark, src, out, ck)
    got = [(r.site_id, r.country, r.visitor_hash, r.id) for r in spark.read.parquet(str(out)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


class Memory:
    """State and timers of one key; `sent` counts what would be messages to the JVM."""

    def __init__(self):
        self.sent, self.timers, self.values = 0, set(), {}

    def getValueState(self, name, schema):
        def count(f):
            def run(*a):
                self.sent += 1
                return f(*a)
            return run

        values = self.values
        return SimpleNamespace(get=count(lambda: values.get(name)), update=count(lambda v: values.__setitem__(name, v)),
                               exists=count(lambda: name in values), clear=count(lambda: values.pop(name, None)))

    def registerTimer(self, at):
        self.sent += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.sent += 1
        self.timers.remove(at)


def test_visitors_of_a_part_share_their_state():
    now, memory = 1_790_000_000_000_000 // (DAY_MS * 1000) * DAY_MS * 1000, Memory()
    views = FirstViews()
    views.init(memory)

    def give(*rows):
        assert list(views.handleInputRows((1, 7), (Row(visitor_hash=v, us=us, id=i, path=f"/{i}", country=None, cand=True) for v, us, i in rows), None)) == []

    def pass_to(ms):
        out, mark = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
        for at in sorted(t for t in memory.timers if t <= ms):
            out += views.handleExpiredTimer((1, 7), mark, at)
            memory.timers.remove(at)
        return sorted((r.visitor_hash, r.us - now, r.id) for r in out)

    give(*[(f"v{i % 300}", now + 5000 * (900 - i), i) for i in range(900)], ("last", now + DAY_MS * 1000 - 1, 1000))
    give(("v0", now + 1_000, 901), ("v1", now + 60_000_000, 902))
    assert pass_to(now // 1000) == []
    want = sorted([(f"v{i}", 5000 * (300 - i), 600 + i) for i in range(1, 300)] + [("v0", 1000, 901)])
    assert pass_to(now // 1000 + 2000) == want and memory.sent < 30
    give(("v5", now + 3_000_000, 903), ("new", now + 3_000_000, 904))
    assert pass_to(now // 1000 + 4000) == [("new", 3_000_000, 904)]
    # The last view of the day is given out when its key is forgotten; the part goes on.
    assert pass_to(now // 1000 + DAY_MS) == [("last", DAY_MS * 1000 - 1, 1000)] and len(memory.timers) == 1
    give(("v5", now + DAY_MS * 1000 + 2_000_000, 905))
    assert pass_to(now // 1000 + DAY_MS + 3000) == [("v5", DAY_MS * 1000 + 2_000_000, 905)]
    assert pass_to(now // 1000 + 2 * DAY_MS) == [] and not memory.values and not memory.timers
