"""Live forms against their batch twins on the same rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators.sessions import sessionize
from footfall.plans.ingest import Dimensions, ingest
from footfall.schema import HITS
from footfall.sources.beacons import read_beacons
from footfall.operators.bursts import move_to_bots
from footfall.streaming.live import BurstSweep, LiveIngest, live_attempts, live_sessions
from footfall.workload.views import Tables

SF = "/root/testdata/sf0.001"
T0 = datetime(2026, 10, 27, 11, 0)


def dims(spark):
    return Dimensions(
        spark.createDataFrame([(1, "pub1")], "id long, public_id string"),
        spark.createDataFrame([(T0.date(), "salt")], "day date, salt string"),
        spark.createDataFrame([("52.0.0.0", "52.1.255.255", 16509)], "start_ip string, end_ip string, asn int"),
        spark.createDataFrame([("84.0.0.0", "84.255.255.255", "Norway", "Oslo")],
                              "start_ip string, end_ip string, country string, region string"))


def beacon(i, at, body=None, ip="84.1.2.3", ua="Mozilla/5.0 (X11; Linux x86_64) Firefox/120.0"):
    return {
        "beacon_id": i, "received_at": (T0 + timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%S.%f"),
        "body": json.dumps(body or {"s": "pub1", "n": "pageview", "p": f"/x/{i}"}), "user_agent": ua,
        "x_forwarded_for": ip, "peer_ip": "127.0.0.1"}


def write_lines(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_rate_limit_is_150_to_120_within_and_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [beacon(i, i * 0.3) for i in range(150)] + [beacon(1000 + i, i, ip="84.9.9.9") for i in range(5)]
    write_lines(src, "a.json", rows[:70])
    write_lines(src, "b.json", rows[70:])
    batch = ingest(read_beacons(spark, str(src)), dims(spark), "s")
    assert batch.hits.count() == 125
    assert [(r.reason, r.n) for r in batch.drops.collect()] == [("rate", 30)]

    live = LiveIngest(dims(spark), "s", str(tmp_path / "out"))
    stream = spark.readStream.schema(read_beacons(spark, str(src)).schema).option("maxFilesPerTrigger", 1).json(str(src))
    live.start(stream, str(tmp_path / "ck"), availableNow=True).awaitTermination(120)
    hits = spark.read.parquet(str(tmp_path / "out" / "hits"))
    assert hits.select("batch").distinct().count() == 2
    assert hits.groupBy("visitor_hash").count().select("count").orderBy("count").collect() == [(5,), (120,)]
    assert spark.read.parquet(str(tmp_path / "out" / "drops")).agg(F.sum("n")).first()[0] == 30


def test_verdicts_and_order_fields(spark):
    ua = "Mozilla/5.0 (X11; Linux x86_64) Firefox/120.0"
    good = {"s": "pub1", "n": "purchase", "p": "/order/3f2a9b1c7d4e5f60?x=1", "r": "https://www.google.no/?q=1",
            "cur": "eur", "pm": "Klarna", "it": [{"n": "A", "q": 2, "p": 150}]}
    cases = [
        (beacon(1, 0, good), None), (beacon(2, 1, {"s": "nope"}), "unknown_site"), (beacon(3, 2, ["x"]), "bad_json"),
        (beacon(4, 3, ip="52.0.0.9"), "datacenter"), (beacon(5, 4, ip="10.0.0.1"), "private"), (beacon(6, 5, ua=""), "bot"),
        (beacon(7, 6, {"s": "pub1", "wd": 1}), "agent"), (beacon(8, 7, {"s": "pub1", "wd": 0}), None),
        (beacon(9, 8, {"s": "pub1", "r": "https://www.yandex.no/"}), "bot"),
        (beacon(10, 9, {"s": "pub1", "n": "x" * 20000}), "too_large"),
        (beacon(11, 10, {"s": "pub1", "n": "buy", "rv": 500, "cur": "KR", "it": [{"n": "B", "p": 5}]}), None),
        (beacon(12, 11, {"s": "pub1", "rv": 500, "it": [{"n": "B"}]}), None),
    ]
    df = spark.createDataFrame([
        (c["beacon_id"], datetime.fromisoformat(c["received_at"]), c["body"], c["user_agent"], c["x_forwarded_for"], c["peer_ip"])
        for c, _ in cases], "beacon_id long, received_at timestamp_ntz, body string, user_agent string, x_forwarded_for string, peer_ip string"
    ).withColumn("signature_agent", F.lit(None).cast("string")).withColumn("signature_input", F.lit(None).cast("string"))
    out = ingest(df, dims(spark), "s")
    got = {r.beacon_id: r.reason for r in out.judged.collect()}
    assert got == {c["beacon_id"]: want for c, want in cases}
    h = {r.id: r for r in out.hits.collect()}
    assert (h[1].path, h[1].referrer_src, h[1].country, h[1].region, h[1].browser) == (
        "/order/:id", "www.google.no", "Norway", "Oslo", "Firefox")
    assert (h[1].revenue_cents, h[1].currency, h[1].payment_method) == (300, "EUR", "klarna")
    assert (h[11].revenue_cents, h[11].currency) == (None, None)
    assert (h[12].revenue_cents, h[12].currency, h[12].name) == (None, None, "pageview")
    assert {(r.event_id, r.name, r.qty, r.unit_price_cents) for r in out.items.collect()} == {(1, "A", 2, 150), (11, "B", 1, 0)}


def test_sessions_close_as_in_batch(spark, tmp_path):
    hits = Tables(spark, SF).hits.select(*HITS.names).where("name = 'pageview'")
    want = {tuple(r) for r in sessionize(hits, paths=True).select("visitor_hash", "views", "entry_path", "exit_path").collect()}
    src = str(tmp_path / "hits")
    hits.repartition(4).write.parquet(src)
    # A last far-off row pushes the watermark past every session.
    late = hits.orderBy("id").limit(1).withColumn("ts", F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")).withColumn(
        "visitor_hash", F.lit("end"))
    stream = spark.readStream.schema(hits.schema).parquet(src)
    q = live_sessions(stream, late="40 days").writeStream.outputMode("append").format("memory").queryName("live_s").option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    late.write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("live_s").select("visitor_hash", "views", "entry_path", "exit_path").collect()}
    assert got == want


def test_attempt_windows(spark, tmp_path):
    src = str(tmp_path / "tries")
    spark.createDataFrame(
        [(T0 + timedelta(minutes=i), "signup", "k") for i in range(8)] + [(T0, "other", "k")],
        "ts timestamp_ntz, kind string, key string").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp_ntz, kind string, key string").parquet(src)
    q = live_attempts(stream).writeStream.outputMode("update").format("memory").queryName("live_a").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("live_a").select("kind", "used", "blocked").collect()} == {
        ("signup", 8, True), ("other", 1, False)}


@pytest.mark.parametrize("cut", [20, 11])
def test_burst_sweep(spark, tmp_path, cut):
    """A wave in one or two micro-batches is flagged in full; the person next to it is not."""
    def row(i, at, path, vh, country="US", name="pageview"):
        return (i, 1, T0 + timedelta(seconds=at), name, path, country, vh)

    wave = [row(i, i * 0.45, f"/p/{i}", f"bot{i}") for i in range(20)]
    people = [row(100 + i, i, "/guide", f"human{i}", "NO") for i in range(5)]
    schema = "id long, site_id long, ts timestamp_ntz, name string, path string, country string, visitor_hash string"
    cols = ["utm_source", "utm_medium", "utm_campaign"]

    def frame(rows):
        df = spark.createDataFrame(rows, schema)
        for c in cols:
            df = df.withColumn(c, F.lit(None).cast("string"))
        return df

    s = BurstSweep(str(tmp_path / "sweep"))
    s.process(frame(wave[:cut] + people), 0)
    s.process(frame(wave[cut:] + [row(200, 20, "/guide", "human9", "NO")]), 1)
    s.process(frame([row(300, 40, "/p/3", "bot3", name="checkout_start"), row(301, 40, "/guide", "human1", "NO", "scroll")]), 2)
    flagged = spark.read.parquet(str(tmp_path / "sweep" / "flagged"))
    assert sorted(r.visitor_hash for r in flagged.collect()) == sorted(f"bot{i}" for i in range(20))
    diverted = spark.read.parquet(str(tmp_path / "sweep" / "diverted"))
    assert {r.visitor_hash for r in diverted.where("batch = 2").collect()} == {"bot3"}
    # What the stream leaves equals the batch form over all rows.
    every = frame(wave + people + [row(200, 20, "/guide", "human9", "NO"), row(300, 40, "/p/3", "bot3", name="checkout_start"),
                                   row(301, 40, "/guide", "human1", "NO", "scroll")])
    items = spark.createDataFrame([(1, 3), (2, 100)], "id long, event_id long")
    bots = spark.createDataFrame([], "site_id long, day date, bot_class string, agent string, path string, n long")
    day = T0.date()
    live = s.settle(every.limit(0), items, bots, day)
    batch = move_to_bots(every, items, bots, flagged.drop("batch", "hour"))
    for name in ("hits", "items", "bots"):
        cols = batch[name].columns
        assert sorted(map(str, live[name].select(*cols).collect())) == sorted(map(str, batch[name].collect())), name
    assert [r.n for r in live["bots"].collect()] == [21]
