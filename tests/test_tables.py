"""Writers, merges and maintenance on small tables."""

import ast
import hashlib
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from footfall.functions.timewin import month_window, period_window, search_days, split_window
from footfall.operators import accounts, merkle, rollup, text, upkeep
from footfall.operators.robots import merge_bot_counts
from footfall.plans.export import SiteTables, folder_names, write_export
from footfall.schema import BOT_DAILY, ROLLUPS
from footfall.sources.csv_sink import write_csv
from footfall.sources.tables import append_events, scan_hits
from footfall.workload.longterm import cube, rollups
from footfall.workload.views import Tables

SF = "/root/testdata/sf0.001"


def test_windows():
    now = datetime(2024, 1, 30, 23, 59, 59)
    assert period_window(7, now) == (datetime(2024, 1, 24), datetime(2024, 1, 31))
    assert period_window(7, now, 1) == (datetime(2024, 1, 17), datetime(2024, 1, 24))
    assert month_window("2026-01") == (datetime(2026, 1, 1), datetime(2026, 2, 1))
    assert month_window("2026-01", 1) == (datetime(2025, 12, 1), datetime(2026, 1, 1))
    assert month_window("2026-12") == (datetime(2026, 12, 1), datetime(2027, 1, 1))
    assert search_days(7, now) == (date(2024, 1, 22), date(2024, 1, 28))
    old, recent = split_window((datetime(2024, 1, 1), datetime(2024, 1, 31)), datetime(2024, 1, 20))
    assert old == (datetime(2024, 1, 1), datetime(2024, 1, 20)) and recent == (datetime(2024, 1, 20), datetime(2024, 1, 31))


def test_store_and_scan(spark, tmp_path):
    t = Tables(spark, SF)
    append_events(t.hits, t.items, str(tmp_path / "h"), str(tmp_path / "i"))
    window = (datetime(2024, 1, 10), datetime(2024, 1, 12))
    got = scan_hits(spark, str(tmp_path / "h"), window, site_id=1)
    want = t.hits.where("site_id = 1 AND ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12'")
    assert got.count() == want.count() > 0
    assert {p.name for p in (tmp_path / "h").glob("day=*")} >= {"day=2024-01-10", "day=2024-01-11"}


def test_csv_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "=SUM(A1)", 2.5, True, None), (2, 'a;"b', 3.0, False, "x")],
                               "id long, name string, share double, ok boolean, note string")
    write_csv(df.coalesce(1), str(tmp_path / "c"))
    data = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbf")
    assert data.decode("utf-8-sig").splitlines() == [
        "id;name;share;ok;note", "1;'=SUM(A1);2,5;ja;", '2;"a;""b";3;nei;x']


def test_export_has_no_visitor_key(spark, tmp_path):
    t = Tables(spark, SF)
    st = SiteTables(t.hits, t.items, t.sites, t.goals, t.funnels, rollups(t), cube(t), t.bots, t.search)
    names = write_export(st, str(tmp_path / "e"), tenant_id=1)
    assert len(names) == 25
    some = t.hits.select("visitor_hash").first()[0]
    for name in names:
        folders = {p.name for p in (tmp_path / "e" / name).glob("folder=*")}
        assert folders <= {"folder=site1.example", "folder=site2.example"}
        for f in (tmp_path / "e" / name).rglob("*.csv"):
            head = f.read_text("utf-8-sig").splitlines()[0]
            assert "visitor" not in head and "hash" not in head.replace("rollup_hash", "")
            assert some not in f.read_text()


def test_folder_names(spark):
    s = spark.createDataFrame([(1, 1, "a.no/x"), (2, 1, "A.no_x"), (3, 1, "..."), (4, 2, "a.no/x"), (5, 1, "a.no_x-2")], "id long, tenant_id long, domain string")
    got = {r.site_id: r.folder for r in folder_names(s).collect()}
    assert got[3] == "nettsted" and got[4] == "a.no_x" and len({got[i].lower() for i in (1, 2, 3, 5)}) == 4


def test_seal_is_the_published_text(spark):
    r = spark.createDataFrame([(1, date(2024, 1, 1), 4, 2, 2, 50.0)], "site_id long, day date, pageviews long, visitors long, sessions long, bounce_rate double")
    want = hashlib.sha256(b'{"bounce_rate": 50, "day": "2024-01-01", "pageviews": 4, "sessions": 2, "site_id": 1, "visitors": 2}').hexdigest()
    assert r.select(rollup.seal(r)).first()[0] == want


def test_tree_of_any_size(spark):
    def root(hashes):
        level = [hashlib.sha256(b"\0" + bytes.fromhex(h)).digest() for h in hashes]
        while len(level) > 1:
            pairs = [level[i:i + 2] for i in range(0, len(level), 2)]
            level = [hashlib.sha256(b"\1" + p[0] + p[1]).digest() if len(p) == 2 else p[0] for p in pairs]
        return level[0].hex() if level else hashlib.sha256(b"").hexdigest()

    for n in (0, 1, 2, 3, 7, 1024, 1025, 3000):
        hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        rows = [(i % 7 + 1, date.fromordinal(738000 + i // 7), h, None) for i, h in enumerate(hashes)]
        df = spark.createDataFrame(rows, "site_id long, day date, rollup_hash string, txid string")
        ordered = [r[2] for r in sorted(rows, key=lambda r: (r[0], r[1]))]
        leaves = merkle.pending_leaves(df)
        assert merkle.merkle_root(leaves).first()[0] == root(ordered), n
        if n in (7, 1025):
            p = merkle.merkle_proofs(leaves)
            assert p.where(merkle.proof_holds(F.col("rollup_hash"), F.col("proof"), F.col("root"))).count() == n
            assert p.where(merkle.proof_holds(F.reverse("rollup_hash"), F.col("proof"), F.col("root"))).count() == 0


def test_sealed_days_stay(spark):
    old = spark.createDataFrame([(1, date(2024, 1, 1), 5, 5, 5, 0.0, "h", "r", "p", "tx", None), (1, date(2024, 1, 2), 5, 5, 5, 0.0, "h", None, None, None, None)], ROLLUPS)
    new = spark.createDataFrame([(1, date(2024, 1, d), 9, 9, 9, 0.0, "n", None, None, None, None) for d in (1, 2, 3)], ROLLUPS)
    got = {r.day.day: (r.pageviews, r.txid) for r in rollup.merge_rollups(old, new).collect()}
    assert got == {1: (5, "tx"), 2: (9, None), 3: (9, None)}


def test_bot_path_cap(spark):
    day = date(2024, 1, 1)
    old = spark.createDataFrame([(1, day, "search", "Googlebot", "/a", 1)], BOT_DAILY)
    new = spark.createDataFrame([(1, day, "search", "Googlebot", p, 1) for p in ("/a", "/b", "/c", "/d")] + [(1, day, "nonsense", "x", "/p", 1)], BOT_DAILY)
    got = {(r.bot_class, r.path): r.n for r in merge_bot_counts(old, new, cap=2).collect()}
    assert got == {("search", "/a"): 2, ("search", "/b"): 1, ("search", ""): 2, ("other", ""): 1}


def test_deletion_date(spark):
    ended, now = datetime(2024, 1, 1), datetime(2024, 3, 20)
    cases = [(None, datetime(2024, 3, 27)), (datetime(2024, 1, 5), datetime(2024, 3, 25)), (datetime(2024, 3, 29), datetime(2024, 3, 30))]
    df = spark.createDataFrame([(ended, now, w, want) for w, want in cases], "e timestamp_ntz, n timestamp_ntz, w timestamp_ntz, want timestamp_ntz")
    assert df.where(accounts.deletion_date(F.col("e"), F.col("n"), F.col("w")) != F.col("want")).count() == 0


def test_masking_stored_rows_is_idempotent(spark):
    hits = spark.createDataFrame([(1, "/order/1234", "x"), (2, "/ok", "paid 424242424242")], "id long, path string, name string")
    goals = spark.createDataFrame([(1, "path", "/order/77")], "id long, match_type string, match_value string")
    funnels = spark.createDataFrame([(1, '[{"type":"path","value":"/order/9"},{"type":"event","value":"x"}]'), (2, "nope")], "id long, steps string")
    assert upkeep.mask_changes(hits, goals, funnels).count() == 4
    done = upkeep.mask_stored(hits, goals, funnels)
    assert {r.old_value for r in done["backup"].collect()} >= {"/order/1234", "/order/77"}
    assert upkeep.mask_changes(done["events"], done["goals"], done["funnels"]).count() == 0


def test_overlap_counts_inside_words(spark):
    q = spark.createDataFrame([(1, "Pris på esim? ABC esim"), (2, "zzzz")], "question_id long, question string")
    p = spark.createDataFrame([("/a", "A", "esim, eSIMkort og esimesim. Prisen er lav"), ("/b", "B", "pris"), ("/c", "C", "ingenting"), ("/d", "D", "x")],
                              "path string, title string, content string")
    assert {(r.question_id, r.path): r.score for r in text.overlap_score(q, p).collect()} == {(1, "/a"): 5, (1, "/b"): 1}
    got = [(r.question_id, r.path) for r in text.rank_pages(q, p).orderBy("question_id", "rank").collect()]
    assert got == [(1, "/a"), (1, "/b"), (1, "/c"), (2, "/a"), (2, "/b"), (2, "/c")]


def test_package_stays_declarative():
    """No driver-side row loops, RDDs, cross joins, local checkpoints or broadcast hints."""
    banned = {"collect", "toPandas", "crossJoin", "localCheckpoint", "toLocalIterator", "rdd", "broadcast"}
    for f in Path(__file__).parent.parent.joinpath("footfall").rglob("*.py"):
        if {"workload", "llm"} & set(f.parts):
            continue
        names = {n.attr for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.Attribute)}
        assert not names & banned, f


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from footfall.session import shared_dir

    def session(master, folder=None):
        conf = {"spark.checkpoint.dir": folder} if folder else {}
        return SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs:///tmp/x/")) == "hdfs:///tmp/x"
    alone = session("local[2]")
    assert shared_dir(alone) == shared_dir(alone)
