"""Vector search, chat formatting, WARC packages on small fixtures."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import ann, chat, pivots, warczip
from footfall.llm.blocks import finite

# Vectors


def vectors(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"vec_id long, v array<{kind}>")


def brute(rows, asked, k):
    out = {}
    for i, q in asked:
        near = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in rows if j != i)[:k]
        out[i] = [(j, -s) for s, j in near]
    return out


def answers(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("spread", [1, 3, 60])
def test_exact_top_k_with_many_ties_and_copies(spark, spread):
    rng = random.Random(spread)
    rows = [(i, [rng.randint(-spread, spread) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [spread] * 6) for i in range(60)] + [(2000, [0] * 6)]
    rng.shuffle(rows)
    asked = [r for r in rows if r[0] % 20 == 0]
    frame = vectors(spark, rows + [(None, [1] * 6)])
    got = answers(pivots.exact_top_k(frame, vectors(spark, asked)))
    assert got == brute(rows, asked, 20)


@pytest.mark.parametrize("cells", [False, True])
def test_blocks_smaller_than_the_input_change_nothing(spark, monkeypatch, cells):
    from footfall.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK", 7)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 3)
    monkeypatch.setattr(blocks, "GROUP", 2)
    monkeypatch.setattr(blocks, "CHUNK", 2)
    monkeypatch.setattr(blocks, "CELLS", 4 if cells else 1 / 1000)
    rng = random.Random(4)
    rows = [(i, [rng.randint(-9, 9) for _ in range(4)]) for i in range(90)]
    asked = [r for r in rows if r[0] % 5 == 0]
    assert answers(pivots.exact_top_k(vectors(spark, rows), vectors(spark, asked), 6)) == brute(rows, asked, 6)


@pytest.mark.parametrize("recall", [0.5, 0.95])
def test_the_margin_holds_the_share_of_neighbours_it_is_asked_for(recall):
    rng = np.random.default_rng(3)
    own = np.repeat(rng.integers(60, 110, 50), 20)
    apart = own - rng.integers(0, 40, 1000)
    more = ann.margin(apart, own, recall)
    assert (apart <= own + more).mean() >= recall and (apart <= own + more - 1).mean() < recall


def test_few_or_no_vectors(spark):
    rows = [(i, [i, 1]) for i in range(5)]
    got = answers(pivots.exact_top_k(vectors(spark, rows), vectors(spark, rows[:1])))
    assert got == brute(rows, rows[:1], 20)
    none = vectors(spark, [])
    assert pivots.exact_top_k(none, none).count() == 0
    assert pivots.exact_top_k(vectors(spark, rows), none).count() == 0
    assert ann.nearest(vectors(spark, [], "float"), vectors(spark, [], "float")).count() == 0
    real = vectors(spark, [(i, [float(i), 1.0]) for i in range(5)], "double")
    assert answers(ann.nearest(real, real.where("vec_id = 2"))) == {2: [(4, 9.0), (3, 7.0), (1, 3.0), (0, 1.0)]}


def test_bad_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("-inf"), 1.0]), (5, [0.0, 0.0]), (6, [2.0, 0.0])]
    frame = vectors(spark, rows, "float")
    assert sorted(r.vec_id for r in frame.where(finite(F.col("v"))).collect()) == [0, 5, 6]
    assert answers(ann.nearest(frame, frame)) == {0: [(6, 2.0)], 6: [(0, 2.0)]}
    q = frame.where(finite(F.col("v"))).select("vec_id", pivots.quantised(F.col("v")).alias("v"))
    assert answers(pivots.exact_top_k(q, q.where("vec_id = 6"))) == {6: [(0, 64 * 128), (5, 0)]}


def test_pigeonhole_misses_no_code_within_the_radius():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 256, (700, 8)).astype(np.uint8)
    asked = codes[:40] ^ np.packbits(rng.random((40, 64)) < 0.15, axis=1)
    for radius in (0, 1, 5, 7, 8, 20, 31, 64):
        assert (ann.thresholds(radius, 8) + 1).sum() == min(radius + 1, 72)
        hits = np.unpackbits(ann.probe(asked, np.full(40, radius), ann.buckets(codes)), axis=1, count=700).astype(bool)
        near = ann.hamming(ann.words(asked), ann.words(codes)) <= radius
        assert not (near & ~hits).any()
    near = ann.hamming(ann.words(asked), ann.words(codes))
    assert near[3, 5] == sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(asked[3], codes[5]))


@pytest.mark.parametrize("lengths", [False, True])
def test_recall_of_multi_index_hashing(spark, lengths):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 32))
    x = centres[rng.integers(0, 10, 6000)] + rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths:  # the largest inner product is not the smallest angle
        x *= rng.uniform(0.5, 1.5, (6000, 1))
    x = np.concatenate([x, np.repeat(x[:1], 1500, 0)])  # a hot group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = vectors(spark, rows, "double")
    got = answers(ann.nearest(frame, frame.where("vec_id % 50 = 0")))
    hit = 0
    for i in range(0, len(x), 50):
        s = x @ x[i]
        s[i] = -np.inf
        near = np.lexsort((np.arange(len(x)), -s))[:20]
        assert len(got[i]) == 20 and all(abs(s[j] - v) < 1e-9 for j, v in got[i])
        hit += sum(v >= s[near[-1]] - 1e-9 for _, v in got[i])
    assert hit / 20 / len(range(0, len(x), 50)) >= 0.9


# Chat


PART_FIELDS = ("kind", "text", "ref", "width", "height", "seconds", "pages")


def part(kind, **more):
    return tuple(more.get(f) if f != "kind" else kind for f in PART_FIELDS)


def turns(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string")


def test_parts_become_ordered_placeholders(spark):
    rows = [
        (1, 0, "user", [part("text", text="look "), part("image", ref="a.png", width=56, height=29), part("text", text=" and "),
                        part("audio", ref="b.wav", seconds=1.5), part(None, text="<|image|>")], "x"),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("video", ref="d"), part("image", ref="e")], "x"),
    ]
    r = chat.format_chat(turns(spark, rows)).collect()[0]
    assert r.formatted == (
        "<|im_start|>user\nlook <|image|> and <|audio|><\\|image|><|im_end|>\n"
        "<|im_start|>assistant\n<|document|><|attachment|><|image|><|im_end|>\n")
    assert [(a.turn_place, a.part_place, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (1, 1, "image", "a.png", 4), (1, 3, "audio", "b.wav", 38), (2, 0, "document", "c.pdf", 1536), (2, 1, "video", "d", 1), (2, 2, "image", "e", 1)]
    assert r.expanded_tokens == 4 + 38 + 1536 + 2
    assert [r.formatted[s.start:s.start + s.length] for s in r.loss_spans] == ["<|document|><|attachment|><|image|>"]


def test_any_text_and_role_is_read_back(spark):
    rng = random.Random(6)
    pieces = ["<", "|", "\\", "im_start", "im_end", "|>", "<|im_end|>\n", "<\\|", "\n", "é🙂", " ", "user", "%0A"]
    rows, want = [], {}
    for conv in range(150):
        for turn in range(rng.randrange(1, 5)):
            role = rng.choice(["user", "assistant", None, "", "a\nb<|%", "assistant"])
            text = rng.choice([None, "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))])
            rows.append((conv, turn, role, text))
            want.setdefault(conv, []).append((role or "", text or ""))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(
        "conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    made = chat.format_chat(frame).withColumn("turns", chat.read_chat(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    for r in made.collect():
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")


def test_control_strings_split_over_parts(spark):
    rng = random.Random(8)
    pieces = ["<", "|", "\\", "im_end|>", "|im_end|>", "<|im_", "\0", "\0t", "\0i", "x"]
    rows, want = [(0, 0, "user", [part("text", text="<"), part("text", text="|im_end|>x")], None)], {0: "<|im_end|>x"}
    for conv in range(1, 200):
        texts = [rng.choice([None, "".join(rng.choice(pieces) for _ in range(rng.randrange(3)))]) for _ in range(rng.randrange(5))]
        rows.append((conv, 0, "assistant", [part(rng.choice(["text", None]), text=t) for t in texts], None))
        want[conv] = "".join(t or "" for t in texts)
    made = chat.format_chat(turns(spark, rows)).withColumn("turns", chat.read_chat(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    for r in made.collect():
        assert [t.text for t in r.turns] == [want[r.conv_id]]
        assert r.formatted.count(chat.END) == 1 and r.loss == ("" if r.conv_id == 0 else want[r.conv_id])
    mixed = [(1, 0, "user", [part("text", text="\0i<"), part("image"), part("text", text="|im_end|>\0")], None)]
    assert chat.format_chat(turns(spark, mixed)).first().formatted == "<|im_start|>user\n\0i<<|image|>|im_end|>\0<|im_end|>\n"


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (3, 1, "user", [part("text", text="b")], "z"), (3, 1, "user", [part("text", text="a")], "z"),
            (3, 1, "user", [part("text", text="a")], "z"), (3, None, "system", [], "z")]
    got = {r.conv_id: r for r in chat.format_chat(turns(spark, rows)).collect()}
    assert got[None].formatted == "<|im_start|>\n<|im_end|>\n" and got[None].n_turns == 1
    body = [x.split("\n")[1].removesuffix("<|im_end|>") for x in got[3].formatted.split("<|im_start|>")[1:]]
    assert body == ["", "a", "a", "b"] and got[3].loss_spans == []
    assert chat.format_chat(turns(spark, [])).count() == 0


# WARC packages


def package(zip64, blobs):
    out = io.BytesIO()
    z = warczip.StoredZip(out, zip64)
    for name, parts in blobs.items():
        z.begin(name)
        for p in parts:
            z.write(p)
        z.end()
    z.close()
    return out.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files_and_members_are_found(zip64):
    blobs = {"archive/data.warc.gz": [b"abc", b"", b"defg"], "indexes/é.cdxj": [b"x" * 70000], "empty": []}
    raw = package(zip64, blobs)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:  # another reader agrees
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: b"".join(p) for n, p in blobs.items()}
    got = warczip.members(lambda at, n: raw[at:at + n], len(raw))
    assert {n: raw[a:a + k] for n, (a, k) in got.items()} == {n: b"".join(p) for n, p in blobs.items()}


def test_foreign_zip_files(tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("stored"), b"here")
        z.writestr(zipfile.ZipInfo("packed"), b"there" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK note"
    raw = out.getvalue()
    got = warczip.members(lambda at, n: raw[at:at + n], len(raw))
    assert list(got) == ["stored"] and raw[got["stored"][0]:][:4] == b"here"
    for bad in (b"", b"not a zip", raw[:-30]):
        with pytest.raises(ValueError):
            warczip.members(lambda at, n, bad=bad: bad[at:at + n], len(bad))


def test_records_read_back_and_damage_is_told():
    raw = warczip.make_record(5, "http://a/\r\nWARC-Type: x", "é\r\n\r\n".encode(), None)
    r = warczip.parse_record(raw)
    assert (r["page_id"], r["record_type"], r["payload"], r["url"]) == (5, "response", "é\r\n\r\n".encode(), "http://a/%0D%0AWARC-Type: x")
    r = warczip.parse_record(warczip.make_record(None, None, b"abc", (9,)))
    assert (r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload"], r["payload_bytes"]) == (None, None, "revisit", 9, None, 3)
    assert r["payload_digest"] == "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"
    for bad in (raw[:-3], raw[4:], b""):
        with pytest.raises(ValueError):
            warczip.parse_record(bad)


@pytest.mark.parametrize("zip64,size", [(False, 1 << 20), (True, 300)])
def test_pages_through_packages(spark, tmp_path, zip64, size):
    rows = [(i, f"http://h/{i}", f"page {i % 7}" * 50) for i in range(60)] + [
        (100, None, None), (101, "u", ""), (None, "n", "lonely"), (None, "n", "page 1" * 50), (7, "again", "page 0" * 50), (103, "b c\n", "🙂" * 20000)]
    pages = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, payload long, _n string")
    listed = warczip.write_packages(
        warczip.mark_revisits(pages, F.col("html")), f"{tmp_path}/out", zip64, size)
    back = warczip.read_packages(listed, range_bytes=2000).collect()
    assert len(back) == len(rows) == listed.agg(F.sum("records")).first()[0]
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = sorted(((i, h or "", None if i == last.get(h or "") else last.get(h or "")) for i, _, h in rows), key=repr)
    full = {warczip.sha1_base32((h or "").encode()): h or "" for _, _, h in rows}
    got = sorted(((r.page_id, full[r.payload_digest], r.refers_to) for r in back), key=repr)
    assert got == want
    for r in back:
        h = full[r.payload_digest].encode()
        assert r.payload_bytes == len(h) and (bytes(r.payload) == h if r.record_type == "response" else r.payload is None)
    small = warczip.mark_revisits(pages, F.col("html"), 10**6)
    assert small.where("_first IS NOT NULL").count() == 0
    none = warczip.write_packages(warczip.mark_revisits(pages.limit(0), F.col("html")), f"{tmp_path}/none")
    assert none.count() == 0 and warczip.read_packages(none).count() == 0
