"""Operators whose work must grow no faster than their rows: plans, and results beside small forms."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from datetime import date, timedelta

import numpy as np
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from footfall.llm import bpe
from footfall.operators import merkle as mk, text
from footfall.schema import ROLLUPS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sealed(spark, n):
    """n pending days, one of them twice, and days that take no part."""
    seal = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    rows = [(i % 7, date(2020, 1, 1) + timedelta(days=i // 7), 1, 1, 1, 0.0, h, None, None, None, None) for i, h in enumerate(seal)]
    return spark.createDataFrame([*rows, rows[3], (8, date(2020, 1, 1), 1, 1, 1, 0.0, seal[0], "r", "p", "tx0", None),
                                  (8, date(2020, 1, 2), 1, 1, 1, 0.0, None, None, None, None, None)], ROLLUPS)


def test_proofs_are_not_shuffled(spark):
    rollups = sealed(spark, 2500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (mk.attach_anchor(rollups, "tx1", "2024-02-01 00:00:00"), mk.merkle_proofs(mk.pending_leaves(rollups))):
            text = plan(df)
            assert 0 <= text.index("Generate") < text.index("Exchange")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_pending_day_is_anchored(spark):
    got = mk.attach_anchor(sealed(spark, 2500), "tx1", "2024-02-01 00:00:00").cache()
    # The day that comes twice is two leaves; each of its rows meets both.
    assert got.count() == 2500 - 1 + 4 + 2
    assert got.where("txid = 'tx1'").count() == 2503 and got.where("txid = 'tx1'").select("merkle_root").distinct().count() == 1
    assert mk.verify_proofs(got.where("txid = 'tx1'")).where("valid").count() == 2503
    rest = {(r.day.day, r.merkle_root, r.merkle_proof, r.txid) for r in got.where("site_id = 8").collect()}
    assert rest == {(1, "r", "p", "tx0"), (2, None, None, None)}
    leaves = mk.pending_leaves(sealed(spark, 2500))
    some = leaves.where("idx % 500 = 7").select("idx", F.lit("x").alias("more"))
    proofs = mk.merkle_proofs(leaves, some.unionByName(some))
    assert proofs.columns == ["idx", "more", "proof", "root"] and proofs.count() == 2 * some.count() == 10


def test_pages_are_dealt_out_by_their_text(spark, monkeypatch):
    q = spark.createDataFrame([(1, "quick brown foxes"), (2, "lazy dogs lazy")], "question_id long, question string")
    p = spark.createDataFrame([(f"/{i:03}", "T", "Quick brownish foxes. " * (i % 5) + "lazy " * (i % 3)) for i in range(200)] + [("/none", "T", None)],
                              "path string, title string, content string")
    want = sorted(map(tuple, text.overlap_score(q, p).collect()))
    assert len(want) == 160 + 133 and (1, "/004", 12) in {(x[1], x[0], x[2]) for x in want}
    monkeypatch.setattr(text, "PART_CHARS", 1000)
    many = text.overlap_score(q, p)
    assert sorted(map(tuple, many.collect())) == want
    chars = p.agg(F.sum(F.length("content"))).first()[0]
    # Words are counted, and what was found is scored, in as many parts as the text has thousands.
    assert plan(many).count(f", {1 + chars // 1000}), REPARTITION_BY_NUM") == 2
    assert text.overlap_score(q, p.limit(0)).count() == 0


def test_words_are_replayed_in_bounded_groups(monkeypatch):
    sizes = []
    whole = bpe.replay
    monkeypatch.setattr(bpe, "replay", lambda words, pairs: sizes.append(sum(map(len, words))) or whole(words, pairs))
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    words = [f"w{i * 7919:x}orld{i}" for i in range(40000)] + ["x" * 200_000, "end"]
    got = bpe.Encoder(ranks, public_tokenizers.PATTERN).look_up(words)
    assert len(sizes) > 2 and sorted(sizes)[-2] <= bpe.REPLAY_BYTES and len(got) == len(words)
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 1 << 30)
    assert bpe.Encoder(ranks, public_tokenizers.PATTERN).look_up(words) == got


def test_merges_of_many_ranks_are_replayed_at_once(monkeypatch):
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    pairs, rng, calls = bpe.Pairs(ranks), random.Random(4), []
    whole = bpe.Pairs.ranks
    monkeypatch.setattr(bpe.Pairs, "ranks", lambda self, keys: calls.append(len(keys)) or whole(self, keys))
    words = ["".join(rng.choice("etaoinshrdluæ") for _ in range(rng.randrange(3, 14))).encode() for _ in range(14_000)]
    words += [bytes(rng.choice(b"abcdef") for _ in range(3_000)), b"ha" * 2_000]
    tracemalloc.start()
    got = bpe.replay(words, pairs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A step for every few thousand places, not one for every rank; tokens take little beside their bytes.
    size = sum(map(len, words))
    assert 100_000 < size and len(calls) < 400 and peak < 80 * size
    for i in (0, 5, 13_999, 14_000, 14_001):
        assert bpe.replay([words[i]], pairs, 10**9) == [got[i]]
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert [np.frombuffer(b, np.int32).tolist() for b in got] == [own.encode_ordinary(w.decode()) for w in words]
