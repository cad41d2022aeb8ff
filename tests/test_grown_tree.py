"""A stored inclusion tree that grows, against the tree made at once."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from footfall.operators import merkle as mk


def leaves(spark, first, end):
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(first, end)]
    return spark.createDataFrame(rows, "idx long, rollup_hash string")


@pytest.mark.parametrize("sizes", [(1, 5, 1024, 1025, 3000), (1023, 2048, 2049)])
def test_growth_equals_the_tree_made_at_once(spark, sizes):
    tree, had = spark.createDataFrame([], mk.TREE), 0
    assert mk.tree_root(tree).first().root == hashlib.sha256(b"").hexdigest()
    for n in sizes:
        more = mk.grown(tree, leaves(spark, had, n)).cache()
        # Old blocks that no new leaf falls into are not written again.
        assert more.where("round = 0").count() == ((n - 1) >> mk.BITS) - (had >> mk.BITS) + 1
        assert more.where("round > 0").count() == (1 if n > 1 << mk.BITS else 0)
        tree, had = spark.createDataFrame(mk.with_blocks(tree, more).collect(), mk.TREE), n
        whole = leaves(spark, 0, n)
        assert mk.tree_root(tree).first().root == mk.merkle_root(whole).first().root
    some = whole.where((F.col("idx") % 211 == 0) | (F.col("idx") == n - 1)).select("idx", F.lit("x").alias("more"))
    got = {r.idx: r.proof for r in mk.tree_proofs(tree, some).collect()}
    want = {r.idx: r.proof for r in mk.merkle_proofs(whole).collect() if r.idx in got}
    assert got == want and len(got) == some.count()


def test_no_new_leaves_and_replaced_ones(spark):
    tree = spark.createDataFrame(mk.grown(spark.createDataFrame([], mk.TREE), leaves(spark, 0, 1500)).collect(), mk.TREE)
    assert mk.grown(tree, leaves(spark, 0, 0)).count() == 0
    assert mk.tree_proofs(spark.createDataFrame([], mk.TREE), leaves(spark, 0, 3)).count() == 0
    assert mk.tree_proofs(tree, leaves(spark, 1500, 1502)).count() == 0
    other = leaves(spark, 3, 4).withColumn("rollup_hash", F.sha2(F.lit("other"), 256))
    after = mk.with_blocks(tree, mk.grown(tree, other))
    whole = leaves(spark, 0, 1500).where("idx <> 3").unionByName(other)
    assert mk.tree_root(after).first().root == mk.merkle_root(whole).first().root
