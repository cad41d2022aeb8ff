"""Inclusion tree over the seals of pending days.

leaf = sha256(00 || seal), node = sha256(01 || left || right), an odd node moves up as it is.
Aligned blocks of 1024 leaves form subtrees of their own, so a tree is built in rounds of one
shuffle each, as many as the number of leaves needs, and no group ever holds more than 1024
hashes. A proof is the path inside the block followed by the proof of the block in the next
round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.frames import running_totals, union_all
from footfall.session import stored

BITS = 10
PROOF = "array<struct<sibling:string,right:boolean>>"

_NEXT_LEVEL = (
    "transform(sequence(0, (size(lvl) - 1) div 2), i -> CASE WHEN 2 * i + 1 < size(lvl) "
    "THEN unhex(sha2(concat(X'01', lvl[2 * i], lvl[2 * i + 1]), 256)) ELSE lvl[2 * i] END)"
)
_LEVELS = (
    f"aggregate(sequence(1, {BITS}), array(hashes), (acc, _) -> concat(acc, "
    f"array({_NEXT_LEVEL.replace('lvl', 'element_at(acc, -1)')})))"
)
# All inclusion paths of a block, made inside the row: exploding first would copy the block's
# levels to each of its leaves.
_PATH = (
    f"filter(transform(sequence(0, {BITS} - 1), l -> CASE WHEN (shiftright(pos, l) ^ 1) < size(levels[l]) "
    "THEN named_struct('sibling', lower(hex(levels[l][shiftright(pos, l) ^ 1])), "
    "'right', shiftright(pos, l) % 2 = 0) END), x -> x IS NOT NULL)"
)
_PATHS = f"transform(sequence(0, size(levels[0]) - 1), pos -> named_struct('pos', pos, 'path', {_PATH}))"
_ROW_PATHS = (
    "transform(filter(rows, x -> x.pos < size(levels[0])), x -> named_struct('row', x.row, 'proof', "
    f"concat({_PATH.replace('pos', 'x.pos')}, rest), 'root', root))"
)
TREE = "round int, block long, levels array<array<binary>>"


def leaf_hash(hex_col: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex(hex_col)), 256))


def pending_leaves(rollups: DataFrame) -> DataFrame:
    """(idx, site_id, day, rollup_hash) of sealed, not yet anchored days in (site, day) order.
    The position is a per-site row number plus the running count of the sites before, so no
    task sees the whole list."""
    p = rollups.where("txid IS NULL AND rollup_hash IS NOT NULL").select("site_id", "day", "rollup_hash")
    counts = p.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    off = running_totals(counts, [F.col("site_id")], {"offset": F.col("n")}).select("site_id", "offset")
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("day")) - 1
    return p.withColumn("_rank", rank).join(off, "site_id").select(
        (F.col("offset") + F.col("_rank")).alias("idx"), "site_id", "day", "rollup_hash")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(block, levels) from (idx, hash): all levels of each aligned subtree."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda e: e["hash"])
    return nodes.groupBy(F.expr(f"shiftright(idx, {BITS})").alias("block")).agg(
        ordered.alias("hashes")).select("block", F.expr(_LEVELS).alias("levels"))


def _next(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("block").alias("idx"), F.element_at("levels", -1)[0].alias("hash"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Block frames of each round, bottom up."""
    nodes = leaves.select("idx", leaf_hash(F.col("rollup_hash")).alias("hash"))
    last = leaves.agg(F.max("idx")).first()[0] or 0
    rounds = []
    for _ in range(_rounds(int(last))):
        blocks = _blocks(nodes)
        rounds.append(blocks)
        nodes = _next(blocks)
    return rounds


def merkle_root(leaves: DataFrame) -> DataFrame:
    """One row `root`; the hash of nothing for no leaves."""
    top = _next(tree(leaves)[-1]).agg(F.max("hash").alias("hash"), F.count(F.lit(1)).alias("n"))
    return top.select(F.when(F.col("n") > 0, F.lower(F.hex("hash"))).otherwise(
        F.sha2(F.lit(""), 256)).alias("root"))


def merkle_proofs(leaves: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """`rows` (idx of a leaf and others; the leaves themselves if None) with `proof` (array of sibling,
    right) and `root`; an idx may come often.

    Rows go to their block, where their paths are made, and are not shuffled after that: at a hundred
    bytes a level, a proof is many times its row."""
    above = None
    rounds = tree(leaves)
    for blocks in reversed(rounds[1:]):
        own = _with_rest(blocks, above)
        above = own.select(
            "rest", "root", "block", F.inline(F.expr(_PATHS))
        ).select((F.expr(f"shiftleft(block, {BITS})") + F.col("pos")).alias("block"), F.concat("path", "rest").alias("rest"), "root")
    rows = leaves if rows is None else rows
    held = rows.groupBy(F.expr(f"shiftright(idx, {BITS})").alias("block")).agg(
        F.collect_list(F.struct(F.expr(f"cast(idx & {(1 << BITS) - 1} as int)").alias("pos"), F.struct(*rows.columns).alias("row"))).alias("rows"))
    made = _with_rest(rounds[0].join(held, "block"), above).select(F.inline(F.expr(_ROW_PATHS)))
    return made.select("row.*", "proof", "root")


def _with_rest(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """Blocks with the proof of their top hash (`rest`) and `root`, from those of the round above."""
    if above is None:
        return blocks.withColumns({
            "rest": F.array().cast(PROOF), "root": F.lower(F.hex(F.element_at("levels", -1)[0]))})
    return blocks.join(above, "block")


# --- a stored tree that grows ---------------------------------------------------------------

def _rounds(last: int) -> int:
    return max(1, -(-last.bit_length() // BITS))


def grown(old: DataFrame, leaves: DataFrame) -> DataFrame:
    """The blocks (round, block, levels) of a stored tree that `leaves` (idx, rollup_hash) add or
    change; with_blocks() puts them in. `old` (TREE columns) is empty for a new tree; leaves are numbered on
    from the stored ones, and a leaf whose number is stored already takes that place. In each round
    only the blocks above touched ones are read and made again, so rows written grow with the new
    leaves: one more block a round at most. No leaves change nothing."""
    last = leaves.agg(F.max("idx")).first()[0]
    if last is None:
        return old.limit(0)
    top = old.agg(F.max("round")).first()[0]
    rounds = max(_rounds(int(last)), -1 if top is None else top + 1)
    nodes, out = leaves.select("idx", leaf_hash(F.col("rollup_hash")).alias("hash")), []
    for r in range(rounds):
        named = nodes.withColumn("block", F.expr(f"shiftright(idx, {BITS})"))
        before = old.where(F.col("round") == r)
        held = before.join(named.select("block").distinct(), "block", "left_semi").select(
            "block", F.posexplode(F.col("levels")[0]).alias("pos", "hash")).select(
            (F.expr(f"shiftleft(block, {BITS})") + F.col("pos")).alias("idx"), "hash", F.lit(0).alias("_new"))
        both = named.select("idx", "hash", F.lit(1).alias("_new")).unionByName(held)
        blocks = stored(_blocks(both.groupBy("idx").agg(F.max_by("hash", "_new").alias("hash"))), "blocks")
        out.append(blocks.select(F.lit(r).alias("round"), "block", "levels"))
        nodes = _next(blocks)
        if r == top:  # a tree that becomes higher: its root so far is the first node of the new round
            nodes = nodes.unionByName(_next(before.join(blocks.select("block"), "block", "left_anti").select("block", "levels")))
    return union_all(out)


def with_blocks(old: DataFrame, blocks: DataFrame) -> DataFrame:
    """The stored tree after a growth. A table partitioned by round rewrites the touched blocks only."""
    return old.join(blocks.select("round", "block"), ["round", "block"], "left_anti").unionByName(blocks)


def tree_root(tree: DataFrame) -> DataFrame:
    """merkle_root() of a stored tree, from its first blocks."""
    top = tree.where("block = 0").agg(F.max_by(F.element_at("levels", -1)[0], "round").alias("hash"))
    return top.select(F.coalesce(F.lower(F.hex("hash")), F.sha2(F.lit(""), 256)).alias("root"))


def tree_proofs(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (idx and others) with `proof`, looked up in a stored tree, which is not made again; leaves that it
    does not hold are left out. merkle_proofs() is the plan for all leaves at once."""
    top = tree.agg(F.max("round")).first()[0]
    out = wanted.withColumn("proof", F.array().cast(PROOF))
    for r in range(0 if top is None else top + 1):
        at = out.withColumn("block", F.expr(f"shiftright(idx, {BITS * (r + 1)})")).withColumn(
            "pos", F.expr(f"cast(shiftright(idx, {BITS * r}) & {(1 << BITS) - 1} as int)"))
        rows = at.join(tree.where(F.col("round") == r).select("block", "levels"), "block").where("pos < size(levels[0])")
        out = rows.select(*wanted.columns, F.concat("proof", F.expr(_PATH)).alias("proof"))
    return out if top is not None else out.limit(0)


def proof_json(proof: Column) -> Column:
    parts = F.transform(proof, lambda p: F.concat(
        F.lit('{"sibling": "'), p["sibling"], F.lit('", "right": '), p["right"].cast("string"), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))


def proof_holds(leaf_hex: Column, proof: Column, root: Column) -> Column:
    def step(h: Column, p: Column) -> Column:
        sib = F.unhex(p["sibling"])
        one = F.unhex(F.lit("01"))
        both = F.when(p["right"], F.concat(one, h, sib)).otherwise(F.concat(one, sib, h))
        return F.unhex(F.sha2(both, 256))

    return F.lower(F.hex(F.aggregate(proof, leaf_hash(leaf_hex), step))) == root


def verify_proofs(rollups: DataFrame) -> DataFrame:
    """(site_id, day, valid) for anchored days, from the stored proof text."""
    proof = F.from_json("merkle_proof", PROOF)
    return rollups.where("merkle_root IS NOT NULL").select(
        "site_id", "day", proof_holds(F.col("rollup_hash"), proof, F.col("merkle_root")).alias("valid"))


def attach_anchor(rollups: DataFrame, txid: str, anchored_at: str) -> DataFrame:
    """The rollup table after anchoring all pending days under one transaction id."""
    rollups = stored(rollups, "rollups")
    leaves = stored(pending_leaves(rollups), "leaves")
    # Days find their place in the tree first: proofs are made last and stay where they are made.
    days = leaves.select("site_id", "day", "idx")
    p = merkle_proofs(leaves, rollups.join(days, ["site_id", "day"])).select(
        *rollups.columns, F.col("root").alias("_root"), proof_json(F.col("proof")).alias("_proof"))
    rest = rollups.join(days, ["site_id", "day"], "left_anti")
    j = p.unionByName(rest, allowMissingColumns=True)
    hit = F.col("_root").isNotNull()
    return j.select(
        "site_id", "day", "pageviews", "visitors", "sessions", "bounce_rate", "rollup_hash",
        F.when(hit, F.col("_root")).otherwise(F.col("merkle_root")).alias("merkle_root"),
        F.when(hit, F.col("_proof")).otherwise(F.col("merkle_proof")).alias("merkle_proof"),
        F.when(hit, F.lit(txid)).otherwise(F.col("txid")).alias("txid"),
        F.when(hit, F.lit(anchored_at).cast("timestamp_ntz")).otherwise(F.col("anchored_at")).alias("anchored_at"),
    )


def proof_documents(rollups: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, day, document): JSON with totals, seal, inclusion path, root and anchor."""
    r = rollups.where("rollup_hash IS NOT NULL").join(
        sites.select(F.col("id").alias("site_id"), "domain"), "site_id")
    day = F.date_format("day", "yyyy-MM-dd")
    payload = F.struct(
        "site_id", day.alias("day"), "pageviews", "visitors", "sessions",
        F.col("bounce_rate").cast("long").alias("bounce_rate"))
    anchor = F.struct(
        F.col("txid"), F.date_format("anchored_at", "yyyy-MM-dd HH:mm:ss").alias("anchored_at"),
        F.when(F.col("txid").isNull(), "venter").alias("status"))
    doc = F.to_json(F.struct(
        "domain", day.alias("day"), payload.alias("payload"), "rollup_hash",
        F.struct(F.from_json("merkle_proof", PROOF).alias("proof"), F.col("merkle_root").alias("root")).alias("merkle"),
        anchor.alias("chain")))
    return r.select("site_id", "day", doc.alias("document"))
