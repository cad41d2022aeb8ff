"""Merkle manifest of a dataset: a tree per source, a tree over their roots, a proof per document.

Every node carries the interval of leaf ranks that it covers. A level is built by one grouping
of at most WIDTH nodes; a node keeps its members' intervals and hashes. Paths are attached from
the top: a node of level l lies in bucket (first rank div WIDTH^l), a member finds the one node of
the level above whose interval contains its own by joining on that bucket, and its siblings
are the members whose interval differs. What a leaf inherits is stored once per parent, not once
per leaf, so only the last join is as long as the table, and its rows are a few hashes wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.registry import query, table
from footfall.operators.frames import running_totals
from footfall.session import stored

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_BY = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<l:binary,r:binary>>"


def _hash(hexed: Column) -> Column:
    """sha256 of a hex string, as 32 bytes."""
    return F.unhex(F.sha2(hexed.cast("binary"), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return _hash(F.concat(*[field(c) for c in fields]))


def levels(leaves: DataFrame, width: int = WIDTH) -> list[DataFrame]:
    """Levels above `leaves` (tree, rank, hash; ranks of a tree are 0, 1, ...), lowest first: (tree, lo, hi, hash,
    members: array of (lo, hi, hash)). A tree appears in as many levels as its leaves need; a single
    leaf needs none. No group holds more than `width` nodes."""
    nodes = leaves.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "hash")
    size = stored(nodes.groupBy("tree").agg(F.max("hi").alias("n")), "sizes")
    most = size.agg(F.max("n")).first()[0] or 0
    out, span = [], 1
    while span < most:
        # A tree is done when one node covers all its leaves: it goes on while nodes are narrower than it.
        open_ = size.where(F.col("n") > span).select("tree") if span > 1 else size.where("n > 1").select("tree")
        span *= width
        members = nodes.join(open_, "tree").groupBy("tree", F.expr(f"lo div {span}L").alias("bucket")).agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "hash"))).alias("members"))
        run = F.array_join(F.transform("members", lambda m: text_of(m["hash"])), "")
        level = stored(members.select(
            "tree", F.col("members")[0]["lo"].alias("lo"), F.element_at("members", -1)["hi"].alias("hi"), _hash(run).alias("hash"), "members"), "level")
        out.append(level)
        nodes = level.drop("members")
    return out


def tops(leaves: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(tree, hash): the node that covers all leaves of each tree."""
    size = leaves.groupBy("tree").agg((F.max("rank") + 1).alias("hi"))
    nodes = leaves.select("tree", F.lit(0).cast("long").alias("lo"), (F.col("rank") + 1).alias("hi"), "hash").where("hi = 1")
    for level in above:
        nodes = nodes.unionByName(level.select("tree", "lo", "hi", "hash").where("lo = 0"))
    # Of the nodes that begin at rank 0, the lowest that covers everything; one per level and tree.
    return nodes.join(size, ["tree", "hi"]).select("tree", "hash").dropDuplicates(["tree"])


def attach(inside: DataFrame, parents: DataFrame, span: int) -> DataFrame:
    """Nodes of `inside` (tree, lo, hi and others) with the node of `parents` (tree, lo, hi, members, path) whose
    interval contains theirs: `path` grows by their siblings, to the left and to the right. Nodes
    without such a parent stay as they are, with an empty path."""
    p = parents.select(F.col("tree").alias("_tree"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("members").alias("_members"),
                       F.col("path").alias("_path"), F.expr(f"lo div {span}L").alias("_bucket"))
    contained = (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi"))
    joined = inside.withColumn("_b", F.expr(f"lo div {span}L")).join(
        p.hint("merge"), (F.col("tree") == F.col("_tree")) & (F.col("_b") == F.col("_bucket")) & contained, "left")

    def side(test) -> Column:
        siblings = F.filter("_members", test)
        return F.aggregate(siblings, F.lit(b""), lambda a, m: F.concat(a, m["hash"]))

    own = F.struct(side(lambda m: m["hi"] <= F.col("lo")).alias("l"), side(lambda m: m["lo"] >= F.col("hi")).alias("r"))
    none = F.array().cast(PATH)
    path = F.when(F.col("_tree").isNull(), none).otherwise(F.concat(F.array(own).cast(PATH), F.coalesce("_path", none)))
    return joined.withColumn("path", path).drop("_tree", "_lo", "_hi", "_members", "_path", "_bucket", "_b")


def paths(above: list[DataFrame], width: int = WIDTH) -> tuple[DataFrame | None, int]:
    """The lowest level of `above` with `path` (to the left, to the right: hashes of the siblings of each step,
    upwards), and its span. None without levels."""
    upper = None
    for i in range(len(above) - 1, -1, -1):
        level = above[i]
        if upper is None:
            upper = level.withColumn("path", F.array().cast(PATH))
        else:
            upper = attach(level, upper, width ** (i + 2))
        if i:
            upper = stored(upper, "paths")
    return upper, width


def proven(leaves: DataFrame, width: int = WIDTH) -> tuple[DataFrame, list[DataFrame]]:
    """`leaves` (tree, rank, hash, others with names of their own) with `path`, and the levels above."""
    above = levels(leaves, width)
    upper, span = paths(above, width)
    rows = leaves.withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1)
    if upper is None:
        return rows.withColumn("path", F.array().cast(PATH)).drop("lo", "hi"), above
    return attach(rows, upper, span).drop("lo", "hi"), above


def fold(leaf: Column, path: Column) -> Column:
    """The hash that `leaf` leads to over the siblings of `path`."""
    return F.aggregate(path, leaf, lambda h, s: _hash(F.concat(text_of(s["l"]), text_of(h), text_of(s["r"]))))


def siblings_hash(path: Column) -> Column:
    """Hex sha256 over all siblings of a path as hex text, upwards, left to right."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda a, s: F.concat(a, text_of(s["l"]), text_of(s["r"]))).cast("binary"), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where TAMPERED_BY divides the CRC-32 of the decimal doc_id."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED_BY == 0
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def manifest(docs: DataFrame, width: int = WIDTH, changed: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root, verified) of every row of `docs`
    (doc_id, source, lang, n_chars, text); digests as lowercase hex, path: siblings up to the root.

    `changed` is the text that folded_root and verified test; the original one by default. A
    source's leaves ascend by doc_id (null first), equal doc_ids by their hash; null source is a source
    of its own and the first. Repeated rows are leaves of their own, with the same hash. Null and
    empty fields differ. No rows in, no rows out. Other columns of `docs` are not read."""
    fields = [F.col(c) for c in FIELDS]
    now = F.col("text") if changed is None else changed
    other = F.when(~now.eqNullSafe(F.col("text")), leaf_hash([*fields[:-1], now]))
    rows = stored(docs.select("doc_id", "source", leaf_hash(fields).alias("hash"), other.alias("other")), "leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("other").asc()]
    ranked = stored(running_totals(rows, order, {"place": F.lit(1).cast("long")}), "ranked")
    sizes = ranked.groupBy("source").agg(F.min("place").alias("first"))
    sources = stored(running_totals(sizes, [F.col("source").asc_nulls_first()], {"tree": F.lit(1).cast("long")}).select(
        F.col("source").alias("_source"), "first", "tree"), "sources")
    leaves = stored(ranked.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "tree", (F.col("place") - F.col("first")).alias("rank"), "hash", "other"), "ranks")
    below, above = proven(leaves, width)
    subroots = stored(tops(leaves, above), "subroots")
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "hash")
    over, upper = proven(top, width)
    root = tops(top, upper).select(F.lit(1).alias("_one"), F.col("hash").alias("root"))
    over = stored(over.withColumn("_one", F.lit(1)).join(root, "_one").select(
        F.col("rank").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("path").alias("upper")), "over")
    done = below.join(over, "tree").withColumn("path", F.concat("path", "upper"))
    folded = fold(F.coalesce("other", "hash"), F.col("path"))
    return done.select(
        "doc_id", "source", text_of(F.col("hash")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"),
        text_of(F.col("root")).alias("root"), "path", siblings_hash(F.col("path")).alias("proof_sha256"),
        text_of(folded).alias("folded_root"), F.col("root").alias("_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")).drop("_root")


def _crc(text: str) -> str:
    """CRC-32 of an ASCII text in SQL, bit by bit."""
    start = "4294967295::BIGINT"
    step = "CASE WHEN {v} % 2 = 1 THEN xor({v} // 2, 3988292384::BIGINT) ELSE {v} // 2 END"
    bits = f"list_reduce(list_prepend(xor(c, o), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, _: {step.format(v='v')})"
    codes = f"list_transform(string_split({text}, ''), lambda s: ord(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend({start}, {codes}), lambda c, o: {bits}), 4294967295::BIGINT)"


MANIFEST_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN {crc} % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents),
p AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, other FROM d),
h AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source COLLATE C NULLS FIRST) - 1 AS tree,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other FROM p),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM h),
nodes(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, rank, leaf, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 16),
sub AS (SELECT tree, lvl AS height, h AS subroot FROM nodes WHERE n = 1),
tops(lvl, pos, h, n) AS (
  SELECT 0, tree, subroot, (SELECT count(*) FROM sub) FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM tops WHERE n > 1 GROUP BY lvl, pos // 16),
own AS (
  SELECT l.doc_id, l.tree, l.rank, s.lvl, string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < l.rank // (16 ** s.lvl)::BIGINT) AS a,
    string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > l.rank // (16 ** s.lvl)::BIGINT) AS b
  FROM leaves l JOIN nodes s ON s.tree = l.tree AND s.n > 1 AND s.pos // 16 = l.rank // (16 ** (s.lvl + 1))::BIGINT GROUP BY ALL),
up AS (
  SELECT l.doc_id, l.tree, l.rank, 1000 + s.lvl AS lvl, string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < l.tree // (16 ** s.lvl)::BIGINT) AS a,
    string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > l.tree // (16 ** s.lvl)::BIGINT) AS b
  FROM leaves l JOIN tops s ON s.n > 1 AND s.pos // 16 = l.tree // (16 ** (s.lvl + 1))::BIGINT GROUP BY ALL),
path AS (
  SELECT tree, rank, list([coalesce(a, ''), coalesce(b, '')] ORDER BY lvl) AS path FROM (FROM own UNION ALL FROM up) GROUP BY tree, rank)
SELECT doc_id, leaf, subroot, t.h AS root,
  sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[1] || x[2]), '')) AS proof_sha256,
  list_reduce(list_prepend([other, ''], coalesce(path, [])), lambda h, x: [sha256(x[1] || h[1] || x[2]), ''])[1] AS folded_root,
  list_reduce(list_prepend([other, ''], coalesce(path, [])), lambda h, x: [sha256(x[1] || h[1] || x[2]), ''])[1] = t.h AS verified
FROM leaves LEFT JOIN path USING (tree, rank) JOIN sub USING (tree) JOIN tops t ON t.n = 1"""


@query("op13_manifest", MANIFEST_SQL.format(crc=_crc("doc_id::VARCHAR")))
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, tested with a fifth of the documents tampered."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    rows = manifest(docs, changed=tampered_text(F.col("doc_id"), F.col("text")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
