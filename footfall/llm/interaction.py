"""Interaction audit of filters: what every order of the same filters removes, at every step.

A document is known by its mask, one bit per filter it fails. In an order of n filters it goes
at the first filter it fails, so the orders that remove mask m at step s are those whose first
s - 1 letters lie outside m and whose s-th lies inside. Orders are numbered by their Lehmer code,
that is lexicographically; all orders with one prefix are neighbours, so a (mask, step) covers a
few intervals of numbers (`cover`, a table that depends on n alone). Documents are summed per
part and mask; each sum is added at the start of its intervals and taken off at their ends, and
a prefix sum over the n! numbers gives what each order removes at that step.
"""

from __future__ import annotations

import itertools
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.mixing import WORD
from footfall.llm.registry import query, table
from footfall.session import stored

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # percent of the words
MAX_CAPITALS = 2  # percent of the code points
MARKS = "[#$%&*|]"
MOST_FILTERS = 7  # 7! orders of a part are the widest window


def lehmer_rank(prefix: tuple[int, ...], n: int) -> int:
    """Number of the first order of 0..n-1 that starts with `prefix`."""
    rank = 0
    for i, a in enumerate(prefix):
        smaller = a - sum(1 for b in prefix[:i] if b < a)
        rank += smaller * factorial(n - 1 - i)
    return rank


def cover(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, stop): orders start .. stop - 1 remove `mask` at `step`; the intervals of a
    (mask, step) are disjoint and do not touch."""
    out = []
    for mask in range(1, 1 << n):
        inside = [i for i in range(n) if mask >> i & 1]
        outside = [i for i in range(n) if not mask >> i & 1]
        for step in range(1, len(outside) + 2):
            wide = factorial(n - step)
            starts = sorted(lehmer_rank((*head, a), n) for head in itertools.permutations(outside, step - 1) for a in inside)
            spans: list[list[int]] = []
            for s in starts:
                if spans and spans[-1][1] == s:
                    spans[-1][1] = s + wide
                else:
                    spans.append([s, s + wide])
            out += [(mask, step, a, b) for a, b in spans]
    return out


def audit(counts: DataFrame, letters: str = LETTERS, tallies: tuple[str, ...] = ()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, shapley, and removed_<tally> for each
    of `tallies`) of `counts` (part, mask, n, and the tallies: numbers of documents; several rows of
    one part and mask add up).

    Bit i of the mask belongs to the i-th letter. All n! orders and n steps of each part are there,
    zeros included; a part whose documents all pass has zeros; no rows in, no rows out. A null
    part is a part of its own; null counts are zero. `counts` is read twice."""
    n = len(letters)
    if not 1 <= n <= MOST_FILTERS or list(letters) != sorted(set(letters)):
        raise ValueError(f"1 to {MOST_FILTERS} different letters in ascending order")
    sums = ["n", *tallies]
    spans = counts.sparkSession.createDataFrame(cover(n), "mask int, step int, start int, stop int")

    def at(place: str, sign: int) -> Column:
        return F.struct(F.col(place).alias("rank"), *[(F.coalesce(c, F.lit(0)) * sign).cast("long").alias(c) for c in sums])

    # The intervals are as many as n sets, whatever the data: 1211 for five filters.
    ends = counts.join(F.broadcast(spans), "mask").select(
        "part", "step", F.inline(F.array(at("start", 1), at("stop", -1)))).groupBy("part", "step", "rank").agg(
        *[F.sum(c).alias(c) for c in sums])
    bits = [F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(n)]
    known = F.coalesce("n", F.lit(0))
    parts = counts.groupBy("part").agg(
        F.sum(known).alias("docs"),
        F.array(*[F.coalesce(F.sum(F.when(b, known)), F.lit(0)) for b in bits]).alias("fails"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == 1 << i, known)), F.lit(0)) for i in range(n)]).alias("only"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(letters)])
    grid = parts.select("*", F.posexplode(orders).alias("rank", "filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1)))
    grid = grid.select("part", "docs", "rank", "filter_order", "step", place.alias("place"),
                       F.element_at("fails", place).alias("fails"), F.element_at("only", place).alias("unique_fails"))
    same = F.col("part").eqNullSafe(F.col("_part")) & (F.col("step") == F.col("_step")) & (F.col("rank") == F.col("_rank"))
    rows = grid.join(ends.select(*[F.col(c).alias(f"_{c}") for c in ("part", "step", "rank", *sums)]), same, "left")
    upto = Window.partitionBy("part", "step").orderBy("rank")
    rows = rows.select("part", "docs", "rank", "filter_order", "step", "place", "fails", "unique_fails", *[
        F.sum(F.coalesce(f"_{c}", F.lit(0))).over(upto).cast("long").alias("removed" if c == "n" else f"removed_{c}") for c in sums])
    steps = Window.partitionBy("part", "rank").orderBy("step")
    return rows.select(
        "part", "filter_order", "step", (F.col("docs") - F.sum("removed").over(steps)).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[f"removed_{t}" for t in tallies],
        F.sum("removed").over(Window.partitionBy("part", "place")).alias("shapley"))


def flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of `docs` (doc_id, text, source) under the filters A to E.

    A: fewer than 200 words. B: fewer than half of the words differ. C: more than 2 % capitals.
    D: a mark. E: a smaller doc_id has the same text, anywhere in the table. Null text is the
    empty one, null source the part ''. Repeated rows count each and do not fail E by one
    another; a row with a null doc_id neither fails E nor makes others fail it. Texts are read
    once; only their digests travel."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    fails = [
        F.size("words") < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * F.size("words"),
        100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITALS * F.length("text"),
        F.col("text").rlike(MARKS),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    narrow = stored(rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "flags")
    # The first holder of a text is met by digest and doc_id together, so copies of one text are spread.
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    late = F.col("doc_id").isNotNull() & F.col("first").isNull()
    # Narrow rows on both sides and as many of them as documents: one plan at every size.
    return narrow.join(first.hint("merge"), ["digest", "doc_id"], "left").select(
        "doc_id", "part", F.when(late, F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask"))


def counted(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of `flagged` (doc_id, part, mask) and `labels` (doc_id, quality, toxic):
    documents, those labelled quality 1, those labelled toxic 1. Several labels of a document
    count if one of them says so; nulls say nothing."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = flagged.join(told.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])


@query("op11_interaction", """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic,
    len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) AS C,
    regexp_matches(text, '[#$%&*|]') AS D,
    coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS E
  FROM d LEFT JOIN lab ON d.doc_id = lab.doc_id),
m AS (
  SELECT part, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END)
    || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS mask,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM o, range(1, 6) t(step)),
r AS (
  SELECT part, filter_order, step, letter, sum(n)::BIGINT AS docs,
    coalesce(sum(n) FILTER (contains(mask, letter)), 0)::BIGINT AS fails,
    coalesce(sum(n) FILTER (mask = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (contains(mask, letter) AND translate(mask, before, '') = mask), 0)::BIGINT AS removed,
    coalesce(sum(good) FILTER (contains(mask, letter) AND translate(mask, before, '') = mask), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (contains(mask, letter) AND translate(mask, before, '') = mask), 0)::BIGINT AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, (docs - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept,
  removed, fails - removed AS redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r""")
def op11_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, per source."""
    flagged = flags(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    counts = stored(counted(flagged, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")), "counts")
    rows = audit(counts, LETTERS, ("good", "toxic"))
    return rows.withColumnsRenamed({"removed_good": "good_lost", "removed_toxic": "toxic_lost"})
