"""Mixing sources to target weights: repetition rates per source, then whole copies per document.

Only DataFrame functions. Words are counted in the JVM, summed per source with partial
aggregates, and the table of sources (one row each) is joined back to narrow rows; Spark
broadcasts it while its written size is under the session limit and splits a hot source
beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.names import free_prefix
from footfall.llm.registry import query, table
from footfall.operators.frames import running_totals
from footfall.session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, doc_id: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5 over the seed and the id (null: the word null)."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of `sizes` (source, size).

    Sources in code-point order, null last, weigh `weights`, repeating. They share `share`
    times all words by weight; no target is above `cap` times its source's size, and what that
    cuts off goes to the others by weight. The common level (words per unit of weight) is the
    largest of (budget - caps of the first k) / (weight of the rest), sources sorted by cap per
    weight: a too small or too large k only gives a lower level. With no words, all targets are 0."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(totals, [F.col("source").asc_nulls_last()], {"_rank": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", w.cast("long").alias("_w"))
    level = running_totals(
        weighed,
        [(F.col("source_size") / F.col("_w")).asc(), F.col("source").asc_nulls_last()],
        {"_size_before": F.col("source_size"), "_w_before": F.col("_w")},
    )
    all_rows = weighed.agg(F.sum("source_size").alias("_all"), F.sum("_w").alias("_all_w")).first()
    words, weight = float(all_rows["_all"] or 0), int(all_rows["_all_w"] or 0)
    top = level.agg(F.max(
        (F.lit(share * words) - F.lit(cap) * F.col("_size_before")) / (F.lit(weight) - F.col("_w_before"))
    )).first()[0]
    return weighed.select(
        "source", "source_size",
        F.least(F.col("_w") * F.lit(float(top or 0.0)), F.lit(cap) * F.col("source_size")).alias("target"),
    )


def with_copies(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix", prefix: str = "_",
) -> DataFrame:
    """`docs` (doc_id, text, source; other columns kept) with `_size`, `_source_size`, `_target`
    and `_copies` (these names begin with `prefix`, and replace columns of the same names): floor(rate) copies, plus one drawn with the fraction of the rate as its
    probability, where rate = target / source size. The draw depends on seed and id only, so
    reruns agree, and equal ids draw alike. `docs` is read twice.

    Null text has size 0; null source is a source of its own; a source without words is not
    copied, as its rate is undefined; no rows in, no rows out."""
    size, source_size, target, copies = (prefix + c for c in ("size", "source_size", "target", "copies"))
    docs = docs.drop(size, source_size, target, copies)
    key = free_prefix(docs.columns, ["source"]) + "source"
    sized = docs.withColumn(size, word_count(F.col("text")))
    targets = stored(source_targets(sized.select("source", F.col(size).alias("size")), weights, share, cap), "targets")
    targets = targets.select(
        F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target)
    )
    rate = F.coalesce(F.col(target) / F.nullif(F.col(source_size), F.lit(0)), F.lit(0.0))
    extra = (draw(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col(key)), "left")
        .drop(key).withColumn(copies, F.floor(rate) + extra)
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as many times as with_copies() says, same columns."""
    prefix = free_prefix(docs.columns, ["size", "source_size", "target", "copies", "copy"])
    rows = with_copies(docs, weights, share, cap, seed, prefix)
    copies = F.col(f"{prefix}copies")
    return rows.withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(1), copies.cast("int"), F.lit(1)))).where(
        copies > 0).select(*[rows[f"`{c}`"] for c in docs.columns])


MIX_SQL = """
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3
    WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM t),
k AS (
  SELECT *, coalesce(sum(source_size) OVER o, 0)::BIGINT AS size_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before,
    (sum(source_size) OVER ())::BIGINT AS all_size, (sum(w) OVER ())::BIGINT AS all_w FROM w
  WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max((1.5::DOUBLE * all_size - 2.0::DOUBLE * size_before) / (all_w - w_before)) AS top FROM k),
r AS (
  SELECT source, source_size, least(w * coalesce(top, 0), 2.0::DOUBLE * source_size) AS target,
    coalesce(least(w * coalesce(top, 0), 2.0::DOUBLE * source_size) / nullif(source_size, 0), 0) AS rate FROM w, level),
m AS (
  SELECT s.*, r.source_size, r.target, r.rate,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source)"""


@query("op6_mix", MIX_SQL.format(docs="documents") + """
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m""")
def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    rows = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )
