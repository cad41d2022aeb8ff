"""Exact top-k inner products by pivot-table elimination.

Distances from every vector to many pivots are stored beside it. By the triangle inequality,
the largest difference between a query's and a candidate's pivot distances is a lower bound
of their distance d, and score = (|q|^2 + |x|^2 - d^2) / 2 turns it into an upper bound of the
score. In a block of candidates a query first evaluates those with the best bounds; then it
stops for good if no other bound reaches the 20th score found so far, else it evaluates just
those that do.

blocks.py brings blocks of candidates and queries together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import blocks
from footfall.llm.blocks import finite, merge, packed, search
from footfall.llm.registry import query, table

K = 20
PIVOTS = 24
FIRST = 64  # candidates of a block evaluated before the bounds are looked at again


def quantised(v: Column, scale: int = 64) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _squares(rows: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots."""
    square = _squares(rows)[:, None] + _squares(pivots)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def look(q: dict, x: dict, best: list, k: int) -> None:
    """Enters one block of candidates; skips only those whose bound is below the last score."""
    bound = np.zeros((len(q["ids"]), len(x["ids"])), np.float32)
    for p in range(q["dist"].shape[1]):
        np.maximum(bound, np.abs(q["dist"][:, p, None] - x["dist"][None, :, p]), out=bound)
    # Distances are rounded to 24 bits; the bound gives way by more than that can move it.
    reach = q["square"][:, None] + x["square"][None, :]
    upper = (reach - bound.astype(np.float64) ** 2) / 2 + 1e-5 * reach
    upper[q["ids"][:, None] == x["ids"][None, :]] = -np.inf
    first = min(FIRST, len(x["ids"]))
    near = np.argpartition(-upper, first - 1, axis=1)[:, :first]
    scores = np.einsum("qd,qsd->qs", q["x"], x["x"][near])
    scores[np.take_along_axis(upper, near, 1) == -np.inf] = -np.inf
    merge(best, k, x["ids"][near], scores, np.arange(len(q["ids"])))
    np.put_along_axis(upper, near, -np.inf, 1)
    least = np.array([s[-1] if len(s) == k else -np.inf for _, s in best])
    # A bound equal to the last score may hide a tie with a smaller id.
    still = (upper >= least[:, None]) & (upper > -np.inf)
    rows, columns = np.flatnonzero(still.any(1)), np.flatnonzero(still.any(0))
    if len(rows):
        scores = q["x"][rows] @ x["x"][columns].T
        scores[~still[np.ix_(rows, columns)]] = -np.inf
        merge(best, k, x["ids"][columns], scores, rows)


def exact_top_k(vectors: DataFrame, asked: DataFrame, k: int = K, n_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` largest integer inner products of every row of
    `asked` (vec_id, v: array of long) with the rows of `vectors` of another vec_id, ties to the
    smaller vec_id; all of them, if there are fewer.

    `v` must hold no nulls and have one length; products must stay within 2^53. Rows of equal
    vec_id are candidates of their own; a null vec_id is left out. Empty sides give no rows. The
    pivots are the `n_pivots` vectors with the smallest hashes of their ids: a bounded sample
    that only decides how much is skipped, never what is found."""
    vectors, asked = (d.select("vec_id", "v").where("vec_id IS NOT NULL") for d in (vectors, asked))
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    if not picked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = np.array([r["v"] for r in picked], np.float64)

    def derive(x: np.ndarray) -> bytes:
        return distances(x.astype(np.float64), pivots).tobytes()

    def complete(block: dict) -> dict:
        block["dist"] = np.frombuffer(block["more"], np.float32).reshape(len(block["ids"]), -1)
        block["square"] = _squares(block["x"])
        return block

    held, queries = packed(vectors, blocks.BLOCK, derive, "blocks"), packed(asked, blocks.QUERY_BLOCK, derive, "queries")
    return search(held, queries, look, complete, k, "i8").withColumn("score", F.col("score").cast("long"))


EXACT_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op10_pivot_top_k", EXACT_SQL)
def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every 20th vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(finite(F.col("embedding")))
    vectors = rows.select("vec_id", quantised(F.col("embedding")).alias("v"))
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"))
