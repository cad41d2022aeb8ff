"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are lifted by one coordinate to equal length, so that the largest inner product is the
smallest angle, and turned into the signs of learned rotations (iterative quantization, fitted
on a bounded sample). A code is split into bytes, each with a table from byte value to the
vectors that have it. Codes within radius r of a query differ by at most t_i in some byte i
whenever the sum of t_i + 1 exceeds r (pigeonhole), so a query probes in each table the values
within t_i of its own and misses no code within r. Tables are bitmaps over a block of vectors,
and the union of the probes is an OR. Codes that come up are compared whole, and those within
the radius are ranked by their float vectors.

Radii aim at a recall, whatever the number of vectors. For about CALIBRATION of the queries the
true neighbours are found among all rows; their Hamming distances, told from the distance at
which a hundredth of the sample lies around the query, give the margin that holds RECALL of
them. A query's radius is that distance of its own plus the margin.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import blocks
from footfall.llm.blocks import finite, merge, packed, search
from footfall.llm.registry import query, table
from footfall.llm.sample import bounded_sample
from footfall.session import stored

K = 20
BITS = 256
SAMPLE = 8192
ROUNDS = 12
CALIBRATION = 128  # queries whose true neighbours set the margin
RECALL = 0.95
AROUND = 100  # one of so many sample codes lies within a query's own distance
LEAST_RANK = 8  # which is never read off fewer sample codes than this
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_APART = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]]  # bits between two byte values


class Coder:
    """Learned codes of BITS bits for lifted vectors."""

    def __init__(self, sample: np.ndarray, top: float, bits: int = BITS, seed: int = 7):
        self.top = top  # largest squared length of all vectors
        rng = np.random.default_rng(seed)
        x = self.lift(sample)
        self.mean = x.mean(0)
        x = x - self.mean
        width = min(64, x.shape[1])
        turns = []
        for _ in range(-(-bits // width)):
            turn = np.linalg.qr(rng.normal(size=(x.shape[1], width)))[0]
            for _ in range(ROUNDS):
                signs = np.where(x @ turn > 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(x.T @ signs, full_matrices=False)
                turn = u @ v
            turns.append(turn)
        self.turn = np.concatenate(turns, 1)[:, :bits]

    def lift(self, x: np.ndarray, asked: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        more = np.zeros(len(x)) if asked else np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        return np.concatenate([x, more[:, None]], 1)

    def codes(self, x: np.ndarray, asked: bool = False) -> np.ndarray:
        """Codes as rows of bytes; queries are scaled to the common length first."""
        x = self.lift(x, asked)
        if asked:
            x = x * np.sqrt(self.top / np.maximum((x * x).sum(1), 1e-300))[:, None]
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of `a` to all rows of `b`, given as words of 64 bits."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def words(codes: np.ndarray) -> np.ndarray:
    pad = -codes.shape[1] % 8
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, pad)))).view(np.uint64)


def own_distance(codes: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Distance around each query that holds one of AROUND sample codes; all bits if the sample is too small to tell."""
    rank = max(LEAST_RANK, len(sample) // AROUND)
    if rank > len(sample):
        return np.full(len(codes), codes.shape[1] * 8)
    return np.partition(hamming(words(codes), words(sample)), rank - 1, axis=1)[:, rank - 1].astype(np.int64)


def margin(apart: np.ndarray, own: np.ndarray, recall: float = RECALL) -> int:
    """The margin over `own` distances that holds that share of neighbours `apart` bits away."""
    return int(np.quantile(apart - own, recall, method="higher"))


def thresholds(radius: int, n_bytes: int) -> np.ndarray:
    """Bits by which each byte may differ (-1: not probed); t_i + 1 sum to radius + 1."""
    each, more = divmod(radius + 1, n_bytes)
    return np.minimum(np.where(np.arange(n_bytes) < more, each, each - 1), 8)


def buckets(codes: np.ndarray) -> np.ndarray:
    """The index of a block: for each byte of a code and each value of it, a bitmap of the codes that have it."""
    n_bytes, n = codes.shape[1], len(codes)
    held = np.zeros((n_bytes, 256, -(-n // 8)), np.uint8)
    for i in range(n_bytes):
        rows = np.zeros((256, n), bool)
        rows[codes[:, i], np.arange(n)] = True
        held[i] = np.packbits(rows, axis=1)
    return held


def probe(codes: np.ndarray, radius: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Bit matrix (queries x codes of the index, packed) of the codes that share a probed bucket."""
    n_bytes = len(held)
    out = np.zeros((len(codes), held.shape[2]), np.uint8)
    limit = np.stack([thresholds(int(r), n_bytes) for r in radius]) if len(radius) else np.zeros((0, n_bytes), np.int64)
    for i in range(n_bytes):
        for t in np.unique(limit[:, i]):
            if t < 0:
                continue
            mine = np.flatnonzero(limit[:, i] == t)
            values = np.unique(codes[mine, i])
            ball = np.stack([np.bitwise_or.reduce(held[i][_APART[v] <= t], axis=0) for v in values])
            out[mine] |= ball[np.searchsorted(values, codes[mine, i])]
    return out


def look(q: dict, x: dict, best: list, k: int) -> None:
    """Enters what one block of candidates holds within the queries' radii. Only codes that a probe
    brings up are compared, only those within the radius are scored."""
    n = len(x["ids"])
    if "held" not in x:  # once per block, for all queries that meet it
        x["held"], x["words"] = buckets(x["codes"]), np.ascontiguousarray(words(x["codes"]).T)
    up = np.unpackbits(probe(q["codes"], q["radius"], x["held"]), axis=1, count=n).view(bool)
    asked = words(q["codes"])
    for i, (at, radius) in enumerate(zip(q["ids"], q["radius"], strict=True)):
        columns = np.flatnonzero(up[i])
        apart = np.zeros(len(columns), np.uint16)
        for w, word in enumerate(asked[i]):
            apart += np.bitwise_count(x["words"][w].take(columns) ^ word)
        columns = columns[(apart <= radius) & (x["ids"][columns] != at)]
        if len(columns):
            merge(best, k, x["ids"][columns], np.einsum("ij,j->i", x["x"][columns], q["x"][i])[None, :], np.array([i]))


def look_at_all(q: dict, x: dict, best: list, k: int) -> None:
    """Enters the true neighbours' bits apart in the place of their ids: what the margin is read off."""
    apart = hamming(words(q["codes"]), words(x["codes"])).astype(np.int64)
    scores = q["x"] @ x["x"].T
    scores[q["ids"][:, None] == x["ids"][None, :]] = -np.inf
    merge(best, k, apart, scores, np.arange(len(q["ids"])))


def nearest(
    vectors: DataFrame, asked: DataFrame, k: int = K, sample: int = SAMPLE, calibration: int = CALIBRATION, recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `asked` (vec_id, v) the `k` rows of `vectors`
    of another vec_id with the largest inner product among those within its radius.

    Vectors that are null, zero, or hold a null or non-finite component, and rows with a null
    vec_id, take no part. All vectors have one length. Equal vec_ids are candidates of their
    own; equal scores go to the smaller vec_id; empty sides give no rows. Codes are fitted on
    about `sample` vectors and radii on the true neighbours of about `calibration` queries, so that
    these find the share `recall`; both are chosen by hash, and every row is indexed."""
    live = F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda c: c != 0)
    vectors, asked = (d.select("vec_id", "v").where(live) for d in (vectors, asked))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, top = vectors.agg(F.count("*"), F.max(square)).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "f4" if "float" in vectors.schema["v"].dataType.simpleString() else "f8"
    chosen = bounded_sample(vectors, F.xxhash64("vec_id", "v"), sample, n).select("v").toPandas()["v"]
    picked = chosen if len(chosen) else vectors.limit(sample).select("v").toPandas()["v"]  # all in one hash
    rows = np.unique(np.stack(picked.to_numpy()).astype(np.float64), axis=0)
    coder = Coder(rows, float(top))
    known = coder.codes(rows)
    n_bytes = known.shape[1]

    def of(x: np.ndarray) -> bytes:
        return coder.codes(x).tobytes()

    def of_asked(more: int | None) -> Callable[[np.ndarray], bytes]:
        def run(x: np.ndarray) -> bytes:
            codes = coder.codes(x, True)
            own = own_distance(codes, known) + more if more is not None else np.full(len(x), n_bytes * 8)
            return codes.tobytes() + np.clip(own, 0, n_bytes * 8).astype(np.int64).tobytes()

        return run

    def complete(block: dict) -> dict:
        m = len(block["ids"])
        codes = np.frombuffer(block["more"], np.uint8)
        block["codes"] = codes[:m * n_bytes].reshape(m, n_bytes)
        block["radius"] = codes[m * n_bytes:].view(np.int64)
        return block

    index = packed(vectors, blocks.BLOCK, of, "index")
    tried = stored(bounded_sample(asked, F.xxhash64("vec_id"), calibration, asked.count()), "tried")
    first = search(index, packed(tried, blocks.QUERY_BLOCK, of_asked(0), "calibration"), look_at_all, complete, k, kind)
    near = first.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("apart")).toPandas()
    more = None
    if len(near):
        rows = tried.dropDuplicates(["vec_id"]).toPandas()
        own = own_distance(coder.codes(np.stack(rows["v"].to_numpy()).astype(np.float64), True), known)
        near = near.merge(rows[["vec_id"]].assign(own=own), on="vec_id")
        more = margin(near["apart"].to_numpy(), near["own"].to_numpy(), recall)
    found = stored(search(index, packed(asked, blocks.QUERY_BLOCK, of_asked(more), "queries"), look, complete, k, kind), "found")
    # A query in an empty region may have found too few: its radius becomes the whole code.
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    lone = stored(asked.join(full, "vec_id", "left_anti"), "lone")
    if lone.isEmpty():
        return found
    again = search(index, packed(lone, blocks.QUERY_BLOCK, of_asked(None), "queries"), look, complete, k, kind)
    return found.join(lone.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)


@query("op1_multi_index")
def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
