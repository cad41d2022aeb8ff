"""Blocks of vectors that meet blocks of queries.

Both sides are packed into rows of bounded size. Candidate blocks are numbered and taken in
groups, query blocks in chunks, and a cell is one group with one chunk, met through a
cogroup: the work of a stated query set against all rows, dealt out evenly. A candidate crosses
the shuffle once per chunk and a query once per group, so neither side is sent once per block
of the other. A task holds one cell; whatever an operator derives from a candidate block
is made once in it and serves all queries of the chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.session import stored

BLOCK = 4096
QUERY_BLOCK = 512
GROUP = 16  # candidate blocks of a cell, at most
CHUNK = 32  # query blocks of a cell, at most
CELLS = 4  # cells for each core, where sizes leave the choice


def finite(v: Column) -> Column:
    """True for a vector (array of numbers) that is not null and holds no null or non-finite one."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return flat[ends[0]:ends[-1]].reshape(len(column), -1)


def pack(vectors: DataFrame, size: int, derive: Callable[[np.ndarray], bytes]) -> DataFrame:
    """Rows of up to `size` vectors of (vec_id, v): (block, ids, data, more), the last three as bytes;
    `more` is what `derive` makes of the matrix of a block."""
    names = ["block", "ids", "data", "more"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def row(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        ids = np.concatenate([p.column(0).to_numpy() for p in parts])
        data = np.concatenate([_matrix(p.column(1)) for p in parts])
        cells = [[number], [ids.tobytes()], [data.tobytes()], [derive(data)]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        parts: list[pa.RecordBatch] = []
        room = size
        for batch in batches:
            while batch.num_rows:
                parts.append(batch.slice(0, room))
                room -= parts[-1].num_rows
                batch = batch.slice(parts[-1].num_rows)
                if not room:
                    yield row(parts, number)
                    parts, room, number = [], size, number + 1
        if parts:
            yield row(parts, number)

    return vectors.select("vec_id", "v").mapInArrow(run, "block long, ids binary, data binary, more binary")


def unpack(ids: bytes, data: bytes, more: bytes, kind: str) -> dict:
    at = np.frombuffer(ids, np.int64)
    x = np.frombuffer(data, kind).reshape(len(at), -1).astype(np.float64)
    return {"ids": at, "x": x, "more": more}


def merge(best: list, k: int, ids: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
    """Enters scores (one line per query of `rows`; -inf is none) of candidates `ids` into `best`,
    which has (ids, scores) per query, best first, ties to smaller ids."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        least = np.full(len(rows), -np.inf)
    for i, at in enumerate(rows):
        mine, got = best[at]
        floor = max(least[i], got[-1] if len(got) == k else -np.inf)
        good = np.flatnonzero((scores[i] >= floor) & (scores[i] > -np.inf))
        if len(good):
            mine = np.concatenate([mine, (ids[i] if ids.ndim == 2 else ids)[good]])
            got = np.concatenate([got, scores[i, good]])
            order = np.lexsort((mine, -got))[:k]
            best[at] = (mine[order], got[order])


def packed(vectors: DataFrame, size: int, derive: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
    """pack(), stored, with `at`: the number of a block, from 0. Numbers come from block names alone."""
    rows = stored(pack(vectors, size, derive), name)
    number = rows.select("block", (F.row_number().over(Window.orderBy("block")) - 1).cast("long").alias("at"))
    return rows.join(stored(number, "numbers"), "block")


def search(
    candidates: DataFrame, queries: DataFrame, look: Callable, prepare: Callable, k: int, kind: str,
) -> DataFrame:
    """(query_id, rank, vec_id, score double): the `k` best of what `look(query block, candidate block,
    best, k)` enters, over all blocks of packed() `candidates` and `queries`. `prepare` completes an
    unpacked block; `kind` is the type of the components."""
    n, m = candidates.count(), queries.count()
    wanted = max(1, int(CELLS * candidates.sparkSession.sparkContext.defaultParallelism))
    group = min(GROUP, max(1, n // wanted))
    groups = -(-n // group)
    chunk = min(CHUNK, max(1, m * groups // wanted))
    chunks = -(-m // chunk)
    cells = max(1, groups * chunks)

    def dealt(blocks: DataFrame, mine: str, size: int, other: str, others: int) -> DataFrame:
        every = F.sequence(F.lit(0), F.lit(others - 1)) if others else F.array().cast("array<int>")
        rows = blocks.select((F.floor(F.col("at") / size)).cast("int").alias(mine), F.explode(every).alias(other), "ids", "data", "more")
        return rows.repartition(cells, "g", "c")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        def rows(side: pa.Table) -> Iterator[dict]:
            for i in range(side.num_rows):
                yield prepare(unpack(*(side.column(c)[i].as_py() for c in ("ids", "data", "more")), kind))

        asked = list(rows(right))
        best = [[(np.zeros(0, np.int64), np.zeros(0)) for _ in q["ids"]] for q in asked]
        for x in rows(left):
            for q, b in zip(asked, best, strict=True):
                look(q, x, b, k)
        found = [r for b in best for r in b]
        ids = np.concatenate([np.zeros(0, np.int64), *[q["ids"] for q in asked]])
        return pa.table({
            "query_id": pa.array(np.repeat(ids, [len(i) for i, _ in found]), pa.int64()),
            "vec_id": pa.array(np.concatenate([np.zeros(0, np.int64), *[i for i, _ in found]]), pa.int64()),
            "score": pa.array(np.concatenate([np.zeros(0), *[s for _, s in found]]), pa.float64())})

    left, right = dealt(candidates, "g", group, "c", chunks), dealt(queries, "c", chunk, "g", groups)
    found = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInArrow(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
