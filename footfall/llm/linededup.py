"""Line dedup that can be undone: sharded cuckoo filters over exact reference-count tables.

Exact tables hold which document holds which line key (`postings`) and, per key, how many
documents hold it and the last one (`counts`). A key is live while enough documents hold it;
each shard has a cuckoo filter with one entry per live key. Inserting documents raises counts
and enters keys that become live; deleting documents lowers counts and takes entries out
again, so a deletion leaves the index as if the document had never come.

Lines are dropped in two steps: the filters (broadcast in groups of bounded size) reject
nearly all lines inside the task that reads them, and the few left are joined with the exact
table, which removes false positives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.names import free_prefix
from footfall.llm.registry import query, table
from footfall.session import stored

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
SLOTS = 4
SHARD_KEYS = 250_000
BROADCAST_BYTES = 64 << 20


class CuckooFilter:
    """Set of 16-byte keys as 16-bit marks, four to a bucket; each key has two buckets."""

    def __init__(self, n_buckets: int, cells: np.ndarray | None = None):
        self.mask = np.uint64(n_buckets - 1)
        self.cells = np.zeros((n_buckets, SLOTS), np.uint16) if cells is None else cells.reshape(n_buckets, SLOTS)

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(3, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8))))))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        cells = np.frombuffer(blob, np.uint16).copy()
        return cls(len(cells) // SLOTS, cells)

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mark and both buckets of keys given as rows of two unsigned longs."""
        mark = np.maximum(keys[:, 1] & np.uint64(0xFFFF), np.uint64(1))
        one = keys[:, 0] & self.mask
        return mark.astype(np.uint16), one, self.other(one, mark)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(8) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(keys)
        return (self.cells[one] == mark[:, None]).any(1) | (self.cells[two] == mark[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """False if there was no room; the filter is then to be rebuilt larger."""
        for mark, one, two in zip(*self.places(keys), strict=True):
            bucket = one
            if not self._put(one, mark) and not self._put(two, mark):
                for kick in range(500):
                    self.cells[bucket][kick % SLOTS], mark = mark, self.cells[bucket][kick % SLOTS]
                    bucket = self.other(bucket, mark)
                    if self._put(bucket, mark):
                        break
                else:
                    return False
        return True

    def _put(self, bucket, mark) -> bool:
        free = np.flatnonzero(self.cells[bucket] == 0)
        if len(free):
            self.cells[bucket][free[0]] = mark
        return bool(len(free))

    def remove(self, keys: np.ndarray) -> None:
        """Takes out one entry per key; the keys must have been added."""
        for mark, one, two in zip(*self.places(keys), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.cells[bucket] == mark)
                if len(at):
                    self.cells[bucket][at[0]] = 0
                    break
            else:
                raise KeyError("not in the filter")


def _longs(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def normal(line: Column) -> Column:
    """A line without outer ASCII space, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (key, doc_id): keys are MD5 of normal lines of at least `min_chars` code points.
    Rows with a null doc_id hold no keys."""
    lines = F.transform(F.split(F.col("text"), "\n", -1), normal)
    keys = F.array_distinct(F.filter(lines, lambda x: F.length(x) >= min_chars))
    return (
        docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(keys).alias("line"))
        .select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"), "doc_id").distinct()
    )


def _counts(held: DataFrame) -> DataFrame:
    return held.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


@dataclass
class LineIndex:
    """postings (key, doc_id), counts (key, n_docs, last_doc), filters (shard, blob)."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    def shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def live(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)


def build(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
    """Index of `docs` (doc_id, text). The number of shards follows the live keys, so that one
    shard's filter stays small; it is fixed for the life of the index."""
    held = stored(postings(docs, min_chars), "postings")
    counts = stored(_counts(held), "counts")
    live = counts.where(F.col("n_docs") >= min_docs)
    shards = 1 << max(4, int(np.ceil(np.log2(max(1, live.count()) / SHARD_KEYS))))
    index = LineIndex(held, counts, docs.sparkSession.createDataFrame([], "shard int, blob binary"), shards, min_docs, min_chars)
    moves = live.select("key", F.lit("add").alias("move"))
    index.filters = stored(_refilter(index, moves), "filters")
    return index


def _refilter(index: LineIndex, moves: DataFrame) -> DataFrame:
    """Filters after `moves` (key, move: add, drop or keep) of the touched shards."""

    def run(moved: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        shard = int((moved if len(moved) else old)["shard"].iloc[0])
        of = {m: _longs(g) for m, g in moved.groupby("move")["key"]}
        none = np.zeros((0, 2), np.uint64)
        box = CuckooFilter.from_bytes(old["blob"].iloc[0]) if len(old) else CuckooFilter.for_keys(len(of.get("add", none)))
        box.remove(of.get("drop", none))
        if not box.add(of.get("add", none)):
            alive = np.concatenate([of.get("keep", none), of.get("add", none)])
            room = 2 * len(alive)
            while not (box := CuckooFilter.for_keys(room)).add(alive):
                room *= 2
        return pd.DataFrame({"shard": [shard], "blob": [box.to_bytes()]})

    keyed = moves.withColumn("shard", index.shard())
    return keyed.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(run, "shard int, blob binary")


def _changed(index: LineIndex, held: DataFrame, keys: DataFrame) -> LineIndex:
    """The index with postings `held`, where only `keys` have other postings than before."""
    keys = stored(keys.distinct(), "keys")
    fresh = stored(_counts(held.join(keys, "key", "left_semi")), "fresh")
    counts = stored(index.counts.join(keys, "key", "left_anti").unionByName(fresh), "counts")
    new = LineIndex(held, counts, index.filters, index.shards, index.min_docs, index.min_chars)
    was = index.live().select("key", F.lit(True).alias("was"))
    now = new.live().select("key", F.lit(True).alias("now"))
    move = F.when(F.col("was") & F.col("now"), "keep").when(F.col("now"), "add").otherwise("drop")
    new.filters = stored(_refilter(index, was.join(now, "key", "full").select("key", move.alias("move"))), "filters")
    return new


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with `docs` added; documents that it holds already are not counted twice."""
    new = stored(postings(docs, index.min_chars).join(index.postings, ["key", "doc_id"], "left_anti"), "new")
    return _changed(index, stored(index.postings.unionByName(new), "postings"), new.select("key"))


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of `ids` (doc_id); unknown ids change nothing."""
    ids = ids.select("doc_id").distinct()
    gone = index.postings.join(ids, "doc_id", "left_semi").select("key")
    return _changed(index, stored(index.postings.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "postings"), gone)


def _hits(index: LineIndex, held: DataFrame) -> DataFrame:
    """Rows of `held` (key, doc_id) that the filters let through: all live keys and few others."""
    spark = held.sparkSession
    groups: list[list[int]] = [[]]
    room = BROADCAST_BYTES
    for shard, n in sorted(index.filters.select("shard", F.length("blob")).collect()):
        if n > room and groups[-1]:
            groups.append([])
            room = BROADCAST_BYTES
        groups[-1].append(shard)
        room -= n
    keyed = held.withColumn("shard", index.shard())
    out = None
    for group in groups:
        blobs = dict(index.filters.where(F.col("shard").isin(group)).collect())
        sent = spark.sparkContext.broadcast(blobs)

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            boxes = {s: CuckooFilter.from_bytes(b) for s, b in sent.value.items()}
            for batch in batches:
                if batch.num_rows:
                    keys = _longs(batch.column(0).to_pylist())
                    shard = batch.column(2).to_numpy()
                    found = np.zeros(len(keys), bool)
                    for s in np.unique(shard):
                        if s in boxes:
                            mine = shard == s
                            found[mine] = boxes[s].contains(keys[mine])
                    yield batch.filter(pa.array(found))

        part = keyed if len(groups) == 1 else keyed.where(F.col("shard").isin(group))
        ids = held.schema["doc_id"].dataType.simpleString()
        part = part.select("key", "doc_id", "shard").mapInArrow(probe, f"key binary, doc_id {ids}, shard int").drop("shard")
        out = part if out is None else out.unionByName(part)
    return out


def drops(index: LineIndex, held: DataFrame) -> DataFrame:
    """(doc_id, keys) of the lines that documents with the postings `held` lose: live keys, save
    in the last document that holds them."""
    hits = stored(_hits(index, held), "hits")
    live = stored(index.live(), "live")
    lost = hits.join(live, "key").where("doc_id <> last_doc").select("doc_id", "key")
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def _kept(text: str | None, keys: set[bytes]) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if not keys:
        return text or "", len(lines), 0
    stay = [x for x in lines if hashlib.md5(x.strip(SPACE).encode().lower()).digest() not in keys]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def dedup_lines(docs: DataFrame, index: LineIndex, prefix: str = "") -> DataFrame:
    """`docs` (doc_id, text and others) with `kept` (the other lines, joined), `n_lines` before and
    `n_dropped`; these names get `prefix`, and replace columns of the same names. `docs` must be
    in the index. Null or empty texts are one empty line; rows with a null doc_id keep all
    lines; repeated doc_ids are one document, each row loses the same lines; no rows in, no
    rows out."""
    made = [prefix + c for c in ("kept", "n_lines", "n_dropped")]
    docs = docs.drop(*made)
    prefix = free_prefix([*docs.columns, *made], ["id", "keys"])
    key, held = f"{prefix}id", f"{prefix}keys"
    lost = stored(drops(index, index.postings), "lost").select(F.col("doc_id").alias(key), F.col("keys").alias(held))
    # Many documents lose lines, so this side is seldom small: one plan for every size.
    joined = docs.join(lost.hint("merge"), docs["doc_id"] == lost[key], "left").drop(key)
    names = docs.columns
    schema = T.StructType([*docs.schema, *[T.StructField(c, t()) for c, t in zip(made, (T.StringType, T.LongType, T.LongType), strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                _kept(t, set(k or ()))
                for t, k in zip(batch.column("text").to_pylist(), batch.column(held).to_pylist(), strict=True)
            ]
            kept, n, cut = zip(*rows, strict=True) if rows else ((), (), ())
            more = [pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(cut, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + more, [*names, *made])

    return joined.mapInArrow(run, schema)


LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {docs}),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
live AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40
         GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, coalesce(doc_id <> last_doc, false) AS gone FROM k LEFT JOIN live USING (key))"""


@query("op3_line_dedup", LINES_SQL.format(docs="documents") + """
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after, and a digest of the text that stays, per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs, build(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
