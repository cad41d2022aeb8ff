"""SimHash near-duplicates by segment bit counts.

A fingerprint of 64 bits is embedded as the bit counts of its 32 segments of two bits. Counts
of two fingerprints differ, summed over segments, by at most their Hamming distance, so the
Manhattan distance is a lower bound. The grid of that space is searched in projections: two
differing bits move at most two of four blocks of eight segments, so linked fingerprints lie
in the same cell of at least one of the six projections on two blocks. Candidates of a cell
are cut by the Manhattan bound and then verified on the bits.

A crowded cell (near copies of one text) would give all pairs. Its fingerprints meet at
midpoints instead: two fingerprints differ in at most two bits if and only if some word is
within one bit of both, at most 65 fingerprints surround a word, and each has 65 such words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.components import components
from footfall.llm.registry import query, table
from footfall.session import stored

SHINGLE = 3
RADIUS = 2
CROWD = 64
_LANES = (np.arange(8, dtype=np.uint16) * 256)[None, :]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text's word shingles (XXH64, seed 42): a bit is set if it is in
    over half of them. Words are cut at ASCII space; only A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    digest = xxhash.xxh64_intdigest
    join = b" ".join
    hashes = np.fromiter(
        (digest(join(s), 42) for s in zip(*[words[i:] for i in range(size)])), dtype=np.uint64,
        count=len(words) - size + 1)
    lanes = hashes.view(np.uint8).reshape(-1, 8) + _LANES
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * ones.ravel() > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of `docs` (doc_id, text); fp is the fingerprint as a signed long.
    A text that is null, empty or without words has fingerprint zero."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(
                (simhash(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column(1)),
                dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, fp long")


def _shift(c: Column, n: int) -> Column:
    return F.shiftrightunsigned(c, n)


def segment_counts(fp: Column) -> Column:
    """The embedding: 32 fields of two bits, each the bit count of that segment of `fp`."""
    odd, next_bit = F.lit(0x5555555555555555), _shift(fp, 1)
    one = fp.bitwiseXOR(next_bit).bitwiseAND(odd)
    two = fp.bitwiseAND(next_bit).bitwiseAND(odd)
    return one.bitwiseOR(F.shiftleft(two, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings: fields 0, 1, 2 that differ in both bits or the low
    one are one apart, in the high bit alone two."""
    x, odd = a.bitwiseXOR(b), F.lit(0x5555555555555555)
    low, high = x.bitwiseAND(odd), _shift(x, 1).bitwiseAND(odd)
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def links(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) links among the distinct fingerprints of `classes` (fp). Every pair within RADIUS bits
    is connected by these links and every link is within RADIUS; not all pairs are listed."""
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    masks = [blocks[i] | blocks[j] for i in range(4) for j in range(i + 1, 4)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    seg = segment_counts(F.col("fp"))
    cells = classes.select("fp", seg.alias("seg"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("plane"), seg.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(signed)
    ])).alias("at")).select("fp", "seg", "at.plane", "at.cell")
    crowded = stored(cells.groupBy("plane", "cell").count().where(F.col("count") > crowd), "crowded")
    few = cells.join(crowded, ["plane", "cell"], "left_anti")
    a, b = few.alias("a"), few.alias("b")
    close = a.join(b, [
        F.col("a.plane") == F.col("b.plane"), F.col("a.cell") == F.col("b.cell"), F.col("a.fp") < F.col("b.fp"),
        manhattan(F.col("a.seg"), F.col("b.seg")) <= RADIUS,
        F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS,
    ]).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    one = [F.lit(0).cast("long")] + [F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)]
    crowd_fps = cells.join(crowded, ["plane", "cell"], "left_semi").select("fp").distinct()
    around = crowd_fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(m) for m in one])).alias("mid"))
    met = around.groupBy("mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return close.unionByName(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most RADIUS bits.

    Equal fingerprints are one node. Texts without words share fingerprint zero and are linked
    like others. Rows with a null doc_id get a fingerprint and link others, but give no id: a
    component of such rows only has a null component_id. Repeated rows keep their own rows.
    Empty input gives an empty result; other columns are not read."""
    fps = stored(fingerprints(docs), "fps")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = stored(components(links(classes)), "roots")
    smallest = stored(
        roots.join(classes, roots.node == classes.fp).groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    linked = roots.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    labels = stored(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "labels")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` without the documents that have a smaller doc_id in their group; all columns. Rows
    with a null doc_id stay if their group has no id."""
    found = near_duplicates(docs)
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
