"""Quality rules with line frequency across documents: lines that too many documents of a host
share are boilerplate; they go, and documents that are depleted without them are rejected.

One pass over the texts gives, per document, the figures of the base rules and its distinct
normalised lines as 16-byte hashes. Holders of a line are counted per host by grouped sums
(the documents of one hot line are spread by document first, so no task holds them all), the
few lines above the limit meet the stored holders again, and their words are summed per
document. Texts are not shuffled for the verdicts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.registry import query, table
from footfall.session import stored

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of the words
LINE_DOCS = 20  # a line may stand in this many documents of a host,
LINE_PER = 10_000  # and in one of so many of them on larger hosts
MIN_LEFT = 50  # percent of the words that must stay
SLICE = 1000
_DIGIT = re.compile(rb"[0-9]")


def line_key(line: bytes) -> bytes | None:
    """Hash of a line: outer space off, inner space single, A-Z lower-cased, digits alike. None without a word."""
    words = line.split()
    return hashlib.md5(_DIGIT.sub(b"0", b" ".join(words).lower())).digest() if words else None


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words whose content stands at two places or more."""
    windows = list(zip(*[words[i:] for i in range(size)], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    inside = bytearray(len(words))
    mark = b"\x01" * size
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            inside[j:j + size] = mark
            inside[i:i + size] = mark
    return sum(inside)


def measure(text: str | None) -> tuple[int, int, int, int, int, list[tuple[bytes, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and (key, words) of the distinct lines."""
    raw = (text or "").encode()
    words = raw.split()
    # Code points of the words: bytes that are neither space nor a continuation.
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = raw.split(b"\n")
    full = list(compress(lines, map(bytes.strip, lines)))
    held: dict[bytes, int] = {}
    for line in full:
        key = line_key(line)
        held[key] = held.get(key, 0) + len(line.split())
    return len(words), chars, symbols, len(full) - len(set(full)), repeated_words(words), list(held.items())


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, t, the BASE figures, lines) of every row of `docs` (doc_id, text and `host`); t: hash of the text."""
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64("text").alias("t"), "text")
    held = pa.list_(pa.struct([("key", pa.binary()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                *figures, lines = zip(*map(measure, part.column("text").to_pylist()), strict=True)
                lines = [[{"key": k, "words": n} for k, n in x] for x in lines]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *[pa.array(f, pa.int64()) for f in figures], pa.array(lines, held)],
                    ["doc_id", "host", "t", *BASE, "lines"])

    schema = T.StructType([*rows.schema.fields[:3], *[T.StructField(c, T.LongType()) for c in BASE], T.StructField(
        "lines", T.ArrayType(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("words", T.LongType())])))])
    return rows.mapInArrow(run, schema)


def frequent_lines(rows: DataFrame, line_docs: int = LINE_DOCS, line_per: int = LINE_PER) -> DataFrame:
    """(host, key) of the lines of `rows` (measured()) in more distinct documents of their host than
    `line_docs` and than one in `line_per` of its documents. Rows without a doc_id are counted for no line."""
    docs = rows.where("doc_id IS NOT NULL").select("host", "doc_id", "lines")
    size = docs.select("host", "doc_id").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    held = docs.select("host", F.explode("lines.key").alias("key"), "doc_id").distinct()
    many = stored(held.groupBy("host", "key").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > line_docs), "many")
    return many.join(size, "host").where(F.col("holders") > F.floor(F.col("docs") / F.lit(line_per))).select("host", "key")


def base_failed() -> Column:
    """The base rules over the figures of measured()."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def lost_lines(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, host, t, keys, n_lost_words) of the rows (measured()) that hold lines of `frequent`."""
    held = rows.select("doc_id", "host", "t", F.inline("lines"))
    return held.join(frequent, ["host", "key"]).distinct().groupBy("doc_id", "host", "t").agg(
        F.collect_list("key").alias("keys"), F.sum("words").alias("n_lost_words"))


def _with_lost(rows: DataFrame, lost: DataFrame) -> DataFrame:
    names = ("doc_id", "host", "t")
    lost = lost.select(*[F.col(c).alias(f"_{c}") for c in names], "n_lost_words")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("host") == F.col("_host")) & (F.col("t") == F.col("_t"))
    return rows.join(lost.hint("merge"), same, "left").drop(*[f"_{c}" for c in names])


def verdicts(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_per: int = LINE_PER) -> DataFrame:
    """(doc_id, the BASE figures, n_lost_words, base_failed, kept) of every row of `docs` (doc_id, text, `host`).

    kept: the base rules hold, and without its frequent lines the document still has MIN_WORDS
    words and MIN_LEFT percent of its own. Null text is the empty one and fails; a null host
    counts as the host ''; repeated rows are one holder of their lines and are judged alike; a row
    without a doc_id loses lines but is counted for none; no rows in, no rows out. Other columns
    are not read, whatever their names. A text that more than `line_docs` documents of a host copy
    loses all its lines and is rejected with its copies: dedup comes first where one is to stay."""
    rows = stored(measured(docs, host), "measured")
    frequent = stored(frequent_lines(rows, line_docs, line_per), "frequent")
    done = _with_lost(rows.drop("lines"), lost_lines(rows, frequent).drop("keys"))
    lost = F.coalesce("n_lost_words", F.lit(0)).cast("long")
    left = F.col("n_words") - F.col("n_lost_words")
    full = (left >= MIN_WORDS) & (100 * left >= MIN_LEFT * F.col("n_words"))
    return done.withColumn("n_lost_words", lost).select(
        "doc_id", *BASE, "n_lost_words", base_failed().alias("base_failed"), (~base_failed() & full).alias("kept"))


def _without(text: str | None, keys: set[bytes]) -> str:
    return "\n".join(x for x in (text or "").split("\n") if line_key(x.encode()) not in keys) if keys else text or ""


def clean(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_per: int = LINE_PER) -> DataFrame:
    """The rows of `docs` that verdicts() keeps, all columns, their texts without frequent lines."""
    rows = stored(measured(docs, host), "measured")
    frequent = stored(frequent_lines(rows, line_docs, line_per), "frequent")
    lost = stored(lost_lines(rows, frequent), "lost")
    left = F.col("n_words") - F.coalesce("n_lost_words", F.lit(0))
    stay = ~base_failed() & (left >= MIN_WORDS) & (100 * left >= MIN_LEFT * F.col("n_words"))
    good = _with_lost(rows.drop("lines"), lost.drop("keys")).where(stay).select("doc_id", "host", "t").distinct()
    told = good.join(lost.drop("n_lost_words"), good["doc_id"].eqNullSafe(lost["doc_id"]) & (good["host"] == lost["host"])
                     & (good["t"] == lost["t"]), "left").select(good["doc_id"].alias("id"), good["host"], good["t"], "keys")
    # The row travels as one value, so its columns may have any names.
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("rid"), F.xxhash64("text").alias("rt"),
                        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("rhost"))
    same = F.col("rid").eqNullSafe(F.col("id")) & (F.col("rt") == F.col("t")) & (F.col("rhost") == F.col("host"))
    joined = whole.join(told.hint("merge"), same).select("row", F.col("row.text").alias("text"), "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t, set(k or ())) for t, k in zip(
                batch.column("text").to_pylist(), batch.column("keys").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    done = joined.mapInArrow(run, T.StructType([joined.schema["row"], T.StructField("text", T.StringType())]))
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


@query("op12_line_quality", """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM d WHERE len(words) >= 5),
w AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 4], ' ')) AS n FROM p),
rep AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM w WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS words
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)),
k AS (SELECT doc_id, host, line, len(words)::BIGINT AS n, regexp_replace(translate(array_to_string(words, ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS key FROM l WHERE len(words) > 0),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM k GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
freq AS (SELECT k.host, k.key FROM k JOIN hosts USING (host) GROUP BY k.host, k.key
  HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > any_value(docs) // 10000),
lost AS (SELECT doc_id, sum(n)::BIGINT AS n_lost_words FROM k SEMI JOIN freq USING (host, key) GROUP BY doc_id),
f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_lost_words >= 10
    AND 100 * (n_words - n_lost_words) >= 50 * n_words AS kept FROM f""")
def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and line frequency per source, over all documents."""
    return verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
