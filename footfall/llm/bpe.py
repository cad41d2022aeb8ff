"""Byte-level BPE by merge replay.

Tasks read documents in batches. The distinct words of a batch that the task has not met yet
are encoded together: their bytes are laid out as one row of tokens, an index from pair to
the positions where it stands is built once, and merges are applied in the order of their
ranks, each at all its positions, looking again only at the two neighbours that a merge
touches. Words are numbered once per batch, looked up once per number, and the ids of all
documents gathered as arrays. Nothing is shuffled, the table of known words is bounded, and
words are independent, so the batch that a document falls into does not change its ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

import public_tokenizers
from footfall.llm.memory import give_back, small_batches
from footfall.llm.registry import query, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
KNOWN_WORDS = 80_000
CHUNK_CHARS = 1 << 19
SLICE = 1024
REPLAY_BYTES = 1 << 17  # of words whose merges are replayed together: arrays take a hundred times their bytes
_ANY = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_WIDE = f"^ | $| {_ANY}|{_ANY} "  # a space that is not single or stands at an end


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token's bytes in a rank file (base64, space, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


PAIR = 1 << 20  # left id * PAIR + right id names a pair


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of every pair of tokens whose bytes together are a token."""
    get = ranks.get
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = get(token[:i]), get(token[i:])
            if left is not None and right is not None:
                out[left * PAIR + right] = rank
    return out


class Pairs:
    """Rank of a pair of tokens by its number: a dictionary for single pairs, a sorted table for many at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)])  # id of each byte
        self.bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])  # -1: no merge
        self.known = pair_ranks(ranks)
        self.keys = np.array(sorted(self.known), np.int64)
        self.values = np.array([self.known[k] for k in self.keys.tolist()], np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


def _firsts(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which entries, in the order of their ranks, have the lowest rank of their word."""
    order = np.argsort(word, kind="stable")
    w, r = word[order], rank[order]
    heads = np.flatnonzero(np.diff(w, prepend=-1))
    out = np.empty(len(word), bool)
    out[order] = r == np.repeat(r[heads], np.diff(heads, append=len(w)))
    return out


def replay(words: list[bytes], pairs: Pairs, few: int = 24) -> list[bytes]:
    """Ids of each word (none is empty), four bytes each: its merges, lowest rank first, leftmost among equals.

    All words are one row of tokens. The index lists, rank by rank, the places where a pair of that
    rank begins; it is built once and read from its lowest ranks on, some thousand places at a time.
    Of these each word takes those of its own lowest rank, until none is left: words do not touch
    one another, so merges of many ranks are applied at once, as arrays where there are `few` places
    or more. Only the two neighbours of a merged place are looked at again and enter the index."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    if not len(raw):
        return []
    ends = np.cumsum([len(w) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = len(raw)
    now = np.full(n, -1, np.int32)  # rank of the pair that begins here
    now[:-1] = pairs.bytes[raw[:-1], raw[1:]]
    now[ends - 1] = -1
    word = np.repeat(np.arange(len(words), dtype=np.int32), ends - starts)
    ids, after, before = pairs.single[raw].astype(np.int32), np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends - 1] = -1
    before[starts] = -1
    get = pairs.known.get

    def merge(s: np.ndarray) -> np.ndarray:
        """Merges the pairs that begin at `s`, which ascend; the index entries that come of it."""
        if len(s) < few:
            made = []
            for i in s.tolist():
                rank, j = int(now[i]), int(after[i])
                if rank < 0:
                    continue  # the second of a run
                k, h = int(after[j]), int(before[i])
                ids[i], ids[j], now[j], now[i], after[i] = rank, -1, -1, -1, k
                if k >= 0:
                    before[k] = i
                    r = now[i] = get(rank * PAIR + int(ids[k]), -1)
                    if r >= 0:
                        made.append(r << 32 | i)
                if h >= 0:
                    r = now[h] = get(int(ids[h]) * PAIR + rank, -1)
                    if r >= 0:
                        made.append(r << 32 | h)
            return np.array(made, np.int64)
        a = after[s]
        held = np.zeros(len(s), bool)
        held[1:] = a[:-1] == s[1:]  # begins where the one before ends: of a run of these every second stays
        if held.any():
            at = np.arange(len(s))
            stay = (at - np.maximum.accumulate(np.where(held, 0, at))) % 2 == 0
            s, a = s[stay], a[stay]
        rank, k, h = now[s], after[a], before[s]
        ids[s], ids[a], now[a], now[s], after[s] = rank, -1, -1, -1, k
        right, left = np.flatnonzero(k >= 0), np.flatnonzero(h >= 0)
        before[k[right]] = s[right]
        own = rank.astype(np.int64)
        x, y = s[right], h[left]
        places = np.concatenate([x, y])
        found = pairs.ranks(np.concatenate([own[right] * PAIR + ids[k[right]], ids[y].astype(np.int64) * PAIR + own[left]]))
        now[places] = found
        stands = np.flatnonzero(found >= 0)
        return found[stands] << 32 | places[stands]

    at = np.flatnonzero(now >= 0)
    index = np.sort(now[at].astype(np.int64) << 32 | at)  # rank and place
    del at
    grown = [index[:0]]
    while len(index) or len(grown) > 1:
        if len(grown) > 1:
            index = np.sort(np.concatenate([index, *grown]), kind="stable")
            grown = [index[:0]]
        size = max(4096, len(index) >> 4)
        bound = (int(index[size]) >> 32) + 1 << 32 if size < len(index) else 1 << 62
        size = int(np.searchsorted(index, bound))
        near, index = index[:size], index[size:]
        while len(near):
            s, rank = near & 0xFFFFFFFF, near >> 32
            good = now[s] == rank
            if not good.all():
                near, s, rank = near[good], s[good], rank[good]
            first = _firsts(word[s], rank)
            s = np.sort(s[first])
            made = merge(s[np.diff(s, prepend=-1) > 0])
            grown.append(made[made >= bound])
            near = np.sort(np.concatenate([near[~first], made[made < bound]]))
    keep = ids >= 0
    flat, cuts = ids[keep].tobytes(), (4 * np.cumsum(np.add.reduceat(keep, starts, dtype=np.int64))).tolist()
    return [flat[s:e] for s, e in zip([0, *cuts], cuts, strict=False)]


class Encoder:
    """Encodes batches of texts; keeps a bounded table of pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: int = KNOWN_WORDS):
        self.ranks, self.known = ranks, known
        self.pairs = Pairs(ranks)
        self.words = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}  # ids as replay() gives them
        self.old: dict[str, bytes] = {}
        self.one = np.arange(max(ranks.values(), default=0) + 1, dtype=np.int32).tobytes()

    def wide_pieces(self, text: str) -> list[str]:
        """Parts of a text whose words can be found one part at a time: it is cut before every
        single space between two words, where the pattern always starts a new match."""
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace() and out[-1] and not out[-1][-1].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; what is new is entered into the table, with the words it is made of."""
        if len(self.young) > self.known:
            self.young, self.old = {}, self.young
        young, old, ranks = self.young, self.old, self.ranks
        made: list[tuple[str, list[str]]] = []
        todo: set[str] = set()
        for p in pieces:
            if p in young:
                continue
            ids = old.get(p)
            if ids is not None:
                young[p] = ids
            elif p[1:].isalpha() and (p[0] == " " or p[0].isalpha()):
                todo.add(p)
            else:
                words = self.words(p)
                made.append((p, words))
                todo.update(words)
        rest, raws = [], []
        for w in todo:
            if w in young:
                continue
            ids = old.get(w)
            if ids is None:
                raw = w.encode("utf-8", "replace")
                rank = ranks.get(raw)
                if rank is None:
                    rest.append(w)
                    raws.append(raw)
                    continue
                ids = self.one[4 * rank:4 * rank + 4]
            young[w] = ids
        last = np.cumsum([len(r) for r in raws])
        at = 0
        while at < len(rest):
            end = max(at + 1, int(np.searchsorted(last, (last[at - 1] if at else 0) + REPLAY_BYTES, "right")))
            young.update(zip(rest[at:end], replay(raws[at:end], self.pairs), strict=True))
            at = end
        get = young.__getitem__
        for p, words in made:
            if len(words) != 1:
                young[p] = b"".join(map(get, words))
        return list(map(get, pieces))

    def _lists(self, coded: np.ndarray, ends: np.ndarray, pieces: list[str]) -> pa.ListArray:
        """Ids of texts that end after `ends` of the pieces numbered in `coded`."""
        found = self.look_up(pieces)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        long = size[coded]
        last = np.cumsum(long)
        # Token t of the piece at place i is flat[start of that piece + t].
        at = np.repeat((np.cumsum(size) - size)[coded] - (last - long), long) + np.arange(int(last[-1]) if len(last) else 0)
        bounds = np.concatenate([[0], last])[np.concatenate([[0], ends])]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[at], pa.int32()))

    def _plain(self, texts: pa.Array) -> pa.ListArray:
        """Texts whose spaces are single and stand between two others: a piece begins at every space."""
        cut = pc.split_pattern(texts, " ")
        ends = cut.offsets.to_numpy()[1:].astype(np.int64)
        words = cut.values.dictionary_encode()
        number, size = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        number[ends - np.diff(ends, prepend=0)] += size  # the first piece of a text has no space before it
        met = np.zeros(2 * size, bool)
        met[number] = True
        used, number = np.flatnonzero(met), (np.cumsum(met) - 1)[number]
        names = words.dictionary.to_pylist()
        return self._lists(number, ends, [" " + names[i] if i < size else names[i - size] for i in used.tolist()])

    def _spaced(self, texts: list[str]) -> pa.ListArray:
        cut = [self.wide_pieces(t) for t in texts]
        words = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        ends = np.cumsum([len(c) for c in cut], dtype=np.int64)
        return self._lists(words.indices.to_numpy().astype(np.int64), ends, words.dictionary.to_pylist())

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text (none is null), in order."""
        spaced = pc.or_(pc.match_substring_regex(texts, _WIDE), pc.equal(texts, ""))
        wide, plain = np.flatnonzero(spaced.to_numpy(zero_copy_only=False)), np.flatnonzero(pc.invert(spaced).to_numpy(zero_copy_only=False))
        both = pa.concat_arrays([self._plain(texts.take(pa.array(plain))), self._spaced(texts.take(pa.array(wide)).to_pylist())])
        place = np.empty(len(texts), np.int64)
        place[np.concatenate([plain, wide])] = np.arange(len(texts))
        return both.take(pa.array(place))


@lru_cache(maxsize=2)
def _tokens(path: str) -> pa.Array:
    """Bytes of each id; null for a number that is none."""
    ranks = read_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _apply(df: DataFrame, schema: T.StructType, *steps: Step) -> DataFrame:
    """Steps one after the other in one Python worker."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return df.mapInArrow(run, schema)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most SLICE rows and CHUNK_CHARS bytes of text, or one row: ids take more room than texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = int(np.searchsorted(size, before + CHUNK_CHARS, "right"))
        end = max(at + 1, min(end, at + SLICE))
        yield batch.slice(at, end - at)
        at = end


def _encoding(path: str, pattern: str) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier stage left in this worker
        enc = _encoder(path, pattern)
        for batch in batches:
            for part in _chunks(batch):
                yield part.append_column("ids", enc.encode(pc.fill_null(part.column("text"), "")))
            give_back()
        enc.young, enc.old = {}, {}  # the worker goes on to other work
        give_back()

    return run


def _joined(ids: pa.ListArray, names: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The names of all ids one after the other, and where each list begins and the last ends."""
    told = names.take(ids.flatten())
    if told.null_count:
        raise ValueError("an id outside the vocabulary")
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    if not len(told):
        return pa.py_buffer(b""), np.zeros(len(bounds), np.int64)
    at = np.frombuffer(told.buffers()[1], np.int64)[told.offset:][:len(told) + 1]
    return told.buffers()[2], at[bounds]


def _decoding(path: str) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            told, at = _joined(ids, _tokens(path))
            # From buffers, not by pa.array() from memoryviews: that never lets go of what they view.
            out = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), told]).cast(pa.binary())
            if ids.null_count:
                out = pc.if_else(ids.is_valid(), out, None)
            yield batch.append_column("decoded", out)

    return run


def _with(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema, *[T.StructField(n, t) for n, t in more]])


IDS, DECODED = ("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` (text and others) with `ids` (array of int): the text's tokens, without special tokens.

    `vocabulary` is the path of a rank file that every executor has. Null text gives no ids, as
    does an empty one; very long texts and words are encoded whole; a column named ids is
    replaced; repeated rows and empty tables are no special case."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    docs = docs.drop("ids")
    return _apply(docs, _with(docs, IDS), _encoding(path, pattern or public_tokenizers.PATTERN))


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`rows` (ids and others) with `decoded` (binary), the bytes of the tokens in order; null ids
    give null. An id outside the vocabulary is an error; a column named decoded is replaced."""
    rows = rows.drop("decoded")
    return _apply(rows, _with(rows, DECODED), _decoding(vocabulary or public_tokenizers.path(VOCABULARY)))


def encode_and_decode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """decode(encode(docs)) in one pass over one worker."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    docs = docs.drop("ids", "decoded")
    return _apply(docs, _with(docs, IDS, DECODED), _encoding(path, pattern or public_tokenizers.PATTERN), _decoding(path))


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` (text and others) without text, with `n_tokens`, `ids` and `decodes`: whether the ids lead back to
    the text. As encode_and_decode(), but neither texts nor decoded bytes leave the worker; columns of
    these names are replaced."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    docs = docs.drop("n_tokens", "ids", "decodes", "decoded")
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = pc.equal(pc.cast(pc.fill_null(batch.column("text"), ""), pa.binary()), batch.column("decoded"))
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pc.cast(pc.list_value_length(ids), pa.int64()), ids, same], [*names, "n_tokens", "ids", "decodes"])

    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("n_tokens", T.LongType()), T.StructField(*IDS),
                           T.StructField("decodes", T.BooleanType())])
    return _apply(docs, schema, _encoding(path, pattern or public_tokenizers.PATTERN), _decoding(path), run)


def digests(docs: DataFrame, key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of encode_and_decode(); only digests leave the task."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = pa.array([f"{r}," for r in range(len(_tokens(path)))], pa.large_string())
        for batch in batches:
            ids = batch.column("ids")
            told, at = _joined(ids, decimal)
            told, at = memoryview(told), at.tolist()
            shas = [hashlib.sha256(told[s:max(s, e - 1)]).hexdigest() for s, e in zip(at, at[1:], strict=False)]
            back = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pc.cast(pc.list_value_length(ids), pa.int64()), pa.array(shas, pa.string()),
                 pa.array(back, pa.string())], names)

    schema = T.StructType([docs.schema[key], *[
        T.StructField(n, t()) for n, t in zip(names[1:], (T.LongType, T.StringType, T.StringType), strict=True)]])
    return _apply(docs.select(key, "text"), schema, _encoding(path, public_tokenizers.PATTERN), _decoding(path), run)


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
