"""Surrogates for personal data: keyed replacements of the same type, script and format.

A mention is reduced to its entity (type and normal form), so the same person or number gets
the same surrogate in every document and spelling. A name is told by a form of address; each of its
words is an entity with the gender, and where a word comes back in the document without a form
of address, capitalised, it is replaced as well. Surrogates come from HMAC-SHA256 under a
key and are written back in the mention's own format: digits, letter case, separators, an
address's top domain, a card's first digit and checksum, a private network, a name's
gender and alphabet.

Collisions are looked for over the distinct entities of the whole corpus: two entities with one
surrogate, or a surrogate that is itself a real entity. All but the smallest of such a group
try their next surrogate until none is left. A form may have too few surrogates for its
entities; after LONGER tries they grow with every fourth try, so an end is always found. The few entities with later tries are sent to the
tasks that write the texts while their number is under a bound, and joined by document beyond it.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.names import free_prefix
from footfall.llm.registry import query, table
from footfall.session import stored

KEY = b"surrogates of footfall"
SENT_ENTITIES = 100_000
LONGER = 12  # tries after which surrogates leave their length, as their form may be full

# Forms of address by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Mlle", "Madame", "Señora", "Señorita", "Sra", "Doña", "Signora", "Госпожа", "Κυρία")
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Κύριος")
ALPHABETS = {"latin": ("bdfglmnprstv", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστφ", "αεηιου")}

DOTTED = ("Mr", "Mrs", "Ms", "Mme", "Mlle", "Sr", "Sra")  # short forms, often with a full stop

_TITLE = "|".join(
    t + r"\.?" * (t in DOTTED) for t in sorted(FEMALE + MALE + tuple(t.upper() for t in FEMALE + MALE), key=len, reverse=True))
_TITLES = {x for t in FEMALE + MALE for x in (t, t.upper())}
# Beginnings of access keys; they stay, as they are the key's type.
_KEYS = "AKIA|ASIA|AIza|ghp_|gho_|ghs_|glpat-|sk-|xoxb-|xoxp-|eyJ"
# A capital is told by having a lower-case form; classes here are what \w holds less digits.
_WORD = r"[^\W\d_]+(?:['’-](?![sS]\b)[^\W\d_]+)*"
_OCTET = r"25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<secret_body>(?=[+/_.~-]*[A-Za-z0-9])[A-Za-z0-9+/_.~-]{6,}=*)",
    "key": rf"\b(?:{_KEYS})[A-Za-z0-9_-]{{16,}}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "ip": rf"(?<![\d.])(?:{_OCTET})(?:\.(?:{_OCTET})){{3}}(?![\d]|\.\d)",
    "card": r"(?<![\w.])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w])",
    "name": rf"\b(?:{_TITLE}) (?P<name_body>{_WORD}(?: {_WORD}){{0,2}})",
}
FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_WORTH = re.compile(rf"[0-9@=:]|\b(?:{_TITLE}) |\b(?:{_KEYS})")


def folded(name: str) -> str:
    return name.casefold().replace("’", "'")


def entity(m: re.Match) -> tuple[str, str, int, int] | None:
    """(type, normal form, start, end) of a match: what is replaced, and what makes two mentions one."""
    kind = m.lastgroup.removesuffix("_body")
    body = f"{kind}_body" if kind in ("secret", "name") else kind
    text, start, end = m[body], m.start(body), m.end(body)
    if kind == "name":
        words = []
        for w in text.split(" "):
            if not w[0].isupper() or words and w in _TITLES:
                break
            words.append(w)
        if not words:
            return None
        text = " ".join(words)
        title = m["name"][:start - m.start("name")].rstrip(" .")
        title = title.capitalize() if title.isupper() else title
        # Gender is part of the entity: one family name may be a man's and a woman's.
        return kind, ("f" if title in FEMALE else "m") + "|" + folded(text), start, start + len(text)
    if kind == "email":
        return kind, text.lower(), start, end
    if kind in ("card", "ssn", "iban"):
        return kind, re.sub(r"[ -]", "", text), start, end
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        return kind, digits[1:] if len(digits) == 11 and digits[0] == "1" else digits, start, end
    return kind, text, start, end


def entities(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Entities of a whole text from left to right, not overlapping. Words of a name that come back
    without a form of address are entities of their own, with the gender of their first mention."""
    if not _WORTH.search(text):
        return
    found, at = [], 0
    while m := FIND.search(text, at):
        e = entity(m)
        found += [e] if e else []
        # What follows a name may begin another one.
        at = m.end() if m.lastgroup != "name" else e[3] if e else m.start("name_body")
    gender: dict[str, str] = {}
    for kind, normal, _, _ in found:
        if kind == "name":
            g, _, words = normal.partition("|")
            for w in words.split(" "):
                if len(w) > 1:
                    gender.setdefault(w, g)
    if not gender:
        yield from found
        return
    again = re.compile(r"(?<!\w)(?:" + "|".join(
        re.escape(w).replace("'", "['’]") for w in sorted(gender, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    at = 0
    for e in [*found, None]:
        for m in again.finditer(text, at, e[2] if e else len(text)):
            g = gender.get(folded(m[0]))
            if g and m[0][0].isupper() and (not e or m.end() <= e[2]):
                yield "name", f"{g}|{folded(m[0])}", m.start(), m.end()
        if e:
            yield e
            at = e[3]


def parts(kind: str, normal: str) -> list[str]:
    """What is settled of an entity: the words of a name with their gender, else the entity."""
    if kind != "name":
        return [normal]
    gender, _, words = normal.partition("|")
    return [f"{gender}|{w}" for w in words.split(" ")]


class Stream:
    """Pseudo-random numbers from HMAC-SHA256 of an entity and a try."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        self.seed, self.key, self.block, self.left = f"{kind}|{attempt}|{normal}".encode("utf-8", "replace"), key, 0, 0
        self.bits = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            self.bits = int.from_bytes(hmac.digest(self.key, b"%d|" % self.block + self.seed, "sha256"), "big")
            self.left, self.block = 1 << 256, self.block + 1
        self.bits, out = divmod(self.bits, n)
        self.left //= n
        return out

    def like(self, c: str) -> str:
        """A character of the same class: digit, or letter of the same case; others stay."""
        if c.isascii() and c.isdigit():
            return chr(48 + self.below(10))
        if c.isascii() and c.isalpha():
            return chr((65 if c.isupper() else 97) + self.below(26))
        return c


def _luhn(digits: str) -> int:
    twice = [int(d) * 2 for d in digits[-1::-2]]
    return (sum(t - 9 * (t > 9) for t in twice) + sum(int(d) for d in digits[-2::-2])) % 10


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """Normal form of the surrogate of an entity: of its type, its length (names: word count) and form.
    From try LONGER on it is longer (an address: of a wider net, at last of the other version)."""
    s = Stream(key, kind, normal, attempt)
    extra = 0 if attempt < LONGER else 1 + (attempt - LONGER) // 4
    if kind == "email":
        local, _, domain = normal.rpartition("@")
        host, _, top = domain.rpartition(".")
        # The domain has a stream of its own: people of one domain stay together.
        d = Stream(key, "domain", domain, 0)
        return "".join(map(s.like, local + "a" * extra)) + "@" + "".join(map(d.like, host)) + "." + top
    if kind == "ip":
        ip = ipaddress.IPv4Address(normal)
        if extra > 4:
            return str(ipaddress.IPv6Address((0xFD << 120) + s.below(1 << 120)))
        if extra > 2:
            return str(ipaddress.IPv4Address(s.below(1 << 32)))
        if extra and not ip.is_global:
            return str(ipaddress.IPv4Network("10.0.0.0/8")[1 + s.below((1 << 24) - 2)])
        for net in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"):
            if ip in (n := ipaddress.IPv4Network(net)):
                return str(n[1 + s.below(n.num_addresses - 2)])
        while True:
            out = ipaddress.IPv4Address(s.below(1 << 32))
            if out.is_global and not out.is_multicast:
                return str(out)
    if kind == "card":
        body = normal[0] + "".join(map(s.like, normal[1:-1] + "0" * extra))
        if _luhn(normal[:-1]) == (10 - int(normal[-1])) % 10:
            return body + str((10 - _luhn(body)) % 10)
        return body + s.like("0")
    if kind == "iban":
        country, body = normal[:2], "".join(map(s.like, normal[4:] + "0" * extra))
        number = "".join(str(int(c, 36)) for c in body + country + "00")
        return f"{country}{98 - int(number) % 97:02d}{body}"
    if kind == "phone":
        return "".join(str(2 + s.below(8)) if i == 0 else s.like(c) for i, c in enumerate(normal + "0" * extra))
    if kind == "name":
        if " " in normal:  # words have surrogates of their own
            return normal[:2] + " ".join(surrogate(key, kind, p, attempt)[2:] for p in parts(kind, normal))
        gender, _, word = normal.partition("|")
        made = []
        for w in re.split("(['-])", word):
            if w in "'-":
                made.append(w)
                continue
            consonants, vowels = ALPHABETS[script_of(w)]
            n = max(2, min(4, len(w) // 2)) + extra
            made.append("".join(consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))] for _ in range(n)))
        # A name's words show the gender: women's end in a vowel, men's in a consonant.
        made[-1] = made[-1][:-1] + vowels[0] if gender == "f" else made[-1] + consonants[s.below(len(consonants))]
        return gender + "|" + "".join(made)
    if kind == "key":
        prefix = re.match(_KEYS, normal)[0]
        return prefix + "".join(map(s.like, normal[len(prefix):] + "a" * extra))
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", normal) and not normal.isdigit():
        digits = "0123456789abcdef" if normal.islower() else "0123456789ABCDEF"
        return "".join(digits[s.below(16)] for _ in range(len(normal) + extra))
    more = "0" * extra if kind == "ssn" or normal.isdigit() else "a" * extra
    return "".join(map(s.like, normal + more))


def written(kind: str, mention: str, normal: str, new: str) -> str:
    """The surrogate's normal form in the format of a mention of `normal`."""
    if kind == "name":
        words = new.partition("|")[2].split(" ")
        out = []
        for w, m in zip(words, mention.split(" "), strict=True):
            w = w.upper() if m.isupper() and len(m) > 1 else re.sub(r"[^'-]+", lambda x: x[0].capitalize(), w)
            out.append(w.replace("'", "’") if "’" in m else w)
        return " ".join(out)
    if kind == "email":
        cased = len(mention) == len(new)
        return "".join(n.upper() if m.isupper() else n for n, m in zip(new, mention, strict=True)) if cased else new
    if kind in ("card", "ssn", "iban", "phone"):
        skip = sum(c.isalnum() for c in mention) - len(normal)  # a leading 1 that the entity leaves out
        fresh, out = iter(new), []
        for c in mention:
            if c.isalnum():
                skip -= 1
                out.append(c if skip >= 0 else next(fresh))
            else:
                out.append(c)
        return "".join([*out, *fresh])
    return new


def rewrite(text: str, key: bytes, later: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and how many; `later` has the try of entities past their first."""
    out, at, n = [], 0, 0
    for kind, normal, start, end in entities(text):
        new = [surrogate(key, kind, p, later.get((kind, p), 0)) for p in parts(kind, normal)]
        new = new[0] + "".join(" " + x[2:] for x in new[1:])
        out += [text[at:start], written(kind, text[start:end], normal, new)]
        at, n = end, n + 1
    return "".join([*out, text[at:]]) if n else text, n


def distinct_entities(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, kind, normal) of `docs` (doc_id, text); of a name, its words."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (d, k, n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t
                for k, n in {(k, p) for k, n, _, _ in entities(t) for p in parts(k, n)}
            ]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                ["doc_id", "kind", "normal"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, kind string, normal string")


def settle(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, normal, attempt, surrogate) of distinct entities `found` (kind, normal): surrogates are
    distinct and none is an entity of `found`. Each round looks at entities and surrogates
    only; it ends when no entity has to try again, which longer surrogates make sure of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, normals, tries = (c.to_pylist() for c in batch.columns)
            new = [surrogate(key, k, n, a) for k, n, a in zip(kinds, normals, tries, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "normal", "attempt", "surrogate"])

    state = found.select("kind", "normal", F.lit(0).alias("attempt"))
    while True:
        tried = stored(state.mapInArrow(run, "kind string, normal string, attempt int, surrogate string"), "tried")
        shared = tried.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("normal").alias("first")).where("n > 1")
        taken = tried.join(shared, ["kind", "surrogate"]).where("normal <> first").select("kind", "normal")
        real = tried.join(found.select("kind", F.col("normal").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "normal")
        again = stored(taken.unionByName(real).distinct().withColumn("again", F.lit(1)), "again")
        if again.isEmpty():
            return tried
        state = tried.join(again, ["kind", "normal"], "left").select(
            "kind", "normal", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))


def replace_entities(docs: DataFrame, key: bytes = KEY, sent: int = SENT_ENTITIES) -> DataFrame:
    """`docs` with `text` rewritten and `n_entities` (long) added, other columns kept; a column
    n_entities is replaced.

    Null texts stay null with 0 entities; texts without entities are not touched. Equal rows
    are rewritten alike; a null doc_id is allowed. Empty tables give empty results."""
    docs = docs.drop("n_entities")
    mentions = stored(distinct_entities(docs), "mentions")
    settled = settle(stored(mentions.select("kind", "normal").distinct(), "entities"), key)
    later = stored(settled.where("attempt > 0").select("kind", "normal", "attempt"), "later")
    names = docs.columns
    prefix = free_prefix(names, ["id", "later"])
    own_id, own_later = f"{prefix}id", f"{prefix}later"
    few = later.limit(sent + 1).count() <= sent
    if few:
        known = {(r["kind"], r["normal"]): r["attempt"] for r in later.collect()}
        rows = docs
    else:
        known = {}
        per_doc = mentions.join(later, ["kind", "normal"]).groupBy("doc_id").agg(
            F.collect_set(F.struct("kind", "normal", "attempt")).alias(own_later))
        per_doc = per_doc.withColumnRenamed("doc_id", own_id)
        rows = docs.join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own_id)), "left").drop(own_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            more = batch.column(own_later).to_pylist() if not few else [None] * batch.num_rows
            for text, own in zip(batch.column("text").to_pylist(), more, strict=True):
                tries = known if few else {(x["kind"], x["normal"]): x["attempt"] for x in own or ()}
                text, n = (None, 0) if text is None else rewrite(text, key, tries)
                texts.append(text)
                counts.append(n)
            made = {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(
                [made.get(c, batch.column(c)) for c in names] + [pa.array(counts, pa.int64())], [*names, "n_entities"])

    return rows.mapInArrow(run, T.StructType([*docs.schema, T.StructField("n_entities", T.LongType())]))


@query("op2_surrogates")
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data and secrets."""
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
