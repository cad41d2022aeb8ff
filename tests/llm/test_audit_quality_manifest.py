"""Filter interaction, line frequency and Merkle manifest against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall.llm import interaction, linequality, manifest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Filter interaction


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_intervals_cover_what_each_order_removes(n):
    orders = list(itertools.permutations(range(n)))
    assert [interaction.lehmer_rank(p, n) for p in orders] == list(range(len(orders)))
    got = defaultdict(set)
    for mask, step, a, b in interaction.cover(n):
        span = set(range(a, b))
        assert a < b and not span & got[mask, step]
        got[mask, step] |= span
    for mask in range(1, 1 << n):
        for r, p in enumerate(orders):
            first = next(i for i, f in enumerate(p, 1) if mask >> f & 1)
            assert [s for s in range(1, n + 1) if r in got[mask, s]] == [first]


def brute_audit(rows, letters):
    """(part, order, step) -> kept, removed, redundant, unique_fails, shapley of rows (part, letters failed)."""
    out, shap = {}, Counter()
    for part in {p for p, _ in rows}:
        mine = [m for p, m in rows if p == part]
        for order in map("".join, itertools.permutations(letters)):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m]
                left = [m for m in left if f not in m]
                shap[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in m for m in mine) - len(gone), sum(m == f for m in mine), f]
    return {k: (*v[:4], shap[k[0], v[4]]) for k, v in out.items()}


def audited(frame, letters, tallies=()):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in interaction.audit(frame, letters, tallies).collect()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), "".join(x for x in "PQRS" if rng.random() < 0.4)) for _ in range(200)] + [("clean", "")] * 3
    counts = spark.createDataFrame([(p, sum(1 << "PQRS".index(x) for x in m), 1) for p, m in rows], "part string, mask int, n long")
    assert audited(counts, "PQRS") == brute_audit(rows, "PQRS")
    assert audited(counts.limit(0), "PQRS") == {}


def test_audit_refuses_unclear_letters(spark):
    frame = spark.createDataFrame([], "part string, mask int, n long")
    for letters in ("", "BA", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            interaction.audit(frame, letters)


def brute_flags(rows):
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        out.append("".join(x for x, f in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)),
            d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows)), strict=True) if f))
    return out


def test_documents_with_nulls_ties_and_repeats(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(1, long, "s"), (2, long, "t"), (2, long, "t"), (1, long, "s"), (None, long, "s"), (3, None, None), (4, "", "s"), (5, "Ab # ", ""),
            (6, "same " * 300, "s"), (7, long + " x\x85y", "s"), (8, long.upper(), "s"), (9, "é😀 " * 200, "t")]
    names = "doc_id long, text string, source string, mask long, digest string, first long, part string, words long, n long"
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4) for r in rows], names)
    want = Counter((d, s or "", m) for (d, _, s), m in zip(rows, brute_flags(rows), strict=True))
    got = interaction.flags(docs)
    letters = {i: "".join(x for j, x in enumerate("ABCDE") if i >> j & 1) for i in range(32)}
    assert Counter((r.doc_id, r.part, letters[r["mask"]]) for r in got.collect()) == want
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    told = {(r.part, letters[r["mask"]]): (r.n, r.good, r.toxic) for r in interaction.counted(got, labels).collect()}
    sums = defaultdict(lambda: [0, 0, 0])
    for (d, p, m), n in want.items():
        s = sums[p, m]
        s[0], s[1], s[2] = s[0] + n, s[1] + n * (d in (1, 2)), s[2] + n * (d == 2)
    assert told == {k: tuple(v) for k, v in sums.items()}
    assert interaction.counted(interaction.flags(docs.limit(0)), labels).count() == 0


# Line frequency


def plain_key(line):
    words = WORD.findall(line)
    return re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(words))) if words else None


def brute_base(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAb 1\n\t\x0b\x1c\x85 é😀#<|", max_size=60))
def test_base_figures(text):
    assert linequality.measure(text)[:5] == brute_base(text)
    assert {k for k, _ in linequality.measure(text)[5]} == {
        hashlib.md5(k.encode()).digest() for k in map(plain_key, text.split("\n")) if k is not None}


def brute_verdicts(rows, line_docs):
    holders = defaultdict(set)
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            holders[s or "", plain_key(line)].add(d)
    out = []
    for d, t, s in rows:
        n, *_, rep = base = brute_base(t)
        lost = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if plain_key(x) and len(holders[s or "", plain_key(x)] - {None}) > line_docs)
        failed = n < 10 or 100 * rep > 20 * n
        out.append((d, *base, lost, failed, not failed and n - lost >= 10 and 2 * (n - lost) >= n))
    return out


def line_rows():
    rng = random.Random(12)
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 12, 40])))
    menus = ["Home |  About 2024", "home | about 1999\r", "Read more", "All rights reserved by the owners of this page since 2001 or so it seems"]
    rows = [(i, "\n".join([own(), rng.choice(menus), "", rng.choice(menus)]), rng.choice(["a", "a", "b", None])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "x y " * 20, "a"), (None, f"{own()}\n{menus[2]}", "a"), (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2])]
    return rows


def line_frame(spark, rows):
    names = "doc_id long, text string, source string, host string, t string, lines long, kept string, row long, n_lost_words string, keys long, id long"
    return spark.createDataFrame([(*r, "h", "t", 1, "k", 2, "n", 3, 4) for r in rows], names)


def test_verdicts_equal_brute_force(spark):
    rows = line_rows()
    frame = line_frame(spark, rows)
    want = brute_verdicts(rows, 6)
    assert 5 < sum(w[-1] for w in want) < len(rows) - 5
    assert Counter(map(tuple, linequality.verdicts(frame, line_docs=6).collect())) == Counter(want)
    assert linequality.verdicts(frame.limit(0)).count() == 0
    done = linequality.clean(frame, line_docs=6)
    assert done.columns == frame.columns
    holders = defaultdict(set)
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            holders[s or "", plain_key(line)].add(d)
    texts = Counter(
        (d, s, "\n".join(x for x in t.split("\n") if not plain_key(x) or len(holders[s or "", plain_key(x)] - {None}) <= 6))
        for (d, t, s), w in zip(rows, want, strict=True) if w[-1])
    assert Counter((r.doc_id, r.source, r.text) for r in done.collect()) == texts
    assert {(r.host, r.row, r.keys) for r in done.select("host", "row", "keys").collect()} == {("h", 2, 3)}


def test_limit_follows_the_size_of_a_host(spark):
    rows = [(i, f"{'q' * i}word a b c d e f g h i\nshared line", "big" if i < 90 else "small") for i in range(100)]
    got = {r.doc_id: r.n_lost_words for r in linequality.verdicts(line_frame(spark, rows), line_docs=2, line_per=1).collect()}
    assert not any(got.values())  # nothing is in more than all documents of a host
    got = {r.doc_id: r.n_lost_words for r in linequality.verdicts(line_frame(spark, rows), line_docs=20, line_per=2).collect()}
    assert got == {i: 2 * (i < 90) for i in range(100)}


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(hashes, width):
    """Root, and for each leaf its steps (left siblings, right siblings)."""
    steps, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // width * width
            steps[i].append(("".join(level[run:p]), "".join(level[p + 1:run + width])))
        level = [sha("".join(level[i:i + width])) for i in range(0, len(level), width)]
        at = [p // width for p in at]
    return level[0], steps


def brute_manifest(rows, width):
    by = defaultdict(list)
    for doc_id, source, lang, n, text in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text) if hit and text is not None else text
        by[source].append((doc_id, plain_leaf((doc_id, source, lang, n, text)), plain_leaf((doc_id, source, lang, n, low))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in by.values():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [plain_tree([x[1] for x in by[s]], width) for s in order]
    root, over = plain_tree([t[0] for t in trees], width)
    out = []
    for s, (sub, steps), up in zip(order, trees, over, strict=True):
        for (doc_id, leaf, other), own in zip(by[s], steps, strict=True):
            h = other
            for a, b in own + up:
                h = sha(a + h + b)
            out.append((doc_id, leaf, sub, root, sha("".join(a + b for a, b in own + up)), h, h == root))
    return out


@pytest.mark.parametrize("n, width", [(1, 16), (16, 16), (17, 16), (300, 16), (90, 3)])
def test_manifest_equals_brute_force(spark, n, width):
    rng = random.Random(n)
    rows = [(i, rng.choice(["s", "é", "z" * 30, "", None] if i < n // 4 else ["hot"]), rng.choice(["en", None]), i % 7 or None, rng.choice(
        ["Text", None, "", "lower", "ÄB\n"])) for i in range(n)]
    if n > 20:
        rows += [(3, "hot", "en", 1, "Again"), (3, "hot", "en", 1, "Again"), (None, "hot", None, None, None)]
        rows += [(1000 + i, f"one{i}", "en", 1, "X") for i in range(20)]
    names = "doc_id long, source string, lang string, n_chars long, text string, tree long, rank long, path long, lo string, root string, _root long, hash long, first long"
    frame = spark.createDataFrame([(*r, 1, 2, 3, "x", "y", 4, 5, 6) for r in rows], names)
    done = manifest.manifest(frame, width, manifest.tampered_text(F.col("doc_id"), F.col("text")))
    got = done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == Counter(brute_manifest(rows, width))
    if n == 300:
        assert {r.verified for r in got} == {True, False}
        assert {r.verified for r in manifest.manifest(frame, width).collect()} == {True}
        assert manifest.manifest(frame.limit(0)).count() == 0
