"""The registered queries against DuckDB or brute force, and the pipeline against a plain retelling."""

from __future__ import annotations

import hashlib
import shutil
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from footfall.llm import bpe, mixing
from footfall.llm.queries import ORACLES, QUERIES
from test_near_copies import brute
from test_text_operators import brute_targets, groups, plain_fingerprint
from tests_support import compare, duck

SF = "/root/testdata/sf0.001"


def library():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(sf=SF):
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)[0] is None


def test_recall_of_op1(spark):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in QUERIES["op1_multi_index"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        assert sorted(got[ids[i]]) == list(range(1, 21))
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(got[ids[i]].values()))
    assert len(got) == (ids % 20 == 0).sum() and hit >= 0.9 * 20 * len(got)


def test_op5_equals_the_library(spark):
    own, want = library(), {}
    for d, t in texts().items():
        ids = own.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op5_bpe"](spark, SF).collect()} == want


def near_groups(fps):
    """Smallest id of each group of documents (id: fingerprint) linked at two bits or fewer."""
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fps[a] ^ fps[b]).bit_count() <= 2]
    first = {d: d for d in ids}
    for g in groups(links):
        first |= dict.fromkeys(g, min(g))
    return first


def test_op7_equals_brute_force(spark):
    fps = {d: plain_fingerprint(t) for d, t in texts().items()}
    first = near_groups(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, SF).collect()}
    assert got == {d: (f"{f:016x}", first[d]) for d, f in fps.items()}


def test_op2_takes_out_what_it_finds(spark):
    from footfall.llm.surrogates import entities

    before, after = texts(), {r.doc_id: r for r in QUERIES["op2_surrogates"](spark, SF).collect()}
    assert after.keys() == before.keys()
    seen = Counter()
    for d, t in before.items():
        found = list(entities(t))
        assert after[d].n_entities == len(found) and (found or after[d].text == t)
        for kind, _, start, end in found:
            seen[kind] += 1
            assert t[start:end] not in after[d].text
    assert sum(seen.values()) > 5


def test_op4_tells_the_four_languages(spark):
    label = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = QUERIES["op4_language"](spark, SF).collect()
    assert len(rows) == len(label) and all(r.kept for r in rows)
    assert sum(r.language == label[r.doc_id] for r in rows) >= 0.97 * len(rows)


def plain_line_dedup(docs):
    holders = {}

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").encode().lower()

    for d, t in docs.items():
        for line in t.split("\n"):
            if len(line.strip(" \t\n\x0b\x0c\r")) >= 40:
                holders.setdefault(key(line), set()).add(d)
    live = {k: max(h) for k, h in holders.items() if len(h) >= 5}
    return {d: "\n".join(x for x in t.split("\n") if live.get(key(x), d) == d) for d, t in docs.items()}


def test_pipeline_equals_a_plain_retelling(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = texts()
    shared = "A line that many documents share and that is quite long."
    extra = {5000 + i: f"{docs[i]}\n{shared}" for i in range(0, 40)} | {6000: "1234 5678", 6001: "", 6002: docs[3], 6003: docs[3]}
    rows = [(d, t, "en", "src1", len(t)) for d, t in extra.items()] + [(6004, None, None, None, None)]
    base.unionByName(spark.createDataFrame(rows, base.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{SF}/pages.parquet", tmp_path / "pages.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    left = {d: t for d, t in (docs | extra).items() if d not in (6000, 6001)}  # no letters, no language
    left = plain_line_dedup(left)
    first = brute(left.items())
    assert sum(first[d] != d for d in left) > 5
    left = {d: t for d, t in left.items() if first[d] == d}
    size = {d: len([w for w in t.replace("\x0b", " ").replace("\x0c", " ").split() if w]) for d, t in left.items()}
    total = Counter()
    for d, n in size.items():
        total[source[d]] += n
    target, want = brute_targets(dict(total)), {}
    for d in left:
        rate = target[source[d]] / total[source[d]]
        u = int(hashlib.md5(f"mix|{d}".encode()).hexdigest()[:13], 16) / 2**52
        want[d] = int(rate) + (u < rate - int(rate))
    assert Counter(r.doc_id for r in got) == Counter({d: n for d, n in want.items() if n})
    own = library()
    assert all(r.ids == own.encode_ordinary(left[r.doc_id]) and r.n_tokens == len(r.ids) and r.decodes for r in got)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mix", "tokenize"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size long, kept string")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
    assert mixing.mix(docs).count() == 0
    line = "a line that five documents share, long enough to be a key"
    rows = spark.createDataFrame([(i, line, "en", "s", len(line), 7, 8) for i in range(5)], f"{', '.join(
        f'{c} {t}' for c, t in docs.dtypes[:5])}, _new_kept int, _new_n_lines int")
    out = corpus_pipeline.dedup_lines(spark, rows, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars, r._new_kept, r._new_n_lines) for r in out] == [("", 0, 7, 8)] * 4 + [(line, len(line), 7, 8)]
