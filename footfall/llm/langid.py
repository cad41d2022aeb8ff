"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as logarithms: the likelihood of the whole text under
letter-trigram models, the language a page's markup declares, the suffix of its address, and a
prior of its host. How far a declaration or suffix speaks for a language, and how often a host
has it, is counted over all documents from their text posteriors by grouped sums; a host's
counts are smoothed towards those of its domain, and these towards all documents.

Beside the known languages stands a background: a text of another language or of no language is
likelier under the mean of all models mixed with even chances than under any one of them.
What it takes is missing in the confidence, and so such texts are rejected.

Only the trigram models are fitted on a sample: about FIT_ROWS labelled documents (of at most
FIT_CHARS characters), as many of each label where it has them, chosen by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.registry import query, table
from footfall.session import stored

FIT_ROWS = 2000
FIT_LEAST = 100  # rows of a label, however many labels there are
FIT_CHARS = 50_000
UNSEEN = 0.02  # share of even chances in each model
BACKGROUND = 0.5  # share of even chances in the background
OTHER = 0.01  # prior of the background
BUCKETS = 1 << 15
TEXT_WEIGHT = 40.0  # trigrams are not independent: a text counts as this many at most
HOST_WEIGHT = 20.0  # documents' worth of the parent's shares in a host's prior
CUE_WEIGHT = 5.0  # documents' worth of all languages in a cue's shares
LEAST_CONFIDENCE = 0.5
UNIT = 1_000_000  # posteriors are summed as whole millionths, so sums do not depend on order
_ALPHA = np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x10000)])


def trigrams(text: str) -> np.ndarray:
    """Buckets of all letter trigrams of a text, lower-cased; other characters are one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = np.where(c < 0x10000, _ALPHA[np.minimum(c, 0xFFFF)], True)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, c, 32)[keep].astype(np.uint64)
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    return (mixed >> np.uint64(49)).astype(np.int64)


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities (buckets x languages and the background, or none), from
    (doc_id, text, lang)."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= FIT_CHARS)
    held = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(held)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    each = max(FIT_LEAST, FIT_ROWS // len(langs))
    cuts = [(x, int(each / held[x] * 2**64) - 2**63 if held[x] > each else 2**63 - 1) for x in langs]
    cut = F.element_at(F.create_map(*[F.lit(v) for pair in cuts for v in pair]), F.col("lang"))
    chosen = rows.where(F.xxhash64("doc_id", "text") <= cut).select("lang", "text").limit(2 * each * len(langs)).collect()
    langs = sorted({r["lang"] for r in chosen})
    counts = np.zeros((BUCKETS, len(langs)))
    for r in chosen:
        np.add.at(counts[:, langs.index(r["lang"])], trigrams(r["text"]), 1.0)
    seen = counts / np.maximum(counts.sum(0), 1)
    models = (1 - UNSEEN) * seen + UNSEEN / BUCKETS  # an unseen trigram is as unlikely in every language
    other = (1 - BACKGROUND) * seen.mean(1) + BACKGROUND / BUCKETS if langs else np.zeros(BUCKETS)
    return langs, np.log(np.column_stack([models, other])) if langs else counts


def text_posterior(docs: DataFrame, logs: np.ndarray) -> DataFrame:
    """`docs` with `text` replaced by `logp` (array of double): the text's log likelihoods as so many
    trigrams as it counts for, less their largest; the background is last. Texts without letters have an empty array."""
    names = [c for c in docs.columns if c != "text"]
    schema = docs.select(*names, F.lit(None).cast("array<double>").alias("logp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text"):
                grams = trigrams(t.as_py() or "")
                if len(grams) and logs.shape[1]:
                    total = sum(logs[grams[i:i + 65536]].sum(0) for i in range(0, len(grams), 65536))
                    total *= min(1.0, TEXT_WEIGHT / len(grams))
                    out.append((total - total.max()).tolist())
                else:
                    out.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(out, pa.list_(pa.float64()))], [*names, "logp"])

    return docs.select(*names, "text").mapInArrow(run, schema)


def _shares(rows: DataFrame, key: str, n: int, weight: float, base: list[float], parent: DataFrame | None = None) -> DataFrame:
    """(key, share: array of double): language shares of each value of `key`, drawn towards those of
    its parent with the weight of so many documents. `parent` has (parent, base) for the
    column parent of `rows`; where it has none, and without it, `base` stands in."""
    sums = [F.sum(F.round(F.col("p")[i] * UNIT).cast("long")).alias(f"n{i}") for i in range(n)]
    rows = rows.where(F.col(key).isNotNull() & (F.size("p") > 0))
    to = F.array(*[F.lit(float(x)) for x in base])
    if parent is None:
        found = rows.groupBy(key).agg(*sums).withColumn("base", to)
    else:
        found = rows.groupBy(key).agg(*sums, F.max("parent").alias("parent")).join(parent, "parent", "left")
        found = found.withColumn("base", F.coalesce("base", to))
    total = sum((F.col(f"n{i}") for i in range(n)), F.lit(0)) / UNIT
    return found.select(key, F.array(*[
        (F.col(f"n{i}") / UNIT + F.lit(weight) * F.col("base")[i]) / (total + F.lit(weight)) for i in range(n)]).alias("share"))


def softmax(logp: Column) -> Column:
    top = F.array_max(logp)
    e = F.transform(logp, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, declared, suffix, host, domain) of `pages` (page_id, url, html): the document number is
    the last number in the address path; of several pages of a document the one with the
    smallest page_id counts. Pages without such a number are left out; evidence that a page
    lacks is null."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    number = F.regexp_extract("url", r"/(\d{1,18})(?:\.\w+)?/?(?:[?#].*)?$", 1)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1))
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), "."))
    rows = pages.where(number != "").select(number.cast("long").alias("doc_id"), F.struct(
        "page_id", F.nullif(declared, F.lit("")).alias("declared"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).alias("suffix"), F.nullif(host, F.lit("")).alias("host"),
        domain.alias("domain")).alias("e"))
    return rows.groupBy("doc_id").agg(F.min("e").alias("e")).select("doc_id", "e.declared", "e.suffix", "e.host", "e.domain")


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """(doc_id, language, confidence, text_language) of every row of `docs` (doc_id, text, declared,
    suffix, host, domain; others are not read).

    `language` is the best of the known ones; what the background takes is missing in its confidence.
    Missing evidence of a kind says nothing. A text without letters (null, empty, digits) is of
    language und with confidence 0, and so is every text if no language is known. Ties go to
    the first language in order. Repeated rows are judged alike; no rows in, no rows out."""
    return fuse(text_posterior(docs.select("doc_id", "text", "declared", "suffix", "host", "domain"), logs), langs)


def fuse(scored: DataFrame, langs: list[str]) -> DataFrame:
    """identify() for texts that are scored already: (doc_id, logp, declared, suffix, host, domain)."""
    n = len(langs)
    scored = stored(scored.withColumn("p", softmax(F.col("logp"))), "scored")
    if not n:
        return scored.select("doc_id", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_language"))
    even = [1.0 / n] * n
    overall = _shares(scored.withColumn("all", F.lit(1)), "all", n, 1.0, even).first()
    share = list(overall["share"]) if overall else even
    other = F.array(F.lit(float(np.log(OTHER))))  # no cue and no host speaks for the background
    log_all = F.array(*[F.lit(float(np.log(x))) for x in share])
    domains = stored(_shares(scored, "domain", n, HOST_WEIGHT, share), "domains")
    parents = domains.select(F.col("domain").alias("parent"), F.col("share").alias("base"))
    hosts = stored(_shares(scored.withColumn("parent", F.col("domain")), "host", n, HOST_WEIGHT, share, parents), "hosts")
    fused = scored
    score = F.col("logp")

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    for key in ("declared", "suffix"):
        # P(cue | language) in proportion to P(language | cue) / P(language).
        cues = stored(_shares(scored, key, n, CUE_WEIGHT, share), key)
        fused = fused.join(cues.withColumnRenamed("share", f"s_{key}"), key, "left")
        ratio = F.zip_with(F.transform(f"s_{key}", lambda x: F.log(x)), log_all, lambda x, y: x - y)
        score = add(score, F.concat(F.coalesce(ratio, F.array(*[F.lit(0.0)] * n)), F.array(F.lit(0.0))))
    fused = fused.join(hosts.withColumnRenamed("share", "s_host"), "host", "left")
    score = add(score, F.concat(F.coalesce(F.transform("s_host", lambda x: F.log(x)), log_all), other))
    told = fused.withColumn("fused", F.when(F.size("logp") > 0, F.slice(softmax(score), 1, n)))
    names = F.array(*[F.lit(x) for x in langs])

    def best(p: Column) -> Column:
        return F.coalesce(F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1), F.lit("und"))

    return told.select(
        "doc_id", best(F.col("fused")).alias("language"), F.coalesce(F.array_max("fused"), F.lit(0.0)).alias("confidence"),
        best(F.slice("logp", 1, n)).alias("text_language"))


def identify_documents(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """identify() over `docs` (doc_id, text, lang, source): evidence of a document's page where it has
    one, its source as host otherwise. `lang` only labels the sample that fits the models."""
    langs, logs = fit(docs.select("doc_id", "text", "lang"))
    # Texts are scored where they lie; only their scores meet the evidence of pages.
    scored = text_posterior(docs.select("doc_id", "source", "text"), logs)
    rows = scored.join(page_evidence(pages), "doc_id", "left")
    return fuse(rows.withColumn("host", F.coalesce("host", "source")), langs)


def keep_identified(docs: DataFrame, pages: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """`docs` without the documents of unknown language or too low confidence; all columns. A
    document whose rows differ (one doc_id, several texts) goes only if all are rejected; a row
    without a doc_id cannot be told apart from others and stays."""
    told = identify_documents(docs, pages).where("doc_id IS NOT NULL")
    gone = told.groupBy("doc_id").agg(F.max(F.when(F.col("language") == "und", 0.0).otherwise(F.col("confidence"))).alias("c"))
    gone = stored(gone.where(F.col("c") < least).select("doc_id"), "rejected")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    told = identify_documents(docs, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    kept = (F.col("language") != "und") & (F.col("confidence") >= LEAST_CONFIDENCE)
    return told.withColumn("kept", kept)
