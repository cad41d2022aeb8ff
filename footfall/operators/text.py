"""Page texts: the stored pages, and keyword-overlap ranking of pages for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.frames import top_per
from footfall.session import stored

GRAM = 4
PART_CHARS = 8_000_000  # text of one task that counts words


def upsert_pages(old: DataFrame, new: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """(path, title, content, fetched_at, cut): the last fetch of a path wins, of equal times the new one, then the
    larger text. With `least`, thinner
    new pages are no knowledge; with `most`, new texts are stored up to that length and `cut`
    says how many characters went (0 else)."""
    fresh = new.where(F.length("content") >= least) if least else new
    cut = F.greatest(F.length("content") - most, F.lit(0)) if most is not None else F.lit(0)
    fresh = fresh.withColumn("cut", cut.cast("long"))
    if most is not None:
        fresh = fresh.withColumn("content", F.substring("content", 1, most))
    if "cut" not in old.columns:
        old = old.withColumn("cut", F.lit(0).cast("long"))
    both = old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    last = both.groupBy("path").agg(F.max(F.struct("fetched_at", "_new", "content", "title", "cut")).alias("p"))
    return last.select("path", "p.title", "p.content", "p.fetched_at", "p.cut")


def _asked(questions: DataFrame) -> DataFrame:
    """(question_id, asked): distinct question words of four letters or more."""
    return questions.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("question"), F.lit(r"(?U)\w{4,}"), 0))).alias("asked"))


def overlap_score(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(question_id, path, score > 0): for every distinct question word of four letters or
    more, how often it occurs in the page, also inside longer words.

    Pages are dealt out by path in parts of some million characters, their words counted there, and
    what was found is dealt out by path again and stays there until it is scored, so that the caller
    can cut the list per task and a task holds the same however many pages there are. Which vocabulary words contain a
    question word is an equi-join on four-letter pieces between two vocabularies; this table
    and the question words are stored, so their size decides how they are joined."""
    asked = stored(_asked(questions), "asked")
    runs = F.regexp_extract_all(F.lower("content"), F.lit(r"(?U)\w{4,}"), 0)
    parts = 1 + (pages.agg(F.sum(F.length("content"))).first()[0] or 0) // PART_CHARS
    postings = pages.repartition(parts, "path").select("path", F.explode(runs).alias("word")).groupBy("path", "word").agg(
        F.count(F.lit(1)).alias("tf"))
    vocabulary = pages.select(F.explode(F.array_distinct(runs)).alias("word")).distinct()
    at = F.sequence(F.lit(1), F.length("word") - GRAM + 1)
    pieces = vocabulary.select("word", F.explode(F.array_distinct(
        F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(GRAM))))).alias("piece"))
    heads = asked.select("asked").distinct().withColumn("piece", F.substring("asked", 1, GRAM))
    gone = F.length(F.replace(F.col("word"), F.col("asked"), F.lit("")))
    times = ((F.length("word") - gone) / F.length("asked")).cast("long")
    inside = stored(heads.join(pieces, "piece").where(F.col("word").contains(F.col("asked"))).select(
        "asked", "word", times.alias("times")), "inside")
    found = postings.join(inside, "word").repartition(parts, "path").groupBy("path", "asked").agg(F.sum(F.col("times") * F.col("tf")).alias("n"))
    return found.join(asked, "asked").groupBy("path", "question_id").agg(F.sum("n").alias("score"))


def rank_pages(questions: DataFrame, pages: DataFrame, k: int = 3, budget: int | None = 9000) -> DataFrame:
    """(question_id, rank, path, title, score, taken): the k best pages of each question and
    how many characters of each fit into the budget (None: all). Pages without overlap fill up
    in path order, for which the first k paths are enough. Scores leave the task that made
    them only among its k best of a question."""
    fill = pages.select("path").orderBy("path").limit(k).agg(F.collect_list("path").alias("fill"))
    fill = fill.withColumn("fill", F.coalesce("fill", F.array().cast("array<string>")))
    zero = questions.select("question_id").distinct().select(
        "question_id", F.explode(fill.scalar()).alias("path"), F.lit(0).cast("long").alias("score"))
    best = top_per(overlap_score(questions, pages), ["question_id"], [F.desc("score"), F.asc("path")], k)
    scores = best.select("question_id", "path", "score").unionByName(zero).groupBy("question_id", "path").agg(
        F.sum("score").alias("score"))
    best = top_per(scores, ["question_id"], [F.desc("score"), F.asc("path")], k, rank="rank")
    best = best.join(pages.select("path", "title", F.length("content").alias("size")), "path")
    if budget is None:
        return best.select("question_id", "rank", "path", "title", "score", F.col("size").alias("taken"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("question_id").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.least(F.col("size"), F.lit(budget) - before)
    return best.withColumn("taken", taken).where("taken > 0 OR size = 0").select(
        "question_id", "rank", "path", "title", "score", "taken")
