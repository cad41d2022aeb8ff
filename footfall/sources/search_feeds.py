"""Search statistics from provider rows, and which provider property belongs to which site."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.cleaning import url_path
from footfall.functions.timewin import day_lit
from footfall.operators.frames import top_per

KEY = ["site_id", "day", "source", "dim", "key"]


def _num(col, path: str):
    return F.coalesce(F.try_variant_get(col, path, "double").cast("long"), F.lit(0).cast("long"))


def _rows(raw: DataFrame) -> DataFrame:
    return raw.withColumn("v", F.try_parse_json("body")).where(F.col("v").isNotNull())


def normalize_gsc(raw: DataFrame, top: int | None = None) -> DataFrame:
    """(site_id, dim, body) with one JSON row of the Search Console API each; dim is total,
    query or page. Pages are stored as paths; with `top`, each day of a site keeps so many keys
    by clicks, then impressions."""
    v = F.col("v")
    key = F.when(F.col("dim") == "total", "").otherwise(F.try_variant_get(v, "$.keys[1]", "string"))
    path = url_path(key)
    key = F.when(F.col("dim") == "page", F.when(path != "", path).otherwise("/")).otherwise(key)
    rows = _rows(raw).select(
        "site_id", F.to_date(F.try_variant_get(v, "$.keys[0]", "string")).alias("day"),
        F.lit("google").alias("source"), "dim", key.alias("key"),
        _num(v, "$.clicks").alias("clicks"), _num(v, "$.impressions").alias("impressions"),
        F.try_variant_get(v, "$.position", "double").alias("position"))
    order = [F.desc("clicks"), F.desc("impressions"), F.asc("key")]
    return top_per(rows, ["site_id", "day", "dim"], order, top)


def normalize_bing(raw: DataFrame, start: date) -> DataFrame:
    """(site_id, body): daily totals; the date is epoch milliseconds, read as UTC."""
    v = F.col("v")
    ms = F.regexp_extract(F.try_variant_get(v, "$.Date", "string"), r"/Date\((\d+)", 1)
    day = F.to_date(F.timestamp_millis(F.when(ms != "", ms).cast("long")))
    return _rows(raw).select(
        "site_id", day.alias("day"), F.lit("bing").alias("source"), F.lit("total").alias("dim"),
        F.lit("").alias("key"), _num(v, "$.Clicks").alias("clicks"),
        _num(v, "$.Impressions").alias("impressions"), F.lit(None).cast("double").alias("position"),
    ).where(F.col("day") >= day_lit(start))


def normalize_gmc(raw: DataFrame) -> DataFrame:
    """(site_id, body): product totals; the date is {year, month, day} or ISO text."""
    v, at = F.col("v"), "$.productPerformanceView."
    part = lambda p: F.try_variant_get(v, f"{at}date.{p}", "int")
    iso = F.substring(F.try_variant_get(v, at + "date", "string"), 1, 10)
    day = F.coalesce(
        F.make_date(part("year"), part("month"), part("day")),
        F.when(iso.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.to_date(iso)))
    return _rows(raw).select(
        "site_id", day.alias("day"), F.lit("gmc").alias("source"), F.lit("total").alias("dim"),
        F.lit("").alias("key"), _num(v, at + "clicks").alias("clicks"),
        _num(v, at + "impressions").alias("impressions"), F.lit(None).cast("double").alias("position"),
    ).where(F.col("day").isNotNull())


def upsert_search(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fresh rows overwrite stored ones with the same key; providers correct recent days. Of several
    fresh rows of a key, that with most clicks, then impressions, is taken in every run."""
    cols = [*KEY, "clicks", "impressions", "position"]
    value = F.struct("clicks", "impressions", "position")
    both = old.select(*KEY, value.alias("v"), F.lit(0).alias("gen")).unionByName(
        new.select(*KEY, value.alias("v"), F.lit(1).alias("gen")))
    return both.groupBy(*KEY).agg(F.max(F.struct("gen", "v")).alias("m")).select(*KEY, "m.v.*").select(*cols)


def match_property(sites: DataFrame, props: DataFrame) -> DataFrame:
    """(site_id, property): the first of five spellings of the domain that exists."""
    d = F.col("domain")
    spellings = F.array(
        F.concat(F.lit("sc-domain:"), d),
        *[F.concat(F.lit(p), d, F.lit("/")) for p in ("https://", "https://www.", "http://", "http://www.")])
    cands = sites.select(F.col("id").alias("site_id"), F.posexplode(spellings).alias("rank", "property"))
    return cands.join(props.select("property").distinct(), "property").groupBy("site_id").agg(
        F.min_by("property", "rank").alias("property"))


def match_host(sites: DataFrame, urls: DataFrame) -> DataFrame:
    """(site_id, url): the provider URL with the site's host, www. aside."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"\Awww\.", "")
    host = F.regexp_extract("url", r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    u = urls.select("url", bare(host).alias("host"))
    return sites.select(F.col("id").alias("site_id"), bare(F.col("domain")).alias("host")).join(
        u, "host").groupBy("site_id").agg(F.min("url").alias("url"))


def sitemap_urls(maps: DataFrame, host: str | None = None) -> DataFrame:
    """(url) entries of sitemap texts (column `xml`), those that mention `host`."""
    urls = maps.select(F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url"))
    return urls if host is None else urls.where(F.col("url").contains(host))


def new_urls(urls: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(URLs not announced before, the registry after it)."""
    fresh = urls.select("url").distinct().join(seen.select("url"), "url", "left_anti")
    return fresh, seen.select("url").unionByName(fresh)
