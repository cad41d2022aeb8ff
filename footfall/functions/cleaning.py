"""Cleaning of what a beacon carries. Columns named `v` are VARIANT, others strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.masking import mask_label, mask_path
from footfall.schema import MAX_MONEY

_EDGE_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_SCHEME = r"\A[A-Za-z][A-Za-z0-9+.\-]*:"
# Schemes whose last path segment may carry ";parameters".
_PARAM_SCHEME = r"(?i)\A(?:ftp|hdl|prospero|http|imap|https|shttp|rtsp|rtsps|rtspu|sip|sips|mms|sftp|tel):"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def text_field(v: Column, path: str) -> Column:
    """A JSON string at `path`; null when missing or of another JSON type."""
    raw = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(v, path, "string"))


def clean_name(text: Column) -> Column:
    t = strip(text)
    return F.coalesce(mask_label(F.substring(blank_to_null(t), 1, 64)), F.lit("pageview"))


def url_path(url: Column) -> Column:
    """Path part of a URL, without authority, query, fragment and ;parameters."""
    flat = F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")
    rest = F.regexp_replace(F.regexp_replace(flat, _SCHEME, ""), r"\A//[^/?#]*", "")
    rest = F.regexp_extract(rest, r"\A[^?#]*", 0)
    no_params = F.regexp_replace(rest, r";[^/]*\z", "")
    return F.when(flat.rlike(_PARAM_SCHEME) | ~flat.rlike(_SCHEME), no_params).otherwise(rest)


def clean_path(text: Column) -> Column:
    t = strip(text)
    p = F.when(F.substring(t, 1, 10).contains("://"), url_path(t)).otherwise(t)
    p = F.regexp_extract(p, r"\A[^?#]*", 0)
    return F.coalesce(F.when(p.startswith("/"), mask_path(F.substring(p, 1, 512))), F.lit("/"))


def clean_utm(text: Column) -> Column:
    return blank_to_null(F.substring(strip(text), 1, 120))


def _number(v: Column) -> Column:
    """A JSON number (not a boolean, not text) as double, else null."""
    kind = F.schema_of_variant(v)
    return F.when(
        kind.rlike(r"\A(?:BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"),
        F.try_variant_get(v, "$", "double"),
    )


def clean_money(v: Column) -> Column:
    """Whole minor units in [0, cap], else null."""
    n = _number(v)
    return F.when((n == F.floor(n)) & n.between(0, MAX_MONEY), n.cast("long"))


def clean_quantity(v: Column) -> Column:
    n = _number(v)
    return F.coalesce(F.when((n == F.floor(n)) & n.between(1, 999), n.cast("int")), F.lit(1))


def clean_currency(v: Column) -> Column:
    """Missing or blank means NOK; given but not a three-letter code gives null."""
    missing = v.isNull() | F.is_variant_null(v)
    text = F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string")))
    code = F.upper(text)
    return F.when(F.coalesce(missing, F.lit(True)) | (text == ""), "NOK").when(
        code.rlike(r"\A[A-Z]{3}\z"), code
    )


def clean_payment(text: Column) -> Column:
    slug = F.lower(strip(text))
    return F.when(slug.rlike(r"\A[a-z0-9_-]{1,32}\z"), slug)


def clean_items(v: Column, most: int | None = None) -> Column:
    """Product lines: array<struct<name, qty, unit_price_cents>> of all entries, or the first `most`."""
    lines = F.try_variant_get(v, "$", "array<variant>")
    if most is not None:
        lines = F.slice(lines, 1, most)

    def line(x: Column) -> Column:
        price = clean_money(F.try_variant_get(x, "$.p", "variant"))
        return F.struct(
            F.substring(strip(text_field(x, "$.n")), 1, 160).alias("name"),
            clean_quantity(F.try_variant_get(x, "$.q", "variant")).alias("qty"),
            F.coalesce(price, F.lit(0).cast("long")).alias("unit_price_cents"),
        )

    named = F.filter(F.transform(lines, line), lambda x: x["name"] != "")
    return F.coalesce(
        named, F.array().cast("array<struct<name:string,qty:int,unit_price_cents:bigint>>")
    )


def referrer_host(text: Column) -> Column:
    """Host of a referrer URL: no credentials, no port, lower case; null without one."""
    flat = F.regexp_replace(F.substring(text, 1, 2048), r"\A[\x00-\x20]+|[\t\r\n]", "")
    authority = F.regexp_extract(
        flat, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1
    )
    after_user = F.regexp_extract(authority, r"([^@]*)\z", 1)
    broken = authority.contains("[") != authority.contains("]")
    host = F.when(
        after_user.contains("["), F.regexp_extract(after_user, r"\[([^\]]*)", 1)
    ).otherwise(F.regexp_extract(after_user, r"\A[^:]*", 0))
    return F.when(~broken, blank_to_null(F.substring(F.lower(host), 1, 253)))


def normalize_domain(text: Column) -> Column:
    """host[/path] of a typed-in domain; '' when empty or too long."""
    d = F.regexp_replace(F.lower(strip(text)), r"\Ahttps?://", "")
    d = F.regexp_replace(F.regexp_extract(d, r"\A[^?]*", 0), r"\A/+|/+\z", "")
    d = F.regexp_replace(d, r"\Awww\.", "")
    return F.coalesce(F.when(F.length(d) <= 253, d), F.lit(""))


def reconcile_order(
    name: Column, revenue: Column, currency: Column, payment: Column, items: Column
) -> Column:
    """Order fields of one hit: struct<revenue_cents, currency, payment_method, items>.
    Page views carry none. An invalid currency voids the amounts but keeps the lines; a
    missing total is the sum of the lines when that is a sane amount."""
    no_items = F.slice(items, 1, 0)
    lines = F.when(name != "pageview", items).otherwise(no_items)
    paid = F.when(name != "pageview", revenue)
    has_order = paid.isNotNull() | (F.size(lines) > 0)
    total = F.aggregate(
        lines,
        F.lit(0).cast("long"),
        lambda acc, x: acc + x["qty"].cast("long") * x["unit_price_cents"],
    )
    derived = F.when((total > 0) & (total <= MAX_MONEY), total)
    free = F.transform(
        lines,
        lambda x: F.struct(
            x["name"].alias("name"), x["qty"].alias("qty"),
            F.lit(0).cast("long").alias("unit_price_cents"),
        ),
    )
    return F.struct(
        F.when(has_order & currency.isNotNull(), F.coalesce(paid, derived)).alias("revenue_cents"),
        F.when(has_order, currency).alias("currency"),
        F.when(has_order, payment).alias("payment_method"),
        F.when(currency.isNull(), free).otherwise(lines).alias("items"),
    )
