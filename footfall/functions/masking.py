"""Identifier masking in paths and labels, as pure column expressions.

Each test is one regular expression over the segment, so the whole rule stays in the JVM.
A path with no digit, no "@" and no UUID-shaped run skips the per-segment work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = ":id"

# Segments that are followed by an order or receipt number.
ORDER_SLUGS = (
    "order", "orders", "order-received", "view-order", "order-pay", "order-status",
    "receipt", "receipts", "invoice", "invoices", "ordre", "ordrer", "ordre-mottatt",
    "bestilling", "bestillinger", "kvittering", "kvitteringer", "faktura", "fakturaer",
)

_DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
_UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_EMAIL = r"(?iU)[^@/\s]+(?:@|%40)[^@/\s]+\.[A-Za-z]{2,}"
_LONG_NUMBER = r"[0-9]{12}"
# From the start of a hex run of 12 or more, a digit is reached through letters only.
_HEX_WITH_DIGIT = r"(?<![0-9A-Fa-f])(?=[0-9A-Fa-f]{12})[A-Fa-f]*[0-9]"
_MIXED_RUN = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{16})(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])"
_TOKEN = r"\A(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_-]{16,}\z"
_CLASS_CHANGE = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9a-z])|(?<=[a-z])(?=[0-9A-Z])"
_MAYBE = r"(?i)[\p{N}@]|[a-f]{8}-[a-f]{4}-"


def is_id_like(segment: Column) -> Column:
    """True for one segment (no "/") that carries an identifier."""
    changes = F.regexp_count(segment, F.lit(_CLASS_CHANGE))
    enough = F.greatest(F.lit(5), F.ceil(F.length(segment) / 3).cast("int"))
    return (segment != MASK) & (
        segment.rlike(_UUID)
        | segment.rlike(_EMAIL)
        | segment.rlike(_LONG_NUMBER)
        | segment.rlike(_HEX_WITH_DIGIT)
        | segment.rlike(_MIXED_RUN)
        | (segment.rlike(_TOKEN) & (changes >= enough))
    )


def mask_path(path: Column) -> Column:
    """Every identifying segment of a path becomes `:id`."""
    parts = F.split(path, "/", -1)

    def mask(seg: Column, i: Column) -> Column:
        numbered = F.lower(F.get(parts, i - 1)).isin(*ORDER_SLUGS) & seg.rlike(_DIGIT)
        return F.when(F.coalesce(numbered, F.lit(False)) | is_id_like(seg), MASK).otherwise(seg)

    return F.when(path.rlike(_MAYBE), F.array_join(F.transform(parts, mask), "/")).otherwise(path)


def mask_label(text: Column) -> Column:
    """The same test for every word of a free-text label."""
    pieces = F.split(text, r"(?U)(?<=[/\s])|(?=[/\s])", -1)
    masked = F.transform(pieces, lambda w: F.when(is_id_like(w), MASK).otherwise(w))
    return F.when(text.rlike(_MAYBE), F.array_join(masked, "")).otherwise(text)
