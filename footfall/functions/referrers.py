"""Traffic sources: AI assistants, payment redirects, own pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.schema import DIRECT

# Assistant hosts, their utm spellings, display names.
AI_HOSTS = (
    "chatgpt.com", "chat.openai.com", "perplexity.ai", "claude.ai",
    "gemini.google.com", "bard.google.com", "copilot.microsoft.com",
    "you.com", "poe.com", "phind.com", "chat.mistral.ai", "grok.com",
    "chat.deepseek.com",
)
AI_ALIASES = {
    "chatgpt": "chatgpt.com", "openai": "chatgpt.com",
    "perplexity": "perplexity.ai", "claude": "claude.ai",
    "gemini": "gemini.google.com", "copilot": "copilot.microsoft.com",
    "copilot.com": "copilot.microsoft.com", "grok": "grok.com",
    "deepseek": "chat.deepseek.com", "mistral": "chat.mistral.ai",
    "phind": "phind.com", "poe": "poe.com",
}
AI_NAMES = {
    "chatgpt.com": "ChatGPT", "chat.openai.com": "ChatGPT",
    "perplexity.ai": "Perplexity", "claude.ai": "Claude",
    "gemini.google.com": "Gemini", "bard.google.com": "Gemini",
    "copilot.microsoft.com": "Copilot", "you.com": "You.com", "poe.com": "Poe",
    "phind.com": "Phind", "chat.mistral.ai": "Le Chat", "grok.com": "Grok",
    "chat.deepseek.com": "DeepSeek",
}
# Payment redirects are never a source.
PAYMENT_HOSTS = (
    "checkout.vipps.no", "pay.vipps.no", "api.vipps.no",
    "checkout.stripe.com", "pay.stripe.com", "hooks.stripe.com",
    "checkout.klarna.com", "pay.klarna.com",
    "www.paypal.com", "paypal.com",
)

AI_REFERRERS = AI_HOSTS + tuple("www." + h for h in AI_HOSTS)
AI_UTM = AI_REFERRERS + tuple(AI_ALIASES)


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def is_ai_referral(referrer: Column, utm_source: Column) -> Column:
    return F.coalesce(referrer.isin(*AI_REFERRERS), F.lit(False)) | F.coalesce(
        F.lower(utm_source).isin(*AI_UTM), F.lit(False)
    )


def ai_key(referrer: Column, utm_source: Column) -> Column:
    """Canonical assistant host; the referrer wins over the utm tag."""
    utm = F.regexp_replace(F.lower(F.coalesce(utm_source, F.lit(""))), r"\Awww\.", "")
    return F.when(referrer.isin(*AI_REFERRERS), F.regexp_replace(referrer, r"\Awww\.", "")).otherwise(
        F.coalesce(literal_map(AI_ALIASES)[utm], utm)
    )


def ai_name(key: Column) -> Column:
    return F.coalesce(literal_map(AI_NAMES)[key], key)


def settle_payment_source(source: Column) -> Column:
    return F.when(source.isin(*PAYMENT_HOSTS), DIRECT).otherwise(source)


def first_touch(utm_source: Column, referrer: Column) -> Column:
    return F.coalesce(utm_source, referrer, F.lit(DIRECT))


def with_site_domain(hits: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds site_domain. The plan broadcasts `sites` only while its size allows it."""
    return hits.join(
        sites.select(F.col("id").alias("site_id"), F.col("domain").alias("site_domain")),
        "site_id", "left",
    )


def not_self_referral(referrer: Column, domain: Column) -> Column:
    """Clicks between pages of one site are navigation, not a source."""
    own = (referrer == domain) | (referrer == F.concat(F.lit("www."), domain))
    return ~F.coalesce(own, F.lit(False))
