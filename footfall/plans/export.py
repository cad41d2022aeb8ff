"""Everything stored about a site or an account, as tables to be written as CSV.

Every file is one DataFrame for all sites (with site_id), so an export of one account is a
filter and an export of everything is the same plan. Header names are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.geonames import country_label
from footfall.functions.numbers import money_text
from footfall.functions.timewin import day_of, day_text, pageviews
from footfall.operators import commerce, metrics
from footfall.operators.funnels import funnel
from footfall.operators.sessions import entry_exit
from footfall.sources.csv_sink import write_csv
from footfall.sources.tables import ordered_scan


@dataclass
class SiteTables:
    hits: DataFrame
    items: DataFrame
    sites: DataFrame
    goals: DataFrame
    funnels: DataFrame
    rollups: DataFrame
    breakdowns: DataFrame
    bots: DataFrame
    search: DataFrame
    anchors: DataFrame | None = None


# Names of dimensions and totals in the export.
DIM_NAMES = {
    "kpi": "totalt", "page": "side", "source": "kilde", "country": "land", "region": "region",
    "device": "enhet", "browser": "nettleser", "os": "operativsystem", "campaign": "kampanje",
    "entry": "inngangsside", "exit": "utgangsside", "event": "hendelse",
    "ai": "ki_assistent", "ai_total": "ki_assistenter_totalt", "ecom": "ehandel",
    "ecom_source": "ehandel_kilde", "ecom_payment": "ehandel_betalingsmaate",
    "product": "ehandel_produkt", "bot": "robot", "bot_ai_path": "ki_crawler_side",
}
KPI_NAMES = {
    "pageviews": "sidevisninger", "visitors": "unike_besoekende", "sessions": "okter",
    "bounces": "okter_med_en_sidevisning",
}
# File -> (dimension, header of its key).
BREAKDOWN_FILES = {
    "sider": ("page", "side"), "kilder": ("source", "kilde"), "land": ("country", "lagret_verdi"),
    "regioner": ("region", "region"), "enheter": ("device", "enhet"),
    "nettlesere": ("browser", "nettleser"), "operativsystemer": ("os", "operativsystem"),
}


def _renamed(df: DataFrame, names: dict[str, str], key: str = "site_id") -> DataFrame:
    """`key` and the named columns under their export names; optional ones may be absent."""
    return df.select(key, *[F.col(a).alias(b) for a, b in names.items() if a in df.columns])


def breakdown_files(hits: DataFrame, sites: DataFrame) -> dict[str, DataFrame]:
    """The seven page-view breakdowns without a limit, from one shared aggregate."""
    every = metrics.all_breakdowns(hits, sites, None, limit=None)
    out = {}
    for name, (dim, header) in BREAKDOWN_FILES.items():
        part = every.where(F.col("dim") == dim)
        names = {"key": header, "n": "sidevisninger", "visitors": "unike_besoekende"}
        out[name] = _renamed(part, names)
    out["land"] = out["land"].select(
        "site_id", country_label(F.col("lagret_verdi")).alias("land"), "lagret_verdi", "sidevisninger",
        "unike_besoekende")
    return out


def daily_series(hits: DataFrame) -> DataFrame:
    return pageviews(hits).groupBy("site_id", day_of("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("sidevisninger"), F.count_distinct("visitor_hash").alias("unike_besoekende")
    ).select("site_id", day_text("day").alias("dag"), "sidevisninger", "unike_besoekende")


def stored_breakdowns(breakdowns: DataFrame) -> DataFrame:
    from footfall.functions.referrers import literal_map

    dim = F.coalesce(literal_map(DIM_NAMES)[F.col("dim")], F.col("dim"))
    key = F.when(
        F.col("dim") == "kpi", F.coalesce(literal_map(KPI_NAMES)[F.col("key")], F.col("key"))
    ).otherwise(F.col("key"))
    money = F.when(F.col("revenue_cents").isNotNull(), money_text(F.col("revenue_cents")))
    return breakdowns.select(
        "site_id", day_text("day").alias("dag"), dim.alias("dimensjon"), key.alias("verdi"),
        F.col("currency").alias("valuta"), F.col("n").alias("antall"),
        F.col("visitors").alias("unike_besoekende"), money.alias("omsetning"))


def order_files(hits: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    money = lambda df: df.withColumn("omsetning", money_text(F.col("revenue_cents")))
    return {
        "ehandel_oppsummering": _renamed(money(commerce.orders_by_currency(hits)), {
            "currency": "valuta", "orders": "ordrer", "omsetning": "omsetning"}),
        "ehandel_kilder": _renamed(money(commerce.revenue_by_source(hits, None, None, None)), {
            "currency": "valuta", "source": "kilde", "orders": "ordrer", "omsetning": "omsetning"}),
        "ehandel_betalingsmaater": _renamed(money(commerce.revenue_by_payment(hits, None, None, None)), {
            "currency": "valuta", "method": "betalingsmaate", "orders": "ordrer", "omsetning": "omsetning"}),
        "ehandel_produkter": _renamed(money(commerce.products(items)), {
            "currency": "valuta", "product": "produkt", "qty": "antall", "omsetning": "omsetning"}),
    }


def raw_files(hits: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """The raw rows without visitor and session keys."""
    return {
        "raadata_hendelser": _renamed(hits, {
            "id": "hendelse_id", "ts": "tidspunkt_utc", "name": "hendelse", "path": "side",
            "referrer_src": "kilde", "country": "land", "region": "region", "device": "enhet",
            "browser": "nettleser", "os": "operativsystem", "utm_source": "utm_source",
            "utm_medium": "utm_medium", "utm_campaign": "utm_campaign",
            "revenue_cents": "omsetning_minste_enhet", "currency": "valuta", "payment_method": "betalingsmaate"}),
        "raadata_varelinjer": _renamed(items, {
            "id": "varelinje_id", "event_id": "hendelse_id", "ts": "tidspunkt_utc", "name": "produkt",
            "qty": "antall", "unit_price_cents": "enhetspris_minste_enhet", "currency": "valuta"}),
    }


def direct_files(t: SiteTables) -> dict[str, DataFrame]:
    """Files that are a table under other names."""
    return {
        "nettsted": _renamed(
            t.sites.withColumn("site_id", F.col("id")).withColumn("public_dash", F.col("public_dash") == 1), {
                "domain": "domene", "public_id": "nettsted_id", "created_at": "opprettet",
                "public_dash": "offentlig_dashboard"}),
        "roboter": _renamed(t.bots.withColumn("day", day_text("day")), {
            "day": "dag", "bot_class": "klasse", "agent": "agent", "path": "side", "n": "antall"}),
    }


def site_export(t: SiteTables) -> dict[str, DataFrame]:
    """File name -> table, each with site_id."""
    ends = entry_exit(t.hits, None, limit=None)
    page_of = {"inngangssider": "entry", "utgangssider": "exit"}
    out = {
        **direct_files(t),
        "tidsserie": daily_series(t.hits),
        "daglige_tall": _renamed(t.rollups.withColumn("day", day_text("day")), {
            "day": "dag", "pageviews": "sidevisninger", "visitors": "unike_besoekende", "sessions": "okter",
            "bounce_rate": "fluktfrekvens_prosent", "rollup_hash": "rollup_hash", "merkle_root": "merkle_root",
            "merkle_proof": "merkle_proof", "txid": "txid", "anchored_at": "forankret"}),
        "daglige_fordelinger": stored_breakdowns(t.breakdowns),
        **breakdown_files(t.hits, t.sites),
        **{f: ends.where(F.col("kind") == k).select("site_id", F.col("path").alias("side"), F.col("n").alias("okter"))
           for f, k in page_of.items()},
        "kampanjer": _renamed(metrics.campaigns(t.hits, None, None), {
            "source": "utm_source", "medium": "utm_medium", "campaign": "utm_campaign",
            "n": "sidevisninger", "visitors": "unike_besoekende"}),
        "egendefinerte_hendelser": _renamed(metrics.top_events(t.hits, None, None), {
            "event": "hendelse", "n": "antall", "visitors": "unike_besoekende"}),
        "maal": _renamed(metrics.goal_stats(t.hits, t.goals), {
            "name": "maal", "match_type": "type", "match_value": "verdi", "created_at": "opprettet",
            "completions": "unike_fullforinger", "rate": "konverteringsrate_prosent"}),
        "trakter": _renamed(funnel(t.hits, t.funnels, None, digits=1), {
            "funnel": "trakt", "step": "steg", "type": "type", "value": "verdi", "visitors": "besoekende",
            "rate": "andel_av_foerste_steg_prosent"}),
        **order_files(t.hits, t.items),
        "sokestatistikk": _renamed(t.search.withColumn("day", day_text("day")), {
            "day": "dag", "source": "kilde", "dim": "dimensjon", "key": "noekkel", "clicks": "klikk",
            "impressions": "visninger", "position": "posisjon"}),
        **raw_files(t.hits, t.items),
    }
    if t.anchors is not None:
        out["forankringer"] = _renamed(t.anchors, {
            "period": "periode", "rollup_hash": "rollup_hash", "txid": "txid", "anchored_at": "forankret"})
    return out


# Fixed order of the rows in each file, where it is not plain.
SORT_KEYS = {
    "raadata_hendelser": ["tidspunkt_utc", "hendelse_id"], "raadata_varelinjer": ["tidspunkt_utc", "varelinje_id"],
    "tidsserie": ["dag"], "daglige_tall": ["dag"], "daglige_fordelinger": ["dag", "dimensjon", "verdi", "valuta"],
    "roboter": ["dag", "klasse", "agent", "side"], "sokestatistikk": ["dag", "kilde", "dimensjon", "noekkel"],
}


def folder_names(sites: DataFrame) -> DataFrame:
    """(site_id, tenant_id, folder): the domain with unsafe characters replaced, made unique
    within the account by a number."""
    base = F.regexp_replace(F.regexp_replace("domain", r"(?U)[^\p{L}\p{N}._-]", "_"), r"\A[._]+|[._]+\z", "")
    base = F.when(base == "", "nettsted").otherwise(base)
    w = Window.partitionBy("tenant_id", F.lower("base")).orderBy("domain", "id")
    s = sites.withColumn("base", base).withColumn("no", F.row_number().over(w))
    name = F.when(F.col("no") > 1, F.concat("base", F.lit("-"), F.col("no").cast("string"))).otherwise(F.col("base"))
    s = s.select(F.col("id").alias("site_id"), "tenant_id", "no", name.alias("folder"), F.lower(name).alias("_name"))
    # A made-up name can meet the plain name of another site; that one then takes its id too.
    plain = s.where("no = 1").select("tenant_id", "_name", F.lit(True).alias("_taken"))
    s = s.join(plain, ["tenant_id", "_name"], "left")
    clash = (F.col("no") > 1) & F.col("_taken")
    folder = F.when(clash, F.concat("folder", F.lit("-"), F.col("site_id").cast("string"))).otherwise(F.col("folder"))
    return s.select("site_id", "tenant_id", folder.alias("folder"))


def account_tables(tenants: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    return {
        "konto": _renamed(tenants.withColumn("tenant_id", F.col("id")), {
            "name": "firmanavn", "plan": "plan", "trial_ends_at": "proveperiode_slutt",
            "plan_ends_at": "abonnement_gjelder_til", "cancelled_at": "avsluttet", "created_at": "opprettet"},
            "tenant_id"),
        "brukere": _renamed(users.withColumn("email_verified", F.col("email_verified") == 1), {
            "email": "epost", "email_verified": "bekreftet", "created_at": "opprettet"}, "tenant_id"),
    }


def write_export(t: SiteTables, path: str, tenant_id: int | None = None) -> list[str]:
    """Writes every file as CSV under <path>/<file>/folder=<site folder>/. Returns the names."""
    folders = folder_names(t.sites)
    if tenant_id is not None:
        folders = folders.where(F.col("tenant_id") == tenant_id)
    folders = folders.select("site_id", "folder")
    names = []
    for name, df in site_export(t).items():
        rows = df.join(folders, "site_id").drop("site_id")
        rows = ordered_scan(rows, ["folder", *SORT_KEYS.get(name, [])])
        write_csv(rows, f"{path}/{name}", partition_by=["folder"])
        names.append(name)
    return names
