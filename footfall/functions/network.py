"""Addresses: client address, private ranges, range lookups, visitor hash.

An address is compared as a 32-digit hex key: IPv6 in full, IPv4 in its mapped form
(20 zeros, ffff, 8 digits). Text order of keys is numeric order, so a lookup in a range
table is `key BETWEEN first AND last` behind an equi-join on a key prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.agents import first_of, let
from footfall.functions.cleaning import strip
from footfall.session import stored

_V4_PREFIX = "0" * 20 + "ffff"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"

# Address blocks that are not globally reachable, and the exceptions in them.
NOT_GLOBAL_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
GLOBAL_V4 = ("192.0.0.9/32", "192.0.0.10/32")
NOT_GLOBAL_V6 = (
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10",
)
GLOBAL_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
    "2001:30::/28",
)

# Hosting networks by AS number.
DATACENTER_NAMES = {
    16509: "AWS",
    14618: "AWS",
    396982: "Google Cloud",
    8075: "Microsoft Azure",
    14061: "DigitalOcean",
    24940: "Hetzner",
    213230: "Hetzner",
    16276: "OVH",
    63949: "Linode",
    20473: "Vultr",
    31898: "Oracle Cloud",
    45102: "Alibaba Cloud",
    132203: "Tencent Cloud",
    12876: "Scaleway",
    51167: "Contabo",
    197540: "netcup",
    36352: "ColoCrossing/HostPapa",
    18779: "EGIHosting",
    46261: "QuickPacket",
    62874: "Web2Objects",
    40021: "Contabo",
    8100: "QuadraNet",
    53667: "FranTech/BuyVM",
    35916: "MULTACOM",
    55286: "B2 Net/ServerMania",
    397423: "Tier.Net",
    32097: "WholeSale Internet",
    23470: "ReliableSite",
    14576: "Hosting Solution",
    20454: "Secured Servers",
    29802: "Hivelocity",
    40676: "Psychz",
    30058: "FDCservers",
    25820: "IT7 Networks",
    19318: "Interserver",
    30633: "Leaseweb USA",
}


def client_ip(forwarded: Column, peer: Column) -> Column:
    """Only the right-most forwarded entry was added by our own proxy."""
    last = strip(F.element_at(F.split(forwarded, ",", -1), -1))
    return F.when(F.coalesce(forwarded, F.lit("")) != "", last).otherwise(
        F.coalesce(peer, F.lit(""))
    )


def _v4_hex(v4: Column) -> Column:
    octets = F.transform(F.split(v4, r"\."), lambda o: F.lpad(F.hex(o.cast("long")), 2, "0"))
    return F.lower(F.array_join(octets, ""))


def _groups_hex(text: Column) -> Column:
    groups = F.filter(F.split(text, ":", -1), lambda g: g != "")
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def _v6_hex(text: Column) -> Column:
    """Hex digits of lower-case IPv6 text without a zone, null for a malformed one."""
    tail = F.regexp_extract(text, rf":({_V4})\z", 1)
    flat = F.when(tail == "", text).otherwise(let(_v4_hex(tail), lambda h: F.concat(
        F.regexp_replace(text, rf"{_V4}\z", ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4))))

    def short(t: Column) -> Column:
        ends = F.array(
            _groups_hex(F.substring_index(t, "::", 1)), _groups_hex(F.substring_index(t, "::", -1)))
        return let(ends, lambda e: F.when(
            F.length(e[0]) + F.length(e[1]) <= 28,
            F.concat(e[0], F.repeat(F.lit("0"), F.lit(32) - F.length(e[0]) - F.length(e[1])), e[1])))

    return let(flat, lambda t: F.when(
        t.rlike(r"\A[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}\z"), _groups_hex(t)
    ).when(
        t.rlike(r"\A(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?\z"), short(t)))


def ip_key(ip: Column) -> Column:
    """32-digit hex key; null for text that is not an address."""
    return let(strip(ip), lambda t: F.when(
        t.rlike(rf"\A{_V4}\z"), F.concat(F.lit(_V4_PREFIX), _v4_hex(t))
    ).when(t.contains(":"), _v6_hex(F.lower(F.regexp_replace(t, r"%[^%]+\z", "")))))


def _bounds(block: str) -> tuple[str, str]:
    import ipaddress

    net = ipaddress.ip_network(block)
    first, last = int(net.network_address), int(net.broadcast_address)
    if net.version == 4:
        return _V4_PREFIX + f"{first:08x}", _V4_PREFIX + f"{last:08x}"
    return f"{first:032x}", f"{last:032x}"


def _in_blocks(key: Column, blocks: tuple[str, ...]) -> Column:
    return first_of([(key.between(*_bounds(b)), F.lit(True)) for b in blocks], F.lit(False))


def is_private_key(key: Column) -> Column:
    """is_private_ip for an address that already is a key."""
    v4 = _in_blocks(key, NOT_GLOBAL_V4) & ~_in_blocks(key, GLOBAL_V4)
    v6 = _in_blocks(key, NOT_GLOBAL_V6) & ~_in_blocks(key, GLOBAL_V6)
    return F.coalesce(F.when(key.startswith(_V4_PREFIX), v4).when(key.isNotNull(), v6), F.lit(False))


def is_private_ip(ip: Column) -> Column:
    """Not globally reachable. Text that is no address counts as not private."""
    return let(ip_key(ip), is_private_key)


def datacenter_name(asn: Column) -> Column:
    return first_of([(asn == k, F.lit(v)) for k, v in DATACENTER_NAMES.items()])


# --- range lookup ----------------------------------------------------------------------

_FINE_SPAN = 4096


def _slot_width(key: Column) -> Column:
    """Prefix length: /16 of IPv4 (28 digits), /32 of IPv6 (8 digits)."""
    return F.when(key.startswith(_V4_PREFIX), 28).otherwise(8)


def range_table(ranges: DataFrame, values: list[str]) -> DataFrame:
    """Ranges (start_ip, end_ip, values...) as one row per prefix slot they touch. A very
    wide IPv6 range goes into slots of four digits, so no range makes more than 65 536 rows."""
    r = ranges.select(
        ip_key(F.col("start_ip")).alias("first"), ip_key(F.col("end_ip")).alias("last"), *values
    )
    w = _slot_width(F.col("first"))

    def prefix_no(col: str, width: Column) -> Column:
        return F.conv(F.right(F.expr(f"left({col}, w)"), F.lit(8)), 16, 10).cast("long")

    r = r.withColumn("w", w)
    span = prefix_no("last", w) - prefix_no("first", w)
    r = r.withColumn("w", F.when((F.col("w") == 8) & (span > _FINE_SPAN), 4).otherwise(F.col("w")))
    nos = F.sequence(prefix_no("first", w), prefix_no("last", w))
    r = r.withColumn("no", F.explode(nos))
    tail = F.lower(F.lpad(F.hex(F.col("no")), 8, "0"))
    slot = (
        F.when(F.col("w") == 28, F.concat(F.lit("0" * 20), tail))
        .when(F.col("w") == 4, F.right(tail, F.lit(4)))
        .otherwise(tail)
    )
    return _disjoint(r.select(slot.alias("slot"), "first", "last", *values), values)


def _disjoint(slots: DataFrame, values: list[str]) -> DataFrame:
    """(slot, first, past, values...): the stretches of each slot in which one range is the most
    specific: the one that begins last, of those the one that ends first, of those the largest
    value. An address key k is in a stretch if first <= k < past. A point just behind an
    address is its key and a tilde, which sorts before the next key."""
    points = slots.select("slot", F.explode(F.array("first", F.concat("last", F.lit("~")))).alias("at")).distinct()
    inverse = F.translate("last", "0123456789abcdef", "fedcba9876543210")
    over = points.alias("p").join(slots.alias("r"), [
        F.col("p.slot") == F.col("r.slot"), F.col("r.first") <= F.col("p.at"), F.col("p.at") <= F.col("r.last")])
    best = over.groupBy("p.slot", "p.at").agg(
        F.max(F.struct("r.first", inverse.alias("inverse"), *[F.col(f"r.{v}") for v in values])).alias("best"))
    stretch = points.withColumn("past", F.lead("at").over(Window.partitionBy("slot").orderBy("at")))
    return stretch.join(best, ["slot", "at"]).select("slot", F.col("at").alias("first"), "past", *[F.col(f"best.{v}") for v in values])


def lookup_ranges(rows: DataFrame, key: str, ranges: DataFrame, values: list[str]) -> DataFrame:
    """Left join of each row's address key (see ip_key) with the most specific range that holds
    it; every row comes out once.

    The table of disjoint stretches is stored, so its measured size decides: Spark broadcasts it
    under the session's limit, and shuffles beyond. Very wide IPv6 ranges are a second, tiny
    table; where there are none, there is one join."""
    table = stored(range_table(ranges, values), "ranges")
    fine, wide = table.where(F.length("slot") > 4), table.where(F.length("slot") == 4)
    slot = F.expr(f"left(_key, CASE WHEN startswith(_key, '{_V4_PREFIX}') THEN 28 ELSE 8 END)")
    parts = [(fine, slot)]
    if not wide.isEmpty():
        parts.append((wide, F.when(~F.col("_key").startswith(_V4_PREFIX), F.left("_key", F.lit(4)))))
    out = rows.withColumn("_key", F.col(key))
    for i, (part, at) in enumerate(parts):
        part = part.select(
            F.col("slot").alias("_slot"), F.col("first").alias("_first"), F.col("past").alias("_past"),
            F.struct(*values).alias(f"_hit{i}"))
        out = out.withColumn("_at", at).join(part, [
            F.col("_at") == F.col("_slot"), F.col("_key") >= F.col("_first"), F.col("_key") < F.col("_past")],
            "left").drop("_slot", "_first", "_past", "_at")
    hit = F.coalesce(*[F.col(f"_hit{i}") for i in range(len(parts))])
    for v in values:
        out = out.withColumn(v, hit[v])
    return out.drop("_key", *[f"_hit{i}" for i in range(len(parts))])


_DIGITS = "array('0', '1', '2', '3', '4', '5', '6', '7', '8', '9', 'a', 'b', 'c', 'd', 'e', 'f')"


def _prefixes() -> Column:
    """The key prefixes whose addresses together are those from `first` to `last`, none twice. With
    `shared` leading digits in common, and `lo` and `hi` digits left of the trailing zeros of
    first and f of last: whole digits between the two, and down each side the digits above
    (below) the bound's own. That is at most 15 per side and digit, one for an aligned range."""

    def side(bound: str, end: str, compare: str) -> str:
        return f"""IF({end} > shared + 1, concat(flatten(transform(sequence(shared + 2, {end}), i ->
          transform(filter({_DIGITS}, d -> d {compare} substring({bound}, i, 1)), d -> concat(substring({bound}, 1, i - 1), d)))),
          array(left({bound}, {end}))), array())"""

    between = f"""transform(filter({_DIGITS}, d ->
      (d > substring(first, shared + 1, 1) OR (d = substring(first, shared + 1, 1) AND lo <= shared + 1)) AND
      (d < substring(last, shared + 1, 1) OR (d = substring(last, shared + 1, 1) AND hi <= shared + 1))),
      d -> concat(left(first, shared), d))"""
    return F.expr(f"""IF(lo <= shared AND hi <= shared, array(left(first, shared)),
      concat({between}, {side('first', 'lo', '>')}, {side('last', 'hi', '<')}))""")


def block_table(ranges: DataFrame, values: list[str]) -> DataFrame:
    """(prefix, best) of ranges (start_ip, end_ip, values...): per key prefix the most specific of the
    ranges that hold all of its addresses: the one that begins last, of those the one that ends
    first, of those the largest value. Ranges that are no addresses or end before they begin are
    left out."""
    r = ranges.select(ip_key(F.col("start_ip")).alias("first"), ip_key(F.col("end_ip")).alias("last"), *values)
    r = r.where("first <= last").selectExpr(
        "*", "size(filter(sequence(1, 32), i -> left(first, i) = left(last, i))) AS shared",
        "length(trim(TRAILING '0' FROM first)) AS lo", "length(trim(TRAILING 'f' FROM last)) AS hi")
    inverse = F.translate("last", "0123456789abcdef", "fedcba9876543210").alias("inverse")
    return r.select(F.explode(_prefixes()).alias("prefix"), F.struct("first", inverse, *values).alias("best")).groupBy(
        "prefix").agg(F.max("best").alias("best"))


def lookup_blocks(rows: DataFrame, key: str, ranges: DataFrame, values: list[str]) -> DataFrame:
    """lookup_ranges() for range tables of any size and density: no two ranges meet each other, and
    an address meets one row per prefix length in use (33 at most), all by equality.

    Addresses are made distinct first, so a hot one is looked up once; then rows meet the answers
    by address. `rows` is read twice. Columns of `rows` named as `values` are replaced."""
    table = stored(block_table(ranges, values), "blocks")
    lengths = table.agg(F.collect_set(F.length("prefix"))).first()[0]
    tried = rows.select(F.col(key).alias("at")).where("at IS NOT NULL").distinct().select(
        "at", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")).selectExpr(
        "at", "left(at, n) AS prefix")
    best = tried.join(table, "prefix").groupBy("at").agg(F.max("best").alias("best"))
    found = best.select("at", *[F.col(f"best.{v}").alias(v) for v in values])
    rows = rows.drop(*values)
    return rows.join(found, rows[key] == found["at"], "left").drop(found["at"])


def with_datacenter(rows: DataFrame, key: str, asn_ranges: DataFrame) -> DataFrame:
    """Adds dc_asn for addresses of listed hosting networks. Only listed networks are kept
    from the range table, before it is split into slots."""
    listed = asn_ranges.where(F.col("asn").isin(*DATACENTER_NAMES)).select(
        "start_ip", "end_ip", F.col("asn").alias("dc_asn")
    )
    return lookup_ranges(rows, key, listed, ["dc_asn"])


def with_geo(rows: DataFrame, key: str, geo_ranges: DataFrame) -> DataFrame:
    """Adds country and first subdivision; nothing finer exists."""
    return lookup_ranges(rows, key, geo_ranges, ["country", "region"])


# --- visitor hash ----------------------------------------------------------------------

def visitor_hash(ip: Column, ua: Column, site_id: Column, day_salt: Column, secret: str) -> Column:
    """One-way within-a-day visitor key. Null without a salt: there is no fallback."""
    pepper = F.sha2(F.concat(F.lit(secret + ":"), day_salt), 256)
    raw = F.concat_ws("|", pepper, ip, F.coalesce(ua, F.lit("")), site_id.cast("string"))
    return F.when(F.coalesce(day_salt, F.lit("")) != "", F.sha2(raw, 256))
