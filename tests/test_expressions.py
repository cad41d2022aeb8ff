"""Cleaning, masking and classification on the case tables of the rules."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from footfall.functions import agents, cleaning, masking, network, numbers, referrers

HEX16 = "00ff11ee22dd33cc"


def by_length(make, least, most):
    """Paths with a segment of `least` to `most` characters; `make` gives the segment."""
    return [f"/x/{make(n)}/y" for n in range(least, most + 1)]


def masked_twice(n):
    return ["/x/:id/y"] * n


def column(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("r")).collect()]


def test_numbers_are_masked_from_twelve_digits(spark):
    rows = by_length(lambda n: "7" * n, 10, 14)
    assert column(spark, rows, masking.mask_path) == rows[:2] + masked_twice(3)


def test_hex_runs_are_masked_from_twelve_with_a_digit(spark):
    rows = by_length(lambda n: ("a1" * n)[:n], 10, 13)
    assert column(spark, rows, masking.mask_path) == rows[:2] + masked_twice(2)
    letters = by_length(lambda n: "a" * n, 10, 13)  # no digit
    assert column(spark, letters, masking.mask_path) == letters
    broken = ["/x/a1a1a1-b2b2b2/y", "/x/g0a1a1a1a1a1a/y"]  # runs of 6; a run of 12 after a letter that is no hex digit
    assert column(spark, broken, masking.mask_path) == [broken[0], "/x/:id/y"]


def test_mixed_runs_are_masked_from_sixteen(spark):
    rows = by_length(lambda n: ("q9w" * n)[:n], 14, 17)
    assert column(spark, rows, masking.mask_path) == rows[:2] + masked_twice(2)


def test_tokens_are_masked_by_class_changes(spark):
    def token(n, changes):  # n characters in `changes` + 1 stretches of turning class, no run of 16 alphanumerics
        flip, out = ["p", "4"], []
        for i in range(n):
            out.append(flip[min(i, changes) % 2])
        out[8] = "_"
        return "".join(out)

    rows = [f"/x/{token(18, c)}/y" for c in (4, 5, 6, 7)]
    want = []
    for path in rows:
        seg = path.split("/")[2]
        kind = ["d" if c.isdigit() else "l" if c.isalpha() else "-" for c in seg]
        changes = sum({x, y} == {"d", "l"} for x, y in zip(kind, kind[1:]))
        want.append("/x/:id/y" if changes >= max(5, -(-len(seg) // 3)) else path)
    assert column(spark, rows, masking.mask_path) == want
    assert len(set(want)) > 1


def test_uuids_mails_and_order_numbers(spark):
    uuid = "0f0e0d0c-1a2b-3c4d-5e6f-a0b1c2d3e4f5"
    rows = {
        f"/{uuid}": "/:id", f"/a-{uuid.upper()}.txt/b": "/:id/b",
        "/to/kari@post.test/x": "/to/:id/x", "/to/kari%40post.test": "/to/:id", "/to/kari@post": "/to/kari@post", "/@post.test": "/@post.test",
        "": "", "/": "/", "/:id/:id": "/:id/:id", "/a//b/": "/a//b/",
    }
    for slug in masking.ORDER_SLUGS:
        rows |= {f"/{slug}/3": f"/{slug}/:id", f"/{slug.upper()}/n-3/z": f"/{slug.upper()}/:id/z", f"/{slug}/abc": f"/{slug}/abc",
                 f"/{slug}s-x/3": f"/{slug}s-x/3", f"/3/{slug}": f"/3/{slug}"}
    assert column(spark, list(rows), masking.mask_path) == list(rows.values())


def test_masking_twice_is_masking_once(spark):
    import random

    rng = random.Random(12)
    rows = ["/" + "/".join("".join(rng.choices("ab9Z-_@.%4", k=rng.randrange(22))) for _ in range(4)) for _ in range(400)]
    once = column(spark, rows, masking.mask_path)
    assert column(spark, once, masking.mask_path) == once and any(":id" in p for p in once)


def test_labels(spark):
    cases = {
        "kjop": "kjop", f"pay {HEX16} now": "pay :id now", f"pay_{HEX16}": ":id", f"{HEX16}/b\t{HEX16}": ":id/b\t:id",
        "two  spaces 3": "two  spaces 3", None: None, "": "",
    }
    assert column(spark, list(cases), masking.mask_label) == list(cases.values())


def test_names_and_paths(spark):
    assert column(spark, [None, "  ", " signup ", f"x {HEX16}", "y" * 70], cleaning.clean_name) == [
        "pageview", "pageview", "signup", "x :id", "y" * 64]
    cases = {
        "/a?b=1": "/a", "/a#x": "/a", "https://u:p@h.no:8/p/q?x#y": "/p/q", "http://h.no": "/", "a/b": "/",
        None: "/", " /x ": "/x", "https://h.no/a;b=1": "/a", "https://h.no/a;b/c": "/a;b/c", "/a;b": "/a;b",
        "//h/p": "//h/p", "https://h.no/order/1234": "/order/:id", "/" + "x" * 600: "/" + "x" * 511,
    }
    assert column(spark, list(cases), cleaning.clean_path) == list(cases.values())


def test_referrers(spark):
    cases = {
        "https://www.Google.com/search?q=x": "www.google.com", "https://u:p@Host.no:8080/x": "host.no",
        "android-app://com.x/": "com.x", "google.com": None, "": None, None: None, "//x.no/a": "x.no",
        "https://[::1]:80/x": "::1", "https://[::1/x": None, "https://h.no#frag": "h.no", "mailto:a@b.no": None,
    }
    assert column(spark, list(cases), cleaning.referrer_host) == list(cases.values())


def test_domains(spark):
    cases = {
        "https://Eksempel.NO/": "eksempel.no", "www.eksempel.no": "eksempel.no",
        "sidebygger.no/s/Kunde-1": "sidebygger.no/s/kunde-1", "a.no/x?y=1": "a.no/x", "": "", "   ": "",
        None: "", "a" * 253: "a" * 253, "a" * 254: "", "https://www.a.no/sti/": "a.no/sti",
    }
    assert column(spark, list(cases), cleaning.normalize_domain) == list(cases.values())


def test_typed_fields(spark):
    rows = {
        '{"rv":100,"cur":"nok"}': (100, "NOK"), '{"rv":100.0,"cur":""}': (100, "NOK"), '{"rv":1e3}': (1000, "NOK"),
        '{"rv":1.5,"cur":null}': (None, "NOK"), '{"rv":"100","cur":"KR"}': (None, None), '{"rv":true,"cur":7}': (None, None),
        '{"rv":-1,"cur":" eur "}': (None, "EUR"), '{"rv":100000001,"cur":"€"}': (None, None), '{"rv":0}': (0, "NOK"),
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string").withColumn(
        "p", F.try_parse_json("v")).orderBy("i")
    got = df.select(
        cleaning.clean_money(F.try_variant_get("p", "$.rv", "variant")),
        cleaning.clean_currency(F.try_variant_get("p", "$.cur", "variant"))).collect()
    assert [tuple(r) for r in got] == list(rows.values())


def test_items(spark):
    body = ('{"it":[{"n":" A ","q":2,"p":150},{"n":"B","q":true,"p":"x"},{"n":"","q":1},{"n":7},4,'
            '{"n":"C","q":1000,"p":9.0},{"n":"D","q":3.0}]}')
    many = '{"it":[' + ",".join('{"n":"x"}' for _ in range(30)) + "]}"
    df = spark.createDataFrame([(0, body), (1, many), (2, '{"it":{"n":"x"}}'), (3, "{}")], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(cleaning.clean_items(
        F.try_variant_get(F.try_parse_json("v"), "$.it", "variant"))).collect()]
    assert [tuple(x) for x in got[0]] == [("A", 2, 150), ("B", 1, 0), ("C", 1, 9), ("D", 3, 0)]
    assert len(got[1]) == 30 and got[2] == [] and got[3] == []


CHROME = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0 Safari/537.36"


def test_every_listed_agent_is_found_in_a_sentence_of_its_own(spark):
    tokens = [t for t, _, _ in agents.KNOWN_AGENTS]
    got = column(spark, [f"Visitor/2.0 with {t.upper()}/1" for t in tokens], agents.classify_ua)
    for i, (token, g) in enumerate(zip(tokens, got)):
        first = next(x for x in agents.KNOWN_AGENTS[:i + 1] if x[0] in f"visitor/2.0 with {token}/1")
        assert (g["agent"], g["bot_class"]) == first[1:]


def test_agents(spark):
    nobody = ["", "  \t", None]
    assert [tuple(g) for g in column(spark, nobody, agents.classify_ua)] == [("script", "empty")] * 3
    assert column(spark, [CHROME], agents.classify_ua) == [None]
    kinds = {"Own thing (GPTBot)": "ai", "x Googlebot y": "search", "curl/1": "script", "own-crawler/1": "other"}
    assert [g["bot_class"] for g in column(spark, list(kinds), agents.classify_ua)] == list(kinds.values())
    both = column(spark, ["Opera/7.1 Googlebot"], agents.classify_ua)[0]  # a name wins over a fake version
    assert both["bot_class"] == "search"
    devices = {
        CHROME: "desktop", CHROME.replace("X11; Linux x86_64", "iPhone; CPU iPhone OS 18_1 like Mac OS X").replace("Chrome/131.0", "Mobile/15E148"): "mobil",
        CHROME.replace("X11; Linux x86_64", "Linux; Android 15; Pixel Tablet"): "tablet", "anything": "desktop",
    }
    assert [r["device"] for r in column(spark, list(devices), agents.parse_ua)] == list(devices.values())


def test_fake_referrers(spark):
    bad = ["www.yahoo.no", "baidu.no", "WWW.Yandex.NO", "bing.co.uk", "baidu.no."]
    good = [None, "", "www.google.no", "bing.com", "no.search.yahoo.com", "yandex.com.tr", "notyahoo.no", "yahoo.no.example.com"]
    assert column(spark, bad + good, agents.spoofed_referrer) == [True] * len(bad) + [False] * len(good)


def test_signatures(spark):
    df = spark.createDataFrame([
        (0, None, None), (1, None, 'sig1=("@authority");tag="other"'), (2, '"https://chatgpt.com"', None),
        (3, "https://agent.example", None), (4, None, 'sig1=("@authority");created=1;tag="web-bot-auth"')],
        "i int, a string, b string").orderBy("i")
    got = [r[0] for r in df.select(agents.signed_agent(F.col("a"), F.col("b"))).collect()]
    assert got == [None, None, "ChatGPT Agent", "Web Bot Auth", "Web Bot Auth"]


IPS = [
    "10.1.2.3", "192.168.1.50", "127.0.0.1", "169.254.1.1", "100.64.0.1", "172.16.0.1", "172.32.0.1", "8.8.8.8",
    "192.0.0.9", "192.0.0.8", "198.51.100.7", "203.0.113.9", "255.255.255.255", "224.0.0.1", "239.1.1.1", "0.0.0.0",
    "::1", "::", "fc00::1", "fe80::1", "2001:db8::1", "2606:4700:4700::1111", "::ffff:10.0.0.1", "::ffff:8.8.8.8",
    "2001:4:112::1", "2001:20::1", "2001::1", "2002::1", "ff02::1", "64:ff9b::1.2.3.4", "64:ff9b:1::1", "100::1",
    "fe80::1%eth0", "not-an-ip", "", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", " 10.0.0.1 ", "1::2::3",
    "1:2:3:4:5:6:7:8:9", "12345::", "::1.2.3.4", "1:2:3:4:5:6:7::", "2a02:6b8::feed:ff",
]


def test_private_addresses(spark):
    def want(ip):
        try:
            a = ipaddress.ip_address(ip.strip())
        except ValueError:
            return False
        if a.version == 6 and a.ipv4_mapped is not None:
            a = a.ipv4_mapped
        return not a.is_global

    got = column(spark, IPS, network.is_private_ip)
    assert dict(zip(IPS, got)) == {ip: want(ip) for ip in IPS}


def test_address_keys(spark):
    def want(ip):
        try:
            a = ipaddress.ip_address(ip.strip())
        except ValueError:
            return None
        return f"{int(a):032x}" if a.version == 6 else "0" * 20 + f"ffff{int(a):08x}"

    assert column(spark, IPS, network.ip_key) == [want(ip) for ip in IPS]


def test_range_lookup(spark):
    ranges = spark.createDataFrame([
        ("10.0.0.0", "10.255.255.255", "A"), ("11.0.0.0", "11.0.0.255", "B"), ("2a00::", "2a0f:ffff::ffff", "C"),
        ("2001:db8::", "2001:db8:0:ffff::", "D")], "start_ip string, end_ip string, name string")
    ips = ["10.0.0.0", "10.77.1.2", "11.0.0.255", "11.0.1.0", "2a05::9", "2001:db8::5", "2001:db9::", "x"]
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string")
    rows = rows.withColumn("key", network.ip_key(F.col("ip")))
    got = [r.name for r in network.lookup_ranges(rows, "key", ranges, ["name"]).orderBy("i").collect()]
    assert got == ["A", "A", "B", None, "C", "D", None, None]


@pytest.mark.parametrize("lookup", [network.lookup_ranges, network.lookup_blocks])
def test_most_specific_of_overlapping_ranges(spark, lookup):
    rng = random.Random(4)
    made, asked = [], []
    for base, room in ((int(ipaddress.ip_address("84.5.0.0")), 1 << 17), (int(ipaddress.ip_address("2a00:1::")), 1 << 70)):
        def text(n, base=base):
            return str(ipaddress.ip_address(base + n))
        for i in range(120):
            a = rng.choice([rng.randrange(room), rng.randrange(40), rng.randrange(room >> 8) << 8])
            z = min(room - 1, a + rng.choice([0, 1, 15, 255, rng.randrange(room), (1 << rng.randrange(12)) - 1]))
            made.append((text(a), text(z), f"n{i % 50:02d}"))
        asked += [text(rng.choice([rng.randrange(room), rng.randrange(300)])) for _ in range(150)]
        asked += [x for r in made[-20:] for x in r[:2]]
    made += [("84.5.0.9", "84.5.0.1", "turned"), ("x", "84.5.0.1", "bad"), (None, None, "null"), ("0.0.0.0", "255.255.255.255", "all")]
    asked += ["0.0.0.0", "255.255.255.255", "::", "", None, "84.5.0.1", "84.5.0.1"]

    def number(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None
        return int(a) + (0xFFFF << 32 if a.version == 4 else 0)

    held = [(number(a), number(z), n) for a, z, n in made if number(a) is not None and number(z) is not None]
    want = []
    for ip in asked:
        k = number(ip)
        met = [(a, -z, n) for a, z, n in held if k is not None and a <= k <= z]
        want.append(max(met)[2] if met else None)
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, ip string").withColumn("key", network.ip_key(F.col("ip")))
    ranges = spark.createDataFrame(made, "start_ip string, end_ip string, name string")
    got = lookup(rows, "key", ranges, ["name"]).orderBy("i").collect()
    assert [r.i for r in got] == list(range(len(asked))) and [r.name for r in got] == want
    if lookup is network.lookup_blocks:
        none = lookup(rows, "key", ranges.limit(0), ["name"])
        assert none.count() == len(asked) and none.where("name IS NOT NULL").isEmpty()
        aligned = ranges.limit(0).unionByName(spark.sql("SELECT '84.0.0.0' AS start_ip, '84.255.255.255' AS end_ip, 'a' AS name"))
        assert [len(r.prefix) for r in network.block_table(aligned, ["name"]).collect()] == [26]


def test_visitor_hash(spark):
    import hashlib

    salt = hashlib.sha256(b"secret:salt").hexdigest()
    want = hashlib.sha256(f"{salt}|1.2.3.4|UA|7".encode()).hexdigest()
    got = spark.range(1).select(
        network.visitor_hash(F.lit("1.2.3.4"), F.lit("UA"), F.lit(7), F.lit("salt"), "secret"),
        network.visitor_hash(F.lit("1.2.3.4"), F.lit("UA"), F.lit(7), F.lit(""), "secret")).first()
    assert tuple(got) == (want, None)


def test_client_ip(spark):
    df = spark.createDataFrame([(0, "1.1.1.1, 2.2.2.2 ", "9.9.9.9"), (1, "", "9.9.9.9"), (2, None, None)], "i int, x string, p string")
    assert [r[0] for r in df.orderBy("i").select(network.client_ip(F.col("x"), F.col("p"))).collect()] == [
        "2.2.2.2", "9.9.9.9", ""]


@pytest.mark.parametrize("cents,text", [(12345, "123,45"), (5, "0,05"), (-150, "-1,50"), (None, "0,00"), (0, "0,00")])
def test_money(spark, cents, text):
    assert column(spark, [cents], numbers.money_text, "long") == [text]


def test_cells(spark):
    assert column(spark, ["=1", "+1", "-1", "@x", "\tx", "\rx", "/ok", ""], numbers.safe_cell) == [
        "'=1", "'+1", "'-1", "'@x", "'\tx", "'\rx", "/ok", ""]
    assert column(spark, [1.0, 2.5, 3.14159, 0.1], lambda c: numbers.cell(c, "double"), "double") == [
        "1", "2,5", "3,1416", "0,1"]
    assert column(spark, [True, False, None], lambda c: numbers.cell(c, "boolean"), "boolean") == ["ja", "nei", ""]


def test_ai_keys(spark):
    df = spark.createDataFrame([
        (0, "chatgpt.com", None), (1, "www.perplexity.ai", "x"), (2, None, "ChatGPT"), (3, "google.com", "claude.ai"),
        (4, None, "www.claude.ai")], "i int, r string, u string").orderBy("i")
    got = [r[0] for r in df.select(referrers.ai_key(F.col("r"), F.col("u"))).collect()]
    assert got == ["chatgpt.com", "perplexity.ai", "chatgpt.com", "claude.ai", "claude.ai"]
