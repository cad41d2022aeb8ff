"""User-agent and header classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of non-human traffic.
BOT_CLASSES = ("ai", "agent", "search", "social", "monitor", "script", "datacenter", "other")

# Generic robot words.
BOT_WORDS = (
    r"bot|crawl|spider|slurp|bingpreview|facebookexternalhit|embedly|preview|"
    r"pinterest|whatsapp|telegram|headless|monitor|uptime|curl|wget|"
    r"python-requests|axios|go-http|libwww|scrapy|semrush|ahrefs|lighthouse|"
    r"gtmetrix|pingdom|dataprovider|phantom|selenium"
)

# What a bare robot word says about the class.
WORD_CLASS = {
    "empty": "script", "curl": "script", "headless": "script", "go-http": "script",
    "libwww": "script", "monitor": "monitor", "uptime": "monitor",
    "telegram": "social", "preview": "other",
}

# Known agents, first match wins (lower-case token, name, class).
KNOWN_AGENTS = (
    ("chatgpt-user", "ChatGPT-User", "ai"),
    ("oai-searchbot", "OAI-SearchBot", "ai"),
    ("gptbot", "GPTBot", "ai"),
    ("claude-user", "Claude-User", "ai"),
    ("claude-searchbot", "Claude-SearchBot", "ai"),
    ("claudebot", "ClaudeBot", "ai"),
    ("claude-web", "Claude-Web", "ai"),
    ("anthropic-ai", "anthropic-ai", "ai"),
    ("perplexity-user", "Perplexity-User", "ai"),
    ("perplexitybot", "PerplexityBot", "ai"),
    ("mistralai-user", "MistralAI-User", "ai"),
    ("duckassistbot", "DuckAssistBot", "ai"),
    ("meta-externalagent", "meta-externalagent", "ai"),
    ("meta-externalfetcher", "meta-externalfetcher", "ai"),
    ("facebookbot", "FacebookBot", "ai"),
    ("bytespider", "Bytespider", "ai"),
    ("ccbot", "CCBot", "ai"),
    ("amazonbot", "Amazonbot", "ai"),
    ("google-cloudvertexbot", "Google-CloudVertexBot", "ai"),
    ("cohere-ai", "cohere-ai", "ai"),
    ("cohere-training-data-crawler", "cohere-ai", "ai"),
    ("youbot", "YouBot", "ai"),
    ("diffbot", "Diffbot", "ai"),
    ("ai2bot", "AI2Bot", "ai"),
    ("timpibot", "Timpibot", "ai"),
    ("imagesiftbot", "ImagesiftBot", "ai"),
    ("omgilibot", "Omgilibot", "ai"),
    ("google-inspectiontool", "Google-InspectionTool", "search"),
    ("storebot-google", "Storebot-Google", "search"),
    ("adsbot-google", "AdsBot-Google", "search"),
    ("mediapartners-google", "Mediapartners-Google", "search"),
    ("googleother", "GoogleOther", "search"),
    ("googlebot", "Googlebot", "search"),
    ("bingpreview", "BingPreview", "search"),
    ("bingbot", "Bingbot", "search"),
    ("applebot", "Applebot", "search"),
    ("yandex.com/bots", "YandexBot", "search"),
    ("baiduspider", "Baiduspider", "search"),
    ("duckduckbot", "DuckDuckBot", "search"),
    ("petalbot", "PetalBot", "search"),
    ("seznambot", "SeznamBot", "search"),
    ("qwantbot", "Qwantbot", "search"),
    ("mojeekbot", "MojeekBot", "search"),
    ("naver.me/spd", "Yeti (Naver)", "search"),
    ("sogou web spider", "Sogou", "search"),
    ("slurp", "Yahoo Slurp", "search"),
    ("facebookexternalhit", "facebookexternalhit", "social"),
    ("facebot", "Facebot", "social"),
    ("twitterbot", "Twitterbot", "social"),
    ("linkedinbot", "LinkedInBot", "social"),
    ("slackbot", "Slackbot", "social"),
    ("slack-imgproxy", "Slackbot", "social"),
    ("discordbot", "Discordbot", "social"),
    ("telegrambot", "TelegramBot", "social"),
    ("whatsapp", "WhatsApp", "social"),
    ("pinterest", "Pinterest", "social"),
    ("redditbot", "redditbot", "social"),
    ("skypeuripreview", "Skype", "social"),
    ("mastodon/", "Mastodon", "social"),
    ("embedly", "Embedly", "social"),
    ("iframely", "Iframely", "social"),
    ("uptimerobot", "UptimeRobot", "monitor"),
    ("pingdom", "Pingdom", "monitor"),
    ("statuscake", "StatusCake", "monitor"),
    ("site24x7", "Site24x7", "monitor"),
    ("better uptime", "Better Stack", "monitor"),
    ("betterstack", "Better Stack", "monitor"),
    ("uptime-kuma", "Uptime Kuma", "monitor"),
    ("hetrixtools", "HetrixTools", "monitor"),
    ("updown.io", "updown.io", "monitor"),
    ("checkly", "Checkly", "monitor"),
    ("datadogsynthetics", "Datadog", "monitor"),
    ("newrelicpinger", "New Relic", "monitor"),
    ("chrome-lighthouse", "Lighthouse", "monitor"),
    ("lighthouse", "Lighthouse", "monitor"),
    ("gtmetrix", "GTmetrix", "monitor"),
    ("semrush", "SemrushBot", "monitor"),
    ("ahrefs", "AhrefsBot", "monitor"),
    ("mj12bot", "MJ12bot", "monitor"),
    ("dotbot", "DotBot", "monitor"),
    ("rogerbot", "rogerbot", "monitor"),
    ("screaming frog", "Screaming Frog", "monitor"),
    ("siteauditbot", "SiteAuditBot", "monitor"),
    ("dataforseobot", "DataForSeoBot", "monitor"),
    ("blexbot", "BLEXBot", "monitor"),
    ("serpstatbot", "serpstatbot", "monitor"),
    ("dataprovider", "Dataprovider", "monitor"),
    ("headlesschrome", "HeadlessChrome", "script"),
    ("phantomjs", "PhantomJS", "script"),
    ("selenium", "Selenium", "script"),
    ("puppeteer", "Puppeteer", "script"),
    ("playwright", "Playwright", "script"),
    ("curl/", "curl", "script"),
    ("wget", "Wget", "script"),
    ("python-requests", "python-requests", "script"),
    ("python-urllib", "python-urllib", "script"),
    ("python-httpx", "python-httpx", "script"),
    ("aiohttp", "aiohttp", "script"),
    ("axios", "axios", "script"),
    ("node-fetch", "node-fetch", "script"),
    ("undici", "undici", "script"),
    ("go-http-client", "Go-http-client", "script"),
    ("okhttp", "okhttp", "script"),
    ("apache-httpclient", "Apache-HttpClient", "script"),
    ("java/", "Java", "script"),
    ("libwww-perl", "libwww-perl", "script"),
    ("scrapy", "Scrapy", "script"),
    ("postmanruntime", "PostmanRuntime", "script"),
)

# Operators that sign their requests.
SIGNING_HOSTS = {"chatgpt.com": "ChatGPT Agent", "openai.com": "ChatGPT Agent"}

# Search hosts no engine uses, and user agents no browser sends.
FAKE_SEARCH_HOST = (
    r"\A(?:www\.)?(?:yahoo|bing|yandex|baidu)\."
    r"(?:no|se|dk|fi|is|de|fr|nl|be|at|ch|it|es|pt|pl|cz|ie|uk|co\.uk)\z"
)
FAKER_OPERA = r"\AOpera/\d+\.\d+\.\("
PRESTO_MODERN = (
    r"Presto/.*(?:Windows NT 1[01]|Chrome/|Edg/)|(?:Windows NT 1[01]|Chrome/|Edg/).*Presto/"
)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_of(pairs: list[tuple[Column, object]], default: object = None) -> Column:
    """CASE over (condition, value) pairs; the first true condition wins."""
    head, *rest = pairs
    out = reduce(lambda c, p: c.when(*p), rest, F.when(*head))
    return out if default is None else out.otherwise(default)


def _blank(ua: Column) -> Column:
    return ua.isNull() | ~ua.rlike(r"(?U)[^\s]")


def _word_in(low: Column) -> Column:
    """First robot word of a lower-cased user agent, else null. The cheap containment tests
    spare people the regular expression."""
    any_word = reduce(lambda x, y: x | y, [low.contains(w) for w in BOT_WORDS.split("|")])
    return F.when(any_word, F.regexp_extract(low, f"({BOT_WORDS})", 1))


def bot_match(ua: Column) -> Column:
    """'empty' for a blank user agent, else the robot word found, else null."""
    return F.when(_blank(ua), "empty").otherwise(_word_in(F.lower(ua)))


def parse_ua(ua: Column) -> Column:
    """struct<device, browser, os> in coarse categories."""
    u = F.lower(ua)

    def says(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [u.contains(w) for w in words])

    os_ = first_of([
        (says("windows"), "Windows"), (says("iphone", "ipad", "ios"), "iOS"),
        (says("mac os x", "macintosh"), "macOS"), (says("android"), "Android"),
        (says("linux"), "Linux"),
    ], "Annet")
    device = first_of([
        (says("ipad", "tablet") | (says("android") & ~says("mobile")), "tablet"),
        (says("mobile", "iphone", "android"), "mobil"),
    ], "desktop")
    browser = first_of([
        (says("edg"), "Edge"), (says("opr", "opera"), "Opera"),
        (says("samsungbrowser"), "Samsung Internet"), (says("firefox", "fxios"), "Firefox"),
        (says("chrome", "crios"), "Chrome"), (says("safari"), "Safari"),
    ], "Annet")
    return F.struct(device.alias("device"), browser.alias("browser"), os_.alias("os"))


def impossible_ua(ua: Column) -> Column:
    """Why no browser can have sent this user agent, else null."""
    return F.when(ua.rlike(FAKER_OPERA), "faker-opera").when(
        ua.contains("Presto/") & ua.rlike(PRESTO_MODERN), "presto-modern"
    )


def spoofed_referrer(host: Column) -> Column:
    h = F.regexp_replace(F.lower(F.trim(host)), r"\.+\z", "")
    return F.coalesce(h.rlike(FAKE_SEARCH_HOST), F.lit(False))


def _verdict(cls: Column, agent: Column) -> Column:
    return F.struct(cls.alias("bot_class"), agent.alias("agent"))


def _known_no(low: Column) -> Column:
    """Position of the first known agent a lower-cased user agent names, else null."""
    return first_of([(low.contains(token), F.lit(i)) for i, (token, _, _) in enumerate(KNOWN_AGENTS)])


def _pick(field: int, no: Column) -> Column:
    return F.get(F.array(*[F.lit(a[field]) for a in KNOWN_AGENTS]), no)


def _by_ua(blank: Column, known: Column, word: Column, ua: Column) -> Column:
    word_class = first_of([(word == w, F.lit(c)) for w, c in WORD_CLASS.items()], F.lit("other"))
    return (
        F.when(blank, _verdict(F.lit("script"), F.lit("empty")))
        .when(known.isNotNull(), _verdict(_pick(2, known), _pick(1, known)))
        .when(word.isNotNull(), _verdict(word_class, word))
        .when(impossible_ua(ua).isNotNull(), _verdict(F.lit("script"), F.lit("fake-ua")))
    )


def classify_ua(ua: Column) -> Column:
    """struct<bot_class, agent> for a user agent that is not a person, else null."""
    return let(F.lower(ua), lambda low: let(
        F.struct(_known_no(low).alias("known"), _word_in(low).alias("word")),
        lambda f: _by_ua(_blank(ua), f["known"], f["word"], ua)))


def is_named_agent(agent: Column) -> Column:
    return agent.isin(*sorted({name for _, name, _ in KNOWN_AGENTS}))


def signed_agent(signature_agent: Column, signature_input: Column) -> Column:
    """Agent name for a request with signature headers, else null."""
    sig = F.lower(F.regexp_replace(F.trim(F.coalesce(signature_agent, F.lit(""))), r'\A"+|"+\z', ""))
    declared = F.lower(F.coalesce(signature_input, F.lit(""))).contains("web-bot-auth")
    host = F.regexp_extract(F.regexp_replace(sig, r"\A.*?://", ""), r"\A[^/]*", 0)
    name = first_of([
        ((host == h) | host.endswith("." + h), F.lit(n)) for h, n in SIGNING_HOSTS.items()
    ], F.lit("Web Bot Auth"))
    return F.when((sig != "") | declared, name)


def with_robot(
    hits: DataFrame, ua: str, signature_agent: str, signature_input: str, webdriver: str, ref_host: str
) -> DataFrame:
    """Adds `robot`, struct<bot_class, agent> or null for a person. Named robot, then
    signature, then the webdriver flag, then a bare robot word or impossible user agent, then
    a fake referrer. The steps are columns of their own, so each is computed once per row."""
    h = hits.withColumn("_ua", F.coalesce(F.col(ua), F.lit(""))).withColumn("_low", F.lower("_ua"))
    h = h.withColumn("_known", _known_no(F.col("_low"))).withColumn("_word", _word_in(F.col("_low")))
    h = h.withColumn("_by_ua", _by_ua(_blank(F.col("_ua")), F.col("_known"), F.col("_word"), F.col("_ua")))
    h = h.withColumn("_signed", signed_agent(F.col(signature_agent), F.col(signature_input)))
    robot = (
        F.when(is_named_agent(F.col("_by_ua.agent")), F.col("_by_ua"))
        .when(F.col("_signed").isNotNull(), _verdict(F.lit("agent"), F.col("_signed")))
        .when(F.col(webdriver), _verdict(F.lit("agent"), F.lit("webdriver")))
        .when(F.col("_by_ua").isNotNull(), F.col("_by_ua"))
        .when(spoofed_referrer(F.col(ref_host)), _verdict(F.lit("script"), F.lit("fake-referrer")))
    )
    return h.withColumn("robot", robot).drop("_ua", "_low", "_known", "_word", "_by_ua", "_signed")
