import datetime as dt

import pytest
from pyspark.sql import functions as F

from emendata.functions import dates, http, text, urls

URLS = [
    # (address, identity, why)
    ("http://www.paper.example/politics/story-1.html?utm_source=x&utm_medium=y", "https://paper.example/politics/story-1.html", "campaign tags, www, http"),
    ("https://m.paper.example/a/b-2.html", "https://paper.example/a/b-2.html", "mobile host"),
    ("https://amp.paper.example/w/story?CMP=tw", "https://paper.example/w/story", "amp host, capitals in a tag"),
    ("https://paper.example/w/story/amp", "https://paper.example/w/story", "amp segment"),
    ("https://paper-example.cdn.ampproject.org/c/s/www.paper.example/n/w-1.amp", "https://paper.example/n/w-1", "amp cache"),
    ("https://paper-example.cdn.ampproject.org/v/paper.example/n?b=2&amp_js_v=1", "https://paper.example/n?b=2", "amp cache with a query"),
    ("https://paper.example/s/?outputType=amp", "https://paper.example/s", "rendition marker, slash"),
    ("https://paper.example/s?format=pdf", "https://paper.example/s?format=pdf", "another format is another thing"),
    ("https://paper.example/s?amp", "https://paper.example/s", "marker without value"),
    ("https://paper.example/s?m=1&mobile=TRUE&x=1", "https://paper.example/s?x=1", "mobile markers"),
    ("https://paper.example/s?m=2", "https://paper.example/s?m=2", "m that is no marker"),
    ("https://paper.example/s#part", "https://paper.example/s", "fragment"),
    ("https://paper.example/m/news/t.html?ito=x", "https://paper.example/news/t.html", "leading m segment"),
    ("https://paper.example/t?b=2&a=1&page=3", "https://paper.example/t?a=1&b=2&page=3", "sorted"),
    ("https://paper.example:443/t", "https://paper.example/t", "default port"),
    ("http://paper.example:80/t", "https://paper.example/t", "default port of http"),
    ("https://paper.example:8443/t", "https://paper.example:8443/t", "another port"),
    ("https://paper.example/x/../y/./z//q", "https://paper.example/y/z/q", "dot segments and slashes"),
    ("https://paper.example/%c3%bcber?q=%c3%a4", "https://paper.example/%C3%BCber?q=%C3%A4", "escapes"),
    ("HTTPS://WWW.Paper.EXAMPLE/Path", "https://paper.example/Path", "case"),
    ("https://user:pw@www.paper.example/t/", "https://paper.example/t", "credentials"),
    ("https://paper.example/a-1.amp.html", "https://paper.example/a-1.html", "amp before the extension"),
    ("https://www.m.org/t", "https://m.org/t", "a host is not eaten"),
    ("https://m.org", "https://m.org/", "nor this"),
    ("https://paper.example", "https://paper.example/", "root"),
    ("https://my_site.paper.example:8080/t", "https://my_site.paper.example/t", "underscore host, its port does not count"),
    ("  https://paper.example/t  ", "https://paper.example/t", "space around"),
    ("ftp://paper.example/t", None, "scheme"),
    ("paper.example/t", None, "no scheme"),
    ("https:///t", None, "no host"),
    ("https://paper.example/a b", None, "illegal"),
    ("", None, "blank"),
    (None, None, "null"),
]


def test_url_identity(spark):
    rows = spark.createDataFrame([(u,) for u, _, _ in URLS], "u string").select("u", urls.canonical_url(F.col("u")).alias("c"))
    rows = rows.select("u", "c", urls.canonical_url(F.col("c")).alias("again")).collect()
    for (u, want, why), r in zip(URLS, rows, strict=True):
        assert (r.c, r.again) == (want, want), (u, why)


def test_declared_identity(spark):
    rows = [
        ("https://a.example/x?utm_a=1", "https://a.example/real", "https://a.example/real"),
        ("https://a.example/x", "https://a.example/", "https://a.example/x"),
        ("https://a.example/", "https://a.example/?utm_x=1", "https://a.example/"),
        ("https://a.example/x", "mailto:me", "https://a.example/x"),
        ("https://a.example/x", None, "https://a.example/x"),
    ]
    df = spark.createDataFrame(rows, "u string, d string, w string")
    assert df.filter(~urls.document_identity(F.col("u"), F.col("d")).eqNullSafe(F.col("w"))).count() == 0
    hosts = spark.createDataFrame([("https://A.example:8/x",), ("nothing",)], "u string").select(urls.host_bucket(F.col("u")), urls.provisional_identity(F.col("u"))).collect()
    assert [tuple(r) for r in hosts] == [("a.example", "https://a.example:8/x"), ("nothing", "nothing")]


SAME = [
    ("Two  words\there", "Two words here"),
    ("„Quoted“ and «quoted»", '"Quoted" and "quoted"'),
    ("It’s", "It's"),
    ("a – b — c", "a - b - c"),
    ("wait…", "wait..."),
    ("soft­hyphen zero​width", "softhyphen zerowidth"),
    ("été", "été"),
    ("Posted 3 hours ago here", "Posted a few minutes ago here"),
    ("Stand: vor 5 Minuten", "Stand: vor einer Stunde"),
    ("it came just now", "it came moments ago"),
    ("see x.example/p?sessionId=A93F2B77 ok", "see x.example/p?sessionId=B71E0C44 ok"),
    ("tag utm_source=news end", "tag utm_source=social end"),
    ("id 7f3a9c21b48e5d06 x", "id c04d15ae9b72f831 x"),
    ("key 4a1f9c02-77b1-4e35-9a0e-1f2b3c4d5e6f x", "key b7c05d1e-2a34-4f88-91cc-70de6f5a4b32 x"),
    ("no 1712345678901 x", "no 1798765432109 x"),
]
OTHER = [
    ("one word", "one words"),
    ("Case", "case"),
    ("End.", "End?"),
    ("three years ago", "four years ago"),
    ("a SARS-CoV-2-variant here", "a SARS-CoV-3-variant here"),
    ("no 4711", "no 4712"),
    ("shadow: dark", "shadow: light"),
]


def test_fold_and_hash(spark):
    rows = [(a, b, True) for a, b in SAME] + [(a, b, False) for a, b in OTHER]
    h = lambda c: text.content_hash(F.lit("t"), F.array(F.col(c)))
    for r in spark.createDataFrame(rows, "a string, b string, same boolean").select("*", (h("a") == h("b")).alias("got")).collect():
        assert r.got == r.same, (r.a, r.b)


def test_hash_ignores_empty_paragraphs_and_keeps_borders(spark):
    df = spark.range(1).select(
        text.content_hash(F.lit("t"), F.array(F.lit("a"), F.lit(" "), F.lit("7f3a9c21b48e5d06"), F.lit("b"))).alias("a"),
        text.content_hash(F.lit("t"), F.array(F.lit("a"), F.lit("b"))).alias("b"),
        text.content_hash(F.lit("t"), F.array(F.lit("ab"))).alias("c"),
        text.content_hash(F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("d"),
        text.content_hash(F.lit(""), F.array().cast("array<string>")).alias("e"),
    ).first()
    assert df.a == df.b != df.c and df.d == df.e


AT = dt.datetime(2026, 8, 18, 9, 0, 0)
DATES = [
    ("Mon, 17 Aug 2026 08:15:00 +0200", "2026-08-17 06:15:00", True),
    ("17 Aug 2026 06:15:00 GMT", "2026-08-17 06:15:00", True),
    ("mon 17 aug 2026 06:15 gmt", "2026-08-17 06:15:00", True),
    ("Mon, 17 Aug 26 06:15:00 UT", "2026-08-17 06:15:00", True),
    ("Mon, 17 Aug 2026 02:15:00 EDT", "2026-08-17 06:15:00", True),
    ("Mon, 17 Aug 2026 08:15:00 +0200 (CEST)", "2026-08-17 06:15:00", True),
    ("Mon, 17 Aug 2026 08:15:00 GMT+0200", "2026-08-17 06:15:00", True),
    ("Mon, 17 Aug 2026 08:15:00 +02:00", "2026-08-17 06:15:00", True),
    ("2026-08-17T06:15:00Z", "2026-08-17 06:15:00", True),
    ("2026-08-17T08:15:00+02:00", "2026-08-17 06:15:00", True),
    ("2026-08-17T08:15+0200", "2026-08-17 06:15:00", True),
    ("2026-08-17T08:15:00+02", "2026-08-17 06:15:00", True),
    ("2026-08-17T06:15:00.250Z", "2026-08-17 06:15:00.250000", True),
    ("2026-08-17T06:15:00", "2026-08-17 06:15:00", False),
    ("2026-08-17 06:15:00", "2026-08-17 06:15:00", False),
    ("2026-08-17", "2026-08-17 00:00:00", False),
    ("Mon, 17 Aug 2026 06:15:00 MESZ", "2026-08-17 06:15:00", False),
    ("Mon, 17 Aug 2026 06:15:00", "2026-08-17 06:15:00", False),
    ("2026-08-18T10:00:00Z", "2026-08-18 10:00:00", True),
    ("2026-08-18T10:00:01Z", "2026-08-18 09:00:00", False),
    ("Tue, 17 Aug 2026 06:15:00 GMT", None, False),
    ("30 Feb 2026 06:15:00 GMT", None, False),
    ("today at 12", None, False),
    ("17/08/2026", None, False),
    ("", None, False),
    (None, None, False),
]


def test_dates(spark):
    df = spark.createDataFrame([(d, AT) for d, _, _ in DATES], "d string, at timestamp")
    rows = df.select(dates.normalise_date(F.col("d"), F.col("at")).alias("x")).select(F.col("x.instant").cast("string").alias("i"), "x.exact").collect()
    for (raw, want, exact), r in zip(DATES, rows, strict=True):
        got = r.i and dt.datetime.fromisoformat(r.i)
        assert (got, r.exact) == (want and dt.datetime.fromisoformat(want), exact), raw


def test_shown(spark):
    x = spark.createDataFrame([(AT,), (None,)], "t timestamp").select(dates.shown(F.col("t"), "Europe/Zurich").alias("s")).collect()
    assert [r.s for r in x] == ["18.08.2026 11:00", None]
    with pytest.raises(Exception):
        dates.shown(F.col("t"), "No/Where")


def test_http(spark):
    rows = [
        ("text/html; charset=utf-8", b"<p>", 200, "FETCHED"),
        ("TEXT/HTML", b"%PDF-1.7", 200, "SKIPPED_NOT_HTML"),
        ("application/pdf", b"<p>", 200, "SKIPPED_NOT_HTML"),
        (None, b"\x00\x00\x00\x18ftypmp42", 200, "SKIPPED_NOT_HTML"),
        (None, b"<p>", 200, "FETCHED"),
        ("application/octet-stream", b"hello", 204, "FETCHED"),
        ("text/html", b"", 200, "FAILED"),
        ("text/html", b"<p>", 404, "FAILED"),
        ("text/html", b"<p>", None, "FAILED"),
    ]
    df = spark.createDataFrame(rows, "t string, b binary, s int, w string")
    for r in df.select("w", http.fetch_verdict(F.lit(False), F.col("s"), F.col("t"), F.col("b")).alias("v"), http.fetch_verdict(F.lit(True), F.col("s"), F.col("t"), F.col("b")).alias("r")).collect():
        assert r.v == r.w and r.r == "BLOCKED_BY_ROBOTS"
    one = spark.range(1).select(
        http.byte_order_mark(F.unhex(F.lit("FFFE000041"))), http.byte_order_mark(F.unhex(F.lit("FFFE4100"))), http.charset_parameter(F.lit('text/html; Charset="Latin1"')),
        http.request_target(F.lit("https://a.b?x=1#y")), http.origin(F.lit("HTTPS://u@A.b:8/x")), http.product_token(F.lit("bot/1.0 (x)")),
        http.crawl_gap(F.lit(100.0), 2.0, 30.0), http.crawl_gap(F.lit(None).cast("double"), 2.0, 30.0), http.robots_access(F.lit(404)), http.robots_access(F.lit(503)),
    ).first()
    assert tuple(one) == ("UTF-32LE", "UTF-16LE", "Latin1", "/?x=1", "https://a.b:8", "bot", 30.0, 2.0, "ALLOW", "DENY")


def test_encoding_repair(spark):
    v = "struct<charset:string,source:string,replaced:boolean>"
    rows = [
        (("UTF-8", "HTTP_HEADER", True), ("windows-1252", "DOCUMENT", False), "LOSS_ENDED"),
        (("UTF-8", "DEFAULT", False), ("UTF-8", "DEFAULT", True), "LOSS_BEGAN"),
        (("UTF-8", "BOM", True), ("UTF-16BE", "BOM", True), "CHARSET_CHANGED"),
        (("UTF-8", "BOM", False), ("windows-1252", "BOM", False), None),
        (None, ("UTF-8", "BOM", True), None),
        (("UTF-8", "BOM", True), None, None),
    ]
    df = spark.createDataFrame(rows, f"a {v}, b {v}, w string")
    for r in df.select("w", http.encoding_repair(F.col("a"), F.col("b")).alias("k"), http.encoding_rationale(F.col("a"), F.col("b")).alias("why")).collect():
        assert r.k == r.w and (r.why is None) == (r.w is None)
        assert r.w != "LOSS_ENDED" or "UTF-8 (HTTP Content-Type), with replacement characters" in r.why
