from pyspark.sql import functions as F

from emendata.sources import articles, captures, encoding, feeds, robots

PAGE = """<!DOCTYPE html><html><head><title>Site - Head</title><meta property="og:title" content="Shared head"><link rel="shortlink canonical" href="/real?utm_x=1">
<script>var t = "</p><p>no prose in a script, whatever it says here.</p>";</script></head><body>
<header><h1>The Site</h1></header><nav><ul><li>Home of everything that there is</li></ul></nav>
<article class="main-story"><header><h1>The   real&nbsp;head</h1><p>A lead that stands in the header of the article.</p></header>
<p><b>First paragraph with enough words to be prose<br>and a second line
<p>Second one: it is a sentence. <div class="ad-box"><p>Buy this wonderful thing that nobody needs now.</p></div>
<blockquote><p>Quoted words that are long enough to count as prose.</p></blockquote>
<p>Short one.</p><p>Tiny</p><p><a href="/x">A link that makes up all of this block of text</a></p><p>Read more</p>
<h2 class="t">Sub head</h2><p>Under the sub head there is a paragraph of prose.</p>
<div data-area="teaser list"><p>Inside the root a data value does not count as furniture.</p></div>
<h3>Related reading</h3><h3>Another box</h3></article>
<div class="relatedStories"><article><p>A teaser in an article of its own, quite a long text.</p></article></div>
<footer><p>Footer text that is long enough to be taken for prose.</p></footer></body></html>"""


def test_article():
    title, paragraphs = articles.extract(PAGE)
    assert title == "The real head"
    assert paragraphs == [
        "A lead that stands in the header of the article.",
        "First paragraph with enough words to be prose and a second line",
        "Second one: it is a sentence.",
        "Quoted words that are long enough to count as prose.",
        "Short one.",
        "Sub head",
        "Under the sub head there is a paragraph of prose.",
        "Inside the root a data value does not count as furniture.",
    ]


def test_article_edges():
    assert articles.extract(None) == articles.extract("  ") == ("", [])
    assert articles.extract("<p>No root at all, but a paragraph of some length.</p>") == ("", ["No root at all, but a paragraph of some length."])
    dense = "<html><title>T</title><body><div id=a><p>Some prose that is long enough for this.</p></div><div><p>x</p></div>"
    assert articles.extract(dense) == ("T", ["Some prose that is long enough for this."])
    table = "<table><tr><td><p>Left cell with prose that goes on for a while.<td>right</table>"
    assert articles.extract(table)[1] == ["Left cell with prose that goes on for a while."]
    assert articles.extract("<main><h1>Only a head</h1></main>") == ("Only a head", [])
    assert articles.extract("<p><<<>>&&& </b></p></p>broken")[1] == []


def test_canonical_declaration(spark):
    assert articles.declared_canonical(PAGE, "https://a.example/x/y") == "https://a.example/real?utm_x=1"
    assert articles.declared_canonical("<link rel=alternate href=/a>", "https://a.example") is None
    assert articles.declared_canonical(None, None) is None
    df = spark.createDataFrame([(PAGE, "https://a.example/x"), (None, None)], "html string, url string")
    a, b = (r.a for r in df.select(articles.article(F.col("html"), F.col("url")).alias("a")).collect())
    assert (a.title, len(a.paragraphs), a.canonical) == ("The real head", 8, "https://a.example/real?utm_x=1")
    assert (b.title, b.paragraphs, b.canonical) == ("", [], None)


RSS = """<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>F</title>
<item><title>One &amp; only</title><link> https://a.example/1 </link><description><![CDATA[<p>Sum</p>]]></description><pubDate>Mon</pubDate><guid>g1</guid></item>
<item><title>No link</title></item>
<item><title>Two</title><link/><link>https://a.example/2</link><dc:date>2026</dc:date></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link rel="self" href="https://a.example/self"/>
<link rel="related" href="https://a.example/rel"/><link href="https://a.example/e"/><id>i</id><updated>u</updated><content>body</content></entry>
<entry><title>F&nbsp;</title><link rel="related" href="https://a.example/rel"/></entry></feed>"""


def test_feeds(spark):
    rss, atom = feeds.parse_feed(RSS), feeds.parse_feed(ATOM)
    assert (rss["feed_type"], atom["feed_type"]) == ("rss_2.0", "atom_1.0")
    assert rss["entries"][0] == {"title": "One & only", "link": "https://a.example/1", "summary": "<p>Sum</p>", "published_raw": "Mon", "updated_raw": None, "guid": "g1"}
    assert rss["entries"][1]["link"] == "https://a.example/2" and rss["entries"][1]["published_raw"] == "2026"
    assert rss["skipped"] == ["entry 1 has no link (title=No link)"]
    assert [e["link"] for e in atom["entries"]] == ["https://a.example/e", "https://a.example/rel"]
    assert atom["entries"][0]["summary"] == "body" and atom["entries"][0]["updated_raw"] == "u"
    assert feeds.parse_feed("<rdf:RDF xmlns:rdf='r'><item><link>l</link></item></rdf:RDF>")["feed_type"] == "rss_1.0"
    assert feeds.parse_feed(" ")["failure"] == "empty body"
    assert feeds.parse_feed("<html><p>x</html>")["failure"].startswith("not a feed: root element is <html>")
    assert feeds.parse_feed(RSS[:-30])["failure"].startswith("malformed XML")
    df = spark.createDataFrame([("a", 0, RSS), ("b", 1, ATOM), ("c", 2, "no")], "feed string, pos int, body string")
    rows = feeds.feed_entries(df, "body", "feed", "pos").orderBy("pos", "slot").collect()
    assert [(r.feed, r.slot, r.title) for r in rows] == [("a", 0, "One & only"), ("a", 1, "Two"), ("b", 0, "E"), ("b", 1, "F")]
    assert {r.scope for r in feeds.feed_failures(df, "body", "feed").collect()} == {"FEED", "ENTRY"}


def test_catalogue(spark, tmp_path):
    text = "feeds:\n  - url: ${BASE:https://a.example}/rss  # main\n    name: 'A'\n  - name: B\n    url: https://b.example\n  - url: ''\n    name: C\n  - url: https://b.example\n    name: again\n"
    assert feeds.catalogue_rows(text, {}) == [("https://a.example/rss", "A"), ("https://b.example", "B")]
    assert feeds.catalogue_rows(text, {"BASE": "x"})[0][0] == "x/rss"
    (tmp_path / "feeds.yaml").write_text(text)
    assert feeds.read_catalogue(spark, str(tmp_path / "feeds.yaml")).count() == 2
    assert feeds.read_catalogue(spark, str(tmp_path / "none.yaml")).count() == 0


def test_encoding(spark):
    d = encoding.decode
    assert d("é".encode(), None) == {"text": "é", "charset": "UTF-8", "source": "DEFAULT", "replaced": False, "warnings": []}
    assert d(b"\xef\xbb\xbf\xc3\xa9", "text/html; charset=latin1")["source"] == "BOM"
    assert len(d(b"\xef\xbb\xbf\xc3\xa9", "text/html; charset=latin1")["warnings"]) == 1
    x = d(b"<meta charset=iso-8859-1>\x80", None)
    assert (x["text"][-1], x["charset"], x["source"]) == ("€", "windows-1252", "DOCUMENT")
    x = d(b"<meta http-equiv=Content-Type content='text/html; charset=utf-8'>\xff", "text/html")
    assert (x["replaced"], x["text"][-1]) == (True, "�") and len(x["warnings"]) == 1
    assert d(b"<?xml version='1.0' encoding='utf-16'?>a", None)["source"] == "DEFAULT"
    assert d(b"a", "text/html; charset=nonsense")["warnings"]
    assert d("é".encode("utf-16"), None)["text"] == "é"
    assert d(None, None)["text"] == d(b"", "x")["text"] == ""
    rows = spark.createDataFrame([(b"\xe9", "text/html; charset=latin1"), (None, None)], "b binary, t string").select(encoding.decoded(F.col("b"), F.col("t")).alias("d"))
    assert [r[0] for r in rows.select("d.text").collect()] == ["é", ""]
    assert rows.select(encoding.verdict(F.col("d")).alias("v")).first().v.charset == "windows-1252"


ROBOTS = """# file
Disallow: /before
User-agent: first
User-agent: EmenBot
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$
Disallow:
Crawl-delay: 7

User-agent: *
Disallow: /

User-agent: emenbot
Disallow: /second
"""


def test_robots(spark):
    files = spark.createDataFrame([("a", ROBOTS), ("b", "User-agent: *\nDisallow: /x"), ("c", None)], "site string, body string")
    known = robots.rules(files, "site", "body", "emenbot")
    assert {(r.site, r.allow, r.pattern) for r in known.collect()} == {
        ("a", False, "/private"), ("a", True, "/private/open"), ("a", False, "/*.pdf$"), ("a", False, "/second"), ("b", False, "/x")
    }
    assert {r.crawl_delay for r in known.filter("site = 'a'").collect()} == {7.0}
    asked = [("a", "/private/x", False), ("a", "/private/open/x", True), ("a", "/a.pdf", False), ("a", "/a.pdf?x", True), ("a", "/second", False), ("a", "/", True), ("b", "/xy", False), ("b", "/y", True), ("c", "/", True), ("d", "/", True)]
    df = spark.createDataFrame(asked, "site string, target string, want boolean")
    assert robots.verdicts(df, known, "site", "target").filter("allowed <> want").count() == 0


def test_captures(spark):
    hops = spark.createDataFrame([("a", 301, "b"), ("b", 302, "c"), ("c", 200, None), ("x", 301, "y"), ("y", 301, "x"), ("l0", 301, "l1"), ("l1", 301, "l2"), ("l2", 301, "l3"), ("l3", 200, None)], "url string, status int, location string")
    asked = spark.createDataFrame([("a",), ("x",), ("l0",), ("gone",), ("c",)], "url string")
    got = {r.url: (r.final_url, r.n_hops, r.end) for r in captures.final_hops(asked, hops, most=2).collect()}
    assert got == {"a": ("c", 2, "OK"), "x": ("y", 1, "LOOP"), "l0": ("l2", 2, "TOO_MANY"), "gone": ("gone", 0, "MISSING"), "c": ("c", 0, "OK")}
    pages = spark.createDataFrame([(b"x",), (b"x",), (b"y",), (None,)], "html binary")
    stored = captures.new_pages(pages, "html")
    assert stored.count() == 2 and captures.new_pages(pages, "html", stored.limit(1)).count() == 1
    assert stored.filter(captures.legal_ref(F.col("ref"))).count() == 2
    assert spark.createDataFrame([("../x",)], "ref string").filter(captures.legal_ref(F.col("ref"))).count() == 0


def test_awkward_bytes_and_pages():
    for label in ("undefined", "idna", "punycode", "unicode_escape", "utf-7", "rot13", "\x00", "x" * 500):
        got = encoding.decode(b"<p>plain", f"text/html; charset={label}")
        assert (got["text"], got["source"]) == ("<p>plain", "DEFAULT") and len(got["warnings"]) == 1
    assert encoding.decode(b"\xfe\xff\x00a\xd8", None)["replaced"]
    deep = "<div>" * 3000 + "<p>Deep down there is a paragraph with enough words to be prose.</p>"
    assert articles.extract(deep)[1] == ["Deep down there is a paragraph with enough words to be prose."]
    assert articles.extract("<p>A paragraph with enough words to be prose <![xx and a mark in it> goes on to its end.</p>")[1]
    for cut in ("<![", "<![CDATA[x", "<!", "<!--", "<", "</", "<a href='", "<?"):
        articles.read_page("<p>text</p>" + cut, "https://x.org/")


def test_lenient_feeds():
    item = "<item><title>A & B &amp; C &eacute; &region=1</title><link>http://x.org/?a=1&ref=2</link><description><![CDATA[1 &nbsp; <b>2</b>]]></description></item>"
    got = feeds.parse_feed(f"<!DOCTYPE rss [<!ENTITY a 'b'>]><!-- <item> --><rss version='2.0'><channel>{item}</b></channel></rss>")
    assert got["failure"] is None
    (entry,) = got["entries"]
    assert entry["title"] == "A & B & C \u00e9 &region=1" and entry["link"] == "http://x.org/?a=1&ref=2" and entry["summary"] == "1 &nbsp; <b>2</b>"
    deep = "<x>" * 3000 + item + "</x>" * 3000
    assert len(feeds.parse_feed(f"<rss><channel>{deep}</channel></rss>")["entries"]) == 1
    assert feeds.parse_feed("<rss><channel><item><b>torn</item></channel></rss>")["failure"] == "malformed XML: <b> is never closed"


def test_many_pages_in_one_batch(spark):
    n = 2 * articles.PAGES_AT_ONCE + 3
    rows = [(i, None if i % 9 == 0 else f"<h1>Page {i} &quot</h1><p>This is the only sentence of page {i}.") for i in range(n)]
    found = spark.createDataFrame(rows, "i int, html string").coalesce(1).select("i", articles.article(F.col("html")).alias("a")).collect()
    assert {r.i: (r.a.title, r.a.paragraphs) for r in found} == {
        i: ("", []) if i % 9 == 0 else (f'Page {i} "', [f"This is the only sentence of page {i}."]) for i in range(n)
    }


def test_pages_are_dealt_out_before_they_are_read(spark):
    from emendata.plans import catalogue

    for name in ("article_titles", "extracted_articles", "declared_identities", "article_bodies"):
        assert "REPARTITION_BY_NUM" in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
