"""Feeds: the catalogue, and entries out of RSS and Atom in any of their dialects."""

from __future__ import annotations

import html
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of elements by what they say, and relations that do not lead to the article.
PUBLISHED = ("pubdate", "date", "published", "issued", "created")
UPDATED = ("updated", "modified")
SUMMARY = ("description", "summary")
GUID = ("guid", "id")
ENTRIES = ("item", "entry")
OTHER_RELATIONS = ("self", "enclosure", "edit", "replies", "hub")
ATOM_03 = "http://purl.org/atom/ns#"

ENTRY = "struct<title:string,link:string,summary:string,published_raw:string,updated_raw:string,guid:string>"
FEED = f"struct<feed_type:string,failure:string,entries:array<{ENTRY}>,skipped:array<string>>"


def _local(name: str) -> str:
    return name.lower().rpartition(":")[2] if ":" in name else name.lower()


class _Element:
    """An element; ``closed`` once its end tag has come. All walks are loops, so depth does not matter."""

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.tag, self.attrs, self.pieces, self.closed = _local(name), name, attrs, [], False

    @property
    def children(self) -> list[_Element]:
        return [p for p in self.pieces if isinstance(p, _Element)]

    def _written(self, begin, end) -> str:
        out, stack = [], list(reversed(self.pieces))
        while stack:
            piece = stack.pop()
            if isinstance(piece, str):
                out.append(piece)
            else:
                stack += [end(piece), *reversed(piece.pieces), begin(piece)]
        return "".join(out)

    def text(self) -> str:
        return self._written(lambda x: "", lambda x: "")

    def markup(self) -> str:
        return self._written(lambda x: f"<{x.tag}>", lambda x: f"</{x.tag}>")

    def below(self):
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.children[::-1]


# What XML is made of, in the order in which it is tried: comments, character data, instructions, declarations, tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![A-Za-z](?:[^<>\[]|\[.*?\])*>"
    r"|</\s*(?P<end>[^\s<>/]+)[^>]*>|<(?P<start>[A-Za-z_][^\s<>/=]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def unescape(text: str) -> str:
    """Numbers and names of HTML between & and ;, anything else as it is written: &region=x stays what it is."""
    return re.sub(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);", lambda m: html.unescape(m[0]), text)


def _tree(body: str) -> _Element:
    """The tree under a nameless top element.

    Lenient: a bare ampersand and names of HTML stand for what they look like, an end tag without a start is passed
    over, and an end tag ends what is open inside its element, which then is not ``closed``.
    """
    top = _Element("", {})
    top.closed = True
    stack = [top]
    for m in TOKEN.finditer(body.lstrip("\ufeff")):
        if m["data"] is not None:
            stack[-1].pieces.append(m["data"])
        elif m["text"] is not None:
            stack[-1].pieces.append(unescape(m["text"]))
        elif m["end"]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == m["end"]), None)
            if at is not None:
                stack[at].closed = True
                del stack[at:]
        elif m["start"]:
            found = ((name, next(v for v in values if v is not None)) for name, *values in ((x[1], x[2], x[3], x[4]) for x in ATTRIBUTE.finditer(m["attrs"])))
            node = _Element(m["start"], {name: unescape(value) for name, value in found})
            stack[-1].pieces.append(node)
            if m["attrs"].rstrip().endswith("/"):
                node.closed = True
            else:
                stack.append(node)
    return top


def _first(item: _Element, names: tuple[str, ...], markup: bool = False) -> str | None:
    for child in item.children:
        if child.name in names:
            value = (child.markup() if markup and child.children else child.text()).strip()
            if value:
                return value
    return None


def _link(item: _Element) -> str | None:
    """The best of the links: text between tags and plain or alternate addresses rank alike, other relations last."""
    ranked = []
    for place, child in enumerate(x for x in item.children if x.name == "link"):
        relation = child.attrs.get("rel", "").strip().lower()
        if "href" not in child.attrs:
            target, rank = child.text().strip(), 0
        elif relation in OTHER_RELATIONS:
            continue
        else:
            target, rank = child.attrs["href"].strip(), int(relation not in ("", "alternate"))
        if target:
            ranked.append((rank, place, target))
    return min(ranked)[2] if ranked else None


def _kind(root: _Element) -> str | None:
    if root.name == "rss":
        return "rss_" + (root.attrs.get("version", "").strip() or "2.0")
    if root.name == "feed":
        return "atom_0.3" if any(ATOM_03 in v for v in root.attrs.values()) else "atom_1.0"
    return "rss_1.0" if root.name == "rdf" else None


def parse_feed(body: str | None) -> dict:
    """feed_type and entries with the entries skipped, or a failure and nothing else. Dates stay as written."""
    out = {"feed_type": None, "failure": None, "entries": [], "skipped": []}
    if body is None or not body.strip():
        return out | {"failure": "empty body"}
    top = _tree(body)
    root = next(iter(top.children), None)
    kind = _kind(root) if root else None
    if kind is None:
        return out | {"failure": f"not a feed: root element is {f'<{root.tag}>' if root else 'absent'}"}
    torn = next((x for x in top.below() if not x.closed), None)
    if torn is not None:
        return out | {"failure": f"malformed XML: <{torn.tag}> is never closed"}
    for i, item in enumerate(x for x in top.below() if x.name in ENTRIES):
        title, link = _first(item, ("title",)), _link(item)
        if link is None:
            out["skipped"].append(f"entry {i} has no link (title={title})")
            continue
        out["entries"].append(
            {
                "title": title,
                "link": link,
                "summary": _first(item, SUMMARY, True) or _first(item, ("content",), True),
                "published_raw": _first(item, PUBLISHED),
                "updated_raw": _first(item, UPDATED),
                "guid": _first(item, GUID),
            }
        )
    return out | {"feed_type": kind}


def parsed_feed(body: Column) -> Column:
    """``parse_feed`` of each body as a struct, by one Arrow function."""
    import pyarrow as pa

    entry = pa.struct([(n, pa.string()) for n in ("title", "link", "summary", "published_raw", "updated_raw", "guid")])
    kind = pa.struct([("feed_type", pa.string()), ("failure", pa.string()), ("entries", pa.list_(entry)), ("skipped", pa.list_(pa.string()))])

    @F.arrow_udf(FEED)
    def run(bodies):
        return pa.array([parse_feed(b.as_py()) for b in bodies], kind)

    return run(body)


def feed_entries(responses: DataFrame, body: str, feed: str, feed_pos: str) -> DataFrame:
    """One row per entry: feed, feed_pos, slot (place in its feed) and the fields of the entry."""
    read = responses.withColumn("_f", parsed_feed(F.col(body)))
    rows = read.select(feed, feed_pos, F.posexplode("_f.entries").alias("slot", "_e"))
    return rows.select(feed, feed_pos, "slot", "_e.*")


def feed_failures(responses: DataFrame, body: str, feed: str) -> DataFrame:
    """Feeds that could not be read, and entries that were skipped, with the reason."""
    read = responses.withColumn("_f", parsed_feed(F.col(body)))
    failed = read.filter("_f.failure IS NOT NULL").select(feed, F.col("_f.failure").alias("reason"), F.lit("FEED").alias("scope"))
    return failed.unionByName(read.select(feed, F.explode("_f.skipped").alias("reason"), F.lit("ENTRY").alias("scope")))


def catalogue_rows(text: str | None, environment: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(url, name) of a catalogue file: ``feeds:`` and a list of url and name; placeholders ${NAME:default} filled in.

    Entries with a blank url or name go, and of equal urls all but the first. No text is an empty catalogue.
    """
    env = os.environ if environment is None else environment
    fill = lambda v: re.sub(r"\$\{([^}:]+)(?::([^}]*))?\}", lambda m: env.get(m[1], m[2] if m[2] is not None else m[0]), v)
    entries: list[dict[str, str]] = []
    for line in (text or "").splitlines():
        bare = re.sub(r"(?:^|\s)#.*$", "", line).rstrip()
        m = re.match(r"^\s*(-\s+)?(url|name)\s*:\s*(.*)$", bare)
        if re.match(r"^\s*-\s*$", bare) or (m and m[1]):
            entries.append({})
        if m and entries:
            value = m[3].strip()
            entries[-1][m[2]] = fill(value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value).strip()
    out: dict[str, str] = {}
    for e in entries:
        if e.get("url") and e.get("name"):
            out.setdefault(e["url"], e["name"])
    return list(out.items())


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue at ``path`` (any file system that Spark reads); a missing file is an empty one."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        found = None
    return spark.createDataFrame(catalogue_rows(found[0] if found else None), "url string, name string")


def active_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.filter("active").orderBy("url")


def feed_options(feeds: DataFrame) -> DataFrame:
    """Feeds for a choice by name, capitals aside."""
    return feeds.select("id", "name").orderBy(F.lower("name"), "name", "id")
