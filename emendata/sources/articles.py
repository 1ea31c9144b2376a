"""Articles out of HTML: a title and paragraphs, without the furniture of the page."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from emendata.sources.dom import Node, parse

# Thresholds of prose.
LEAST_PROSE, LEAST_SENTENCE, LEAST_HEADING, MOST_LABEL, MOST_ATTRIBUTE = 30, 8, 3, 80, 100
MOST_LINKED = 0.5
# Kinds of elements.
PROSE_BLOCKS = frozenset("p h2 h3 h4 h5 h6 li blockquote".split())
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section td".split())
NON_PROSE = frozenset(
    "script style noscript template svg math iframe object embed video audio canvas map form button input select "
    "textarea label fieldset nav aside figure figcaption dialog".split()
)
NON_PROSE_ROLES = frozenset(
    "navigation banner complementary contentinfo dialog alert search menu menubar toolbar tablist form".split()
)
# Whole words of class, id and data values that name furniture, and beginnings of such words.
FURNITURE = frozenset(
    "ad ads adslot adbox adunit advert banner sponsor promo promotion outbrain taboola plista "
    "cookie cookies consent gdpr paywall subscribe subscription abo newsletter signup register login logout account "
    "nav navigation navbar menu submenu breadcrumb breadcrumbs sidebar masthead toolbar utility skiplink skip "
    "related recommended recommendations teaser teasers trending mostread viewed popular meistgelesen readmore weiterlesen "
    "morelink forum discussion diskussion comment comments kommentar kommentare disqus livefyre "
    "social share sharing sharebar teilen follow followus tags taglist topics byline credit credits copyright "
    "impressum datenschutz sitemap search suche pagination pager popup modal overlay lightbox widget player "
    "gallery slideshow carousel footer".split()
)
FURNITURE_PREFIXES = tuple("advert anzeig werbung sponsored recommend empfehl abonn newslett kommentar socialmedia".split())
# Labels that are furniture wherever they stand.
LABELS = frozenset(
    (
        "anzeige|anzeigen|werbung|advertisement|advertising|sponsored|sponsored content|gesponsert|mehr zum thema|"
        "auch interessant|lesen sie auch|das könnte sie auch interessieren|read more|more on this story|related topics|"
        "related articles|most viewed|most read|meistgelesen|trending|im trend|weiterlesen|artikel weiterlesen|"
        "zur startseite|zum inhalt springen|kommentare|comments|kommentar schreiben|leave a comment|teilen|"
        "diesen artikel teilen|share this article|share|auf facebook teilen|newsletter|newsletter abonnieren|sign up|"
        "log in|einloggen|folgen sie uns|follow us|follow us on twitter|alle rechte vorbehalten|all rights reserved|"
        "cookie-einstellungen|mehr informationen|more information|quelle|quellen|source|sources|foto|bild"
    ).split("|")
)

_HIDDEN = re.compile(r"[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
_SPACES = re.compile(r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_GAP = re.compile(r"[ \t\n\x0b\f\r]+")
_EDGE = re.compile(r"^[!-/:-@\[-`{-~\s\u00bb\u00ab\u201c\u201d\u2018\u2019\u2013\u2014]+|[!-/:-@\[-`{-~\s\u00bb\u00ab\u201c\u201d\u2018\u2019\u2013\u2014]+$", re.ASCII)
_ENDED = re.compile(r"[.!?\u2026][\"'\u00bb\u201d]?$")
_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_PAYLOAD = re.compile(r'[/{}<>"]')


def tidy(text: str) -> str:
    return _GAP.sub(" ", _SPACES.sub(" ", _HIDDEN.sub("", text))).strip("".join(map(chr, range(33))))


def _is_root(node: Node, kind: int) -> bool:
    return (
        node.tag == "article",
        node.attrs.get("itemprop", "").lower() == "articlebody",
        node.tag == "main",
        node.attrs.get("role", "").lower() == "main",
    )[kind]


ROOT_KINDS = range(4)


def _any_root(node: Node) -> bool:
    return any(_is_root(node, k) for k in ROOT_KINDS)


def _inside_root(node: Node) -> bool:
    return any(_any_root(x) for x in node.above())


def _names_furniture(names: str) -> bool:
    words = [w.lower() for w in _NAME.split(names) if w]
    return any(w in FURNITURE or w.startswith(FURNITURE_PREFIXES) for w in words)


def _is_furniture(node: Node) -> bool:
    if _names_furniture(node.attrs.get("class", "") + " " + node.attrs.get("id", "")):
        return True
    values = [v for k, v in node.attrs.items() if k.startswith("data-") and v and len(v) <= MOST_ATTRIBUTE and not _PAYLOAD.search(v)]
    return bool(values) and _names_furniture(" ".join(values)) and not _inside_root(node)


def _first_text(nodes) -> str:
    return next((t for n in nodes if (t := tidy(n.text()))), "")


def title_of(document: Node) -> str:
    """The headline shown before those declared for sharing, those before any other headline, the page's title last."""
    every = list(document.walk())
    if found := _first_text(n for n in every if n.attrs.get("itemprop", "").lower() == "headline"):
        return found
    for kind in ROOT_KINDS:
        for root in (n for n in every if _is_root(n, kind)):
            if found := _first_text(n for n in root.walk() if n.tag == "h1"):
                return found
    metas = [n for n in every if n.tag == "meta"]
    for key, value in (("property", "og:title"), ("name", "twitter:title"), ("name", "title")):
        meta = next((n for n in metas if n.attrs.get(key, "").lower() == value), None)
        if meta is not None and (found := tidy(meta.attrs.get("content", ""))):
            return found
    found = _first_text(n for n in every if n.tag == "h1")
    return found or next((tidy(n.text()) for n in every if n.tag == "title"), "")


def _drop(node: Node, unwanted) -> None:
    """Remove elements below that are unwanted; what goes with its parent is not looked at."""
    stack = [node]
    while stack:
        parent = stack.pop()
        gone = {id(x) for x in parent.children if isinstance(x, Node) and unwanted(x)}
        if gone:
            for x in parent.children:
                if id(x) in gone:
                    x.parent = None
            parent.children = [x for x in parent.children if id(x) not in gone]
        stack += [x for x in reversed(parent.children) if isinstance(x, Node)]


def _structural(node: Node) -> bool:
    a = node.attrs
    if node.tag in NON_PROSE or a.get("aria-hidden", "").lower() == "true" or "hidden" in a:
        return True
    if a.get("role", "").lower() in NON_PROSE_ROLES:
        return True
    return node.tag in ("header", "footer") and not _inside_root(node)


def _linked_share(node: Node, text: str) -> float:
    if not text:
        return 1.0
    return min(1.0, sum(len(tidy(a.text())) for a in node.walk() if a.tag == "a") / len(text))


def _kept(node: Node, text: str) -> bool:
    if not text or (len(text) <= MOST_LABEL and _EDGE.sub("", text.lower()) in LABELS):
        return False
    if _linked_share(node, text) > MOST_LINKED:
        return False
    if node.tag in HEADINGS:
        return len(text) >= LEAST_HEADING
    sentence = len(text) >= LEAST_SENTENCE and text.find(" ") > 0 and _ENDED.search(text)
    return len(text) >= LEAST_PROSE or bool(sentence)


def prose_of(root: Node, title: str = "") -> list[str]:
    """The innermost blocks with prose, in order, without headings at the end that introduce nothing."""
    found: list[tuple[str, str | None]] = []  # text, and the shape of a heading
    for node in root.walk():
        if node.tag not in PROSE_BLOCKS or any(x.tag in PROSE_BLOCKS for x in node.walk()):
            continue
        text = tidy(node.text())
        if _kept(node, text) and text != title:
            found.append((text, f"{node.tag}|{node.attrs.get('class', '')}" if node.tag in HEADINGS else None))
    introducing = {a[1] for a, b in zip(found, found[1:], strict=False) if a[1] and b[1] is None}
    end = len(found)
    while end and found[end - 1][1] and len(found[end - 1][0]) <= MOST_LABEL and found[end - 1][1] not in introducing:
        end -= 1
    if len(found) - end >= sum(shape is None for _, shape in found):
        end = len(found)
    return [text for text, _ in found[:end]]


def _weight(node: Node) -> int:
    return sum(map(len, prose_of(node)))


def content_root(document: Node) -> Node:
    """The declared root of the first kind that has prose, the longest of its kind; else the densest container."""
    every = list(document.walk())
    for kind in ROOT_KINDS:
        weighed = [(_weight(n), n) for n in every if _is_root(n, kind)]
        best = max((w for w, _ in weighed), default=0)
        if best:
            return next(n for w, n in weighed if w == best)
    best = next((n for n in every if n.tag == "body"), document)
    most = _weight(best)
    for node in list(best.walk()):
        if node.tag in CONTAINERS:
            weight = _weight(node)
            if weight > most or (weight == most and best in node.above()):
                best, most = node, weight
    return best


def extract(html: str | None) -> tuple[str, list[str]]:
    """Title and paragraphs; a page that cannot be made sense of is a page without content."""
    return extract_from(parse(html)) if html and html.strip() else ("", [])


def extract_from(document: Node) -> tuple[str, list[str]]:
    """``extract`` of a parsed page, whose tree is used up."""
    title = title_of(document)
    _drop(document, _structural)
    holds = {id(x) for n in document.walk() if _any_root(n) for x in (n, *n.above())}
    _drop(document, lambda n: id(n) not in holds and n.tag not in ("html", "body") and _is_furniture(n))
    root = content_root(document)
    _drop(root, _is_furniture)
    return title, prose_of(root, title)


def declared_canonical(html: str | None, base: str | None) -> str | None:
    """The absolute address of the first link that calls itself canonical; none if that is not http(s)."""
    return canonical_in(parse(html), base) if html and html.strip() else None


def canonical_in(document: Node, base: str | None) -> str | None:
    """``declared_canonical`` of a parsed page."""
    for node in document.walk():
        if node.tag == "link" and "href" in node.attrs and "canonical" in node.attrs.get("rel", "").lower().split():
            try:
                found = urljoin(base or "", node.attrs["href"].strip())
            except ValueError:
                return None
            return found if "://" in found else None
    return None


def read_page(html: str | None, base: str | None) -> dict:
    """title, paragraphs and canonical of a page, whose tree is built once."""
    if not html or not html.strip():
        return {"title": "", "paragraphs": [], "canonical": None}
    document = parse(html)
    canonical = canonical_in(document, base)
    title, paragraphs = extract_from(document)
    return {"title": title, "paragraphs": paragraphs, "canonical": canonical}


#: Pages whose results are Python objects at a time: what a worker holds besides its batch.
PAGES_AT_ONCE = 64
ARTICLE = "struct<title:string,paragraphs:array<string>,canonical:string>"


def article(html: Column, url: Column | None = None) -> Column:
    """Struct (title, paragraphs, canonical) of a page, by one Arrow function; the tree is built once for both."""
    import pyarrow as pa

    @F.arrow_udf(ARTICLE)
    def run(pages, bases):
        kind = pa.struct([("title", pa.string()), ("paragraphs", pa.list_(pa.string())), ("canonical", pa.string())])
        out = []
        for at in range(0, len(pages), PAGES_AT_ONCE):
            both = zip(pages.slice(at, PAGES_AT_ONCE), bases.slice(at, PAGES_AT_ONCE), strict=True)
            out.append(pa.array([read_page(page.as_py(), base.as_py()) for page, base in both], kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return run(html, F.lit(None).cast("string") if url is None else url)


def has_content(found: Column) -> Column:
    """A headline alone is content."""
    return (found["title"] != "") | (F.size(found["paragraphs"]) > 0)
