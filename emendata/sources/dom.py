"""A small document tree over the standard parser, with the end tags that HTML leaves out."""

from __future__ import annotations

from html.parser import HTMLParser

# Fixed values of HTML: elements without content, and start tags that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul li dd dt summary center".split()
)
BLOCKS = ENDS_P | frozenset("html head body tr td th tbody thead tfoot caption title".split())
#: A start tag ends open elements of these kinds, up to a boundary.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("table td th caption button object template html".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def walk(self):
        """Elements below, in document order."""
        stack = [x for x in reversed(self.children) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node))

    def above(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def text(self) -> str:
        """Text as shown: blocks and line breaks stand apart, other space as written."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag == "br":
                out.append(" ")
            elif x.tag not in ("script", "style", "template") or x is self:
                apart = x.tag in BLOCKS
                stack.append(" " if apart else "")
                stack.extend(reversed(x.children))
                out.append(" " if apart else "")
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def close_to(self, tags: set[str], boundary: set[str] | frozenset[str]) -> None:
        """End the outermost open element of ``tags`` inside the nearest boundary."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in boundary:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self.close_to({"p"}, SCOPE)
        if tag in SIBLINGS:
            self.close_to(*SIBLINGS[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in SCOPE and tag not in SCOPE and tag not in ("table", "body", "html"):
                break
        if tag == "p":  # an end without a start is an empty paragraph
            self.open[-1].children.append(Node("p", {}, self.open[-1]))

    def parse_marked_section(self, i, report=1):
        """What begins like a marked section is a comment up to the next bracket."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
