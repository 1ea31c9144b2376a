"""Decisions over captured responses and encoding verdicts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types that may be HTML, and those that say nothing.
HTML_TYPES = ("text/html", "application/xhtml+xml")
OPAQUE_TYPES = ("application/octet-stream", "binary/octet-stream", "unknown/unknown", "*/*")
# Fixed values: (name, offset in bytes, hex) of formats that are not HTML.
MAGIC = (
    ("PDF", 0, "255044462D"),
    ("PNG", 0, "89504E47"),
    ("JPEG", 0, "FFD8FF"),
    ("GIF", 0, "47494638"),
    ("BMP", 0, "424D"),
    ("RIFF container (WebP, WAV)", 0, "52494646"),
    ("ZIP container (docx, epub)", 0, "504B0304"),
    ("gzip", 0, "1F8B"),
    ("ISO media (mp4)", 4, "66747970"),
    ("Ogg", 0, "4F676753"),
    ("ICO", 0, "00000100"),
    ("ELF", 0, "7F454C46"),
)
# Byte order marks, a longer one before one that it starts with.
MARKS = (("UTF-8", "EFBBBF"), ("UTF-32BE", "0000FEFF"), ("UTF-32LE", "FFFE0000"), ("UTF-16BE", "FEFF"), ("UTF-16LE", "FFFE"))


# How a source of a charset is called in prose.
SOURCES = {"BOM": "byte order mark", "HTTP_HEADER": "HTTP Content-Type", "DOCUMENT": "document declaration", "DEFAULT": "default"}


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def may_be_html(content_type: Column) -> Column:
    """HTML by its type, or of a type that says nothing."""
    return media_type(content_type).isin("", *HTML_TYPES, *OPAQUE_TYPES)


def _first(tests: list[tuple[Column, str]]) -> Column:
    out = F.when(tests[0][0], tests[0][1])
    for test, value in tests[1:]:
        out = out.when(test, value)
    return out


def binary_format(body: Column) -> Column:
    """The name of a binary format by the body's first bytes; null for what may be text."""
    head = F.hex(F.substring(body, 1, 16))
    return _first([(F.substring(head, 1 + 2 * at, len(h)) == h, name) for name, at, h in MAGIC])


def byte_order_mark(body: Column) -> Column:
    head = F.hex(F.substring(body, 1, 4))
    return _first([(head.startswith(h), name) for name, h in MARKS])


def charset_parameter(content_type: Column) -> Column:
    """The charset a Content-Type names, quotes off; null if none."""
    found = F.trim(F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*[\"']?([^\"';]*)", 1))
    return F.when(found != "", found)


def fetch_verdict(refused: Column, status: Column, content_type: Column, body: Column) -> Column:
    """FETCHED, BLOCKED_BY_ROBOTS, SKIPPED_NOT_HTML or FAILED for a captured article response."""
    return (
        F.when(F.coalesce(refused, F.lit(False)), "BLOCKED_BY_ROBOTS")
        .when(status.isNull() | ~status.between(200, 299), "FAILED")
        .when(~may_be_html(content_type), "SKIPPED_NOT_HTML")
        .when(binary_format(body).isNotNull(), "SKIPPED_NOT_HTML")
        .when(F.coalesce(F.octet_length(body), F.lit(0)) == 0, "FAILED")
        .otherwise("FETCHED")
    )


def feed_verdict(status: Column) -> Column:
    """Outcome of a captured conditional request for a feed: FETCHED, NOT_MODIFIED or FAILED."""
    return F.when(status == 304, "NOT_MODIFIED").when(status.between(200, 299), "FETCHED").otherwise("FAILED")


def retried(status: Column, error: Column) -> Column:
    """Whether a response is worth another attempt: a server's error or none at all."""
    return error.isNotNull() | status.isNull() | (status >= 500)


def robots_access(status: Column) -> Column:
    """PARSE what a robots file says, ALLOW all for client errors, else DENY all for a short time."""
    return F.when(status.between(200, 299), "PARSE").when(status.between(400, 499), "ALLOW").otherwise("DENY")


def crawl_gap(requested: Column, default: float, most: float) -> Column:
    """Seconds between requests: what the site asks for within bounds, never less than the default."""
    return F.greatest(F.lit(default), F.least(F.coalesce(requested, F.lit(default)), F.lit(most)))


def request_target(url: Column) -> Column:
    """What robots rules are matched with: raw path (or /) and query."""
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return F.concat(F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1))


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case, credentials off."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    return F.lower(F.concat(scheme, F.regexp_extract(url, r"^[^:]+://(?:[^/?#@]*@)?([^/?#]*)", 1)))


def product_token(agent: Column) -> Column:
    return F.regexp_extract(agent, r"^([^/\s(]*)", 1)


def described(verdict: Column) -> Column:
    """An encoding verdict (struct charset, source, replaced) in words."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), verdict["source"])
    lossy = F.when(verdict["replaced"], ", with replacement characters").otherwise("")
    return F.concat(verdict["charset"], F.lit(" ("), label, F.lit(")"), lossy)


def encoding_repair(before: Column, after: Column) -> Column:
    """Why a difference comes from decoding: LOSS_ENDED, LOSS_BEGAN or CHARSET_CHANGED; null if it does not.

    A verdict that was not recorded says nothing.
    """
    return F.when(
        before.isNotNull() & after.isNotNull(),
        F.when(before["replaced"] & ~after["replaced"], "LOSS_ENDED")
        .when(~before["replaced"] & after["replaced"], "LOSS_BEGAN")
        .when(before["replaced"] & (before["charset"] != after["charset"]), "CHARSET_CHANGED"),
    )


def encoding_rationale(before: Column, after: Column) -> Column:
    """The repair in a sentence; null if there is none."""
    kind = encoding_repair(before, after)
    said = (
        F.when(kind == "LOSS_ENDED", "the earlier text was decoded with replacement characters, the later was not")
        .when(kind == "LOSS_BEGAN", "the earlier text was decoded cleanly, the later needed replacement characters")
        .when(kind == "CHARSET_CHANGED", "both texts needed replacement characters, under different charsets")
    )
    return F.concat(F.lit("Decoding changed: "), said, F.lit(". Now "), described(after), F.lit(", before "), described(before), F.lit("."))
