"""Bytes to text: which charset, on whose word, and whether characters were lost."""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emendata.functions.http import MARKS, SOURCES
from emendata.sources.dom import parse

PRESCAN = 4096
# Labels that mean windows-1252 on the web.
LATIN_1 = "iso-8859-1 iso8859-1 iso8859_1 iso_8859-1 iso_8859_1 latin1 l1 8859_1 819 cp819 ibm819 ibm-819 csisolatin1".split()
#: How Python's codecs are called in verdicts, where that is not the name in capitals.
NAMES = {"cp1252": "windows-1252", "utf-8": "UTF-8", "iso8859-1": "ISO-8859-1", "ascii": "US-ASCII", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE", "utf-32-be": "UTF-32BE", "utf-32-le": "UTF-32LE"}

# The codecs that pages are written in; others that Python knows are no charsets of the web.
WEB_CODECS = frozenset(
    "ascii utf-8 utf-16 utf-16-le utf-16-be utf-32 utf-32-le utf-32-be cp866 cp437 cp850 cp852 cp855 cp874 "
    "cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 iso8859-1 iso8859-2 iso8859-3 iso8859-4 iso8859-5 "
    "iso8859-6 iso8859-7 iso8859-8 iso8859-9 iso8859-10 iso8859-11 iso8859-13 iso8859-14 iso8859-15 iso8859-16 "
    "tis-620 koi8-r koi8-u mac-roman mac-cyrillic gb2312 gbk gb18030 hz big5 big5hkscs cp950 euc_jp shift_jis cp932 "
    "iso2022_jp iso2022_kr euc_kr cp949 johab".split()
)

DECODED = "struct<text:string,charset:string,source:string,replaced:boolean,warnings:array<string>>"


def _codec(label: str) -> str | None:
    try:
        info = codecs.lookup(label.strip())
    except (LookupError, ValueError):
        return None
    return info.name if info.name in WEB_CODECS else None


def _shown(codec: str) -> str:
    found = re.match(r"cp(125\d)$", codec)
    return NAMES.get(codec) or (f"windows-{found[1]}" if found else codec.upper().replace("_", "-").replace("ISO8859", "ISO-8859"))


def _parameter(content_type: str | None) -> str | None:
    m = re.search(r";\s*charset\s*=\s*[\"']?([^\"';]*)", content_type or "", re.I)
    return (m and m[1].strip()) or None


def _declared(body: bytes, mark: tuple[str, bytes] | None) -> str | None:
    """What the document's own head says: an XML declaration at its very start, else the first meta that does."""
    skip = len(mark[1]) if mark else 0
    head = body[skip : skip + PRESCAN].decode(mark[0] if mark else "latin-1", "replace")
    if m := re.match(r"\s*<\?xml\s[^>]*?encoding\s*=\s*[\"']([^\"']+)[\"']", head, re.I):
        return m[1].strip() or None
    for meta in parse(head).walk():
        if meta.tag == "meta":
            if label := meta.attrs.get("charset", "").strip():
                return label
            if meta.attrs.get("http-equiv", "").strip().lower() == "content-type" and (label := _parameter(";" + meta.attrs.get("content", ""))):
                return label
    return None


def decode(body: bytes | None, content_type: str | None) -> dict:
    """text, charset, source (BOM, HTTP_HEADER, DOCUMENT or DEFAULT), replaced, and warnings.

    The mark in the bytes outranks the header, the header the document; whoever loses with another charset is named in
    a warning. UTF-16 by the document's own word is not believed, since that word was read as single bytes.
    """
    if not body:
        return {"text": "", "charset": "UTF-8", "source": "DEFAULT", "replaced": False, "warnings": []}
    mark = next(((name, bytes.fromhex(h)) for name, h in MARKS if body.startswith(bytes.fromhex(h))), None)
    said, warnings = [], []
    for source, label in (("BOM", mark and mark[0]), ("HTTP_HEADER", _parameter(content_type)), ("DOCUMENT", _declared(body, mark))):
        if not label:
            continue
        low = label.strip().lower()
        if source == "DOCUMENT" and low.startswith("utf-16"):
            warnings.append(f"the document says {label}, but could be read as single bytes and so is not; ignored")
            continue
        codec = "cp1252" if low in LATIN_1 else _codec(label)
        if codec is None:
            warnings.append(f"{SOURCES[source]} names the unknown charset '{label}'; ignored")
        else:
            said.append((source, codec))
    source, codec = said[0] if said else ("DEFAULT", "utf-8")
    for other, theirs in said[1:]:
        if theirs != codec:
            warnings.append(f"charset conflict: {SOURCES[source]} says {_shown(codec)}, {SOURCES[other]} says {_shown(theirs)}; {SOURCES[source]} wins")
    data, replaced = body[len(mark[1]) if mark else 0 :], False
    try:
        text = data.decode(codec)
    except UnicodeError:
        warnings.append(f"the bytes are not valid {_shown(codec)}, which {SOURCES[source]} declared; characters were replaced")
        text, replaced = data.decode(codec, "replace"), True
    return {"text": text.removeprefix("\ufeff"), "charset": _shown(codec), "source": source, "replaced": replaced, "warnings": warnings}


def decoded(body: Column, content_type: Column) -> Column:
    """``decode`` as a struct, by one Arrow function: Catalyst's decoder stops at bytes it does not know."""
    import pyarrow as pa

    kind = pa.struct(
        [("text", pa.string()), ("charset", pa.string()), ("source", pa.string()), ("replaced", pa.bool_()), ("warnings", pa.list_(pa.string()))]
    )

    @F.arrow_udf(DECODED)
    def run(bodies, types):
        return pa.array([decode(b.as_py(), t.as_py()) for b, t in zip(bodies, types, strict=True)], kind)

    return run(body, content_type)


def verdict(found: Column) -> Column:
    """The encoding verdict that a revision keeps."""
    return F.struct(found["charset"].alias("charset"), found["source"].alias("source"), found["replaced"].alias("replaced"))
