"""Folding of text to what a reader would call the same, and the hash of an article's folded content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "emendata-fold-1"
IDENTIFIER, RELATIVE_TIME = "\x01", "\x02"

# What counts as one thing. Character classes of java.util.regex.
LINE_BREAK = r"[\t\n\x0B\f\r\u0085\u2028\u2029]"
EXOTIC_SPACE = r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
INVISIBLE = r"[\u00ad\u200b-\u200f\u2060\ufeff\p{Cc}]"
DOUBLE_QUOTE = r"[\u00ab\u00bb\u201c\u201d\u201e\u201f\u2033\u301d\u301e\uff02]"
SINGLE_QUOTE = r"[\u2018\u2019\u201a\u201b\u2032\u2039\u203a\uff07\u00b4\u0060]"
DASH = r"[\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2212\ufe58\uff0d]"
ELLIPSIS = r"\u2026"

# The words of relative times, German and English, days at the longest.
NUMBER = r"\d{1,3}"
DE_COUNTS = (NUMBER, "einer", "einem", "eine", r"ein\s+paar", "wenigen", rf"etwa\s+{NUMBER}",
             "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf")
DE_UNITS = ("sekunden?", "minuten?", "stunden?", "tagen", "tag")
DE_PHRASES = (r"vor\s+kurzem", r"vor\s+wenigen\s+augenblicken", "soeben", r"gerade\s+eben", r"eben\s+erst")
EN_COUNTS = (NUMBER, "a", "an", "few", r"a\s+few", r"couple\s+of", rf"about\s+{NUMBER}",
             "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
EN_UNITS = ("seconds?", "minutes?", "mins?", "hours?", "hrs?", "days?")
EN_PHRASES = (r"moments\s+ago", r"just\s+now")

# Names whose assigned value is an identifier; utm_ and letters is one too.
IDENTIFIER_NAMES = (
    "ad ads adid adslot adslotid adunit adunitid advert advertid session sessionid sid ssid uid guid uuid "
    "cid clientid visitorid reqid requestid correlationid traceid trackingid token nonce impression impressionid "
    "creative creativeid placement placementid slot slotid campaignid"
).split()

#: Shortest alphanumeric run that is opaque if it holds a digit, and if it is all hexadecimal.
OPAQUE_RUN, HEX_RUN = 12, 16

#: What any of the foldings needs to change a text without digits, and the run of characters that they need besides with
#: digits: most words and paragraphs have neither, and one look at them serves for all the patterns.
SUSPECT = r"[^ !-9;<>-_a-~\u00c0-\u024f]|^ | $|  |(?i:vor|eben|ago|now|[a-f]{8})"
SUSPECT_RUN = rf"[\p{{Alnum}}_-]{{{OPAQUE_RUN}}}"


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


_GERMAN = rf"vor\s+{_any(DE_COUNTS)}\s+{_any(DE_UNITS)}"
_ENGLISH = rf"{_any(EN_COUNTS)}\s+{_any(EN_UNITS)}\s+ago"
RELATIVE = rf"(?i)(?<!\p{{Alnum}}){_any((_GERMAN, *DE_PHRASES, _ENGLISH, *EN_PHRASES))}(?!\p{{Alnum}})"
UUID = r"(?i)(?<!\p{Alnum})[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?!\p{Alnum})"
ASSIGNMENT = (
    rf"(?i)(?<!\p{{Alnum}})(?:\p{{Alnum}}+[_-])*{_any((*IDENTIFIER_NAMES, r'utm_\p{Alpha}+'))}(?:[_-]\p{{Alnum}}+)*"
    r"\s*[=:]\s*[\p{Alnum}%._~+-]{2,}"
)
#: A token of OPAQUE_RUN characters or more in which some run between separators is opaque, found by looking ahead.
OPAQUE = (
    r"(?<![\p{Alnum}_-])(?=[\p{Alnum}_-]*?(?<!\p{Alnum})"
    rf"(?:(?=\p{{Alnum}}*[0-9])\p{{Alnum}}{{{OPAQUE_RUN},}}|[0-9a-fA-F]{{{HEX_RUN},}})(?!\p{{Alnum}}))"
    rf"\p{{Alnum}}[\p{{Alnum}}_-]{{{OPAQUE_RUN - 1},}}(?![\p{{Alnum}}_-])"
)


#: Texts that are Python objects at a time.
COMPOSED_AT_ONCE = 256


def _composed(texts):
    """NFC of each text of an Arrow array; what is composed already, as nearly all text is, is only looked at."""
    from unicodedata import is_normalized, normalize

    import pyarrow as pa
    import pyarrow.compute as pc

    out = []
    for at in range(0, len(texts), COMPOSED_AT_ONCE):
        part = texts.slice(at, COMPOSED_AT_ONCE)
        if pc.all(pc.string_is_ascii(part)).as_py() is False:
            part = pa.array([x if x is None or is_normalized("NFC", x) else normalize("NFC", x) for x in part.to_pylist()], pa.string())
        out.append(part)
    return pa.concat_arrays([x.cast(pa.string()) for x in out]) if out else pa.array([], pa.string())


def nfc(text: Column) -> Column:
    """Canonical composition, a batch at a time; Catalyst has no expression for it."""
    import pyarrow as pa

    @F.arrow_udf("string")
    def run(texts):
        return _composed(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)

    return run(text)


def nfc_all(paragraphs: Column) -> Column:
    """Canonical composition of every text of an array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    @F.arrow_udf("array<string>")
    def run(lists):
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat = _composed(pc.list_flatten(lists))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, flat, mask=pc.is_null(lists))

    return run(paragraphs)


def fold(text: Column, compose: bool = True) -> Column:
    """The folded text; null folds to the empty text.

    ``compose`` false leaves out canonical composition, for text known to be composed: all the rest is Catalyst.
    """
    x = F.coalesce(text, F.lit(""))
    if compose:
        x = nfc(x)
    return F.when(suspect(x), _folded(x)).otherwise(x)


def suspect(x: Column) -> Column:
    """Whether folding may change a composed text that is not null. No word of a text that is not suspect is."""
    return F.rlike(x, F.lit(SUSPECT)) | (F.rlike(x, F.lit("[0-9]")) & F.rlike(x, F.lit(SUSPECT_RUN)))


def _folded(x: Column) -> Column:
    """``fold`` of composed text, pattern by pattern."""
    for pattern, by in (
        (LINE_BREAK, " "),
        (EXOTIC_SPACE, " "),
        (INVISIBLE, ""),
        (DOUBLE_QUOTE, '"'),
        (SINGLE_QUOTE, "'"),
        (DASH, "-"),
        (ELLIPSIS, "..."),
        (RELATIVE, RELATIVE_TIME),
        (UUID, IDENTIFIER),
        (ASSIGNMENT, IDENTIFIER),
        (OPAQUE, IDENTIFIER),
        (r"\s+", " "),
        # Markers at the edges go with the space there: a paragraph that is only an identifier folds to nothing.
        (r"^[\x00-\x20]+|[\x00-\x20]+$", ""),
    ):
        x = F.regexp_replace(x, pattern, by)
    return x


def hash_of_folded(title: Column, paragraphs: Column) -> Column:
    """SHA-256 over the folded title and the non-empty folded paragraphs, each with its length before it."""
    field = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x, F.lit("\n"))
    kept = F.filter(paragraphs, lambda p: p != "")
    return F.sha2(F.concat(F.lit(SCHEME + "\n"), field(title), F.array_join(F.transform(kept, field), "")), 256)


def content_hash(title: Column, paragraphs: Column, compose: bool = True) -> Column:
    """The identity of an article's content. Null paragraphs count as none."""
    none = F.array().cast("array<string>")
    folded = F.transform(F.coalesce(nfc_all(paragraphs) if compose else paragraphs, none), lambda p: fold(p, compose=False))
    return hash_of_folded(fold(title, compose), folded)

