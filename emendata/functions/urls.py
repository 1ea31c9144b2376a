"""One identity per address: a canonical URL as a column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and names of tracking parameters.
TRACKING_PREFIXES = "utm_ at_ ns_ wt_ etcc_ pk_ piwik_ matomo_ mtm_ hsa_ oly_ amp_ guce_ _hs".split()
TRACKING_NAMES = (
    "fbclid gclid gclsrc gbraid wbraid dclid msclkid twclid ttclid igshid igsh yclid li_fat_id epik mc_cid mc_eid _ga "
    "_gl usqp ref ref_src refsrc referrer share feature xtor cmp cmpid icid ito smid smtyp partner mbid ncid srnd taid "
    "guccounter __twitter_impression"
).split()
# Parameters that mark another rendition by their value, and host labels that stand for one.
AMP_MARKERS = ("output", "outputtype", "format")
MOBILE_MARKERS = ("m", "mobile")
HOST_LABELS = ("www", "www1", "www2", "m", "mobile", "mobil", "touch", "wap", "amp")
AMP_CACHE = ".cdn.ampproject.org"

#: scheme, authority, path, query
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: What no URI may hold: spaces, controls, delimiters, and escapes that are none.
ILLEGAL = r"[\x00-\x20\x7f<>\"{}|\\^`]|%(?![0-9a-fA-F]{2})"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``."""
    return F.transform(F.array(value), body)[0]


def parsed(url: Column) -> Column:
    """Struct (scheme, authority, path, query) of a legal URL; null otherwise. query is null where there is no '?'."""
    part = lambda i: F.regexp_extract(url, PARTS, i)
    query = F.when(F.regexp_extract(url, r"^[^#]*", 0).contains("?"), part(4))
    found = F.struct(part(1).alias("scheme"), part(2).alias("authority"), part(3).alias("path"), query.alias("query"))
    return F.when(url.rlike(PARTS) & ~url.rlike(ILLEGAL), found)


def raw_host(authority: Column) -> Column:
    return F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::[0-9]*)?$", 1)


def port_of(authority: Column) -> Column:
    """The port as text, empty if none; an authority whose host has an underscore has none that counts."""
    port = F.regexp_replace(F.regexp_extract(authority, r":([0-9]+)$", 1), "^0+(?=[0-9])", "")
    return F.when(raw_host(authority).contains("_"), F.lit("")).otherwise(port)


def host_identity(host: Column) -> Column:
    """Lower case, no dots at the end, without labels of other renditions while a dot remains in the rest."""
    bare = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.regexp_replace(bare, rf"^(?:(?:{'|'.join(HOST_LABELS)})\.)+(?=[^.]*\.)", "")


def upper_escapes(value: Column) -> Column:
    """Percent escapes in capitals: the parts between escapes and the escapes, zipped together again."""
    escape = "%[0-9a-fA-F]{2}"
    between = F.split(value, escape, -1)
    found = F.concat(F.transform(F.regexp_extract_all(value, F.lit(f"({escape})"), 1), F.upper), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, b)), "")


def without_dots(path: Column) -> Column:
    """Dot segments resolved and runs of slashes closed; '..' above the root stays, as it leads nowhere."""

    def step(done: Column, segment: Column) -> Column:
        top = F.element_at(F.concat(F.array(F.lit("..")), done), -1)
        up = (segment == "..") & (top != "..")
        return F.when((segment == ".") | (segment == ""), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.concat(done, F.array(segment))
        )

    segments = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    tail = path.rlike(r"(?:/|/\.|/\.\.)$")
    return F.concat(F.lit("/"), F.array_join(segments, "/"), F.when(tail & (F.size(segments) > 0), "/").otherwise(""))


def path_identity(path: Column) -> Column:
    """No dot segments, no segments or endings of other renditions, no slash at the end; '/' where nothing is left."""
    whole = upper_escapes(without_dots(F.when(path == "", "/").otherwise(path)))
    segments = F.filter(F.split(whole, "/", -1), lambda s: F.lower(s) != "amp")
    mobile = lambda s: F.when(F.lower(F.get(s, F.lit(1))) == "m", F.concat(F.slice(s, 1, 1), F.slice(s, 3, 100_000))).otherwise(s)
    joined = F.array_join(let(segments, mobile), "/")
    plain = F.regexp_replace(F.regexp_replace(joined, r"(?i)\.amp(\.html)$", ".html"), r"(?i)\.amp$", "")
    rooted = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit("/"), plain))
    cut = F.regexp_replace(rooted, r"(?<=.)/$", "")
    return F.when(cut == "", "/").otherwise(cut)


def decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def is_tracking(name: Column) -> Column:
    prefixes = reduce(lambda a, b: a | b, [name.startswith(p) for p in TRACKING_PREFIXES])
    return name.isin(TRACKING_NAMES) | prefixes


def is_rendition(name: Column, value: Column) -> Column:
    low = F.lower(value)
    return (name == "amp") | (name.isin(*AMP_MARKERS) & (low == "amp")) | (name.isin(*MOBILE_MARKERS) & low.isin("1", "true"))


def query_identity(query: Column) -> Column:
    """Parameters that identify, raw but for escapes in capitals, sorted by decoded name, then raw text."""
    pair = lambda p: F.struct(
        F.lower(decoded(F.regexp_extract(p, "^([^=]*)", 1))).alias("name"),
        upper_escapes(p).alias("raw"),
        decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value"),
    )
    pairs = F.transform(F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.trim(p) != ""), pair)
    kept = F.filter(pairs, lambda p: (p["name"] != "") & ~is_tracking(p["name"]) & ~is_rendition(p["name"], p["value"]))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: p["raw"]), "&")


def unwrapped(url: Column) -> Column:
    """The address an AMP cache URL stands for; any other URL as it is."""

    def open_(p: Column) -> Column:
        rest = F.regexp_extract(p["path"], r"^/[cv]/(?:s/)?(.+)$", 1)
        inner = F.concat(F.lit("https://"), rest, F.when(p["query"].isNotNull(), F.concat(F.lit("?"), p["query"])).otherwise(""))
        return F.when(F.lower(raw_host(p["authority"])).endswith(AMP_CACHE) & (rest != ""), inner).otherwise(url)

    return F.coalesce(let(parsed(url), open_), url)


def canonical_url(url: Column) -> Column:
    """The identity of an address: https, no fragment, no credentials; null for what is no http(s) URL with a host."""

    def build(p: Column) -> Column:
        host, port = host_identity(raw_host(p["authority"])), port_of(p["authority"])
        shown = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
        tail = let(query_identity(p["query"]), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        whole = F.concat(F.lit("https://"), host, shown, path_identity(p["path"]), tail)
        return F.when(F.lower(p["scheme"]).isin("http", "https") & (host != ""), whole)

    trimmed = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    legal = F.lower(F.regexp_extract(trimmed, PARTS, 1)).isin("http", "https")
    return F.when(legal, let(trimmed, lambda t: let(unwrapped(t), lambda u: let(parsed(u), build))))


def is_site_root(canonical: Column) -> Column:
    return canonical.rlike(r"^[^/]*//[^/]*/?$")


def document_identity(url: Column, declared: Column) -> Column:
    """The page's own declaration if it holds up, else the address; ``declared`` is an absolute URL or null.

    A declaration of the site's root on a page that is not the root is a template's mistake.
    """
    own, said = canonical_url(url), canonical_url(declared)
    wrong = is_site_root(said) & ~F.coalesce(is_site_root(own), F.lit(False))
    return F.coalesce(F.when(~wrong, said), own)


def provisional_identity(link: Column) -> Column:
    return F.coalesce(canonical_url(link), link)


def host_bucket(url: Column) -> Column:
    """What a rate limit counts by: the host in lower case, or the whole address where there is none."""
    host = F.lower(raw_host(F.regexp_extract(url, PARTS, 2)))
    return F.when(F.coalesce(host, F.lit("")) != "", host).otherwise(url)
