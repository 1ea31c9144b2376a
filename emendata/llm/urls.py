"""URL filters: listed rules first, then the reputation of the host.

Reputation is empirical Bayes: the share of bad among labelled pages is shrunk by beta-binomial priors, from the
whole to the suffix, to the registered domain, to the host. A host is blocked if the lower bound of its posterior
lies above a cutoff.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emendata.llm.common import durable

MOST_RULES = 500
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# Second labels under which names are registered in countries that group them, as in example.co.uk.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org", "sch")


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent domain of it and the path; null if none."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        hit = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def strength(groups: DataFrame) -> tuple[float, float]:
    """Mean and prior strength of a beta-binomial by moments, from groups with n labelled and bad of them."""
    x = groups.filter("n > 0").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("between"),
    ).first()
    if not x.k:
        return 0.5, 2.0
    mean = (x.bad + 1.0) / (x.n + 2.0)
    spread = (x.between - x.bad * float(x.bad) / x.n) / (mean * (1 - mean)) - (x.k - 1)
    room = x.n - x.squares / x.n - (x.k - 1)
    rho = min(0.5, max(0.001, spread / room)) if room > 0 else 0.5
    return mean, 1 / rho - 1


def registered(host: str, second_labels: tuple[str, ...] = SECOND_LABELS) -> tuple[Column, Column, Column]:
    """Labels, registered domain and suffix of a host; credentials and port do not belong to either.

    The suffix is the last label, or the last two where the last has two letters and the one before is one of
    ``second_labels``; the registered domain has one label more. A numeric address is a domain of its own under a
    suffix of its own kind, as is a host of one label.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(host), r"^[^@]*@", ""), r":[0-9]*$", "")
    numeric = bare.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[")
    names = F.split(bare, r"\.")
    two = (F.length(F.element_at(names, -1)) == 2) & F.get(names, F.size(names) - 2).isin(*second_labels) & (F.size(names) > 2)
    n = F.when(numeric, 0).when(two, 2).otherwise(1)
    last = lambda k: F.concat_ws(".", F.slice(names, F.greatest(F.lit(1), F.size(names) - k + 1), k))
    return names, F.when(numeric, bare).otherwise(last(n + 1)), F.when(numeric, F.lit("[]")).otherwise(last(n))


def reputations(hosts: DataFrame, z: float = 1.645, second_labels: tuple[str, ...] = SECOND_LABELS) -> DataFrame:
    """Posterior of each host: host, n, bad, mean, bound (mean less z standard deviations).

    ``hosts`` has one row per host with n and bad; hosts without labels inherit from their domain, suffix, and all.
    """
    _, domain, suffix = registered("host", second_labels)
    level = hosts.select("host", "n", "bad", suffix.alias("suffix"), domain.alias("domain"))
    level = durable(level)
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = durable(level.groupBy("domain", "suffix").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    overall, by_suffix = strength(suffixes)
    _, by_domain = strength(domains)
    _, by_host = strength(level)
    shrunk = lambda n, bad, prior, k: (bad + F.lit(k) * prior) / (n + F.lit(k))
    suffixes = suffixes.select("suffix", shrunk(F.col("n"), F.col("bad"), F.lit(overall), by_suffix).alias("_prior"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", shrunk(F.col("n"), F.col("bad"), F.col("_prior"), by_domain).alias("_prior")
    )
    out = level.join(domains, "domain").withColumn("mean", shrunk(F.col("n"), F.col("bad"), F.col("_prior"), by_host))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(by_host + 1)))
    return out.select("host", "n", "bad", "mean", (F.col("mean") - F.lit(z) * deviation).alias("bound"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES, cutoff: float = 0.5, z: float = 1.645
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict ('allow' or 'block').

    ``outcomes`` has the columns url and bad (boolean, null: not labelled), one row per labelled page. Null urls and
    those without :// have an empty host and path, which are judged as any other host. Rows that repeat are judged
    each and count each. Columns other than page_id and url are not read. A hot host is summed before it is shuffled,
    and the join that brings verdicts back splits it.
    """
    url = F.col("url")
    labelled = outcomes.select(host_of(url).alias("host"), F.col("bad").cast("boolean").alias("bad")).filter("bad IS NOT NULL")
    seen = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    every = pages.select(host_of(url).alias("host")).distinct()
    known = every.join(seen, "host", "left").fillna(0, ["n", "bad"])
    blocked = durable(reputations(known, z).filter(F.col("bound") > cutoff).select(F.col("host").alias("_host")))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.join(blocked, F.col("host") == F.col("_host"), "left")
    rows = rows.withColumn("_m", matched(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("_host").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("_m.rule").alias("rule"), F.coalesce(F.col("_m.verdict"), own).alias("verdict"))


def outcomes_by_number(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose path ends in a document's number: bad if that document is of low quality or toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    numbered = pages.select("url", number.try_cast("bigint").alias("_n"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marked = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_n")).agg(F.max(bad).alias("bad"))
    return numbered.filter("_n IS NOT NULL").join(marked, "_n").select("url", "bad")
