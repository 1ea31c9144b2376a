import math
import random

import pytest

from emendata.llm.urls import RULES, UrlRule, judge_urls, outcomes_by_number, reputations

PAGES = [
    (1, "http://a.b.Example.ORG/es/1?x#y"), (2, "https://example.org/en/12"), (3, "https://x.org"), (4, "https://x.org/"),
    (5, "http://shop.com/de/1"), (6, "http://shop.com/fr/1"), (7, "http://shop.com/en/1"), (8, None), (9, "no scheme/de/"),
    (10, ""), (11, "http://notexample.org/es/"), (12, "http://com/de/"), (13, "ftp://u://v"), (14, "http://bad.net/1"), (14, "http://bad.net/1"),
]


def judged(spark, outcomes):
    pages = spark.createDataFrame([(*p, "host") for p in PAGES], "page_id long, url string, host string")
    return judge_urls(pages, outcomes).collect()


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=UrlRule("", "", ""))
    return host, path, (best.host + best.path) or None, best.verdict


def test_rules_and_reputation(spark):
    bad = [("http://bad.net/x", True)] * 60 + [("http://shop.com/x", False)] * 200 + [("http://q.org/x", None)]
    out = judged(spark, spark.createDataFrame(bad, "url string, bad boolean"))
    assert len(out) == len(PAGES)
    urls = dict(PAGES)
    for r in out:
        host, path, rule, verdict = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if host == "bad.net" else "allow"))


def test_no_labels_and_no_pages(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    assert {r.verdict for r in judged(spark, none) if r.rule is None} == {"allow"}
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(pages, none).count() == 0


def test_outcomes(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/7.html"), (2, "http://a.b/en/8/?q"), (3, "http://a.b/en/x"), (4, None)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 0), (7, 1, 0), (8, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted((r.url, r.bad) for r in outcomes_by_number(pages, labels).collect()) == [("http://a.b/en/7.html", True), ("http://a.b/en/8/?q", False)]


def plain_strength(groups):
    """Beta-binomial by moments, over (n, bad) of groups with labels."""
    groups = [(n, bad) for n, bad in groups if n]
    if not groups:
        return 0.5, 2.0
    n, bad = sum(g[0] for g in groups), sum(g[1] for g in groups)
    mean = (bad + 1) / (n + 2)
    between = sum(m * (b / m - bad / n) ** 2 for m, b in groups) / (mean * (1 - mean))
    room = n - sum(m * m for m, _ in groups) / n - (len(groups) - 1)
    rho = min(0.5, max(0.001, (between - (len(groups) - 1)) / room)) if room > 0 else 0.5
    return mean, 1 / rho - 1


def test_posteriors_at_three_levels(spark):
    r = random.Random(4)
    hosts = {}
    for suffix, worse in (("com", 0.1), ("co.uk", 0.5), ("biz", 0.9)):
        for d in range(12):
            share = min(0.99, max(0.01, r.gauss(worse, 0.25)))
            for h in ("", "www.", "a.b."):
                n = r.choice([0, 0, 1, 5, 40, 200])
                hosts[f"{h}d{d}.{suffix}"] = (suffix, f"d{d}.{suffix}", n, sum(r.random() < share for _ in range(n)))
    hosts["u@d1.com:8080"] = ("com", "d1.com", 30, 30)
    hosts["10.0.0.7:81"] = ("[]", "10.0.0.7", 9, 9)
    hosts["localhost"] = ("localhost", "localhost", 0, 0)

    def sums(level):
        out = {}
        for x in hosts.values():
            n, bad = out.get(x[level], (0, 0))
            out[x[level]] = (n + x[2], bad + x[3])
        return out

    suffixes, domains = sums(0), sums(1)
    (mean, ks), (_, kd), (_, kh) = plain_strength(suffixes.values()), plain_strength(domains.values()), plain_strength([x[2:] for x in hosts.values()])
    rows = spark.createDataFrame([(h, x[2], x[3]) for h, x in hosts.items()], "host string, n long, bad long")
    got = {x.host: x for x in reputations(rows).collect()}
    blocked = 0
    for h, (suffix, domain, n, bad) in hosts.items():
        one = (suffixes[suffix][1] + ks * mean) / (suffixes[suffix][0] + ks)
        two = (domains[domain][1] + kd * one) / (domains[domain][0] + kd)
        post = (bad + kh * two) / (n + kh)
        bound = post - 1.645 * math.sqrt(post * (1 - post) / (n + kh + 1))
        assert got[h].mean == pytest.approx(post, rel=1e-9) and got[h].bound == pytest.approx(bound, rel=1e-9)
        blocked += bound > 0.5
    assert 5 < blocked < len(hosts) - 5
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    outcomes = spark.createDataFrame([(f"http://{h}/y", k < x[3]) for h, x in hosts.items() for k in range(x[2])], "url string, bad boolean")
    judged_ = judge_urls(pages, outcomes, rules=()).filter("verdict = 'block'").collect()
    assert {x.host for x in judged_} == {h for h in hosts if got[h].bound > 0.5}
