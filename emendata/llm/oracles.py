"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from emendata.llm import licences, rules, urls

WORD = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    x = f"lower(coalesce({column}, ''))"
    x = f"regexp_replace({x}, {quoted(licences.COPYRIGHT_LINE)}, ' ', 'g')"
    x = f"replace({x}, 'https://', 'http://')"
    x = f"' ' || regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for a, b in licences.SPELLINGS:
        x = f"replace({x}, ' {a} ', ' {b} ')"
    for a, b, c in licences.SPLIT_SPELLINGS:
        x = f"replace({x}, ' {a}  {b} ', ' {c} ')"
    return f"trim({x})"


def license_scan() -> str:
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in licences.CATALOGUE)
    longs = ", ".join(f"({quoted(b)}, {quoted(a)})" for a, b in licences.LONG_TEXTS)
    return f"""
    WITH form AS (SELECT id, {_canonical('t')} AS f FROM (VALUES {values}) v(id, t)),
    known AS (SELECT k, min(id) AS id FROM (SELECT sha256(f) AS k, id FROM form WHERE f <> '' UNION ALL SELECT * FROM (VALUES {longs})) GROUP BY 1),
    whole AS (SELECT doc_id, {_canonical('text')} AS f FROM documents),
    cut AS (SELECT doc_id, {_canonical('line')} AS f
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
    hits AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS ids
             FROM cut JOIN known ON f <> '' AND sha256(f) = k GROUP BY 1)
    SELECT w.doc_id, CASE WHEN f <> '' THEN sha256(f) END AS digest, known.id AS license_id, coalesce(ids, '') AS notice_ids
    FROM whole w LEFT JOIN known ON f <> '' AND sha256(f) = k LEFT JOIN hits h ON w.doc_id = h.doc_id
    """


LINE_DEDUP = rf"""
    WITH body AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM body),
    w AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n FROM l),
    c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
    m AS (SELECT b.doc_id AS d, b.pos AS p, a.doc_id AS e, a.pos AS q
          FROM c a JOIN c b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos))),
    r AS (SELECT *, p - row_number() OVER (PARTITION BY d, e, p - q ORDER BY p) AS island FROM m),
    x AS (SELECT d, p, max(p) OVER (PARTITION BY d, e, p - q, island) AS last FROM r),
    runs AS (SELECT d, p, max(last) AS last FROM x GROUP BY 1, 2),
    long AS (SELECT d, p, last FROM runs JOIN c s ON s.doc_id = d AND s.pos = p JOIN c t ON t.doc_id = d AND t.pos = last
             WHERE t.upto - s.upto + s.n >= 50),
    gone AS (SELECT DISTINCT d, unnest(range(p, last + 1)) AS p FROM long),
    kept AS (SELECT c.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.p IS NULL), '') AS text,
                    count(*) AS n_lines, count(gone.p) AS n_removed
             FROM c LEFT JOIN gone ON d = doc_id AND p = pos GROUP BY 1)
    SELECT o.doc_id, CASE WHEN o.text IS NOT NULL THEN kept.text END AS text,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
    FROM documents o LEFT JOIN kept ON o.doc_id = kept.doc_id
"""

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE t AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
        FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                            WHEN len(w) > 0 THEN ['< ' || array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
    one AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
          FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
    twice AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT a AS doc_id, a AS r FROM twice UNION SELECT twice.b, reach.r FROM reach JOIN twice ON twice.a = reach.doc_id),
    low AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
    SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(r, s.doc_id) AS component_id, s.doc_id = coalesce(r, s.doc_id) AS kept
    FROM s LEFT JOIN low ON s.doc_id = low.doc_id
"""


def quality_rules() -> str:
    stop = "|".join(dict.fromkeys(rules.STOP_WORDS))
    tests = []
    for r in rules.RULES:
        for sign, bound in ((">=", r.low), ("<=", r.high)):
            if bound is not None:
                tests.append(f"{r.measure} {sign} {bound}::DOUBLE" + (f" * {r.per}" if r.per else ""))
    symbols = "[" + rules.SYMBOLS + "]"
    return rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM t),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
          FROM w WHERE len(w) >= 5),
    f AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
    r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM f) GROUP BY 1),
    m AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                 length(text) - length(regexp_replace(text, '{symbols}', '', 'g')) AS n_symbols,
                 len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
                 len(list_filter(w, lambda x: regexp_matches(x, '^(?i:{stop})([.,;:!?]|$)'))) AS n_stop_words,
                 length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper
          FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND {' AND '.join(tests)} AS kept
    FROM b
    """


def url_filter() -> str:
    host = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    ordered = sorted(urls.RULES, key=lambda r: (-len(r.host + r.path), r))
    fits = [
        (f"(host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)})", r) for r in ordered
    ]
    rule = "CASE " + " ".join(f"WHEN {t} THEN {quoted(r.host + r.path)}" for t, r in fits) + " END"
    listed = "CASE " + " ".join(f"WHEN {t} THEN {quoted(r.verdict)}" for t, r in fits) + " END"

    def strength(name: str, groups: str) -> str:
        return f"""
    {name}0 AS (SELECT count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(n::DOUBLE * n) AS squares, sum(bad::DOUBLE * bad / n) AS between_
               FROM {groups} WHERE n > 0),
    {name}1 AS (SELECT *, (bad + 1.0) / (n + 2.0) AS mean, n - squares / n - (k - 1) AS room FROM {name}0),
    {name} AS (SELECT CASE WHEN k = 0 THEN 0.5::DOUBLE ELSE mean END AS mean, CASE WHEN k = 0 THEN 2.0::DOUBLE ELSE 1 / (CASE WHEN room > 0 THEN
               least(0.5, greatest(0.001, ((between_ - bad * bad::DOUBLE / n) / (mean * (1 - mean)) - (k - 1)) / room)) ELSE 0.5 END) - 1 END AS kappa FROM {name}1)"""

    return rf"""
    WITH p AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
    d AS (SELECT doc_id, max(((coalesce(quality, 1) = 0) OR (coalesce(toxic, 0) = 1))::INT) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    o AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM p JOIN d
          ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?$', 1), '') AS BIGINT) GROUP BY 1),
    h AS (SELECT DISTINCT p.host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, regexp_replace(regexp_replace(p.host, '^[^@]*@', ''), ':[0-9]*$', '') AS bare FROM p LEFT JOIN o ON p.host = o.host),
    i AS (SELECT host, n, bad, bare, string_split(bare, '.') AS s, regexp_matches(bare, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$|^\[') AS numeric FROM h),
    j AS (SELECT *, CASE WHEN len(s) > 2 AND length(s[-1]) = 2 AND s[-2] IN ({", ".join(map(quoted, urls.SECOND_LABELS))}) THEN 2 ELSE 1 END AS k FROM i),
    x AS (SELECT host, n, bad, CASE WHEN numeric THEN '[]' ELSE array_to_string(s[-k:], '.') END AS suffix, CASE WHEN numeric THEN bare ELSE array_to_string(s[-(k + 1):], '.') END AS domain FROM j),
    dom AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM x GROUP BY 1, 2),
    suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dom GROUP BY 1),
    {strength('ks', 'suf')}, {strength('kd', 'dom')}, {strength('kh', 'x')},
    suf1 AS (SELECT suffix, (bad + ks.kappa * ks.mean) / (n + ks.kappa) AS prior FROM suf, ks),
    dom1 AS (SELECT domain, (bad + kd.kappa * prior) / (n + kd.kappa) AS prior FROM dom JOIN suf1 ON dom.suffix = suf1.suffix, kd),
    host1 AS (SELECT host, n, kh.kappa AS kappa, (bad + kh.kappa * prior) / (n + kh.kappa) AS mean FROM x JOIN dom1 ON x.domain = dom1.domain, kh),
    blocked AS (SELECT host FROM host1 WHERE mean - 1.645 * sqrt(mean * (1 - mean) / (n + kappa + 1)) > 0.5)
    SELECT page_id, p.host, path, {rule.replace('(host =', '(p.host =').replace('ends_with(host', 'ends_with(p.host')} AS rule,
           coalesce({listed.replace('(host =', '(p.host =').replace('ends_with(host', 'ends_with(p.host')},
                    CASE WHEN blocked.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN blocked ON p.host = blocked.host
    """


ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan(),
    "op3_line_dedup": LINE_DEDUP,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op7_quality_rules": quality_rules(),
    "op9_url_filter": url_filter(),
}
