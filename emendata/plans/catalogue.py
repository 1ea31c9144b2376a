"""Queries over the driver's tables and the SQL they are held against.

events stand for an observation log: user_id is the document, event_type the content. Orders stand for documents under
a re-check policy, customers and nations for documents and feeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emendata.functions import dates, http, text, urls
from emendata.functions.spread import spread
from emendata.operators import diff, planning, reports, versioning
from emendata.sources import articles, captures, encoding, feeds, robots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for work on their markup, which a file of one row group would leave to one task."""
    return spread(table(spark, sf_dir, "pages"), "page_id", "url")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")


def event_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.append_if_changed(observations(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


REVISIONS = """
    o AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    v AS (SELECT *, sum(CASE WHEN n = 1 OR before IS DISTINCT FROM event_type THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS version_number,
                    n = 1 OR before IS DISTINCT FROM event_type AS is_new FROM o),
    r AS (SELECT event_id, user_id, ts, event_type, version_number FROM v WHERE is_new)"""


@query(f"WITH {REVISIONS} SELECT * FROM r")
def append_if_changed(spark, sf_dir):
    return event_revisions(spark, sf_dir)


@query(
    f"""WITH {REVISIONS} SELECT event_id, user_id, ts, event_type, CASE WHEN is_new THEN 'APPENDED' ELSE 'UNCHANGED' END AS outcome,
        version_number, CASE WHEN is_new THEN nullif(version_number - 1, 0) ELSE version_number END AS previous_version FROM v"""
)
def store_verdicts(spark, sf_dir):
    return versioning.store_verdicts(observations(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH {REVISIONS} SELECT user_id, max(version_number) AS version_count, max(ts) FILTER (WHERE version_number > 1) AS last_changed_at FROM r GROUP BY 1")
def document_counters(spark, sf_dir):
    return versioning.counters(event_revisions(spark, sf_dir), "user_id", "ts")


@query(f"WITH {REVISIONS} SELECT user_id, event_id, ts, event_type, version_number FROM r QUALIFY version_number = max(version_number) OVER (PARTITION BY user_id)")
def latest_revisions(spark, sf_dir):
    return versioning.latest(event_revisions(spark, sf_dir), "user_id").select("user_id", "event_id", "ts", "event_type", "version_number")


@query(f"WITH {REVISIONS} SELECT event_id, ts, event_type, version_number FROM r WHERE user_id = 7 ORDER BY version_number")
def revision_history(spark, sf_dir):
    return versioning.history(event_revisions(spark, sf_dir), "user_id", 7).select("event_id", "ts", "event_type", "version_number")


@query(f"WITH {REVISIONS} SELECT event_id, ts, event_type FROM r WHERE user_id = 7 AND version_number = 2")
def one_revision(spark, sf_dir):
    return versioning.version(event_revisions(spark, sf_dir), "user_id", 7, 2).select("event_id", "ts", "event_type")


def _changed(spark, sf_dir, **options):
    revisions = event_revisions(spark, sf_dir)
    seen = observations(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("first_seen_at"))
    documents = versioning.counters(revisions, "user_id", "ts").join(seen, "user_id")
    newest = versioning.latest(revisions, "user_id").select("user_id", F.col("event_type").alias("newest"))
    return versioning.changed_documents(documents, newest, "user_id", **options)


_CHANGED = f"""WITH {REVISIONS},
    d AS (SELECT user_id, max(version_number) AS version_count, max(ts) FILTER (WHERE version_number > 1) AS last_changed_at FROM r GROUP BY 1),
    s AS (SELECT user_id, min(ts) AS first_seen_at FROM events GROUP BY 1),
    l AS (SELECT user_id, event_type AS newest FROM r QUALIFY version_number = max(version_number) OVER (PARTITION BY user_id))
    SELECT d.user_id, version_count, last_changed_at, first_seen_at, newest FROM d JOIN s USING (user_id) JOIN l USING (user_id)"""


@query(_CHANGED + " WHERE version_count > 1 ORDER BY last_changed_at DESC NULLS LAST, user_id LIMIT 50")
def changed_documents(spark, sf_dir):
    return _changed(spark, sf_dir)


@query(
    _CHANGED
    + " WHERE version_count >= 3 AND coalesce(last_changed_at, first_seen_at) >= TIMESTAMP '2024-01-15' ORDER BY last_changed_at DESC NULLS LAST, user_id LIMIT 200"
)
def changed_documents_filtered(spark, sf_dir):
    return _changed(spark, sf_dir, since=F.lit("2024-01-15").cast("timestamp_ntz"), least_versions=3, limit=1000)


@query(
    """WITH o AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS before, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version_number FROM o WHERE n = 1 OR before IS DISTINCT FROM text),
    d AS (SELECT conv_id, max(version_number) AS version_count, max(turn) FILTER (WHERE version_number > 1) AS last_changed_at FROM r GROUP BY 1)
    SELECT d.conv_id, version_count, last_changed_at, text AS newest FROM d JOIN r ON d.conv_id = r.conv_id AND version_number = version_count
    WHERE version_count > 1 ORDER BY last_changed_at DESC NULLS LAST, d.conv_id LIMIT 50"""
)
def changed_conversations(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    revisions = versioning.append_if_changed(log, "conv_id", "turn", "text")
    newest = versioning.latest(revisions, "conv_id").select("conv_id", F.col("text").alias("newest"))
    return versioning.changed_documents(versioning.counters(revisions, "conv_id", "turn"), newest, "conv_id")


@query(f"WITH {REVISIONS} SELECT user_id, event_type, version_number FROM r WHERE ts <= TIMESTAMP '2024-02-01' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, version_number DESC) = 1")
def as_of_revision(spark, sf_dir):
    at = F.lit("2024-02-01").cast("timestamp_ntz")
    return versioning.as_of(event_revisions(spark, sf_dir), "user_id", "ts", at).select("user_id", "event_type", "version_number")


@query(
    f"""WITH {REVISIONS}, q AS (SELECT event_id, user_id, ts - INTERVAL 1 HOUR AS asked FROM events)
    SELECT q.event_id, q.user_id, asked, r.event_type, r.version_number FROM q LEFT JOIN r ON r.user_id = q.user_id AND r.ts <= asked
    QUALIFY row_number() OVER (PARTITION BY q.event_id ORDER BY r.ts DESC NULLS LAST, r.version_number DESC) = 1"""
)
def as_of_join(spark, sf_dir):
    asked = observations(spark, sf_dir).select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("asked"))
    revisions = event_revisions(spark, sf_dir).drop("event_id")
    return versioning.as_of_join(asked, revisions, "user_id", "asked", "ts", ["event_type", "version_number"])


@query(f"WITH {REVISIONS}, f AS (SELECT *, min(version_number) OVER (PARTITION BY user_id, event_type) AS first_version FROM r) SELECT user_id, event_type, version_number, first_version FROM f WHERE first_version < version_number")
def revert_detection(spark, sf_dir):
    return versioning.reverts(event_revisions(spark, sf_dir), "user_id", "event_type").select("user_id", "event_type", "version_number", "first_version")


@query(f"WITH {REVISIONS} SELECT user_id, lag(version_number) OVER w AS from_version, version_number AS to_version, lead(version_number) OVER w IS NULL AS current, lag(event_type) OVER w AS from_event_type, event_type AS to_event_type FROM r WINDOW w AS (PARTITION BY user_id ORDER BY version_number) QUALIFY from_version IS NOT NULL")
def revision_pairs(spark, sf_dir):
    return versioning.revision_pairs(event_revisions(spark, sf_dir), "user_id", ["event_type"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_number FROM events")
def renumbered_backfill(spark, sf_dir):
    return versioning.renumbered(observations(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "version_number")


@query(f"WITH {REVISIONS} SELECT * FROM r")
def merged_batches(spark, sf_dir):
    """Two batches merged give the revisions of one."""
    log = observations(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    early = versioning.append_if_changed(log.filter(F.col("ts") < cut).select("user_id", "at", "event_type"), "user_id", "at", "event_type")
    late = versioning.merge_revisions(early, log.filter(F.col("ts") >= cut).select("user_id", "at", "event_type"), "user_id", "at", "event_type")
    both = early.unionByName(late)
    return both.select("at.event_id", "user_id", "at.ts", "event_type", "version_number")


@query(
    """SELECT event_type AS identity, min_by(user_id, event_id) AS feed_id, min_by(user_id, event_id) FILTER (WHERE value > 50) AS observed_origin,
       min_by(ts, event_id) AS first_seen_at, max_by(ts, event_id) AS last_checked_at FROM events GROUP BY 1"""
)
def registered_documents(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias("identity"), "user_id", "ts", "event_id", F.when(F.col("value") > 50, F.col("user_id")).alias("origin"))
    return versioning.register(seen, "identity", "ts", "user_id", "origin", "event_id")


@query("SELECT n_nationkey, n_name, count(c_custkey) AS documents FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY documents DESC, n_name LIMIT 5")
def feed_coverage(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return versioning.feed_coverage(table(spark, sf_dir, "nation"), customers, "n_nationkey", "n_name", "c_custkey")


@query(
    """WITH d AS (SELECT page_id, url, lead(url) OVER (ORDER BY page_id) AS origin FROM pages),
    w AS (SELECT DISTINCT url FROM pages),
    m AS (SELECT w.url, page_id, 1 AS rank, d.url AS i FROM w JOIN d ON d.url = w.url UNION ALL SELECT w.url, page_id, 2, d.url FROM w JOIN d ON d.origin = w.url)
    SELECT url, page_id FROM m QUALIFY row_number() OVER (PARTITION BY url ORDER BY rank, i) = 1"""
)
def either_key_lookup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("origin"))
    known = pages.join(after, "page_id", "left").withColumnRenamed("url", "identity")
    return versioning.either_key_lookup(pages.select("url").distinct(), known, "url", "identity", "origin", ["page_id"])


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1")
def not_planned(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return versioning.not_planned(pages, pages.filter("page_id % 3 = 0"), "url", "page_id")


_STRIKES = """
    a AS (SELECT user_id, ts, event_type = 'error' AS failed, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS ok FROM events),
    s AS (SELECT user_id, max(ts) AS last_attempt_at, count(*) FILTER (WHERE failed AND ok = 0) AS failure_count FROM a GROUP BY 1)"""


def _strikes(spark, sf_dir):
    return planning.attempt_strikes(observations(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error", "ts")


@query(f"WITH {_STRIKES} SELECT * FROM s")
def attempt_strikes(spark, sf_dir):
    return _strikes(spark, sf_dir)


@query(
    f"""WITH {_STRIKES}, h AS (SELECT c_custkey AS user_id, last_attempt_at, coalesce(failure_count, 0) AS failure_count FROM customer LEFT JOIN s ON user_id = c_custkey),
    q AS (SELECT *, row_number() OVER (PARTITION BY failure_count >= 1 ORDER BY last_attempt_at NULLS FIRST, user_id) AS n FROM h)
    SELECT user_id, last_attempt_at, failure_count, CASE WHEN failure_count >= 1 THEN 'ABANDONED' WHEN n <= 50 THEN 'ADMITTED' ELSE 'DEFERRED' END AS admission FROM q"""
)
def article_budget(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    histories = planning.histories_of(wanted, _strikes(spark, sf_dir), "user_id")
    return planning.ArticleBudget(50, 1).admit(histories, "user_id").select("user_id", "last_attempt_at", "failure_count", "admission")


@query(
    """WITH t AS (SELECT user_id % 25 AS feed, count(*) AS fetches, count(*) FILTER (WHERE event_type = 'purchase') AS confirmed
                  FROM events WHERE value > 40 AND event_type IN ('purchase', 'view') GROUP BY 1)
    SELECT n_nationkey AS feed, CASE WHEN confirmed > 0 THEN 0 ELSE least(n_regionkey + coalesce(fetches, 0), 2147483647) END::INT AS unconfirmed_claims FROM nation LEFT JOIN t ON feed = n_nationkey"""
)
def claim_credibility(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "purchase", "CHANGED").when(F.col("event_type") == "view", "UNCHANGED").otherwise("FAILED")
    results = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("feed"), "value", outcome.alias("outcome"))
    tally = planning.claim_tally(results, "feed", F.col("value") > 40, "outcome")
    feeds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("feed"), F.col("n_regionkey").alias("unconfirmed_claims"))
    return planning.claim_strikes(feeds, tally, "feed")


#: 500 hours after the last order, of 2001-08-01: after every check.
NOW = 998_424_000
_STATES = """
    e AS (SELECT o_orderkey AS pos, 'host' || (o_custkey % 40) AS host, epoch(o_orderdate)::BIGINT AS first_seen,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE epoch(o_orderdate)::BIGINT + (o_orderkey % 500) * 3600 END AS last_checked,
          CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0 THEN epoch(o_orderdate)::BIGINT + (o_orderkey % 90) * 3600 END AS last_changed,
          CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 + o_orderkey % 5 END AS version_count,
          epoch(o_orderdate)::BIGINT + (o_orderkey % 700) * 3600 AS feed_updated, o_orderkey % 11 = 0 AS feed_updated_exact, (o_orderkey % 30)::INT AS unconfirmed_claims FROM orders)"""


def states(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000
    day = day.cast("long")
    unseen = key % 7 == 0
    return orders.select(
        key.alias("pos"),
        F.concat(F.lit("host"), (F.col("o_custkey") % 40).cast("string")).alias("host"),
        day.alias("first_seen"),
        F.when(~unseen, day + (key % 500) * 3600).alias("last_checked"),
        F.when(~unseen & (key % 3 == 0), day + (key % 90) * 3600).alias("last_changed"),
        F.when(unseen, 0).otherwise(1 + key % 5).alias("version_count"),
        (day + (key % 700) * 3600).alias("feed_updated"),
        (key % 11 == 0).alias("feed_updated_exact"),
        (key % 30).cast("int").alias("unconfirmed_claims"),
    )


_PLAN = f"""WITH {_STATES},
    x AS (SELECT *, greatest(first_seen, last_changed) AS event, coalesce(feed_updated_exact AND feed_updated > last_checked, false) AS claim FROM e),
    d AS (SELECT *, CASE WHEN last_checked IS NULL THEN 'DUE' WHEN claim AND unconfirmed_claims < 20 THEN 'DUE'
                         WHEN {NOW} - event > 604800 * least(1 + greatest(0, version_count - 1), 4) THEN 'RETIRED'
                         WHEN {NOW} - last_checked >= greatest(600, least(43200, floor(greatest(0, {NOW} - event) * 0.25::DOUBLE))) THEN 'DUE' ELSE 'WAITING' END AS d FROM x),
    p AS (SELECT *, sum(coalesce(last_checked > {NOW} - 3600, false)::INT) OVER (PARTITION BY host) AS spent,
                 row_number() OVER (PARTITION BY host, d ORDER BY last_checked NULLS FIRST, pos) AS turn FROM d),
    f AS (SELECT pos, host, CASE WHEN d = 'DUE' AND spent + turn > 120 THEN 'THROTTLED' ELSE d END AS decision FROM p)"""


@query(_PLAN + " SELECT pos, host, decision FROM f")
def recheck_plan(spark, sf_dir):
    return planning.RecheckPolicy().plan(states(spark, sf_dir), NOW).select("pos", "host", "decision")


@query(_PLAN + " SELECT decision, count(*) AS n FROM f GROUP BY 1")
def recheck_report(spark, sf_dir):
    return planning.RecheckPolicy().plan(states(spark, sf_dir), NOW).groupBy("decision").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_STATES}, x AS (SELECT *, greatest(first_seen, last_changed) AS event FROM e)
    SELECT pos, last_checked FROM x WHERE last_checked < {NOW} - 600 AND (event > {NOW} - 604800 OR (version_count > 1 AND event > {NOW} - 4 * 604800)) ORDER BY last_checked, pos LIMIT 500"""
)
def possibly_due(spark, sf_dir):
    return planning.RecheckPolicy().possibly_due(states(spark, sf_dir), NOW, doc="pos").select("pos", "last_checked")


@query("SELECT page_id, row_number() OVER (PARTITION BY trim(url) ORDER BY page_id) > 1 AS duplicate FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, url || ' ' FROM pages WHERE page_id % 2 = 0)")
def first_link_wins(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    again = pages.filter("page_id % 2 = 0").select((F.col("page_id") + 1_000_000).alias("page_id"), F.concat("url", F.lit(" ")).alias("url"))
    return planning.first_link_wins(pages.unionByName(again), "url", ["page_id"]).select("page_id", "duplicate")


@query(
    """WITH n AS (SELECT n_name AS url, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS name FROM nation WHERE n_nationkey >= 5),
    o AS (SELECT n_name AS url, n_name AS old FROM nation WHERE n_nationkey < 20)
    SELECT coalesce(o.url, n.url) AS url, coalesce(name, old) AS name, CASE WHEN o.url IS NULL THEN 'added' WHEN name <> old THEN 'renamed' ELSE 'kept' END AS change FROM o FULL JOIN n ON o.url = n.url"""
)
def catalog_sync(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    old = nations.filter("n_nationkey < 20").select(F.col("n_name").alias("url"), F.col("n_name").alias("name"))
    name = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name"))
    return planning.sync_catalogue(old, nations.filter("n_nationkey >= 5").select(F.col("n_name").alias("url"), name.alias("name")))


@query(
    """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 'old' ELSE 'old' END AS etag,
       CASE WHEN n_nationkey % 3 = 0 THEN 'new' WHEN n_nationkey % 3 = 1 THEN 'new' ELSE 'was' END AS last_modified,
       CASE WHEN n_nationkey % 3 = 0 THEN 200 WHEN n_nationkey % 3 = 1 THEN 304 ELSE 500 END AS last_status, 5::BIGINT AS last_polled_at FROM nation"""
)
def validator_carry_over(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    feeds = nations.select(F.col("n_nationkey").alias("id"), F.lit("old").alias("etag"), F.lit("was").alias("last_modified"), F.lit(None).cast("int").alias("last_status"), F.lit(1).cast("long").alias("last_polled_at"))
    status = F.element_at(F.array(F.lit(200), F.lit(304), F.lit(500)), (F.col("n_nationkey") % 3 + 1).cast("int"))
    results = nations.select(F.col("n_nationkey").alias("id"), http.feed_verdict(status).alias("outcome"), F.lit(None).cast("string").alias("etag"), F.lit("new").alias("last_modified"), status.alias("status"), F.lit(5).cast("long").alias("polled_at"))
    return planning.validators(feeds, results, "id")


@query("SELECT count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type IN ('view', 'error')) AS checked FROM events")
def run_report(spark, sf_dir):
    return planning.run_report(observations(spark, sf_dir), "event_type", ("view", "error"))


_CANONICAL = r"""
    p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
    c AS (SELECT page_id, 'https://' || regexp_replace(lower(host), '^((www|m)\.)+', '') || coalesce(nullif(regexp_replace(path, '/$', ''), ''), '/') ||
          CASE WHEN len(k) > 0 THEN '?' || array_to_string(list_sort(k), '&') ELSE '' END AS canonical_url
          FROM (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref=')) AS k FROM p))"""


@query(f"WITH {_CANONICAL} SELECT * FROM c")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query(f"WITH {_CANONICAL} SELECT canonical_url, count(*) AS n, min(page_id) AS first_page FROM c GROUP BY 1")
def url_identity_groups(spark, sf_dir):
    return canonical_urls(spark, sf_dir).groupBy("canonical_url").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages")
def host_buckets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host_bucket(F.col("url")).alias("host"))


@query()
def folded_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.content_hash(F.lit(""), F.split("text", "\n")).alias("content_hash"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("SELECT sha256(html)[1:2] || '/' || sha256(html)[3:4] || '/' || sha256(html) || '.html.gz' AS ref, min(length(html)) AS n FROM pages GROUP BY 1")
def raw_store(spark, sf_dir):
    pages = captures.new_pages(table(spark, sf_dir, "pages").select(F.encode("html", "UTF-8").alias("html")), "html")
    return pages.select("ref", F.length(F.decode("body", "UTF-8")).cast("long").alias("n"))


@query("SELECT o_orderkey, epoch_us(o_orderdate + INTERVAL 1 MINUTE) - 7200000000 AS micros, true AS exact FROM orders")
def normalised_dates(spark, sf_dir):
    written = F.concat(F.date_format("o_orderdate", "d MMM yyyy HH:mm"), F.lit(" +0200"))
    later = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 1 MINUTE"))
    found = later.select("o_orderkey", dates.normalise_date(written, F.lit("2030-01-01").cast("timestamp")).alias("d"))
    return found.select("o_orderkey", F.unix_micros("d.instant").alias("micros"), F.col("d.exact").alias("exact"))


@query(
    """SELECT event_type, verdict, count(*) AS n FROM (SELECT event_type, CASE WHEN user_id % 5 = 0 THEN 'BLOCKED_BY_ROBOTS' WHEN event_type = 'error' THEN 'FAILED' WHEN user_id % 3 = 0 THEN 'SKIPPED_NOT_HTML' ELSE 'FETCHED' END AS verdict
       FROM events) GROUP BY 1, 2"""
)
def fetch_verdicts(spark, sf_dir):
    """Of several reasons the one that fetch_verdict asks for first holds: robots, then a failure, then the body."""
    return verdict_counts(observations(spark, sf_dir))


def verdict_counts(rows):
    body = F.when(F.col("user_id") % 3 == 0, F.unhex(F.lit("89504E470D0A"))).otherwise(F.encode(F.lit("<p>"), "UTF-8"))
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    verdict = http.fetch_verdict(F.col("user_id") % 5 == 0, status, F.lit("Text/HTML; charset=x"), body)
    return rows.select("event_type", verdict.alias("verdict")).groupBy("event_type", "verdict").agg(F.count("*").alias("n"))


@query(
    """SELECT page_id, CASE WHEN ends_with(path, '.html') THEN false WHEN starts_with(path, '/en/1') THEN true WHEN starts_with(path, '/en/') THEN false ELSE true END AS allowed
       FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(url, '(\\?[^#]*)', 1) AS path FROM pages)"""
)
def robots_verdicts(spark, sf_dir):
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/ # English\nAllow: /en/1\nDisallow: *.html$\nDisallow:\nCrawl-delay: 3\n"
    known = robots.rules(spark.createDataFrame([("all", body)], "site string, body string"), "site", "body", "emendata")
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("all").alias("site"), http.request_target(F.col("url")).alias("target"))
    return robots.verdicts(pages, known, "site", "target").select("page_id", "allowed")


@query(
    """WITH v AS (SELECT user_id, event_id, event_type = 'error' AS replaced, CASE WHEN value > 50 THEN 'UTF-8' ELSE 'windows-1252' END AS charset FROM events),
    l AS (SELECT *, lag(replaced) OVER w AS old, lag(charset) OVER w AS was FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, CASE WHEN old IS NULL THEN NULL WHEN old AND NOT replaced THEN 'LOSS_ENDED' WHEN NOT old AND replaced THEN 'LOSS_BEGAN' WHEN old AND was <> charset THEN 'CHARSET_CHANGED' END AS repair FROM l"""
)
def encoding_repairs(spark, sf_dir):
    verdict = F.struct(F.when(F.col("value") > 50, "UTF-8").otherwise("windows-1252").alias("charset"), F.lit("DOCUMENT").alias("source"), (F.col("event_type") == "error").alias("replaced"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", verdict.alias("v"))
    before = F.lag("v").over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("b", before).select("event_id", http.encoding_repair(F.col("b"), F.col("v")).alias("repair"))


@query("SELECT page_id, regexp_replace(replace(replace(replace(replace(regexp_replace(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '\\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS title FROM pages")
def article_titles(spark, sf_dir):
    return whole_pages(spark, sf_dir).select("page_id", articles.article(F.col("html"), F.col("url")).getField("title").alias("title"))


@query()
def extracted_articles(spark, sf_dir):
    found = whole_pages(spark, sf_dir).select("page_id", "url", articles.article(F.col("html"), F.col("url")).alias("a"))
    return found.select(
        "page_id",
        urls.document_identity(F.col("url"), F.col("a.canonical")).alias("identity"),
        F.col("a.title").alias("title"),
        F.size("a.paragraphs").alias("n_paragraphs"),
        F.array_join("a.paragraphs", "\n").alias("body"),
        text.content_hash(F.col("a.title"), F.col("a.paragraphs")).alias("content_hash"),
    )


@query()
def revision_diffs(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("title"), F.split("text", "\n").alias("paragraphs"), "text")
    revisions = versioning.append_if_changed(log, "conv_id", "turn", "text")
    found = diff.diffs_of_revisions(revisions, "conv_id", "title", "paragraphs")
    count = lambda kind: F.size(F.filter("diff.paragraphs", lambda c: c["kind"] == kind)).alias(kind.lower())
    return found.select("conv_id", "from_version", "to_version", count("ADDED"), count("REMOVED"), count("MOVED"), count("CHANGED"), F.col("diff.title").isNotNull().alias("title_changed"), F.col("diff.rewrites").alias("rewrites"), F.to_json("diff").alias("diff"))


def edited_parts(spark, sf_dir):
    """Two revisions of each part: by its key a paragraph is added, removed, moved, or has a word replaced.

    The paragraphs share no words; one is spelt composed before and decomposed after, which is no change.
    """
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    made = lambda words: F.concat(F.lit(words + " "), name)
    a, b, c = made("the council met on monday evening about"), made("roads will be closed until further notice near"), made("critics called that old plan too costly for")
    d, e, edited = F.lit("r\u00e9sum\u00e9 caf\u00e9 of all"), made("nobody was hurt when it happened at"), made("critics called that new plan too costly for")
    spelt, more = F.lit("re\u0301sume\u0301 cafe\u0301 of all"), made("officials added one more sentence after")
    after = F.when(kind == 0, F.array(a, b, c, spelt, e, more)).when(kind == 1, F.array(a, c, spelt, e)).when(kind == 2, F.array(b, c, spelt, e, a)).otherwise(F.array(a, b, edited, spelt, e))
    parts = table(spark, sf_dir, "part")
    title = F.when(kind == 3, F.lit("After")).otherwise(F.lit("Before"))
    rows = parts.select("p_partkey", F.lit(1).alias("version_number"), F.lit("Before").alias("title"), F.array(a, b, c, d, e).alias("paragraphs"))
    rows = rows.unionByName(parts.select("p_partkey", F.lit(2).alias("version_number"), title.alias("title"), after.alias("paragraphs")))
    return diff.diffs_of_revisions(rows, "p_partkey", "title", "paragraphs")


@query(
    """SELECT p_partkey, (p_partkey % 4 = 0)::INT AS added, (p_partkey % 4 = 1)::INT AS removed, (p_partkey % 4 = 2)::INT AS moved, (p_partkey % 4 = 3)::INT AS changed,
       p_partkey % 4 = 3 AS title_changed FROM part"""
)
def edit_kinds(spark, sf_dir):
    count = lambda kind: F.size(F.filter("diff.paragraphs", lambda c: c["kind"] == kind)).alias(kind.lower())
    return edited_parts(spark, sf_dir).select("p_partkey", count("ADDED"), count("REMOVED"), count("MOVED"), count("CHANGED"), F.col("diff.title").isNotNull().alias("title_changed"))


@query("SELECT p_partkey, 'critics called that old plan too costly for ' || p_name AS from_text, 'old' AS removed_words, 'new' AS added_words, 2 AS from_index, 2 AS to_index FROM part WHERE p_partkey % 4 = 3")
def marked_words(spark, sf_dir):
    rows = edited_parts(spark, sf_dir).select("p_partkey", F.explode("diff.paragraphs").alias("c")).filter("c.kind = 'CHANGED'")
    marked = rows.select("p_partkey", "c", diff.word_markup(F.col("c.from_text"), F.col("c.to_text"), F.col("c.words")).alias("m"))
    shown = lambda side: F.trim(F.array_join(F.transform(F.filter(side, lambda x: x["marked"]), lambda x: x["text"]), " "))
    return marked.select("p_partkey", F.col("c.from_text").alias("from_text"), shown("m.before").alias("removed_words"), shown("m.after").alias("added_words"), F.col("c.from_index").alias("from_index"), F.col("c.to_index").alias("to_index"))


@query(
    """SELECT page_id, ['UTF-8', 'UTF-8', 'UTF-16BE', 'UTF-8'][page_id % 4 + 1] AS charset, ['HTTP_HEADER', 'BOM', 'BOM', 'DOCUMENT'][page_id % 4 + 1] AS source,
       false AS replaced, [0, 1, 1, 1][page_id % 4 + 1] AS n_warnings, md5(html) AS hash FROM pages"""
)
def decoded_pages(spark, sf_dir):
    """Pages as bytes: by the header's word, by their mark against the header's, by their mark against their own word, and by that word after an unknown one."""
    pages, kind = table(spark, sf_dir, "pages"), F.col("page_id") % 4
    plain = F.encode("html", "UTF-8")
    body = F.when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(kind == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("html", "UTF-16BE"))).otherwise(plain)
    header = F.when(kind == 0, "text/html; charset=utf-8").when(kind == 1, "text/html; charset=latin1").when(kind == 3, "text/html; charset=undefined")
    found = pages.select("page_id", encoding.decoded(body, header).alias("d"))
    return found.select("page_id", "d.charset", "d.source", "d.replaced", F.size("d.warnings").alias("n_warnings"), F.md5("d.text").alias("hash"))


@query(
    """SELECT page_id // 10 AS feed, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS slot, 'Page ' || page_id || ' & more <i>' AS title, url AS link,
       'rss_2.0' AS feed_type, 'a &nbsp; b' AS summary FROM pages"""
)
def feed_entries(spark, sf_dir):
    """Feeds of ten pages each, written with the liberties that feeds take: bare ampersands, names of HTML, stray end tags."""
    title = F.concat(F.lit("<title>Page "), F.col("page_id"), F.lit(" & more &lt;i&#62;</title></b>"))
    item = F.concat(F.lit("<item>"), title, F.lit("<link>"), "url", F.lit("</link><description><![CDATA[a &nbsp; b]]></description></item>"))
    feeds_ = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 10).alias("feed")).agg(F.sort_array(F.collect_list(F.struct("page_id", item.alias("item")))).alias("i"))
    body = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel>'), F.array_join("i.item", ""), F.lit("</channel></rss>"))
    read = feeds_.select("feed", feeds.parsed_feed(body).alias("f"))
    rows = read.select("feed", F.col("f.feed_type").alias("feed_type"), F.posexplode("f.entries").alias("slot", "e"))
    return rows.select("feed", "slot", F.col("e.title").alias("title"), F.col("e.link").alias("link"), "feed_type", F.col("e.summary").alias("summary"))


@query(
    """SELECT n_nationkey, ['text/html', 'application/pdf', '', 'TEXT/HTML; charset=x', 'image/png', 'application/octet-stream'][n_nationkey % 6 + 1] AS content_type,
       [true, false, true, true, false, true][n_nationkey % 6 + 1] AS may_be_html, ['PDF', 'PNG', NULL, 'gzip', 'ISO media (mp4)', 'JPEG', NULL][n_nationkey % 7 + 1] AS format,
       [NULL, NULL, 'UTF-8', NULL, NULL, NULL, 'UTF-16LE'][n_nationkey % 7 + 1] AS mark FROM nation"""
)
def html_gates(spark, sf_dir):
    key = F.col("n_nationkey")
    types = F.array(*map(F.lit, ("text/html", "application/pdf", "", "TEXT/HTML; charset=x", "image/png", "application/octet-stream")))
    heads = F.array(*map(F.lit, ("255044462D31", "89504E470D0A", "EFBBBF3C70", "1F8B0800", "0000002066747970", "FFD8FFE0", "FFFE3C00")))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.get(types, (key % 6).cast("int")).alias("content_type"), F.unhex(F.get(heads, (key % 7).cast("int"))).alias("body"))
    return rows.select("n_nationkey", "content_type", http.may_be_html(F.col("content_type")).alias("may_be_html"), http.binary_format(F.col("body")).alias("format"), http.byte_order_mark(F.col("body")).alias("mark"))


@query(
    """WITH f AS (SELECT page_id, url FROM pages WHERE page_id % 3 = 0), r AS (SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM f) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
    SELECT page_id, url, 0 AS part FROM f UNION ALL SELECT page_id, url, 1 FROM r"""
)
def run_candidates(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    offered = pages.filter("page_id % 3 = 0")
    return planning.candidates(offered, versioning.not_planned(pages, offered, "url", "page_id"), "page_id")


@query(
    """WITH f AS (SELECT user_id % 5 AS origin, ts, event_id FROM events WHERE event_id % 50 = 0), q AS (SELECT event_id, user_id % 5 AS origin, ts FROM events)
    SELECT q.event_id, CASE WHEN q.ts < f.ts + INTERVAL 6 HOUR THEN f.event_id END AS rules FROM q LEFT JOIN f ON f.origin = q.origin AND f.ts <= q.ts
    QUALIFY row_number() OVER (PARTITION BY q.event_id ORDER BY f.ts DESC NULLS LAST) = 1"""
)
def robots_cache(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("origin"), "ts")
    fetches = log.filter("event_id % 50 = 0").select("origin", F.col("ts").alias("fetched_at"), F.col("event_id").alias("rules"))
    return robots.cached_at(log, fetches, "origin", "ts", "fetched_at", ["rules"], "6 HOURS").select("event_id", "rules")


@query(
    """WITH t AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, role, n AS since_version, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS title_number FROM t WHERE n = 1 OR before IS DISTINCT FROM role"""
)
def title_history(spark, sf_dir):
    log = versioning.renumbered(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn").select("conv_id", "version_number", "role")
    return versioning.title_history(log, "conv_id", "role")


def one_of(values, key):
    """The value at the place that ``key`` (a column from 0) names."""
    return F.get(F.array(*map(F.lit, values)), key.cast("int"))


@query(
    """SELECT o_orderkey, ['Updated <time> by ', 'id <id> of ', 'see <id> now ', 'ref <id> in ', 'written 3 weeks ago by ', 'seen <time> <id> ', ''][o_orderkey % 7 + 1] || o_orderpriority AS folded FROM orders"""
)
def masked_texts(spark, sf_dir):
    """Relative times up to days, UUIDs, assigned identifiers and opaque tokens are masked, at the edges to nothing; weeks are text."""
    said = ("Updated vor 3 Stunden by ", "id 123e4567-E89B-12d3-a456-426614174000 of ", "see ad-session = ab12cd34 now ", "ref abcdef_ghijkl123456 in ")
    made = one_of((*said, "written 3 weeks  ago by ", "seen About 5 minutes ago utm_source=mail ", "token: abc "), F.col("o_orderkey") % 7)
    folded = text.fold(F.concat(made, F.col("o_orderpriority")))
    shown = F.replace(F.replace(folded, F.lit(text.RELATIVE_TIME), F.lit("<time>")), F.lit(text.IDENTIFIER), F.lit("<id>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("folded"))


@query(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://my_host.example.com/a' || page_id WHEN 1 THEN 'https://example.com/a' || page_id || '?page=2'
       WHEN 2 THEN 'https://example.com/a' || page_id || '.html' WHEN 3 THEN 'https://example.com/a' || page_id || '?m=2' WHEN 4 THEN 'mailto:desk' || page_id || '@example.com'
       ELSE 'https://example.com/b' || page_id || '?q=%C3%A9' END AS identity FROM pages"""
)
def url_variants(spark, sf_dir):
    """Hosts with an underscore, cached, mobile and other renditions, credentials and dot segments; what is no URL stays."""
    heads = ("http://my_host.example.com:8080/a", "https://x-example-com.cdn.ampproject.org/c/s/www.example.com/a", "https://example.com/m/amp/a", "https://example.com/a")
    tails = ("", "?page=2", ".amp.html", "?outputType=AMP&mobile=true&m=2&amp", "@example.com", "?q=%c3%a9#x")
    kind = F.col("page_id") % 6
    url = F.concat(one_of((*heads, "mailto:desk", "HTTPS://user:pw@EXAMPLE.com:443/a/../b"), kind), F.col("page_id"), one_of(tails, kind))
    return table(spark, sf_dir, "pages").withColumn("url", url).select("page_id", urls.provisional_identity(F.col("url")).alias("identity"))


@query(
    f"""WITH {_CANONICAL} SELECT page_id, CASE WHEN page_id % 3 = 1 THEN regexp_extract(canonical_url, '^https://[^/]*') || '/story/' || page_id ELSE canonical_url END AS identity FROM c"""
)
def declared_identities(spark, sf_dir):
    """Pages that declare nothing, a relative address, or the root of their site, which is not believed."""
    kind = F.col("page_id") % 3
    link = F.concat(F.lit('<head><link rel="alternate Canonical" href="'), F.when(kind == 1, F.concat(F.lit("/story/"), "page_id", F.lit("?utm_source=x"))).otherwise("/"), F.lit('">'))
    html = F.when(kind == 0, F.col("html")).otherwise(F.replace(F.col("html"), F.lit("<head>"), link))
    found = whole_pages(spark, sf_dir).select("page_id", "url", articles.article(html, F.col("url")).getField("canonical").alias("declared"))
    return found.select("page_id", urls.document_identity(F.col("url"), F.col("declared")).alias("identity"))


_LABELS = ", ".join(f"'{x}'" for x in sorted(articles.LABELS))


@query(
    f"""WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(html, '<h1>(.*)</article>', 1, 's'), '<p>')) AS x, generate_subscripts(string_split(regexp_extract(html, '<h1>(.*)</article>', 1, 's'), '<p>'), 1) AS i FROM pages),
    t AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS x FROM p),
    k AS (SELECT t.page_id, t.i, t.x FROM t JOIN t h ON h.page_id = t.page_id AND h.i = 1 WHERE t.i > 1 AND t.x <> h.x AND lower(trim(t.x, '.,:;!?-*# ')) NOT IN ({_LABELS}) AND (length(t.x) >= 30 OR (length(t.x) >= 8 AND strpos(t.x, ' ') > 0 AND regexp_matches(t.x, '[.!?…]$'))))
    SELECT page_id, count(x)::INT AS n_paragraphs, coalesce(string_agg(x, chr(10) ORDER BY i), '') AS body FROM pages LEFT JOIN k USING (page_id) GROUP BY 1"""
)
def article_bodies(spark, sf_dir):
    """The prose of each page: not its navigation, advertisement, scripts or footer, nor its headline again or scraps."""
    found = whole_pages(spark, sf_dir).select("page_id", articles.article(F.col("html"), F.col("url")).getField("paragraphs").alias("p"))
    return found.select("page_id", F.size("p").alias("n_paragraphs"), F.array_join("p", "\n").alias("body"))


@query(
    """WITH s AS (SELECT n_nationkey, [200, 204, 301, 404, 429, 503, NULL][n_nationkey % 7 + 1] AS status, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey * 5.0::DOUBLE END AS asked FROM nation)
    SELECT n_nationkey, CASE WHEN status IN (200, 204) THEN 'PARSE' WHEN status IN (404, 429) THEN 'ALLOW' ELSE 'DENY' END AS access, status IS NULL OR status = 503 AS again,
    greatest(10, least(coalesce(asked, 10), 60))::DOUBLE AS gap FROM s"""
)
def robots_policies(spark, sf_dir):
    status, key = one_of((200, 204, 301, 404, 429, 503, None), F.col("n_nationkey") % 7), F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", status.alias("status"), F.when(key % 4 > 0, key * 5.0).alias("asked"))
    gap = http.crawl_gap(F.col("asked"), 10.0, 60.0)
    return rows.select("n_nationkey", http.robots_access(F.col("status")).alias("access"), http.retried(F.col("status"), F.lit(None)).alias("again"), gap.alias("gap"))


@query(
    """SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || CASE WHEN page_id % 2 = 0 THEN ':8080' ELSE '' END AS origin, 'bot' || page_id AS token FROM pages"""
)
def request_origins(spark, sf_dir):
    """Origins of addresses with ports and credentials, and the name an agent goes by in robots files."""
    port = F.when(F.col("page_id") % 2 == 0, ":8080/").otherwise("/")
    url = F.concat(F.regexp_extract("url", "^([a-z]+://)", 1), F.lit("me:pw@"), F.upper(F.regexp_extract("url", "://([^/?#]*)", 1)), port)
    agent = F.concat(F.lit("bot"), "page_id", F.lit("/1.0 (+https://example.org)"))
    return table(spark, sf_dir, "pages").select("page_id", http.origin(url).alias("origin"), http.product_token(agent).alias("token"))


@query(
    f"""WITH {REVISIONS} SELECT event_id, CASE WHEN is_new AND version_number = 1 THEN 'NEW' WHEN is_new THEN 'CHANGED' ELSE 'UNCHANGED' END AS outcome FROM v"""
)
def ingest_outcomes(spark, sf_dir):
    found = versioning.store_verdicts(observations(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")
    return found.select("event_id", versioning.ingest_outcome(F.col("previous_version").isNull(), F.col("outcome")).alias("outcome"))


@query(f"WITH {REVISIONS} SELECT user_id, version_number FROM r WHERE event_type = 'error'")
def lossy_revisions(spark, sf_dir):
    """Revisions decoded with loss."""
    rows = event_revisions(spark, sf_dir).withColumn("encoding", F.struct((F.col("event_type") == "error").alias("replaced")))
    return versioning.replaced_versions(rows).select("user_id", "version_number")


@query(
    """WITH c AS (SELECT list(n ORDER BY i) AS f FROM (SELECT i, count(event_id) AS n FROM range(3) t(i) LEFT JOIN events ON user_id % 3 = i GROUP BY 1)),
    d AS (SELECT list(n ORDER BY i) AS a FROM (SELECT i, count(event_id) AS n FROM range(8) t(i) LEFT JOIN events ON event_id % 8 = i GROUP BY 1))
    SELECT format('{{"feeds":{{"fetched":{},"not_modified":{},"failed":{}}},"articles":{{"new":{},"changed":{},"unchanged":{},"skipped":{},"failed":{},"deferred":{},"abandoned":{},"not_due":{},"checked":{},"replaced":{}}}}}',
      f[1], f[2], f[3], a[1], a[2], a[3], a[4], a[5], a[6], a[7], a[8], (SELECT count(*) FROM events), (SELECT count(*) FROM events WHERE value > 50)) AS response FROM c, d"""
)
def run_responses(spark, sf_dir):
    """What a run answers: feeds and articles by outcome, and the texts decoded with loss."""
    log = table(spark, sf_dir, "events")
    polled = log.select(one_of(reports.FEED_OUTCOMES, F.col("user_id") % 3).alias("outcome"))
    checked = log.select(one_of(reports.ARTICLE_OUTCOMES, F.col("event_id") % 8).alias("outcome"), "value")
    return reports.run_response(polled, checked, F.col("value") > 50)


@query(
    """SELECT conv_id, format('{{"conv_id":{},"turn":{},"paragraph_count":{}}}', conv_id, turn, len(string_split(text, chr(10)))) AS response FROM conversations"""
)
def listing_responses(spark, sf_dir):
    """Rows of a listing with the number of paragraphs in place of the paragraphs."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("paragraphs"))
    return reports.changed_response(rows, "conv_id", "paragraphs")


@query(
    """WITH v AS (SELECT user_id, event_id, event_type = 'error' AS lossy, CASE WHEN value > 50 THEN 'UTF-8' ELSE 'windows-1252' END AS charset FROM events),
    s AS (SELECT *, charset || ' (document declaration)' || CASE WHEN lossy THEN ', with replacement characters' ELSE '' END AS said FROM v),
    l AS (SELECT *, lag(lossy) OVER w AS old, lag(charset) OVER w AS was, lag(said) OVER w AS told FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, 'Decoding changed: ' || CASE WHEN old AND NOT lossy THEN 'the earlier text was decoded with replacement characters, the later was not'
      WHEN NOT old AND lossy THEN 'the earlier text was decoded cleanly, the later needed replacement characters'
      WHEN old AND was <> charset THEN 'both texts needed replacement characters, under different charsets' END || '. Now ' || said || ', before ' || told || '.' AS rationale FROM l"""
)
def repair_rationales(spark, sf_dir):
    """The sentence that explains a difference by its decoding."""
    verdict = F.struct(F.when(F.col("value") > 50, "UTF-8").otherwise("windows-1252").alias("charset"), F.lit("DOCUMENT").alias("source"), (F.col("event_type") == "error").alias("replaced"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", verdict.alias("v"))
    before = F.lag("v").over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("b", before).select("event_id", http.encoding_rationale(F.col("b"), F.col("v")).alias("rationale"))


@query("SELECT event_id, 0 AS part, event_type FROM events UNION ALL SELECT o_orderkey, 1, NULL FROM orders")
def run_results(spark, sf_dir):
    """Results of feeds, then of documents looked at again, which lack the feeds' columns."""
    again = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    return reports.all_results(table(spark, sf_dir, "events").select("event_id", "event_type"), again)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey <> 2")
def active_feeds(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("https://"), F.lower("n_name")).alias("url"), (F.col("n_regionkey") != 2).alias("active"))
    return feeds.feed_options(feeds.active_feeds(rows))
