"""What to look at again: decaying re-check intervals, per-host ceilings, attempt budgets, credibility of claims."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR = 3600
INT_MAX = 2_147_483_647


@dataclass(frozen=True)
class RecheckPolicy:
    """Durations in seconds."""

    min_interval: int = 10 * 60
    max_interval: int = 12 * HOUR
    age_factor: float = 0.25
    window: int = 7 * 24 * HOUR
    max_window_factor: int = 4
    requests_per_hour: int = 120
    max_unconfirmed_claims: int = 20

    def __post_init__(self):
        if min(self.min_interval, self.max_interval, self.window) <= 0:
            raise ValueError("durations must be positive")
        if self.max_interval < self.min_interval:
            raise ValueError("max_interval is shorter than min_interval")
        if not (math.isfinite(self.age_factor) and self.age_factor > 0):
            raise ValueError("age_factor must be finite and positive")
        if min(self.max_window_factor, self.requests_per_hour, self.max_unconfirmed_claims) < 1:
            raise ValueError("factors and ceilings must be 1 or more")

    # Columns of a state: host, first_seen, last_checked, last_changed, version_count, feed_updated, feed_updated_exact,
    # unconfirmed_claims; times are epoch seconds, last_checked is null for what was never seen.

    def last_event(self) -> Column:
        return F.greatest("first_seen", "last_changed")

    def interval(self, now: Column) -> Column:
        age = F.greatest(F.lit(0), now - self.last_event())
        return F.greatest(F.lit(self.min_interval), F.least(F.lit(self.max_interval), F.floor(age * F.lit(self.age_factor))))

    def watched_for(self) -> Column:
        changes = F.greatest(F.lit(0), F.col("version_count") - 1)
        return F.lit(self.window) * F.least(1 + changes, F.lit(self.max_window_factor))

    def claims_an_edit(self) -> Column:
        return F.coalesce(F.col("feed_updated_exact") & (F.col("feed_updated") > F.col("last_checked")), F.lit(False))

    def believed(self) -> Column:
        return self.claims_an_edit() & (F.col("unconfirmed_claims") < self.max_unconfirmed_claims)

    def decision(self, now: Column) -> Column:
        """DUE, WAITING or RETIRED of a state by itself."""
        return (
            F.when(F.col("last_checked").isNull(), "DUE")
            .when(self.believed(), "DUE")
            .when(now - self.last_event() > self.watched_for(), "RETIRED")
            .when(now - F.col("last_checked") >= self.interval(now), "DUE")
            .otherwise("WAITING")
        )

    def plan(self, states: DataFrame, now: int, pos: str = "pos") -> DataFrame:
        """``states`` with decision; DUE becomes THROTTLED beyond what the host may still be asked this hour.

        Every candidate checked in the last hour counts against its host, whatever becomes of it. What is due is
        granted in order of the last check, never seen first, then by ``pos``.
        """
        at = F.lit(now)
        host = Window.partitionBy("host")
        decided = states.withColumn("_d", self.decision(at))
        decided = decided.withColumn("_spent", F.sum((F.coalesce(F.col("last_checked") > at - HOUR, F.lit(False))).cast("long")).over(host))
        turn = F.row_number().over(Window.partitionBy("host", "_d").orderBy(F.col("last_checked").asc_nulls_first(), pos))
        over = (F.col("_d") == "DUE") & (F.col("_spent") + turn > self.requests_per_hour)
        return decided.withColumn("decision", F.when(over, "THROTTLED").otherwise(F.col("_d"))).drop("_d", "_spent")

    def possibly_due(self, documents: DataFrame, now: int, limit: int = 500, doc: str = "doc") -> DataFrame:
        """A coarse choice before the policy: not checked within the shortest interval and still inside a window."""
        event, checked = self.last_event(), F.col("last_checked")
        stable, widest = now - self.window, now - self.window * self.max_window_factor
        open_ = (event > stable) | ((F.col("version_count") > 1) & (event > widest))
        return documents.filter((checked < now - self.min_interval) & open_).orderBy(checked, doc).limit(limit)


def sound_states(states: DataFrame) -> DataFrame:
    """States a policy may be asked about: a host, no negative counts, a history only where there was a check."""
    seen = F.col("last_checked").isNotNull()
    fresh = F.col("last_changed").isNull() & (F.coalesce("version_count", F.lit(0)) == 0)
    counts = (F.coalesce("version_count", F.lit(0)) >= 0) & (F.coalesce("unconfirmed_claims", F.lit(0)) >= 0)
    return states.filter(F.col("host").isNotNull() & (F.trim("host") != "") & counts & (seen | fresh))


@dataclass(frozen=True)
class ArticleBudget:
    max_articles: int = 50
    max_failures: int = 5

    def __post_init__(self):
        if self.max_articles < 1 or self.max_failures < 1:
            raise ValueError("both limits must be 1 or more")

    def admit(self, histories: DataFrame, pos: str = "pos") -> DataFrame:
        """``histories`` (last_attempt_at, failure_count) with admission.

        Too many failures: ABANDONED, which uses up nothing. Of the rest those waiting longest are ADMITTED, never
        tried first, as many as the budget has; the others are DEFERRED. The choice is a bounded sort, not a global rank.
        """
        given_up = F.col("failure_count") >= self.max_failures
        chosen = histories.filter(~given_up).orderBy(F.col("last_attempt_at").asc_nulls_first(), pos).limit(self.max_articles)
        chosen = F.broadcast(chosen.select(F.col(pos).alias("_pos")))  # max_articles rows at most
        joined = histories.join(chosen, F.col(pos) == F.col("_pos"), "left")
        verdict = F.when(given_up, "ABANDONED").when(F.col("_pos").isNotNull(), "ADMITTED").otherwise("DEFERRED")
        return joined.withColumn("admission", verdict).drop("_pos")


def attempt_strikes(attempts: DataFrame, link: str, order: list[str], failed: Column, at: str) -> DataFrame:
    """Per link last_attempt_at and failure_count, the failures since the last success."""
    by = Window.partitionBy(link).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = attempts.withColumn("_f", failed).withColumn("_ok", F.sum((~F.col("_f")).cast("long")).over(by))
    return after.groupBy(link).agg(F.max(at).alias("last_attempt_at"), F.count_if(F.col("_ok") == 0).alias("failure_count"))


def histories_of(wanted: DataFrame, strikes: DataFrame, link: str) -> DataFrame:
    """The attempt history of each wanted link; what was never tried has no failures."""
    return wanted.join(strikes, link, "left").withColumn("failure_count", F.coalesce("failure_count", F.lit(0)))


def claim_tally(results: DataFrame, feed: str, claimed: Column, outcome: str) -> DataFrame:
    """Per feed: fetches made under a standing claim of an edit, and how many of them confirmed it."""
    counted = results.filter(claimed & F.col(outcome).isin("CHANGED", "UNCHANGED"))
    return counted.groupBy(feed).agg(F.count("*").alias("fetches"), F.count_if(F.col(outcome) == "CHANGED").alias("confirmed"))


def claim_strikes(feeds: DataFrame, tally: DataFrame, feed: str, strikes: str = "unconfirmed_claims") -> DataFrame:
    """Strikes after a run: any confirmation forgives all, else the fetches add up, and stop at the largest int."""
    joined = feeds.join(tally.select(F.col(feed).alias("_feed"), "fetches", "confirmed"), F.col(feed) == F.col("_feed"), "left")
    old, new = F.coalesce(F.col(strikes), F.lit(0)).cast("long"), F.coalesce("fetches", F.lit(0))
    after = F.when(F.col("confirmed") > 0, F.lit(0)).otherwise(F.least(old + new, F.lit(INT_MAX)))
    return joined.withColumn(strikes, after.cast("int")).drop("_feed", "fetches", "confirmed")


def first_link_wins(entries: DataFrame, link: str, order: list[str]) -> DataFrame:
    """Entries with duplicate: whether an earlier entry of the run had the same link, spaces around it aside."""
    key = F.trim(F.col(link))
    return entries.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def run_report(results: DataFrame, outcome: str, outcomes: tuple[str, ...]) -> DataFrame:
    """One row: how many results had each outcome, and checked, their sum."""
    counts = [F.count_if(F.col(outcome) == o).alias(o.lower()) for o in outcomes]
    return results.agg(*counts, F.count_if(F.col(outcome).isin(*outcomes)).alias("checked"))


def validators(feeds: DataFrame, results: DataFrame, feed: str) -> DataFrame:
    """Feed state after a poll: results have feed, outcome, etag, last_modified, status, polled_at.

    A fetch replaces both validators, even by nothing; not modified replaces those it names; a failure keeps both.
    Status and time are always written.
    """
    new = results.select(F.col(feed).alias("_f"), "outcome", *[F.col(c).alias(f"_{c}") for c in ("etag", "last_modified", "status", "polled_at")])
    joined = feeds.join(new, F.col(feed) == F.col("_f"), "left")

    def kept(c: str) -> Column:
        return F.when(F.col("outcome") == "FETCHED", F.col(f"_{c}")).when(F.col("outcome") == "NOT_MODIFIED", F.coalesce(f"_{c}", c)).otherwise(F.col(c))

    polled = F.col("_f").isNotNull()
    return joined.select(
        *[F.col(c) for c in feeds.columns if c not in ("etag", "last_modified", "last_status", "last_polled_at")],
        kept("etag").alias("etag"),
        kept("last_modified").alias("last_modified"),
        F.when(polled, F.col("_status")).otherwise(F.col("last_status")).alias("last_status"),
        F.when(polled, F.col("_polled_at")).otherwise(F.col("last_polled_at")).alias("last_polled_at"),
    )


def sync_catalogue(feeds: DataFrame, listed: DataFrame) -> DataFrame:
    """Additive upsert by url: url, name, change ('added', 'renamed' or 'kept'). Feeds not listed stay; nothing is deleted."""
    old, new = feeds.select("url", F.col("name").alias("_old")), listed.select("url", F.col("name").alias("_new"))
    joined = old.join(new, "url", "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNotNull() & (F.col("_new") != F.col("_old")), "renamed").otherwise("kept")
    return joined.select("url", F.coalesce("_new", "_old").alias("name"), change.alias("change"))


def polite_schedule(requests: DataFrame, host: str, arrive: str, seconds: str, gap: float) -> DataFrame:
    """Start times under a rate limit per host: the gap counts from the end of the call before.

    start_i = max(arrive_i, end_(i-1) + gap), unrolled: the latest of arrive_j plus all that is spent from j to i.
    """
    by = Window.partitionBy(host).orderBy(arrive).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.col(seconds) + gap).over(by), F.lit(0.0))
    upto = Window.partitionBy(host).orderBy(arrive).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return requests.withColumn("_s", spent).withColumn("start", F.max(F.col(arrive) - F.col("_s")).over(upto) + F.col("_s")).drop("_s")


def candidates(from_feeds: DataFrame, rechecks: DataFrame, position: str) -> DataFrame:
    """Everything a run may fetch: what the feeds offer, then the stored documents they no longer carry.

    The order is (part, position), part being 0 for feeds and 1 for re-checks, so that nothing has to be numbered
    through; columns of one side only are null on the other.
    """
    first, then = from_feeds.withColumn("part", F.lit(0)), rechecks.withColumn("part", F.lit(1))
    if position not in first.columns or position not in then.columns:
        raise ValueError(f"both sides need the column {position}")
    return first.unionByName(then, allowMissingColumns=True)
