"""Keyed history over a log of observations: a revision exists only where the content really changed.

Observations have a document key, an order and a content (or its hash). Comparing each observation with the one before
it is the same as comparing it with the newest revision, because unchanged observations carry the newest one's hash;
so one window per document does it, and equal content that returns later is a revision again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_LISTED = 200


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def store_verdicts(observations: DataFrame, doc: str, order: str | Sequence[str], content: str) -> DataFrame:
    """Every observation with outcome (APPENDED or UNCHANGED), version_number and previous_version (null for the first)."""
    by = Window.partitionBy(doc).orderBy(*_columns(order))
    before = F.lag(content).over(by)
    first = F.row_number().over(by) == 1
    marked = observations.withColumn("_new", first | ~F.col(content).eqNullSafe(before))
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("version_number", F.sum(F.col("_new").cast("long")).over(upto))
    return numbered.select(
        *[F.col(c) for c in observations.columns],
        F.when(F.col("_new"), "APPENDED").otherwise("UNCHANGED").alias("outcome"),
        "version_number",
        F.when(F.col("_new"), F.col("version_number") - 1).otherwise(F.col("version_number")).alias("_p"),
    ).withColumn("previous_version", F.when(F.col("_p") > 0, F.col("_p"))).drop("_p")


def append_if_changed(observations: DataFrame, doc: str, order: str | Sequence[str], content: str) -> DataFrame:
    """The revisions: observations that differ from the newest revision, with version_number from 1."""
    return store_verdicts(observations, doc, order, content).filter("outcome = 'APPENDED'").drop("outcome", "previous_version")


def merge_revisions(stored: DataFrame, observations: DataFrame, doc: str, order: str, content: str) -> DataFrame:
    """New revisions of a later batch: the newest stored revision per document stands before its observations.

    ``stored`` has doc, order, content and version_number. Only the newest row of each document is shuffled again.
    """
    newest = latest(stored, doc).select(doc, order, content, F.col("version_number").alias("_base"))
    both = newest.withColumn("_old", F.lit(True)).unionByName(
        observations.select(doc, order, content, F.lit(None).cast("long").alias("_base")).withColumn("_old", F.lit(False))
    )
    by = Window.partitionBy(doc).orderBy(F.col("_old").desc(), order)
    changed = F.when(F.col("_old"), False).otherwise((F.row_number().over(by) == 1) | ~F.col(content).eqNullSafe(F.lag(content).over(by)))
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = both.withColumn("_new", changed).withColumn(
        "version_number", F.coalesce(F.max("_base").over(upto), F.lit(0)) + F.sum(F.col("_new").cast("long")).over(upto)
    )
    return numbered.filter("_new").select(doc, order, content, "version_number")


def counters(revisions: DataFrame, doc: str, at: str) -> DataFrame:
    """version_count and last_changed_at, which is null until there is a second revision."""
    return revisions.groupBy(doc).agg(
        F.max("version_number").alias("version_count"),
        F.max(F.when(F.col("version_number") > 1, F.col(at))).alias("last_changed_at"),
    )


def register(sightings: DataFrame, identity: str, at: str, feed: str, origin: str, order: str) -> DataFrame:
    """One document per identity: first feed, first non-null origin in order, first_seen_at, last_checked_at."""
    return sightings.groupBy(identity).agg(
        F.min_by(feed, order).alias("feed_id"),
        F.min_by(F.col(origin), F.when(F.col(origin).isNotNull(), F.col(order))).alias("observed_origin"),
        F.min_by(at, order).alias("first_seen_at"),
        F.max_by(at, order).alias("last_checked_at"),
    )


def ingest_outcome(created: Column, outcome: Column) -> Column:
    """NEW for a document just made, CHANGED for an appended revision, else UNCHANGED."""
    return F.when(created, "NEW").when(outcome == "APPENDED", "CHANGED").otherwise("UNCHANGED")


def history(revisions: DataFrame, doc: str, key) -> DataFrame:
    return revisions.filter(F.col(doc) == F.lit(key)).orderBy("version_number")


def version(revisions: DataFrame, doc: str, key, number: int) -> DataFrame:
    return revisions.filter((F.col(doc) == F.lit(key)) & (F.col("version_number") == number))


def latest(revisions: DataFrame, doc: str) -> DataFrame:
    """The newest revision of each document, by one aggregation."""
    row = F.struct("version_number", F.struct(*revisions.columns).alias("row"))
    return revisions.groupBy(F.col(doc).alias("_doc")).agg(F.max_by(row, "version_number").alias("_m")).select("_m.row.*")


def as_of(revisions: DataFrame, doc: str, at: str, instant) -> DataFrame:
    """Per document the newest revision observed at ``instant`` or before; of equal times the higher version."""
    row = F.struct(*revisions.columns)
    seen = revisions.filter(F.col(at) <= F.lit(instant))
    return seen.groupBy(F.col(doc).alias("_doc")).agg(F.max_by(row, F.struct(at, "version_number")).alias("row")).select("row.*")


def as_of_join(questions: DataFrame, revisions: DataFrame, doc: str, q_at: str, r_at: str, take: Sequence[str]) -> DataFrame:
    """Each question with the columns ``take`` of its document's revision as of its time, null where there was none.

    Union and running last value instead of a range join: one shuffle on the document, no pairs.
    """
    nothing = [F.lit(None).cast(revisions.schema[c].dataType).alias(c) for c in take]
    asked = F.struct(*questions.columns)
    left = questions.select(F.col(doc), F.col(q_at).alias("_t"), F.lit(None).cast("long").alias("_v"), asked.alias("_q"), *[n.alias(f"_{c}") for n, c in zip(nothing, take, strict=True)])
    right = revisions.select(F.col(doc), F.col(r_at).alias("_t"), F.col("version_number").cast("long").alias("_v"), F.lit(None).cast(left.schema["_q"].dataType).alias("_q"), *[F.col(c).alias(f"_{c}") for c in take])
    # At one time revisions stand before questions, the higher version last.
    by = Window.partitionBy(doc).orderBy("_t", F.col("_q").isNotNull(), "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = F.last(F.when(F.col("_q").isNull(), F.struct(*[F.col(f"_{c}").alias(c) for c in take])), ignorenulls=True).over(by)
    found = left.unionByName(right).withColumn("_r", picked).filter(F.col("_q").isNotNull())
    return found.select("_q.*", *[F.col("_r").getField(c).alias(c) for c in take])


def reverts(revisions: DataFrame, doc: str, content: str) -> DataFrame:
    """Revisions whose content the document has had before, with the first version that had it."""
    first = F.min("version_number").over(Window.partitionBy(doc, content))
    return revisions.withColumn("first_version", first).filter("first_version < version_number")


def replaced_versions(revisions: DataFrame) -> DataFrame:
    """Revisions that were decoded with replacement characters; an unrecorded encoding is not one of them."""
    return revisions.filter(F.col("encoding.replaced"))


def renumbered(rows: DataFrame, doc: str, at: str, tie: str) -> DataFrame:
    """version_number by time, ties by ``tie``: the numbering that a store without numbers gets."""
    return rows.withColumn("version_number", F.row_number().over(Window.partitionBy(doc).orderBy(at, tie)).cast("long"))


def revision_pairs(revisions: DataFrame, doc: str, columns: Sequence[str]) -> DataFrame:
    """Adjacent revisions side by side: from_version, to_version, current, from_ and to_ of each column; newest first."""
    by = Window.partitionBy(doc).orderBy("version_number")
    row = F.struct("version_number", *columns)
    paired = revisions.withColumn("_from", F.lag(row).over(by)).withColumn("_top", F.lead("version_number").over(by).isNull())
    paired = paired.filter(F.col("_from").isNotNull())
    sides = [x for c in columns for x in (F.col(f"_from.{c}").alias(f"from_{c}"), F.col(c).alias(f"to_{c}"))]
    return paired.select(
        doc, F.col("_from.version_number").alias("from_version"), F.col("version_number").alias("to_version"), F.col("_top").alias("current"), *sides
    )


def append_revisions(revisions: DataFrame, path: str) -> None:
    """Append to the store; there is no way to update or delete a revision."""
    revisions.write.mode("append").parquet(path)


def broken_numbers(revisions: DataFrame, doc: str) -> DataFrame:
    """Documents whose stored numbers are not 1..n once each; empty for a sound store."""
    found = revisions.groupBy(doc).agg(F.count("*").alias("n"), F.countDistinct("version_number").alias("kinds"), F.max("version_number").alias("top"))
    return found.filter("n <> kinds OR n <> top")


def changed_documents(
    documents: DataFrame,
    latest_revisions: DataFrame,
    doc: str,
    limit: int = 50,
    feed: tuple[str, object] | None = None,
    since=None,
    least_versions: int = 2,
) -> DataFrame:
    """Documents with more than one revision and their newest one, last changed first (never changed last), then by key.

    ``feed`` (column, value) and ``since`` narrow it, by the last change or else the first sight; the limit is
    clamped to 1..200 and ``least_versions`` to 2 or more.
    """
    found = documents.filter(F.col("version_count") >= max(2, least_versions))
    if feed is not None:
        found = found.filter(F.col(feed[0]) == F.lit(feed[1]))
    if since is not None:
        found = found.filter(F.coalesce("last_changed_at", "first_seen_at") >= F.lit(since))
    newest = found.join(latest_revisions, doc)
    return newest.orderBy(F.col("last_changed_at").desc_nulls_last(), F.col(doc).asc()).limit(max(1, min(MOST_LISTED, limit)))


def capped(listing: DataFrame) -> bool:
    """Whether a listing is as long as a listing can be, so that more may have been cut."""
    return listing.count() == MOST_LISTED


def feed_coverage(feeds: DataFrame, documents: DataFrame, feed: str, name: str, doc: str, limit: int | None = 5) -> DataFrame:
    """Documents per feed, feeds without any included, most first, then by name."""
    counts = documents.groupBy(F.col(feed).alias("_f")).agg(F.count(doc).alias("documents"))
    found = feeds.join(counts, F.col(feed) == F.col("_f"), "left").select(feed, name, F.coalesce("documents", F.lit(0)).alias("documents"))
    found = found.orderBy(F.col("documents").desc(), name)
    return found if limit is None else found.limit(limit)


def either_key_lookup(wanted: DataFrame, documents: DataFrame, url: str, identity: str, origin: str, take: Sequence[str]) -> DataFrame:
    """Wanted urls that are a document's identity or the origin it was seen at; identity beats origin.

    Of several documents the one with the smallest identity is taken, then the one with the smallest values of ``take``.
    Two equi-joins and a pick instead of one join on either column.
    """
    by_identity = wanted.join(documents.select(F.col(identity).alias(url), *take, F.lit(1).alias("_by"), F.col(identity).alias("_i")), url)
    by_origin = wanted.join(documents.select(F.col(origin).alias(url), *take, F.lit(2).alias("_by"), F.col(identity).alias("_i")), url)
    rank = F.row_number().over(Window.partitionBy(url).orderBy("_by", "_i", *take))
    return by_identity.unionByName(by_origin).withColumn("_n", rank).filter("_n = 1").drop("_n", "_by", "_i")


def fetch_url(identity: Column, origin: Column) -> Column:
    """The url to fetch a known document from."""
    return F.coalesce(origin, identity)


def not_planned(stored: DataFrame, planned: DataFrame, url: str, position: str | None = None) -> DataFrame:
    """Stored documents whose fetch url is not planned yet, once each: the first by ``position``.

    Without a position the first is that with the smallest values, column by column.
    """
    order = F.struct(*[F.col(c) for c in ([position] if position else []) + [c for c in stored.columns if c not in (url, position)]])
    first = stored.groupBy(url).agg(F.min_by(F.struct(*stored.columns), order).alias("_row"))
    return first.join(planned.select(url).distinct(), url, "left_anti").select("_row.*")


def title_history(revisions: DataFrame, doc: str, title: str) -> DataFrame:
    """Titles as a history of their own, whatever the body does."""
    return append_if_changed(revisions.select(doc, F.col("version_number").alias("_v"), title), doc, "_v", title).select(
        doc, title, F.col("_v").alias("since_version"), F.col("version_number").alias("title_number")
    )
