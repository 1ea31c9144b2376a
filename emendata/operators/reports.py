"""What the service of old answered over HTTP, as rows of JSON or as columns for a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcomes in the order a report names them.
FEED_OUTCOMES = ("FETCHED", "NOT_MODIFIED", "FAILED")
ARTICLE_OUTCOMES = ("NEW", "CHANGED", "UNCHANGED", "SKIPPED", "FAILED", "DEFERRED", "ABANDONED", "NOT_DUE")
# Windows of a listing in seconds; all has no start.
WINDOWS = {"hour": 3600, "day": 86_400, "week": 604_800, "month": 2_592_000, "all": None}


def window_start(name: str, now: int) -> int:
    """Epoch seconds from which a listing reaches, the start included; an unknown name is an error."""
    return 0 if WINDOWS[name] is None else now - WINDOWS[name]


def run_response(feeds: DataFrame, articles: DataFrame, lossy: Column | None = None) -> DataFrame:
    """One row: response, JSON with the counts of feeds and articles by outcome, checked, and texts decoded with loss.

    ``feeds`` and ``articles`` have the column outcome. Both are summed in one pass each.
    """
    counts = lambda names: [F.count_if(F.col("outcome") == n).alias(n.lower()) for n in names]
    polled = feeds.agg(*counts(FEED_OUTCOMES))
    lost = F.count_if(lossy if lossy is not None else F.lit(False)).alias("replaced")
    checked = articles.agg(*counts(ARTICLE_OUTCOMES), F.count("*").alias("checked"), lost)
    body = polled.select(F.lit(1).alias("_j"), F.struct(*polled.columns).alias("feeds")).join(
        checked.select(F.lit(1).alias("_j"), F.struct(*checked.columns).alias("articles")), "_j"
    )
    return body.select(F.to_json(F.struct("feeds", "articles")).alias("response"))


def all_results(feed_results: DataFrame, rechecks: DataFrame) -> DataFrame:
    """Results of a run: those of feeds, then those of documents looked at again, with their place."""
    return feed_results.withColumn("part", F.lit(0)).unionByName(rechecks.withColumn("part", F.lit(1)), allowMissingColumns=True)


def changed_response(listing: DataFrame, doc: str, paragraphs: str | None = None) -> DataFrame:
    """JSON of each document of a listing; the number of paragraphs stands for the paragraphs."""
    fields = [F.size(c).alias("paragraph_count") if c == paragraphs else F.col(c) for c in listing.columns]
    return listing.select(doc, F.to_json(F.struct(*fields)).alias("response"))


def revisions_response(revisions: DataFrame, doc: str, at: str) -> DataFrame:
    """JSON of each document's revisions, oldest first."""
    row = F.struct("version_number", at)
    return revisions.groupBy(doc).agg(F.to_json(F.struct(F.sort_array(F.collect_list(row)).alias("revisions"))).alias("response"))


def diff_response(diffs: DataFrame) -> DataFrame:
    """JSON of each diff with its versions; what a change does not have is left out."""
    return diffs.select("from_version", "to_version", F.to_json(F.struct("from_version", "to_version", "diff.title", "diff.paragraphs")).alias("response"))


def classification(repair: Column, found: Column, encoding: str = "ENCODING_REPAIR") -> Column:
    """ENCODING_REPAIR where decoding explains a change, SUBSTANTIVE where text was rewritten, else COSMETIC.

    ``found`` is a diff. The finer line between correction and substance needs a reader.
    """
    return F.when(repair.isNotNull(), encoding).when(found["rewrites"], "SUBSTANTIVE").otherwise("COSMETIC")


def change_rows(diffs: DataFrame, doc: str, repair: Column) -> DataFrame:
    """The table of changes: one row per pair of versions, so a pair that is computed again replaces itself."""
    return diffs.select(
        doc,
        "from_version",
        "to_version",
        classification(repair, F.col("diff")).alias("classification"),
        F.col("diff.title").isNotNull().alias("title_changed"),
        F.to_json("diff").alias("diff_payload"),
    ).dropDuplicates([doc, "from_version", "to_version"])
