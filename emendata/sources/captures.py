"""Captured traffic: redirect chains and the content-addressed store of raw pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status codes that redirect.
REDIRECTS = (301, 302, 303, 307, 308)


def final_hops(requests: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """url, final_url, n_hops, end ('OK', 'LOOP', 'TOO_MANY' or 'MISSING') of each request over captured hops.

    ``hops`` has url, status and location, one row per url. At most ``most`` joins, each on what is still open.
    """
    known = hops.select(F.col("url").alias("_u"), F.col("status").alias("_s"), F.col("location").alias("_l"))
    at = requests.select("url", F.col("url").alias("final_url"), F.array("url").alias("_seen"), F.lit(0).alias("n_hops"), F.lit(None).cast("string").alias("end"))
    for _ in range(most + 1):
        step = at.join(known, F.col("final_url") == F.col("_u"), "left")
        moves = F.col("end").isNull() & F.col("_s").isin(*REDIRECTS) & F.col("_l").isNotNull()
        loop = moves & F.array_contains("_seen", F.col("_l"))
        go = moves & ~loop & (F.col("n_hops") < most)
        end = (
            F.when(F.col("end").isNotNull(), F.col("end"))
            .when(loop, "LOOP")
            .when(moves & ~go, "TOO_MANY")
            .when(F.col("_u").isNull(), "MISSING")
            .when(~moves, "OK")
        )
        at = step.select(
            "url",
            F.when(go, F.col("_l")).otherwise(F.col("final_url")).alias("final_url"),
            F.when(go, F.concat("_seen", F.array("_l"))).otherwise(F.col("_seen")).alias("_seen"),
            (F.col("n_hops") + go.cast("int")).alias("n_hops"),
            end.alias("end"),
        )
    return at.drop("_seen")


def raw_ref(body: Column) -> Column:
    """Where a page's bytes are kept: two levels of folders by the hash of what is not compressed."""
    digest = F.sha2(body, 256)
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, F.lit(".html.gz"))


def legal_ref(ref: Column) -> Column:
    """Whether a reference points into the store and nowhere else."""
    return ref.rlike(r"^([0-9a-f]{2})/([0-9a-f]{2})/\1\2[0-9a-f]{60}\.html\.gz$")


def new_pages(captured: DataFrame, body: str, stored: DataFrame | None = None) -> DataFrame:
    """ref and body of pages that the store does not have yet, once each."""
    fresh = captured.select(raw_ref(F.col(body)).alias("ref"), F.col(body).alias("body")).filter("ref IS NOT NULL").dropDuplicates(["ref"])
    return fresh if stored is None else fresh.join(stored.select("ref"), "ref", "left_anti")


def write_pages(pages: DataFrame, path: str) -> None:
    """Append new pages; Parquet pages are compressed, so the bytes are stored as they are."""
    pages.write.mode("append").option("compression", "gzip").parquet(path)
