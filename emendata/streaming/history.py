"""The same history from a stream: state per key, or a merge per micro-batch into a stored table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from emendata.operators.versioning import merge_revisions


def stateful_revisions(observations: DataFrame) -> DataFrame:
    """Revisions of a stream of (doc, at, content): doc, at, content, version_number.

    State per document is the newest content and its number. Rows of one trigger are taken by ``at``, then content.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, number = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "content"], kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            if number == 0 or row.content != content:
                content, number = row.content, number + 1
                out.append((key[0], row.at, content, number))
        state.update((content, number))
        yield pd.DataFrame(out, columns=["doc", "at", "content", "version_number"])

    return observations.groupBy("doc").applyInPandasWithState(
        step,
        "doc long, at timestamp, content string, version_number long",
        "content string, number long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def stateful_strikes(attempts: DataFrame) -> DataFrame:
    """Running failures since the last success of a stream of (link, at, failed): link, at, failure_count."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (count,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for failed in rows["failed"]:
            count = count + 1 if failed else 0
        state.update((count,))
        yield pd.DataFrame([(key[0], rows["at"].iloc[-1], count)], columns=["link", "at", "failure_count"])

    return attempts.groupBy("link").applyInPandasWithState(
        step, "link long, at timestamp, failure_count long", "count long", "update", GroupStateTimeout.NoTimeout
    )


def stateful_claim_strikes(results: DataFrame) -> DataFrame:
    """Claims in a row that fetches did not confirm, of a stream of (feed, at, changed): feed, at, unconfirmed_claims.

    One confirmation in a trigger clears the count, as one in a run does; else the fetches of the trigger are added.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (count,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches))
        count = 0 if rows["changed"].any() else min(count + len(rows), 2**31 - 1)
        state.update((count,))
        yield pd.DataFrame([(key[0], rows["at"].max(), count)], columns=["feed", "at", "unconfirmed_claims"])

    return results.groupBy("feed").applyInPandasWithState(
        step, "feed long, at timestamp, unconfirmed_claims long", "count long", "update", GroupStateTimeout.NoTimeout
    )


def requests_per_hour(checks: DataFrame, host: str, at: str, late: str = "10 minutes", slide: str = "1 hour") -> DataFrame:
    """Requests per host and hour of a stream, an hour beginning every ``slide``; what is later than ``late`` is not counted."""
    counted = checks.withWatermark(at, late).groupBy(F.window(at, "1 hour", slide), host).agg(F.count("*").alias("requests"))
    return counted.select(host, F.col("window.start").alias("hour"), "requests")


class AlreadyRunning(RuntimeError):
    """A run was asked for while one of that name goes on."""


def run_every(stream: DataFrame, name: str, run, checkpoint: str, interval: str | None = "30 seconds") -> StreamingQuery:
    """Start ``run(batch, number)`` over the stream, every ``interval``, or once over what is there (None).

    One run at a time: while a query of this name is active another is refused.
    """
    if any(q.name == name for q in stream.sparkSession.streams.active):
        raise AlreadyRunning(name)
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


def merge_into(store: str):
    """A foreachBatch function that appends a batch's revisions to the table at ``store``.

    Each batch writes a folder of its own and replaces it when it is run again, so a repeated batch changes nothing:
    it is merged with the batches before it only.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("doc", "at", "content")
        try:
            before = spark.read.parquet(store).filter(F.col("batch") < number).drop("batch")
        except AnalysisException:  # no batch has been stored yet
            before = spark.createDataFrame([], rows.schema).withColumn("version_number", F.lit(0).cast("long"))
        fresh = merge_revisions(before, rows, "doc", "at", "content")
        fresh.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return run
