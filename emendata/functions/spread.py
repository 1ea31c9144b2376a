"""Rows dealt out before work that is heavy for their size."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys``, which should tell rows apart, over as many tasks as a shuffle has.

    Files are cut by bytes and by row groups, and adaptive execution joins small partitions, so that a small file of
    much work is left to one task otherwise. The number is given, which adaptive execution leaves as it is.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
