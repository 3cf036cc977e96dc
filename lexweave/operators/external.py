"""Rows through an outside function in small batches, resumable."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet; what is done may be any size."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def in_batches(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int = 50, workers: int | None = None) -> DataFrame:
    """``call`` on at most ``size`` rows at a time. ``workers`` bounds how many run at once.

    The function may run again for the same rows if a task is lost, so it must
    be safe to repeat; write the result as a table before using it twice.
    """

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), size):
                yield call(pdf.iloc[at : at + size])

    return (rows.repartition(workers) if workers else rows).mapInPandas(run, schema)


def merge_replies(rows: DataFrame, replies: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with ``column`` from the replies where there is one, else their own."""
    new = replies.groupBy(key).agg(F.max(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
