"""Heavy keys: finding them, and grouping or joining without hot tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import parallelism

#: A key is heavy from this share of one task's fair load on.
HEAVY_SHARE = 0.5


def heavy_keys(counts: DataFrame, keys: Sequence[str], n: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys of ``counts`` (one row per key, ``n`` rows each) that alone fill
    ``share`` of a fair task.

    A heavy key holds at least ``share / tasks`` of all rows, so there are at
    most ``tasks / share`` of them whatever the size of the data: the result
    has a proven bound and may be broadcast. Empty input gives no keys.
    """
    tasks = parallelism(counts.sparkSession)
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(
        (F.col(n) > total * F.lit(share / tasks)) & (F.col(n) >= 8)
    ).select(*keys, F.col(n).alias("_heavy_n"))


def salt_of(by: Column, buckets: int) -> Column:
    """Salt from a hash of ``by``: random with regard to the key, but the same
    when a lost task runs again (``rand()`` isn't)."""
    return F.pmod(F.xxhash64(by, F.lit(0x5A17)), F.lit(buckets)).cast("int")


def attach_by_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Inner join of many rows with one row per key, safe if one key holds most rows.

    ``per_key`` carries ``n``, the rows of each key. Its heavy keys (bounded in
    number) are broadcast, the others go through a shuffled join; null keys
    match nothing.
    """
    heavy = heavy_keys(per_key, keys, n).drop("_heavy_n").withColumn("_hot", F.lit(True))
    marked = per_key.join(F.broadcast(heavy), list(keys), "left")
    hot = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot is null").drop("_hot")
    # rows of a heavy key match nothing in ``rest``; they leave before the shuffle
    cool = rows.join(F.broadcast(heavy.drop("_hot")), list(keys), "left_anti")
    return rows.join(F.broadcast(hot), list(keys)).unionByName(cool.join(rest, list(keys)))
