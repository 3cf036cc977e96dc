"""Per-key totals where a few keys hold most rows (two-stage salted aggregation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import parallelism
from .skew import heavy_keys, salt_of


def salted_distinct_totals(
    rows: DataFrame,
    key: Column,
    item: Column,
    amount: Column,
    names: tuple[str, str, str],
) -> DataFrame:
    """Per key the number of distinct items and the sum of their amounts.

    ``rows`` holds one row per delivery of an item; an item delivered again
    counts once, with its largest amount. Stage 1 counts by (key, salt), where
    only heavy keys get more than one salt; stage 2 merges by key. The salt is
    a hash of the item, so all copies of an item meet in one task.

    Defined results: a null key is a key of its own; rows with a null item are
    dropped (they name nothing to count); a null amount is 0; an empty table
    gives an empty result.
    """
    k, n_items, total = names
    slim = rows.select(key.alias("_k"), item.alias("_i"), F.coalesce(amount, F.lit(0)).cast("bigint").alias("_a")).where("_i is not null")
    counts = slim.groupBy("_k").agg(F.count("*").alias("_n"))
    heavy = heavy_keys(counts, ["_k"], "_n").withColumnRenamed("_k", "_hk")
    buckets = parallelism(rows.sparkSession)
    salted = slim.join(F.broadcast(heavy), F.col("_k").eqNullSafe(F.col("_hk")), "left").select(
        "_k", "_i", "_a", F.when(F.col("_hk").isNotNull(), salt_of(F.col("_i"), buckets)).otherwise(F.lit(0)).alias("_salt")
    )
    items = salted.repartition("_k", "_salt").groupBy("_k", "_salt", "_i").agg(F.max("_a").alias("_a"))
    stage1 = items.groupBy("_k", "_salt").agg(F.count("*").alias("_n"), F.sum("_a").alias("_s"))
    return stage1.groupBy("_k").agg(F.sum("_n").alias(n_items), F.sum("_s").alias(total)).withColumnRenamed("_k", k)


def word_key(word: Column) -> Column:
    """Word without outer blanks, in lower case."""
    return F.lower(F.regexp_replace(word, r"(?U)^\s+|(?<!\s)\s+$", ""))


def word_totals(entries: DataFrame) -> DataFrame:
    """word, n_entries, n_examples of a word-to-examples table."""
    return salted_distinct_totals(
        entries,
        word_key(F.col("word")),
        F.col("entry_id"),
        # the size of one leaf: the scan needn't read the sentences
        F.when(F.col("examples").isNull(), F.lit(0)).otherwise(F.size("examples.ex_id")),
        ("word", "n_entries", "n_examples"),
    )


def word_totals_with_vocab(entries: DataFrame, vocab: DataFrame) -> DataFrame:
    """Word totals beside the number of distinct vocabulary ids and days of the word.

    Both sides are reduced to one row per word before they meet, so the join
    can't be skewed however often a word recurs on either side. A word of one
    side only has 0 on the other.
    """
    left = word_totals(entries)
    right = vocab.groupBy(word_key(F.col("word")).alias("word")).agg(
        F.count_distinct("id").alias("n_vocab_ids"), F.count_distinct("day").alias("n_days")
    )
    both = left.alias("l").join(right.alias("r"), F.col("l.word").eqNullSafe(F.col("r.word")), "full")
    num = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_entries", "n_examples", "n_vocab_ids", "n_days")]
    return both.select(F.coalesce("l.word", "r.word").alias("word"), *num)
