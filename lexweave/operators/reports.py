"""Counting reports: frequencies, categories, coverage, top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialise
from .salted import word_key


def first_copy(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest row of each key. An aggregate, so copies meet map-side first."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(order)).alias("_r")).select("_r.*")


def live(rows: DataFrame) -> DataFrame:
    """Rows that aren't softly deleted; a null mark isn't one."""
    return rows.where(~F.coalesce("deleted", F.lit(False)))


def question_tokens(questions: DataFrame) -> DataFrame:
    """(id, volume, pos, token): content words of the sentence, then of the choices A to D."""
    words = F.concat(
        *(F.coalesce(text.content_tokens(c), F.array().cast("array<string>")) for c in [F.col("sentence"), *(F.col("choices")[k] for k in "ABCD")])
    )
    return questions.select("id", "volume", F.posexplode(words).alias("pos", "token"))


def token_counts(tokens: DataFrame, *by: str) -> DataFrame:
    """(by, token, n, first_id, first_pos): counts with the first occurrence, which breaks ties."""
    return tokens.groupBy(*by, "token").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("_f")).select(
        *by, "token", "n", F.col("_f.id").alias("first_id"), F.col("_f.pos").alias("first_pos")
    )


_BY_COUNT = [F.desc, F.asc]


def _ranked(by: Sequence[str], n: str, ties: Sequence[str]) -> Column:
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return F.row_number().over(w.orderBy(F.desc(n), *ties))


def word_frequency_top(tokens: DataFrame, k: int = 100) -> DataFrame:
    """(rank, token, n, pct): the k most frequent words and their share of all.

    Only the k rows kept by the top-k are ranked; the total is one row.
    """
    counts = token_counts(tokens)
    total = counts.agg(F.sum("n")).scalar()
    top = counts.withColumn("total", total).orderBy(F.desc("n"), "first_id", "first_pos").limit(k)
    rank = _ranked([], "n", ["first_id", "first_pos"])
    return top.select(rank.cast("bigint").alias("rank"), "token", "n", F.round(F.col("n") * 100.0 / F.greatest(F.col("total"), F.lit(1)), 4).alias("pct"))


def word_frequency_top_per_group(tokens: DataFrame, group: str, k: int = 10) -> DataFrame:
    """(group, rank, token, n): the k most frequent words of each group."""
    rank = _ranked([group], "n", ["first_id", "first_pos"])
    return token_counts(tokens, group).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select(group, "rank", "token", "n")


def vocabulary_size(tokens: DataFrame, group: str) -> DataFrame:
    """(group, n_tokens, n_distinct)."""
    return tokens.groupBy(group, "token").agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


NO_CATEGORY = "(미분류)"


def category_of(category: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit(NO_CATEGORY))


def category_counts(questions: DataFrame) -> DataFrame:
    """(volume, category, n): per volume and category, with totals (null) on either level."""
    return questions.select("volume", category_of(F.col("category")).alias("category")).rollup("volume", "category").agg(F.count("*").alias("n"))


def category_cube(questions: DataFrame) -> DataFrame:
    """(volume, test, level, n): all combinations of volume and test; level tells which are summed over."""
    return questions.cube("volume", "test").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"))


def category_wide(questions: DataFrame) -> DataFrame:
    """Category by every volume there is (a column each, named by the volume), zero-filled, with the total over all
    questions; questions without a volume stand under ``null``. No questions give no volume columns."""
    wide = questions.select(category_of(F.col("category")).alias("category"), "volume").groupBy("category").pivot("volume").count().na.fill(0)
    cells = F.array(*(F.col(f"`{c}`") for c in wide.columns[1:])).cast("array<bigint>")
    return wide.withColumn("total", F.aggregate(cells, F.lit(0).cast("bigint"), lambda a, n: a + n))


def category_pivot(questions: DataFrame) -> DataFrame:
    """(category, volume, n, total): the crosstab of ``category_wide`` in rows, for any number of volumes; every
    category stands beside every volume there is, zero-filled, with its total over all questions."""
    cells = questions.select(category_of(F.col("category")).alias("category"), "volume").groupBy("category", "volume").agg(F.count("*").alias("n"))
    cells = materialise(cells, "category-cells")  # one row per category and volume that meet, read three times
    grid = cells.groupBy("category").agg(F.sum("n").alias("total")).crossJoin(cells.select("volume").distinct())
    g, c = grid.alias("g"), cells.alias("c")
    both = g.join(c, (F.col("g.category") == F.col("c.category")) & F.col("g.volume").eqNullSafe(F.col("c.volume")), "left")
    return both.select("g.category", "g.volume", F.coalesce("c.n", F.lit(0)).cast("bigint").alias("n"), "g.total")


def category_share(questions: DataFrame) -> DataFrame:
    """(volume, category, n, pct): share within the volume."""
    n = questions.groupBy("volume", category_of(F.col("category")).alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("volume")), 4))


def ordered_categories(questions: DataFrame, order: Sequence[str]) -> DataFrame:
    """(place, category, n): known categories in their order, others by name, none last."""
    n = questions.groupBy(category_of(F.col("category")).alias("category")).agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*(F.lit(c) for c in order)), F.col("category"))
    group = F.when(at > 0, 0).when(F.col("category") != NO_CATEGORY, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy().orderBy(group, at, "category"))  # one row per category
    return n.select(place.cast("bigint").alias("place"), "category", "n")


def example_counts(entries: DataFrame) -> DataFrame:
    """(word, n_examples): keys of the mapping with their distinct examples."""
    ids = F.coalesce(F.col("examples.ex_id"), F.array().cast("array<bigint>"))
    rows = entries.select(word_key(F.col("word")).alias("word"), F.explode_outer(ids).alias("ex_id"))
    return rows.groupBy("word", "ex_id").agg(F.lit(1).alias("_o")).groupBy("word").agg(F.count("ex_id").alias("n_examples"))


def coverage(vocab: DataFrame, counts: DataFrame, group: str = "day") -> DataFrame:
    """(group, total, matched, with_hits, pct, pct_hits).

    ``matched`` is by key alone, ``with_hits`` by at least one example. The
    vocabulary keeps its repeats; a null word is never matched.
    """
    v = vocab.select(group, word_key(F.col("word")).alias("word"))
    both = v.join(counts, "word", "left")
    agg = both.groupBy(group).agg(
        F.count("*").alias("total"), F.count("n_examples").alias("matched"), F.count_if(F.coalesce("n_examples", F.lit(0)) > 0).alias("with_hits")
    )
    pct = lambda c: F.round(F.col(c) * 100.0 / F.col("total"), 4)
    return agg.select(group, "total", "matched", "with_hits", pct("matched").alias("pct"), pct("with_hits").alias("pct_hits"))


def matched_words(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """(day, place, word, n_examples): the matched words of each day, the most frequent first; a day of any size."""
    from .patches import ranked_within

    both = vocab.select("id", "day", word_key(F.col("word")).alias("word")).join(counts, "word")
    order = [-F.col("n_examples"), F.col("word"), F.col("id")]
    return ranked_within(both, "day", order).select("day", "place", "word", "n_examples")


def tokens_not_in(tokens: DataFrame, vocab: DataFrame, k: int = 30, sample: int = 5) -> DataFrame:
    """(token, n, first_ids): most frequent words that are no vocabulary entry, with their first ids."""
    per_id = tokens.groupBy("token", "id").agg(F.count("*").alias("n"))
    missing = per_id.join(vocab.select(word_key(F.col("word")).alias("token")).distinct(), "token", "left_anti")
    top = missing.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(k)
    rank = F.row_number().over(Window.partitionBy("token").orderBy("id"))
    firsts = missing.join(F.broadcast(top.select("token")), "token").withColumn("_r", rank).where(F.col("_r") <= sample)  # k rows
    ids = firsts.groupBy("token").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("first_ids"))
    return top.join(ids, "token")


def top_words(counts: DataFrame, k: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("n_examples"), "word").limit(k)


def without_examples(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, word) of the vocabulary without any example."""
    v = vocab.select("id", word_key(F.col("word")).alias("word"))
    return v.join(counts.where("n_examples > 0"), "word", "left_anti").select("id", "word")


def histogram(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(name, n) of a value (or of an exploded array's elements), null as 'none'."""
    return rows.select(value.alias("_v")).select(F.coalesce("_v", F.lit("none")).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def examples(entries: DataFrame) -> DataFrame:
    """One row per distinct example, with its word."""
    e = entries.select(word_key(F.col("word")).alias("word"), F.explode("examples").alias("e")).select("word", "e.*")
    return first_copy(e, "ex_id", "ex_id")


def top_examples(ex: DataFrame, k: int = 5) -> DataFrame:
    """(word, rank, ex_id): per word Part 5 first, then by volume, then as they came."""
    w = Window.partitionBy("word").orderBy(F.when(F.col("part") == 5, 0).otherwise(1), F.coalesce("volume", F.lit(99)), "ex_id")
    return ex.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("word", "rank", "ex_id")


def keep_first(ex: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first example of each word and key, in arrival order."""
    k = ex.withColumn("_key", key)
    return k.groupBy("word", "_key").agg(F.min_by(F.struct(*ex.columns), F.struct(*order)).alias("_r")).select("_r.*")


def word_documents(ex: DataFrame) -> DataFrame:
    """(word, total_count, parts, first_sources): one row per word from its distinct sentences.

    Examples are kept first come, then ordered by volume, test, part, question.
    The sources are those of the first three; ``patches.word_example_pages`` has all examples in order.
    """
    once = keep_first(ex, text.dedupe_key(F.col("sentence")), ["ex_id"])
    order = F.struct(F.coalesce("volume", F.lit(0)).alias("a"), F.coalesce("test", F.lit(0)).alias("b"), F.coalesce("part", F.lit(0)).alias("c"), F.coalesce("question_number", F.lit(0)).alias("d"), F.col("ex_id").alias("e"))
    counts = once.groupBy("word").agg(F.count("*").alias("total_count"), F.array_join(F.array_sort(F.collect_set(F.col("part").cast("string"))), ",").alias("parts"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(order))
    # at most three rows of a word pass the limit, and already before the shuffle
    top = once.select("word", F.trim("source").alias("source"), order.alias("o"), rank.alias("r")).where("r <= 3")
    firsts = top.groupBy("word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "source"))), lambda x: x["source"]), ";").alias("first_sources"))
    return counts.join(firsts, "word").select("word", "total_count", "parts", "first_sources")
