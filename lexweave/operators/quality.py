"""Data quality: rules to issue rows, duplicates, gaps, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text
from ..functions.lexicon import BLANK, CATEGORIES

QUESTION_ID = r"^vol(\d+)_test(\d+)_part(\d+)_(\d{3})$"
VOCAB_ID = r"^hw_\d{4,}$"
LEVELS = ["기초", "800", "900"]


def question_rules() -> dict[tuple[str, str], Column]:
    """(field, rule) -> condition under which it is broken. Null never breaks a comparison."""
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract(id, '^vol(\\\\d+)_test(\\\\d+)_part(\\\\d+)_(\\\\d{{3}})$', {i}), '') as int)")
    keys = F.map_keys("choices")
    return {
        ("id", "pattern"): ~F.col("id").rlike(QUESTION_ID),
        ("id", "volume"): part(1) != F.col("volume"),
        ("id", "test"): part(2) != F.col("test"),
        ("id", "part"): part(3) != F.col("part"),
        ("test", "range"): ~F.col("test").between(1, 10),
        ("part", "range"): ~F.col("part").isin(5, 6, 7),
        ("question_number", "range"): ~F.col("question_number").between(101, 200),
        ("sentence", "empty"): F.coalesce(text.strip(F.col("sentence")), F.lit("")) == "",
        ("sentence", "no_blank"): (F.col("part") == 5) & ~F.col("sentence").contains(BLANK),
        ("choices", "keys"): F.size(F.array_except(F.array(*map(F.lit, "ABCD")), keys)) > 0,
        ("choices", "empty"): F.exists(F.map_values("choices"), lambda c: F.coalesce(text.strip(c), F.lit("")) == ""),
        ("answer", "value"): ~F.col("answer").isin(*"ABCD"),
        ("answer", "missing"): F.col("answer").isNull(),
        ("category", "value"): ~F.col("category").isin(*CATEGORIES),
    }


def vocab_rules() -> dict[tuple[str, str], Column]:
    return {
        ("id", "pattern"): ~F.col("id").rlike(VOCAB_ID),
        ("word", "empty"): F.coalesce(text.strip(F.col("word")), F.lit("")) == "",
        ("word", "blanks"): F.col("word") != text.strip(F.col("word")),
        ("meaning_kr", "empty"): F.coalesce(text.strip(F.col("meaning_kr")), F.lit("")) == "",
        ("day", "range"): F.col("day") < 1,
        ("level", "value"): ~F.col("level").isin(*LEVELS),
        ("pos", "unknown"): F.col("pos").isNotNull() & (F.size(classify.pos_list(F.col("pos"))) == 0),
    }


#: Rules whose breach is a warning; all others are errors.
WARNINGS = {("sentence", "no_blank"), ("category", "value"), ("answer", "missing"), ("word", "blanks"), ("level", "value")}


def issues(rows: DataFrame, rules: dict[tuple[str, str], Column], file: str) -> DataFrame:
    """(severity, file, item_id, field, rule): one row per broken rule, in one pass over the rows."""
    found = [
        F.when(c, F.struct(F.lit("warning" if k in WARNINGS else "error").alias("severity"), F.lit(k[0]).alias("field"), F.lit(k[1]).alias("rule")))
        for k, c in rules.items()
    ]
    return rows.select(F.col("id").alias("item_id"), F.explode(F.array_compact(F.array(*found))).alias("i")).select(
        "i.severity", F.lit(file).alias("file"), "item_id", "i.field", "i.rule"
    )


def issue_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("file", "severity", "field", "rule").agg(F.count("*").alias("n"))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """(id, n, first_at): ids that came more than once, with their first arrival."""
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.date_format(F.min("loaded_at"), "yyyy-MM-dd HH:mm:ss").alias("first_at")).where("n > 1")


def repeated_words(vocab: DataFrame, word: Column, within: str = "day") -> DataFrame:
    """(within, word, n, first_id): words that a day (or level, ...) has more than once, under several ids."""
    return vocab.groupBy(within, word.alias("word")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def sequence_gaps(questions: DataFrame, first: int = 101) -> DataFrame:
    """(volume, test, n, n_missing, missing): numbers absent between the first and the largest."""
    q = questions.groupBy("volume", "test").agg(F.array_sort(F.collect_set("question_number")).alias("have"))
    gone = F.array_except(F.sequence(F.lit(first), F.array_max("have")), F.col("have"))
    return q.select("volume", "test", F.size("have").cast("bigint").alias("n"), F.size(gone).cast("bigint").alias("n_missing"), F.array_join(gone.cast("array<string>"), ",").alias("missing")).where("n_missing > 0")


def wrong_totals(entries: DataFrame) -> DataFrame:
    """(entry_id, total_count, n_examples): rows whose stated total isn't their number of examples."""
    n = F.coalesce(F.when(F.col("examples").isNotNull(), F.size("examples.ex_id")), F.lit(0))
    return entries.select("entry_id", "total_count", n.alias("n_examples")).where(~F.col("total_count").eqNullSafe(F.col("n_examples"))).distinct()


def mapping_without_vocab(entries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(vocab_id, n): references, as written, that no vocabulary row has. Counted first, joined after."""
    n = entries.where("vocab_id is not null").groupBy("vocab_id").agg(F.count_distinct("entry_id").alias("n"))
    return n.join(vocab.select(F.col("id").alias("vocab_id")).distinct(), "vocab_id", "left_anti")


def fixed_sentences(questions: DataFrame) -> DataFrame:
    """(id, fixed): sentences that change by trimming or by a standard blank mark."""
    s = text.strip(F.col("sentence"))
    f = F.when(s.contains(BLANK), s).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "-{5,}", BLANK), "_{5,}", BLANK), r"\.{5,}", BLANK))
    return questions.select("id", f.alias("fixed"), "sentence").where("fixed <> sentence").select("id", "fixed")
