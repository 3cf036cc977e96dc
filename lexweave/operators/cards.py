"""Cards, notes and study pages from the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text
from . import reports
from .patches import unique_name
from .salted import word_key

_LEVELS = {"기초": "level::basic", "800": "level::800", "900": "level::900"}


def tag_column() -> Column:
    """Day, level, stars and first part of speech of a vocabulary row as tags."""
    level = F.element_at(F.create_map(*(F.lit(x) for kv in _LEVELS.items() for x in kv)), F.col("level"))
    pos = F.get(classify.pos_list(F.col("pos")), 0)
    return F.array_compact(
        F.array(
            F.when(F.col("day").isNotNull(), F.format_string("day::%02d", "day")),
            level,
            F.when(F.col("frequency").isNotNull(), F.concat(F.lit("freq::"), F.length("frequency").cast("string"))),
            F.when(pos.isNotNull(), F.concat(F.lit("pos::"), pos)),
        )
    )


def tags(vocab: DataFrame) -> DataFrame:
    """(id, tags)."""
    return vocab.select("id", tag_column().alias("tags"))


def tag_histogram(vocab: DataFrame) -> DataFrame:
    return tags(vocab).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def vocab_cards(vocab: DataFrame, ex: DataFrame) -> DataFrame:
    """(id, word, level, n_examples, examples): card rows with up to three examples by priority; none gives 0 and ''."""
    once = reports.keep_first(ex, text.dedupe_key(F.col("sentence")), ["ex_id"])
    total = once.groupBy("word").agg(F.count("*").alias("n"))
    top = reports.top_examples(once, 3).join(ex.select("ex_id", text.unbold(F.col("sentence")).alias("s")), "ex_id")
    shown = top.groupBy("word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]), "\n").alias("examples"))
    v = vocab.select("id", word_key(F.col("word")).alias("word"), F.coalesce(F.nullif("level", F.lit("")), "frequency", F.lit("none")).alias("level"))
    both = v.join(total, "word", "left").join(shown, "word", "left")
    return both.select("id", "word", "level", F.coalesce("n", F.lit(0)).alias("n_examples"), F.coalesce("examples", F.lit("")).alias("examples"))


def notes(vocab: DataFrame) -> DataFrame:
    """(guid, fields, tags): notes with a key that stays the same between exports."""
    none = F.lit("")
    fields = F.concat_ws("\x1f", text.strip(F.col("word")), *(F.coalesce(text.escape_html(F.col(c)), none) for c in ("meaning_kr", "meaning_en", "example_sentence", "example_translation")))
    return vocab.select(F.sha2("id", 256).alias("guid"), fields.alias("fields"), F.array_join(tag_column(), " ").alias("tags"))


def pages(vocab: DataFrame) -> DataFrame:
    """(id, path, content): one Markdown page per entry in a folder per day."""
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("word: "), text.strip(F.col("word"))), F.concat(F.lit("day: "), F.coalesce(F.col("day").cast("string"), F.lit(""))), F.concat(F.lit("level: "), F.coalesce("level", F.lit(""))), F.lit("---"))
    links = F.array_join(F.transform(F.coalesce("related_words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("[["), F.coalesce(w, F.lit("")), F.lit("]]"))), " ")
    body = F.concat_ws("\n", front, F.concat(F.lit("# "), text.strip(F.col("word"))), F.concat(F.lit("> "), F.coalesce("example_sentence", F.lit(""))), links)
    rows = vocab.select("id", "day", unique_name().alias("name"), body.alias("content"))
    return rows.select("id", F.format_string("day%02d/%s.md", F.coalesce("day", F.lit(0)), "name").alias("path"), "content")


def page_links(page_rows: DataFrame) -> DataFrame:
    """(id, target): edges of the pages' wiki links."""
    found = F.regexp_extract_all("content", F.lit(r"\[\[([^\]|]+)\]\]"), F.lit(1))
    return page_rows.select("id", F.explode(found).alias("target")).distinct()


def front_matter(page_rows: DataFrame) -> DataFrame:
    """(id, word, day, level) read back from the pages' front matter."""
    block = F.regexp_extract("content", r"(?s)^---\s*\n(.*?)\n---", 1)
    get = lambda k: F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{k}: ?(.*)$", 1)), F.lit(""))
    return page_rows.select("id", get("word").alias("word"), get("day").cast("int").alias("day"), get("level").alias("level"))


def quote_blocks(page_rows: DataFrame) -> DataFrame:
    """(id, n_quotes): runs of quoted lines of each page."""
    lines = F.split("content", "\n")
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).startswith(">") & ~F.coalesce(F.get(lines, i - 1).startswith(">"), F.lit(False)))
    return page_rows.select("id", F.size(starts).cast("bigint").alias("n_quotes"))


def majority_pos(vocab: DataFrame) -> DataFrame:
    """(word, pos): the part of speech that most rows of a word give, the first seen on ties."""
    v = vocab.select(word_key(F.col("word")).alias("word"), "id", F.explode(classify.pos_list(F.col("pos"))).alias("pos"))
    n = v.groupBy("word", "pos").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    # the least of (-n, first seen) is the most frequent, and the first seen among equals
    return n.groupBy("word").agg(F.min_by("pos", F.struct((-F.col("n")).alias("n"), "first", "pos")).alias("pos"))


def volume_histogram(ex: DataFrame) -> DataFrame:
    """(volume, n): examples per volume, taken from the source's text where the field is null."""
    from_text = F.expr("try_cast(nullif(regexp_extract(source, '(?i)vol[^0-9]*([0-9]+)', 1), '') as int)")
    return ex.groupBy(F.coalesce("volume", from_text).alias("volume")).agg(F.count("*").alias("n"))
