"""Patches, updates, merges and keys in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, text
from ..session import materialise
from . import reports
from .salted import word_key


def with_row_number(rows: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Rows numbered from 1 in a total order, without bringing them into one task.

    The rows are range-partitioned and written once, each partition numbers
    its own, and what comes before each partition is added from a table of one
    row per partition.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = materialise(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ordered")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", before.alias("_before"))  # one row per partition
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.withColumn("_own", own).join(F.broadcast(starts), "_p").withColumn(name, F.col("_own") + F.col("_before")).drop("_p", "_own", "_before")


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    return with_row_number(rows, order).withColumn("batch_id", F.ceil(F.col("row_no") / size))


def chapter_map(vocab: DataFrame, size: int = 500) -> DataFrame:
    """(day, page, n_words, words): the entries of each day in the order of their ids,
    at most ``size`` to a page, so that a day of any size makes no large group.
    Entries without a day come first, as day -1."""
    v = vocab.select(F.coalesce("day", F.lit(-1)).alias("day"), "id", F.trim("word").alias("w"))
    paged = batches(v, ["day", "id"], size).groupBy("day", F.col("batch_id").alias("page"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("row_no", "w"))), lambda s: s["w"])
    return paged.agg(F.count("*").alias("n_words"), F.array_join(words, ",").alias("words"))


def sequential_ids(vocab: DataFrame) -> DataFrame:
    """(id, new_id): ids counted in the order of day, word and old id."""
    v = vocab.select("id", F.coalesce("day", F.lit(0)).alias("d"), word_key(F.col("word")).alias("w"))
    return with_row_number(v, ["d", "w", "id"]).select("id", F.format_string("hw_%04d", F.col("row_no")).alias("new_id"))


def unique_name() -> Column:
    """A vocabulary row's file name within its day, repeats with _2, _3 and so on."""
    base = text.file_name(F.col("word"))
    k = F.row_number().over(Window.partitionBy("day", base).orderBy("id"))
    return F.when(k == 1, base).otherwise(F.concat_ws("_", base, k.cast("string")))


def unique_names(vocab: DataFrame) -> DataFrame:
    """(id, day, name): file names within a day."""
    return vocab.select("id", "day", unique_name().alias("name"))


def update_from_explanation(questions: DataFrame) -> DataFrame:
    """(id, translation, vocabulary, updated): fields filled from the marked parts of the explanation where they are null."""
    _, tr, voc = text.split_explanation(F.col("explanation"))
    new_t, new_v = F.coalesce("translation", tr), F.coalesce("vocabulary", voc)
    changed = ~new_t.eqNullSafe(F.col("translation")) | ~new_v.eqNullSafe(F.col("vocabulary"))
    return questions.select("id", new_t.alias("translation"), new_v.alias("vocabulary"), changed.alias("updated"))


def pos_corrections(vocab: DataFrame) -> DataFrame:
    """(status, n): each entry's part of speech against the latest one given for its word."""
    v = vocab.select("id", word_key(F.col("word")).alias("word"), F.array_join(classify.pos_list(F.col("pos")), ",").alias("pos"), "loaded_at")
    latest = v.where("pos <> ''").groupBy("word").agg(F.max_by("pos", F.struct("loaded_at", "id")).alias("new"))
    both = v.join(latest, "word", "left")
    status = F.when(F.col("new").isNull(), "missing").when(F.col("new") == F.col("pos"), "unchanged").otherwise("updated")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def repaired_examples(entries: DataFrame) -> DataFrame:
    """(entry_id, idx, new_sentence): patches for corrupt sentences, by place in the array."""
    rows = entries.select("entry_id", F.posexplode("examples").alias("idx", "e")).where(text.is_corrupt(F.col("e.sentence")))
    return rows.select("entry_id", "idx", text.repair(F.col("e.sentence")).alias("new_sentence")).distinct()


def apply_patches(entries: DataFrame, patches: DataFrame) -> DataFrame:
    """(entry_id, n_patched, total_count): patches applied by index; patches out of
    range are ignored, sentences that are empty afterwards are dropped and not counted."""
    p = patches.groupBy("entry_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "new_sentence"))).alias("m"))
    once = entries.select("entry_id", "examples").where("examples is not null").dropDuplicates(["entry_id"])
    both = once.join(p, "entry_id")
    new = F.transform("examples", lambda e, i: F.coalesce(F.element_at(F.col("m"), i), e["sentence"]))
    hit = F.size(F.filter(F.map_keys("m"), lambda k: (k >= 0) & (k < F.size("examples"))))
    return both.select("entry_id", hit.cast("bigint").alias("n_patched"), F.size(F.filter(new, lambda s: s != "")).cast("bigint").alias("total_count"))


def matched_questions(ex: DataFrame, questions: DataFrame) -> DataFrame:
    """(ex_id, question_id): examples whose normalised text is a filled question's.

    Repeated keys keep the smallest question id, so no example multiplies.
    """
    filled = text.fill_first(F.col("sentence"), F.col("choices")[F.col("answer")])
    q = questions.where("answer is not null").select("id", text.fuzzy_key(filled).alias("key")).where("key <> ''").groupBy("key").agg(F.min("id").alias("question_id"))
    return ex.select("ex_id", text.fuzzy_key(F.col("sentence")).alias("key")).join(q, "key").select("ex_id", "question_id")


def canonical_words(entries: DataFrame) -> DataFrame:
    """(word, canonical, n_spellings): the first spelling of each word, blanks removed."""
    e = entries.select("entry_id", word_key(F.col("word")).alias("word"), text.strip(F.col("word")).alias("s"))
    return e.groupBy("word").agg(F.min_by("s", "entry_id").alias("canonical"), F.count_distinct("s").alias("n_spellings"))


def incremental_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """(word, total_count, n_added, parts): new examples joined to old ones; old ones win, repeats fall out."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    once = reports.keep_first(both, text.dedupe_key(F.col("sentence")), ["_new", "ex_id"])
    return once.groupBy("word").agg(
        F.count("*").alias("total_count"), F.sum("_new").cast("bigint").alias("n_added"), F.array_join(F.array_sort(F.collect_set(F.col("part").cast("string"))), ",").alias("parts")
    )


def word_sets(vocab: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, n): sizes of the union, the intersection and both differences of two word sets."""
    a, b = (t.select(word_key(F.col("word")).alias("word")).where("word is not null").distinct() for t in (vocab, entries))
    sizes = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("only_vocab", a.subtract(b)), ("only_entries", b.subtract(a))]
    out = None
    for kind, rows in sizes:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def natural_order(rows: DataFrame, label: Column) -> DataFrame:
    """(place, label): distinct labels by the number in them, those without one last."""
    n = F.expr("try_cast(nullif(regexp_extract(label, '([0-9]+)', 1), '') as int)")
    d = rows.select(label.alias("label")).where("label is not null").distinct()
    keyed = d.select("label", n.isNull().cast("int").alias("_last"), F.coalesce(n, F.lit(0)).alias("_n"))
    return with_row_number(keyed, ["_last", "_n", "label"], "place").select(F.col("place").cast("bigint"), "label")


def _hybrid_keys() -> list[Column]:
    key = F.coalesce(F.nullif("page", F.lit(0)), F.coalesce("test", F.lit(0)) * 1000 + F.coalesce("question_number", F.lit(0)))
    return [F.coalesce("volume", F.lit(0)), key, F.col("ex_id")]


def ranked_within(rows: DataFrame, key: str, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Rows numbered from 1 within each ``key`` in a total order, without bringing a hot key into one task.

    The rows are range-partitioned by key and order and written once. Each
    partition numbers its own; only its first key can have rows before it, so
    what comes before is a table of at most one row per partition.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    names = [f"_o{i}" for i in range(len(order))]
    placed = rows.withColumns(dict(zip(names, order))).repartitionByRange(parts, key, *names).withColumn("_p", F.spark_partition_id())
    placed = materialise(placed, "ranked")
    sizes = placed.groupBy("_p", key).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_p", F.col(key).alias("_k"), before.alias("_before")).where("_before is not null")
    own = F.row_number().over(Window.partitionBy("_p", key).orderBy(*names))
    both = placed.withColumn("_own", own).alias("r").join(F.broadcast(starts.alias("s")), (F.col("r._p") == F.col("s._p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    place = F.col("_own") + F.coalesce("_before", F.lit(0))
    return both.select(*(F.col(f"r.{c}") for c in rows.columns), place.cast("bigint").alias(name))


def hybrid_order(ex: DataFrame) -> DataFrame:
    """(word, place, ex_id): all examples of each word by page, or by test and question number where there is no page."""
    return ranked_within(ex.select("word", "volume", "page", "test", "question_number", "ex_id"), "word", _hybrid_keys()).select("word", "place", "ex_id")


def hybrid_first(ex: DataFrame, k: int = 5) -> DataFrame:
    """(word, place, ex_id): the first ``k`` of ``hybrid_order``; no more than these are sorted."""
    place = F.row_number().over(Window.partitionBy("word").orderBy(*_hybrid_keys()))
    return ex.withColumn("place", place.cast("bigint")).where(F.col("place") <= k).select("word", "place", "ex_id")


def word_example_pages(ex: DataFrame, size: int = 500) -> DataFrame:
    """(word, page, n_examples, ex_ids): all distinct sentences of each word in the order
    of volume, test, part and question, at most ``size`` to a page, so that a word
    with any number of examples makes no large group."""
    cols = ["volume", "test", "part", "question_number", "ex_id"]  # the sentence itself is only moved as the key
    keyed = ex.select("word", text.dedupe_key(F.col("sentence")).alias("_key"), *cols)
    once = keyed.groupBy("word", "_key").agg(F.min_by(F.struct(*cols), "ex_id").alias("_r")).select("word", "_r.*")
    order = [*(F.coalesce(c, F.lit(0)) for c in ("volume", "test", "part", "question_number")), F.col("ex_id")]
    n = ranked_within(once, "word", order)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "ex_id"))), lambda x: x["ex_id"])
    page = F.expr(f"(place - 1) div {size} + 1")
    return n.groupBy("word", page.alias("page")).agg(F.count("*").alias("n_examples"), ids.alias("ex_ids"))
