"""Sampling, distractors, grading and study lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, text
from ..functions.lexicon import POOLED_CATEGORIES
from .patches import ranked_within


def stable_order(*parts: Column | str) -> Column:
    """Pseudo-random order that is the same in every run (and every engine)."""
    return F.md5(F.concat_ws("|", *parts))


def allocation(sizes: DataFrame, count: int, pooled: list[str] = POOLED_CATEGORIES) -> DataFrame:
    """(category, size, alloc): how many of ``count`` rows each category gives.

    ``sizes`` has a row per category (category, size). One row comes from the
    pooled rare categories together, the others share the rest in proportion,
    rounded half to even, at least one and at most their size; what is over or
    missing is settled from the largest category down. The windows run over as
    many rows as there are categories.
    """
    rare = F.col("category").isin(*pooled)
    flex = sizes.where(~rare)
    has_rare = sizes.where(rare).agg(F.least(F.count("*"), F.lit(1))).scalar()
    every = Window.partitionBy()
    n = F.lit(count) - has_rare
    base = flex.withColumn("n", n).withColumn(
        "alloc", F.least(F.col("size"), F.greatest(F.lit(1), F.bround(F.col("size") * F.col("n") / F.sum("size").over(every)).cast("bigint")))
    )
    largest = Window.partitionBy().orderBy(F.desc("size"), "category")
    before = largest.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("n") - F.sum("alloc").over(every)
    base = base.withColumn("gap", gap).withColumn("room", F.when(F.col("gap") > 0, F.col("size") - F.col("alloc")).otherwise(F.col("alloc") - 1))
    used = F.coalesce(F.sum("room").over(before), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("room"), F.abs("gap") - used))
    settled = base.select("category", "size", (F.col("alloc") + F.when(F.col("gap") > 0, take).otherwise(-take)).cast("bigint").alias("alloc"))
    first_rare = F.row_number().over(Window.partitionBy().orderBy("category")) == 1
    rares = sizes.where(rare).select("category", "size", F.when(first_rare, 1).otherwise(0).cast("bigint").alias("alloc"))
    return settled.unionByName(rares)


def category_sizes(questions: DataFrame) -> DataFrame:
    return questions.groupBy(classify.classify_choices(F.col("choices")).alias("category")).agg(F.count("*").alias("size"))


def stratified_sample(questions: DataFrame, count: int, seed: str = "7") -> DataFrame:
    """(category, id): the allocated number of questions of each category in the stable order."""
    q = questions.select("id", classify.classify_choices(F.col("choices")).alias("category"))
    plan = allocation(category_sizes(questions), count).where("alloc > 0").select("category", "alloc")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(stable_order("id", F.lit(seed)), "id"))
    return q.join(F.broadcast(plan), "category").withColumn("r", rank).where(F.col("r") <= count).where("r <= alloc").select("category", "id")  # a row per category


def balanced_sample(vocab: DataFrame, count: int, seed: str = "7") -> DataFrame:
    """(id, day, filled): ``count`` entries, as many per day as divide evenly, the rest from what remains."""
    v = vocab.select("id", F.coalesce("day", F.lit(0)).alias("day"), stable_order("id", F.lit(seed)).alias("o"))
    days = v.agg(F.count_distinct("day")).scalar()
    per_day = F.greatest(F.lit(1), F.floor(F.lit(count) / days))
    # no day gives more than ``count`` rows, so no more of them leave a task
    ranked = v.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy("o", "id"))).where(F.col("r") <= count).withColumn("rest", (F.col("r") > per_day).cast("int"))
    return ranked.orderBy("rest", "o", "id").limit(count).select("id", "day", (F.col("rest") == 1).alias("filled"))


def distractors(vocab: DataFrame, k: int = 3) -> DataFrame:
    """(id, place, distractor): k other senses of the same part of speech.

    The pool of a part of speech is laid out as a ring in the stable order,
    and each sense takes those that follow it, so there is no pairing of all
    with all. Pools of k senses or fewer give what they have.
    """
    pos = F.coalesce(F.get(classify.pos_list(F.col("pos")), 0), F.lit("none"))
    pool = vocab.where("meaning_kr is not null").groupBy(text.first_sense(F.col("meaning_kr")).alias("sense")).agg(F.min(F.struct("id", pos.alias("pos"))).alias("m"))
    pool = pool.select("sense", F.col("m.id").alias("id"), F.col("m.pos").alias("pos"))
    sizes = pool.groupBy("pos").agg(F.count("*").alias("size"))  # one row per part of speech
    placed = ranked_within(pool, "pos", [stable_order("id", "sense"), F.col("id")], "r").join(F.broadcast(sizes), "pos")
    wants = placed.select("id", "pos", "size", "r", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("place")).where("place < size")
    wants = wants.withColumn("at", F.pmod(F.col("r") - 1 + F.col("place"), F.col("size")) + 1)
    other = placed.select("pos", F.col("r").alias("at"), F.col("sense").alias("distractor"))
    return wants.join(other, ["pos", "at"]).select("id", F.col("place").cast("bigint").alias("place"), "distractor")


def permuted_options(questions: DataFrame, seed: str = "7") -> DataFrame:
    """(id, options, new_answer): choices in the stable order, and the label the answer has now."""
    entries = F.filter(F.map_entries("choices"), lambda e: e["key"].isin(*"ABCD"))
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct(F.md5(F.concat_ws("|", F.col("id"), e["key"], F.lit(seed))).alias("o"), e["key"].alias("k"), e["value"].alias("v"))))
    at = F.array_position(F.transform(keyed, lambda e: e["v"]), F.col("choices")[F.col("answer")])
    return questions.where("answer is not null").select(
        "id", F.array_join(F.transform(keyed, lambda e: e["v"]), "|").alias("options"), F.when(at > 0, F.substring(F.lit("ABCD"), at.cast("int"), F.lit(1))).alias("new_answer")
    )


def responses(events: DataFrame, threshold: float = 20.0) -> DataFrame:
    """(user_id, category, at, is_correct) of exam events; a null value is wrong."""
    return events.select("user_id", F.col("event_type").alias("category"), F.col("ts").alias("at"), F.coalesce(F.col("value") >= threshold, F.lit(False)).alias("is_correct"))


def grades(rows: DataFrame, *by: str) -> DataFrame:
    """(by, total, correct, rate): rate in percent with one decimal."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct")).withColumn("rate", F.round(F.col("correct") * 1000.0 / F.col("total")) / 10)


def weak(graded: DataFrame, threshold: float) -> DataFrame:
    """Groups below the threshold, worst first; a missing rate counts as 100."""
    return graded.where(F.coalesce("rate", F.lit(100.0)) < threshold)


def study_documents(weak_rows: DataFrame, topics: dict[str, list[str]], documents: DataFrame) -> DataFrame:
    """(category, topic_rank, doc_id): documents of each weak category's topics, empty ones left out."""
    rows = [(c, i, t) for c, ts in topics.items() for i, t in enumerate(ts, 1)]
    mapping = documents.sparkSession.createDataFrame(rows, "category string, topic_rank long, topic string")
    topic = F.regexp_extract("source", "_([a-z]+)$", 1)
    docs = documents.where(text.strip(F.coalesce("text", F.lit(""))) != "").select("doc_id", topic.alias("topic"))
    return weak_rows.join(F.broadcast(mapping), "category").join(docs, "topic").select("category", "topic_rank", "doc_id")  # the mapping is a parameter


def sittings(rows: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, sitting, n, correct): responses of a user less than a gap apart."""
    w = Window.partitionBy("user_id").orderBy("at")
    new = (F.col("at").cast("timestamp").cast("long") - F.lag(F.col("at").cast("timestamp").cast("long")).over(w) > gap_minutes * 60).cast("int")
    s = rows.withColumn("_n", F.coalesce(new, F.lit(0))).withColumn("sitting", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "sitting").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct"))


def chosen(rows: DataFrame, **allowed: list | None) -> DataFrame:
    """Rows whose columns have one of the allowed values; None means any, null values fall out."""
    for column, values in allowed.items():
        if values is not None:
            rows = rows.where(F.col(column).isin(*values))
    return rows


def wrong_answers(rows: DataFrame, category: str | None = None) -> DataFrame:
    """Answers that are wrong; a missing mark counts as right."""
    wrong = rows.where(~F.coalesce("is_correct", F.lit(True)))
    return wrong if category is None else wrong.where(F.col("category") == category)


def exam_payload(questions: DataFrame) -> DataFrame:
    """(id, payload): each question as the JSON that an exam page embeds; null fields are left out."""
    fields = F.struct("id", "sentence", "choices", "answer", classify.classify_choices(F.col("choices")).alias("category"), "volume", "test", "question_number")
    return questions.select("id", F.to_json(fields).alias("payload"))


def graded_sheet(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(category, total, correct, rate) of (id, user_answer) rows; a question without an answer is wrong."""
    q = questions.where("answer is not null").select("id", "answer", classify.classify_choices(F.col("choices")).alias("category"))
    given = answers.groupBy("id").agg(F.max("user_answer").alias("user_answer"))
    return grades(q.join(given, "id", "left").withColumn("is_correct", F.coalesce(F.col("answer") == F.col("user_answer"), F.lit(False))), "category")
