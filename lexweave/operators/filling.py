"""Blanked sentences: examples from a search, patches that fill them, answers and corrections merged by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, text
from ..functions.lexicon import BLANK
from ..session import materialise
from . import matching


def source_text(volume: Column, test: Column, number: Column) -> Column:
    """A question's source as it is written: ``Vol 3, TEST 07, Q.115``."""
    return F.format_string("Vol %d, TEST %02d, Q.%d", volume, test, number)


def searched_examples(questions: DataFrame, forms: DataFrame, filled: bool = True) -> DataFrame:
    """Examples of words in questions: (word, idx, question_id, sentence, source, volume, test, question_number, part, matched_form).

    A sentence is searched with its answer in the blank, once per word, by the
    first token that matches; it comes out so, or with its blank if not
    ``filled``. ``idx`` counts each word's examples from 0 by question id.
    Questions without a sentence give none; without an answer the blank stays.
    """
    answer = F.coalesce(F.col("choices")[F.col("answer")], F.lit(BLANK))
    q = questions.where("sentence is not null").withColumn("_full", text.fill_first(F.col("sentence"), answer))
    hits = matching.probe_all(q.select("id", F.col("_full").alias("sentence")), forms)
    both = hits.join(q.select("id", F.col("_full" if filled else "sentence").alias("sentence"), "volume", "test", "question_number"), "id")
    idx = F.row_number().over(Window.partitionBy("word").orderBy("id")) - 1
    return both.select(
        "word", idx.cast("bigint").alias("idx"), F.col("id").alias("question_id"), "sentence",
        source_text(F.coalesce("volume", F.lit(0)), F.coalesce("test", F.lit(0)), F.coalesce("question_number", F.lit(0))).alias("source"),
        "volume", "test", "question_number", F.lit(5).alias("part"), F.col("token").alias("matched_form"),
    )


def answer_keys(questions: DataFrame) -> DataFrame:
    """(key, answer, question_id): normalised blanked sentences and what fills them; of equal sentences the first question's."""
    usable = questions.where("sentence is not null and answer is not null and map_contains_key(choices, answer)")
    rows = usable.where(F.col("sentence").contains(BLANK)).select(text.fuzzy_key(F.col("sentence")).alias("key"), F.col("choices")[F.col("answer")].alias("answer"), F.col("id").alias("question_id"))
    return rows.groupBy("key").agg(F.min_by("answer", "question_id").alias("answer"), F.min("question_id").alias("question_id"))


def nominated_pairs(needles: DataFrame, bodies: DataFrame, block: int = 6) -> DataFrame:
    """(needle, body): pairs of texts (id, key) that may contain one another, by hashes alone.

    A needle is named by ``block`` words in a row, or all of a shorter one: by
    those of them that the fewest bodies hold, so what many texts begin with
    brings nothing together. Needles have one key for an id.
    """
    none = F.array().cast("array<bigint>")

    def runs(w: Column, n: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(none)

    # the words of a text are cut once, as a variable
    runs_of = lambda f: F.explode(F.transform(F.array(F.split("key", " ")), lambda w: F.array_distinct(f(w)))[0]).alias("_b")
    size = lambda w: F.least(F.size(w), F.lit(block))
    sizes = sorted(r["g"] for r in needles.select(size(F.split("key", " ")).alias("g")).distinct().collect())  # at most ``block`` numbers
    grams = bodies.where("key <> ''").select(F.col("id").alias("body"), runs_of(lambda w: F.concat(none, *(runs(w, F.lit(g)) for g in sizes))))
    grams = materialise(grams, "body-runs")  # read twice
    counts = grams.groupBy("_b").agg(F.count("*").alias("n"))
    # words that stand nowhere are the rarest: their needle meets no body
    asked = needles.select(F.col("id").alias("needle"), runs_of(lambda w: runs(w, size(w)))).join(counts, "_b", "left")
    rarest = asked.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_b")).alias("r")).where("r.n > 0").select("needle", "r._b")
    return grams.join(rarest, "_b").select("needle", "body")


def contained_pairs(needles: DataFrame, bodies: DataFrame, block: int = 6) -> DataFrame:
    """(needle, body): ids of normalised texts (id, key) whose words stand in a row inside another's.

    Only pairs that ``nominated_pairs`` names are fetched and compared. Null and empty needles stand in nothing.
    """
    one = F.unhex(F.md5(F.concat_ws("\u0001", F.length("key"), "key", F.col("id").cast("string"))))
    own = needles.where("id is not null and key <> ''").select(F.col("id").alias("needle"), F.col("key").alias("needle_key"), one.alias("_n")).distinct()
    own = materialise(own, "needles")  # read three times
    met = nominated_pairs(own.select(F.col("_n").alias("id"), F.col("needle_key").alias("key")), bodies, block).withColumnRenamed("needle", "_n")
    texts = met.join(own, "_n").join(bodies.select(F.col("id").alias("body"), F.col("key").alias("body_key")), "body")
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return texts.where(padded(F.col("body_key")).contains(padded(F.col("needle_key")))).select("needle", "body").distinct()


def fill_patches(examples: DataFrame, answers: DataFrame) -> DataFrame:
    """(word, idx, new_sentence, how): patches that put the answer, in emphasis, into the first blank of an example.

    An example finds its answer by its normalised text (``exact``), else by the
    first question, by id, whose text contains it or stands in it
    (``contained``). Examples without a blank, or that nothing fits, get none.
    """
    blanked = examples.where(F.col("sentence").contains(BLANK)).select("word", "idx", "sentence", text.fuzzy_key(F.col("sentence")).alias("key"))
    texts = blanked.select("key").distinct()  # an example stands under many words
    exact = texts.join(answers, "key").select("key", "answer", F.lit("exact").alias("how"))
    rest = texts.join(answers, "key", "left_anti").select(F.col("key").alias("id"), "key")
    known = answers.select(F.col("question_id").alias("id"), "key")
    pairs = contained_pairs(known, rest).select(F.col("body").alias("key"), F.col("needle").alias("question_id")).unionByName(
        contained_pairs(rest, known).select(F.col("needle").alias("key"), F.col("body").alias("question_id"))
    )
    first = pairs.groupBy("key").agg(F.min("question_id").alias("question_id"))
    close = first.join(answers.drop("key"), "question_id").select("key", "answer", F.lit("contained").alias("how"))
    found = blanked.join(exact.unionByName(close), "key")
    new = text.fill_first(F.replace("sentence", F.lit("**"), F.lit("")), F.concat(F.lit("**"), "answer", F.lit("**")))
    return found.select("word", "idx", new.alias("new_sentence"), "how")


def patched_examples(examples: DataFrame, patches: DataFrame) -> DataFrame:
    """(word, idx, sentence, patched): examples with their patches applied by word and index.

    Patches of indexes that aren't there are ignored; examples that still hold
    a blank are dropped, those after them keep their index.
    """
    both = examples.select("word", "idx", "sentence").join(patches.select("word", "idx", "new_sentence"), ["word", "idx"], "left")
    new = F.coalesce("new_sentence", "sentence")
    rows = both.select("word", "idx", new.alias("sentence"), F.col("new_sentence").isNotNull().alias("patched"))
    return rows.where(~F.coalesce(F.col("sentence").contains(BLANK), F.lit(False)))


def merged_answers(questions: DataFrame, key: DataFrame) -> DataFrame:
    """(id, answer, status): answers of a key (volume, test, question_number, answer) merged into questions.

    A question keeps the answer it has; else it takes the key's, if that is one
    of its choices. ``status`` is kept, filled, invalid or open. Of several
    answers of a key for one question the least counts.
    """
    by = ["volume", "test", "question_number"]
    once = key.where("answer is not null").groupBy(*by).agg(F.min(F.upper(F.trim("answer"))).alias("_key"))
    both = questions.select("id", *by, "answer", "choices").join(once, by, "left")
    valid = F.coalesce(F.array_contains(F.map_keys("choices"), F.col("_key")), F.lit(False))
    status = F.when(F.col("answer").isNotNull(), "kept").when(F.col("_key").isNull(), "open").when(valid, "filled").otherwise("invalid")
    return both.select("id", F.coalesce("answer", F.when(valid, F.col("_key"))).alias("answer"), status.alias("status"))


def corrected_pos(vocab: DataFrame, corrections: DataFrame) -> DataFrame:
    """(id, pos, status): parts of speech of entries after corrections (id, pos) that hold valid ones.

    ``pos`` is a comma-separated list; unknown names in a correction are left
    out, one without a valid name counts as missing. ``status`` is updated,
    unchanged (the same set) or missing (the entry keeps what it has).
    """
    listed = lambda c: F.array_sort(F.array_distinct(classify.pos_list(c)))
    new = corrections.select("id", listed(F.col("pos")).alias("_new")).where(F.size("_new") > 0).groupBy("id").agg(F.max("_new").alias("_new"))
    both = vocab.select("id", listed(F.col("pos")).alias("_old")).join(new, "id", "left")
    status = F.when(F.col("_new").isNull(), "missing").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("updated")
    return both.select("id", F.array_join(F.coalesce("_new", "_old"), ",").alias("pos"), status.alias("status"))


def choice_prefixes(questions: DataFrame, least: int = 4) -> DataFrame:
    """(id, prefix, n_sharers): the longest common prefix of a question's choices, and how
    many of them share ``least`` letters or more with another one."""
    c = F.transform(F.map_values("choices"), text.choice_text)
    q = questions.where("choices is not null").select("id", F.filter(c, lambda w: w.isNotNull()).alias("c"))
    short = F.coalesce(F.array_min(F.transform("c", F.length)), F.lit(0))
    same = lambda i: F.size(F.array_distinct(F.transform("c", lambda w: F.left(w, i)))) == 1
    shared = F.array_max(F.filter(F.sequence(F.lit(0), short), lambda i: (i == 0) | same(i)))
    heads = F.transform(F.filter("c", lambda w: F.length(w) >= least), lambda w: F.left(w, F.lit(least)))
    sharers = F.size(F.filter(heads, lambda h: F.size(F.filter(heads, lambda o: o == h)) > 1))
    return q.select("id", F.coalesce(F.left(F.col("c")[0], shared), F.lit("")).alias("prefix"), sharers.cast("bigint").alias("n_sharers"))
