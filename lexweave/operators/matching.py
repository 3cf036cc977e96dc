"""Words and phrases found in sentences through joins with a dictionary of forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import morph
from ..functions.lexicon import PATTERN_MARKERS, PHRASE_PREPOSITIONS, PHRASE_STOP_WORDS, PLACEHOLDERS
from ..session import materialise
from .salted import word_key


def vocabulary_words(vocab: DataFrame) -> DataFrame:
    """(word, first_id): distinct words and phrases of the vocabulary."""
    return vocab.select(word_key(F.col("word")).alias("word"), "id").where("word <> ''").groupBy("word").agg(F.min("id").alias("first_id"))


def word_forms(words: DataFrame) -> DataFrame:
    """(form, word, first_id): the family of each single word."""
    return words.where("word rlike '^[a-z]+$'").select(F.explode(morph.family(F.col("word"))).alias("form"), "word", "first_id")


def token_rows(sentences: DataFrame, pattern: str = "[a-zA-Z]+", least: int = 3) -> DataFrame:
    """The columns of ``sentences`` but its text, with pos and token."""
    keep = [c for c in sentences.columns if c != "sentence"]
    found = F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))
    return sentences.select(*keep, F.posexplode(found).alias("pos", "token")).where(F.length("token") >= least)


def probe_keys(tokens: DataFrame) -> DataFrame:
    """One row per token and key: the token in lower case, and its lemma if another."""
    low = F.lower("token")
    return tokens.withColumn("form", F.explode(F.array_distinct(F.array(low, morph.lemma(low)))))


def probe_all(sentences: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, word, token): each word once per sentence, with the first token that matched.

    The dictionary's size decides at run time whether it is broadcast.
    """
    hits = probe_keys(token_rows(sentences)).join(forms, "form")
    return hits.groupBy("id", "word").agg(F.min_by("token", "pos").alias("token"))


def fields(questions: DataFrame) -> DataFrame:
    """(id, label, answer, sentence): the sentence as '_', then the choices."""
    labelled = F.array(F.struct(F.lit("_").alias("l"), F.col("sentence").alias("t")), *(F.struct(F.lit(k).alias("l"), F.col("choices")[k].alias("t")) for k in "ABCD"))
    return questions.select("id", "answer", F.explode(labelled).alias("x")).select("id", F.col("x.l").alias("label"), "answer", F.col("x.t").alias("sentence"))


def probe_per_field(questions: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, id, label, token, as_answer): each word once per question and field."""
    hits = probe_keys(token_rows(fields(questions))).join(forms, "form")
    out = hits.groupBy("word", "id", "label").agg(F.min_by("token", "pos").alias("token"), F.first("answer").alias("answer"))
    return out.select("word", "id", "label", "token", F.coalesce(F.col("label") == F.upper("answer"), F.lit(False)).alias("as_answer"))


def first_owner(forms: DataFrame) -> DataFrame:
    """(form, word): each form belongs to the word that came first."""
    return forms.groupBy("form").agg(F.min_by("word", F.struct("first_id", "word")).alias("word"))


def inverted_index(forms: DataFrame) -> DataFrame:
    """(form, n_words, words)."""
    return forms.groupBy("form").agg(F.count_distinct("word").alias("n_words"), F.array_join(F.array_sort(F.collect_set("word")), ",").alias("words"))


# -- phrases ---------------------------------------------------------------


def phrase_tokens(words: DataFrame) -> DataFrame:
    """(phrase, type, idx, t, role): the tokens of each phrase and what they stand for."""
    p = words.where("word like '% %'").select(F.col("word").alias("phrase"), morph.phrase_type(F.col("word")).alias("type"))
    clean = F.trim(F.regexp_replace("phrase", r"\bto\s+do\b", ""))
    rows = p.select("phrase", "type", F.posexplode(F.regexp_extract_all(clean, F.lit("[a-zA-Z']+"), F.lit(0))).alias("idx", "t"))
    role = (
        F.when(F.col("t").isin(*PLACEHOLDERS), "placeholder")
        .when(F.col("t").isin(*PATTERN_MARKERS), "marker")
        .when(F.col("t").isin(*PHRASE_STOP_WORDS) & ~F.col("t").isin(*PHRASE_PREPOSITIONS), "marker")
        .otherwise("content")
    )
    return rows.withColumn("role", role)


def phrase_specs(tokens: DataFrame) -> DataFrame:
    """(phrase, k, n_ph, max_span): families to find, mandatory placeholders, greatest span or null."""
    content = F.col("role") == "content"
    short_prep = content & F.col("t").isin(*PHRASE_PREPOSITIONS) & (F.length("t") <= 3)
    s = tokens.groupBy("phrase", "type").agg(F.count_if(content).alias("k"), F.count_if(F.col("role") == "placeholder").alias("ph"), F.count_if(short_prep).alias("preps"))
    span = F.when(F.col("type") == "TYPE_E_NOUN_PHRASE", F.col("k")).when((F.col("k") <= 3) & (F.col("preps") > 0), F.col("k") + 1)
    need = F.col("type").isin("TYPE_A_BE", "TYPE_B_ONESELF")
    return s.where("k > 0").select("phrase", "k", F.when(need, F.col("ph")).otherwise(F.lit(0)).alias("n_ph"), span.alias("max_span"))


def phrase_forms(tokens: DataFrame) -> DataFrame:
    """(form, t, role): every form that a phrase's token may take."""
    ph = F.element_at(F.create_map(*(x for k, v in PLACEHOLDERS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("t"))
    forms = F.when(F.col("role") == "placeholder", ph).when(F.length("t") < 3, F.array("t")).otherwise(morph.family(F.col("t")))
    return tokens.where("role <> 'marker'").select("t", "role").distinct().select(F.explode(forms).alias("form"), "t", "role").distinct()


def verified_phrases(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """(id, phrase): sentences in which all of a phrase's families occur, its
    mandatory placeholders too, and the first places lie within its span.

    What is kept of a sentence are the first places of the words that phrases
    are made of. A sentence and a phrase meet where the sentence has the
    phrase's two rarest words, so no frequent word brings all its phrases to
    all its sentences; the other words are then looked up in the same row.
    The phrases' tables are stored: while they are small they are broadcast,
    and the sentences' words are never shuffled for them.
    """
    toks = phrase_tokens(words)
    t = token_rows(sentences, "[a-zA-Z']+", 1).select("id", "pos", F.lower("token").alias("token"))
    forms = materialise(phrase_forms(toks), "phrase-forms")
    keys = t.select("id", "pos", F.explode(F.array_distinct(F.array(F.struct(F.col("token").alias("form"), F.lit(True).alias("surface")), F.struct(morph.lemma(F.col("token")).alias("form"), F.lit(False).alias("surface"))))).alias("k"))
    found = keys.select("id", "pos", "k.form", "k.surface").join(forms, "form").where((F.col("role") == "content") | F.col("surface"))
    places = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("t", "pos"))).alias("h"))
    first = F.filter("h", lambda x, i: (i == 0) | (F.get("h", i - 1)["t"] != x["t"]))
    places = materialise(places.select("id", first.alias("h")), "phrase-places")  # read twice

    counts = places.select(F.explode("h.t").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    content = toks.where("role = 'content'").select("phrase", "t").distinct().join(counts, "t", "left")
    # a word that stands nowhere is the rarest: its phrase meets no sentence
    rare = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")))
    named = content.groupBy("phrase").agg(rare.alias("r")).select("phrase", F.col("r.t").alias("ts"))
    a, b = F.get("ts", F.lit(0)), F.coalesce(F.get("ts", F.lit(1)), F.get("ts", F.lit(0)))
    others = toks.where("role = 'placeholder'").groupBy("phrase").agg(F.collect_set("t").alias("ph"))
    need = F.when(F.col("n_ph") > 0, F.col("ph")).otherwise(F.array().cast("array<string>"))
    specs = phrase_specs(toks).join(named, "phrase").join(others, "phrase", "left").select(F.xxhash64(F.least(a, b), F.greatest(a, b)).alias("key"), "phrase", "ts", need.alias("ph"), "max_span")
    specs = materialise(specs, "phrase-specs")
    known = materialise(specs.select("key").distinct(), "phrase-keys")

    # each pair of words of a sentence, which are in order, and each word by itself
    pairs = F.flatten(F.transform("h.t", lambda x, i: F.transform(F.slice("h.t", i + 1, F.size("h")), lambda y: F.xxhash64(x, y))))
    met = places.select("id", "h", F.explode(pairs).alias("key")).join(known, "key", "left_semi").join(specs, "key")
    at = F.transform("ts", lambda x: F.element_at("m", x))
    rows = met.withColumn("m", F.map_from_entries("h")).withColumn("at", at)
    whole = F.forall("at", lambda x: x.isNotNull()) & F.forall("ph", lambda x: F.map_contains_key("m", x))
    return rows.where(whole & (F.col("max_span").isNull() | (F.array_max("at") - F.array_min("at") <= F.col("max_span")))).select("id", "phrase")
