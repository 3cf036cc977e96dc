"""Word forms: families, variants, fallback lemmas, phrase types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .lexicon import DEFAULT_ENDINGS, FAMILY_RULES, GLOSS_ADJECTIVE, GLOSS_ADJECTIVE_WEAK, GLOSS_NO_NOUN, GLOSS_POS, IRREGULAR, LEMMA_ENDINGS, LY_ADJECTIVES, MIN_STEM, PHRASE_STOP_WORDS, SUFFIX_POS, WORD_POS


def family(word: Column) -> Column:
    """Distinct forms of a word: itself and what the ending rules make of it, of three letters or more."""
    w = F.lower(word)
    parts = [F.array(w)]
    for suffix, endings in FAMILY_RULES:
        stem = F.substring(w, F.lit(1), F.length(w) - len(suffix)) if suffix else w
        forms = F.array(*(F.concat(stem, F.lit(e)) for e in endings))
        fits = (F.length(stem) >= MIN_STEM) & (w.endswith(suffix) if suffix else F.lit(True))
        parts.append(F.when(fits, forms).otherwise(F.array().cast("array<string>")))
    return F.when(F.length(w) >= MIN_STEM, F.filter(F.array_distinct(F.concat(*parts)), lambda f: F.length(f) >= MIN_STEM)).otherwise(F.array().cast("array<string>"))


def variants(word: Column) -> Column:
    """Variants: irregular forms, y to ies, dropped e, doubled consonant, plain endings."""
    w = F.lower(word)
    n = F.length(w)
    ends = lambda stem, es: F.array(*(F.concat(stem, F.lit(e)) for e in es.split()))
    none = F.array().cast("array<string>")
    stem = F.substring(w, F.lit(1), n - 1)
    last = F.right(w, F.lit(1))
    irregular = F.create_map(*(x for k, v in IRREGULAR.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    parts = [
        F.array(w),
        F.coalesce(F.element_at(irregular, w), none),
        F.when(w.rlike("[^aeiou]y$") & (n > 2), ends(stem, "ies ied ier iest")).otherwise(none),
        F.when(w.endswith("e") & (n > 2), ends(stem, "ing ed er est ion ions")).otherwise(none),
        F.when(w.rlike("[^aeiou][aeiou][^aeiouywh]$"), ends(F.concat(w, last), "ing ed er")).otherwise(none),
        ends(w, " ".join(DEFAULT_ENDINGS)),
    ]
    return F.array_distinct(F.concat(*parts))


def lemma(word: Column) -> Column:
    """Fallback lemma: the first ending of the list that leaves three letters or more is stripped."""
    w = F.lower(word)
    return reduce(
        lambda acc, e: F.when(w.endswith(e) & (F.length(w) - len(e) >= MIN_STEM), F.substring(w, F.lit(1), F.length(w) - len(e))).otherwise(acc),
        reversed(LEMMA_ENDINGS),
        w,
    )


def suffix_pos(word: Column) -> Column:
    """Part of speech by the first ending of the rule list, null if none fits."""
    w = F.lower(word)
    out = F.lit(None).cast("string")
    for s, pos in reversed(SUFFIX_POS):
        out = F.when(w.endswith(s) & (F.length(w) > len(s) + 2), F.lit(pos)).otherwise(out)
    return out


def gloss_pos(gloss: Column) -> Column:
    """Part of speech by the first pattern that the first sense of a Korean gloss shows, null if none."""
    sense = text.first_sense(gloss)
    out = F.lit(None).cast("string")
    for pos, pattern in reversed(GLOSS_POS):
        out = F.when(sense.rlike(pattern), pos).otherwise(out)
    return out


def decide_pos(word: Column, gloss: Column, tagged: Column | None = None) -> Column:
    """Part of speech of an entry from its word, its Korean gloss and, if there is one,
    a dictionary's tag (``tagged``), in this order: phrases by their gloss alone;
    words with a fixed part of speech; words in -ly; the gloss; endings and tags
    that agree with each other or with a gloss that may be a noun's; clear
    endings; the tag; any ending. What nothing tells is a noun; so is a null word.
    """
    w, sense = F.lower(text.strip(word)), F.coalesce(text.first_sense(gloss), F.lit(""))
    tag = F.lit(None).cast("string") if tagged is None else tagged
    by_gloss, by_end = gloss_pos(gloss), suffix_pos(w)
    adjective = sense.rlike(GLOSS_ADJECTIVE) | (F.length(sense) >= 2) & ~sense.endswith("다") & sense.rlike(GLOSS_ADJECTIVE_WEAK)
    told = F.when(by_gloss.isNotNull(), by_gloss).when(adjective, "adjective")
    noun = (sense != "") & ~sense.rlike(GLOSS_NO_NOUN)
    fixed = F.element_at(F.create_map(*(F.lit(x) for kv in WORD_POS.items() for x in kv)), w)
    by_form = (
        F.when(by_end == tag, by_end)
        .when(noun & ((by_end == "noun") | (tag == "noun") | by_end.isNull()), "noun")
        .when(by_end != "verb", by_end)
        .otherwise(F.coalesce(tag, by_end))
    )
    rules = (
        F.when(w.contains(" "), told)
        .when(fixed.isNotNull(), fixed)
        .when(w.endswith("ly") & (F.length(w) > 3), F.when(w.isin(*LY_ADJECTIVES), "adjective").otherwise("adverb"))
        .otherwise(F.coalesce(told, by_form))
    )
    return F.coalesce(rules, F.lit("noun"))


def phrase_type(phrase: Column) -> Column:
    """Type of a phrase, first rule first."""
    p = F.lower(phrase)
    words = F.split(F.trim(p), " +")
    return (
        F.when(p.startswith("be "), "TYPE_A_BE")
        .when(p.contains("oneself"), "TYPE_B_ONESELF")
        .when(p.contains("one's"), "TYPE_C_ONES")
        .when(p.contains(" to do"), "TYPE_D_TODO")
        .when((F.size(words) <= 3) & F.forall(words, lambda t: ~t.isin(*PHRASE_STOP_WORDS)), "TYPE_E_NOUN_PHRASE")
        .otherwise("TYPE_F_GENERAL")
    )
