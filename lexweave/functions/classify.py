"""Ordered rules: the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import AUXILIARIES, CATEGORY_KEYWORDS, COMPARATIVES, CONJUNCTIONS, OTHER_CATEGORY, POS_NAMES, POS_SHORT, PREPOSITIONS, PRONOUNS, RELATIVES
from .text import choice_text


def share_in(words: Column, members: list[str]) -> Column:
    """Share of an array's elements that are in a list; null for an empty array."""
    return F.size(F.filter(words, lambda w: w.isin(*members))) / F.nullif(F.size(words), F.lit(0))


def prefix_sharers(words: Column, length: int = 4) -> Column:
    """Number of elements that share their first letters with another one."""
    long = F.filter(words, lambda w: F.length(w) >= length)
    heads = F.transform(long, lambda w: F.left(w, F.lit(length)))
    return F.size(F.filter(heads, lambda h: F.size(F.filter(heads, lambda o: o == h)) >= 2))


def classify_choices(choices: Column) -> Column:
    """Grammar category of a question by its choices (a map of label to text)."""
    c = F.transform(F.map_values(choices), choice_text)
    has = lambda w, members: F.exists(F.split(w, " +"), lambda t: t.isin(*members))
    comparative = F.exists(c, lambda w: has(w, COMPARATIVES) | (F.length(w) > 4) & (w.endswith("er") | w.endswith("est")))
    tense = F.size(F.filter(c, lambda w: has(w, AUXILIARIES) | ~w.contains(" ") & (w.endswith("ed") | w.endswith("ing"))))
    return (
        F.when(choices.isNull() | (F.size(c) < 2), OTHER_CATEGORY)
        .when(share_in(c, PRONOUNS) >= 0.75, "대명사")
        .when((share_in(c, RELATIVES) >= 0.5) & (F.size(c) >= 3) & (F.size(F.filter(c, lambda w: w.isin(*RELATIVES))) >= 2), "관계대명사")
        .when(share_in(c, sorted({*PREPOSITIONS, *CONJUNCTIONS})) >= 0.75, "접속사/전치사")
        .when(comparative, "비교급/최상급")
        .when(prefix_sharers(c) >= 3, "품사")
        .when(tense >= 2, "동사시제/태")
        .otherwise("어휘")
    )


def normalise_category(raw: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Group of the first keyword that a label contains; the rest, and null, are other grammar."""
    out = None
    for name, words in (keywords or CATEGORY_KEYWORDS).items():
        for w in words:
            out = F.when(raw.contains(w), name) if out is None else out.when(raw.contains(w), name)
    return out.otherwise(OTHER_CATEGORY)


def pos_list(raw: Column) -> Column:
    """Parts of speech of a field that holds a name, an abbreviation, a JSON list or several; unknown ones fall out."""
    bare = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r'[\[\]"]', "")
    full = F.transform(F.split(bare, "[/,]"), lambda p: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in POS_SHORT.items() for x in kv)), F.trim(p)), F.trim(p)))
    return F.array_distinct(F.filter(full, lambda p: p.isin(*POS_NAMES)))
