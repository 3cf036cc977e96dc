"""Text functions, Column to Column, all in the JVM. Null gives null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import BLANK, GLYPHS, STOP_WORDS

WHITE = r"[ \t\n\r\x0B\f]"


def strip(text: Column | str) -> Column:
    """Without white space at either end (the look-behind keeps long runs linear)."""
    return F.regexp_replace(text, rf"^{WHITE}+|(?<!{WHITE}){WHITE}+$", "")


def collapse(text: Column | str) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{WHITE}+", " "))


def tokens(text: Column, pattern: str = "[a-zA-Z']+") -> Column:
    """Lower-case tokens in order; blanks of two hyphens or more separate."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "-{2,}", " "), F.lit(pattern), F.lit(0)), F.lower)


def content_tokens(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens longer than one character that aren't stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(*stop) & (F.length(t) > 1))


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences of ``least`` characters or more: split behind .!? before a capital, quote or bracket."""
    parts = F.split(collapse(text), r'(?<=[.!?])\s+(?=[A-Z"(])')
    return F.filter(parts, lambda s: F.length(s) >= least)


def dedupe_key(text: Column) -> Column:
    """Key of keep-first de-duplication: no emphasis, one blank, lower case."""
    return F.lower(collapse(F.regexp_replace(text, r"\*\*", "")))


def fuzzy_key(text: Column) -> Column:
    """Lower case, blanks marked, no emphasis, everything but letters and digits as one blank."""
    marked = F.regexp_replace(F.regexp_replace(F.lower(text), "-{3,}", "@@blank@@"), r"\*\*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(marked, r"[^a-z0-9@]+", " "), " +", " "))


def fill_first(text: Column, value: Column, blank: str = BLANK) -> Column:
    """First blank replaced by ``value``, taken literally; text without a blank stays."""
    at = F.instr(text, blank)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), value, F.substring(text, at + len(blank), F.length(text)))).otherwise(text)


def bold(text: Column, form: Column) -> Column:
    """All whole-word occurrences of an alphabetic form in emphasis, whatever their case."""
    return F.when(F.length(form) > 0, F.regexp_replace(text, F.concat(F.lit(r"(?i)\b("), form, F.lit(r")\b")), F.lit("**$1**"))).otherwise(text)


def unbold(text: Column) -> Column:
    return F.regexp_replace(text, r"\*\*(.+?)\*\*", "$1")


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def inline_html(text: Column) -> Column:
    """Escaped text with bold, italic, code and wiki links as HTML."""
    out = escape_html(text)
    for a, b in ((r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"\*([^*]+)\*", "<em>$1</em>"), (r"`([^`]+)`", "<code>$1</code>"), (r"\[\[([^\]|]+)\]\]", '<span class="wikilink">$1</span>')):
        out = F.regexp_replace(out, a, b)
    return out


def file_name(text: Column) -> Column:
    """Name usable for a file: forbidden characters as underscores, no outer dots or blanks."""
    return F.regexp_replace(F.lower(F.regexp_replace(strip(text), r'[<>:"/\\|?*]', "_")), r"^[. ]+|[. ]+$", "")


def first_sense(gloss: Column) -> Column:
    """First sense of a gloss: brackets removed, up to the first comma."""
    return F.trim(F.split(F.regexp_replace(gloss, r"\([^)]*\)", ""), ",")[0])


def choice_text(text: Column) -> Column:
    """Choice in lower case without outer blanks and final marks."""
    return F.regexp_replace(F.lower(strip(text)), "[.,;:]+$", "")


def is_corrupt(text: Column) -> Column:
    """Hangul, Han, interface symbols, box drawing, control characters, or three special characters in a row."""
    return text.rlike("[\\x{AC00}-\\x{D7AF}\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{2190}-\\x{21FF}\\x{25A0}-\\x{27BF}\\x{2500}-\\x{257F}\\x{00}-\\x{08}\\x{0E}-\\x{1F}]") | text.rlike(
        "[^A-Za-z0-9_\\s.,;:!?'\"()\\-/]{3,}"
    )


def repair(text: Column) -> Column:
    """Rule repair: known glyphs before a letter put right, symbols and Han removed, English before Hangul kept up to its
    last sentence end (beyond two fifths of it), stray marks at the end as a full stop."""
    out = text
    for glyph, letters in GLYPHS.items():
        out = F.regexp_replace(out, f"{glyph}([a-z])", f"{letters}$1")
    out = F.regexp_replace(out, "[\\x{2190}-\\x{21FF}\\x{25A0}-\\x{27BF}\\x{2500}-\\x{257F}\\x{00}-\\x{08}\\x{0E}-\\x{1F}]", "")
    head = F.trim(F.regexp_extract(out, "^([^\\x{AC00}-\\x{D7AF}]*)", 1))
    last = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?])", 1))
    english = F.when(F.length(head) <= 15, F.lit("")).when(last - 1 > F.length(head) * 0.4, F.substring(head, F.lit(1), last)).otherwise(head)
    out = F.when(out.rlike("[\\x{AC00}-\\x{D7AF}]"), english).otherwise(out)
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "[\\x{4E00}-\\x{9FFF}]", ""), "  +", " "))
    return F.trim(F.regexp_replace(out, r"[\s\-_=.]{3,}$", "."))


def split_explanation(text: Column) -> tuple[Column, Column, Column]:
    """(explanation, translation, vocabulary): parts behind the marks [번역] and [어휘]."""
    before_vocab = F.split(text, r"\[어휘\]", 2)
    vocab = F.when(F.size(before_vocab) > 1, strip(before_vocab[1]))
    before_tr = F.split(before_vocab[0], r"\[번역\]", 2)
    return strip(before_tr[0]), F.when(F.size(before_tr) > 1, strip(before_tr[1])), vocab


def fix_answer(raw: Column) -> Column:
    """Answer letters from misread ones: 8 is B, 0 is D, bars and brackets fall out."""
    return F.translate(raw, "80}{|l", "BD")
