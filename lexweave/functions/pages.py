"""Text of book pages taken apart: questions, choices, answer keys, explanations, word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import BLANK, POS_SHORT
from .text import escape_html, fix_answer, strip

_HANGUL = "[\\x{AC00}-\\x{D7A3}]+"


def clean_page(raw: Column) -> Column:
    """Page text without footer lines, its blanks in one form."""
    body = F.regexp_replace(raw, r"(?im)^\s*(?:go on to the next page.*|page \d+ of \d+|[-—] ?\d{1,4} ?[-—])\s*$\n?", "")
    return F.regexp_replace(body, r"-{3,}|/{3,}|_{3,}", BLANK)


def flat_question(raw: Column) -> Column:
    """A question in one line; an empty line within it stands for the blank."""
    gap = F.regexp_replace(raw, r"(?:[ \t]*\n){2,}", f" {BLANK} ")
    return F.trim(F.regexp_replace(F.regexp_replace(gap, r"\s*\n\s*", " "), " {2,}", " "))


def question_blocks(page: Column) -> Column:
    """Array of (number, body) for the questions 101 to 200 of a page, in order."""
    marked = F.regexp_replace(page, r"(?<!\d)(1\d\d|200)\.\s+", "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01"), lambda p: p.contains("\x02"))
    return F.transform(parts, lambda p: F.struct(F.split(p, "\x02")[0].cast("int").alias("number"), F.split(p, "\x02")[1].alias("body")))


def question_text(body: Column) -> Column:
    """What stands before the first choice."""
    return flat_question(F.split(body, r"\(A\)", 2)[0])


def choice(body: Column, label: str) -> Column:
    """Text of a choice up to the next label or the end; null if there is none."""
    after = chr(ord(label) + 1)
    found = F.regexp_extract(body, rf"(?s)\({label}\)\s*(.*?)\s*(?:\({after}\)|$)", 1)
    return F.nullif(strip(found), F.lit(""))


def choices(body: Column) -> Column:
    """Map of the labels A to D; labels without text are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), choice(body, k).alias("v")) for k in "ABCD"))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def answer_entries(page: Column) -> Column:
    """Array of (number, answer) of an answer-key page, misread letters put right."""
    joined = F.regexp_replace(page, r"(\d{2})\s(\d)\s*\(", "$1$2 (")
    found = F.regexp_extract_all(joined, F.lit(r"\d{3}\s*\([A-D08}{|l]+\)?"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"(\d{3})", 1).cast("int").alias("number"), fix_answer(F.regexp_extract(x, r"\(([A-D08}{|l]+)", 1)).alias("answer")))


def explanation_sections(raw: Column) -> Column:
    """(category, explanation, translation, vocabulary) of a labelled block.

    A fold over the lines: the first line is the category, a line that begins
    with a label changes the section, every other line goes to the current one.
    Null where no section holds text.
    """
    labels = (("해설", "explanation"), ("번역", "translation"), ("어휘", "vocabulary"))
    names = ["category", "explanation", "translation", "vocabulary"]
    lines = F.filter(F.transform(F.split(raw, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^(?:TEST\s*\d|동영상\s*강의)"))
    start = F.struct(F.lit("").alias("at"), *(F.lit("").alias(n) for n in names))

    def step(acc, line):
        at = F.when(acc["at"] == "", "category")
        for word, name in labels:
            at = at.when(line.startswith(word), name)
        at = at.otherwise(acc["at"])
        label = (acc["at"] != "") & line.rlike("^(?:해설|번역|어휘)")
        rest = F.when(label, strip(F.substring(line, 3, 1_000_000))).otherwise(line)
        return F.struct(at.alias("at"), *(F.when(at == n, F.trim(F.concat_ws(" ", acc[n], rest))).otherwise(acc[n]).alias(n) for n in names))

    out = F.aggregate(lines, start, step)
    return F.when(F.concat(out["explanation"], out["translation"], out["vocabulary"]) != "", F.struct(*(F.regexp_replace(out[n], r"\s{2,}", " ").alias(n) for n in names)))


def word_list_line(line: Column) -> Column:
    """(word, pos, meaning) of a word-list line: a mark, one to four words, a part of
    speech if any, Hangul; null for other lines."""
    m = r"^[^A-Za-z]*(?:[OD] +)?([A-Za-z][A-Za-z'\- ]*?)(?:\s+(n|v|adj|adv|ad|a|prep|conj|phr)\.?)?\s+([^A-Za-z]*[\x{AC00}-\x{D7A3}].*)$"
    word = F.trim(F.regexp_extract(line, m, 1))
    short = F.regexp_extract(line, m, 2)
    pos = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in POS_SHORT.items() for x in (k[:-1], v))), short), F.lit(""))
    meaning = F.array_join(F.regexp_extract_all(F.regexp_extract(line, m, 3), F.lit(f"({_HANGUL})"), F.lit(1)), ", ")
    ok = (F.length(word) >= 2) & (F.size(F.split(word, " +")) <= 4) & (F.length(line) >= 5)
    return F.when(ok, F.struct(word.alias("word"), pos.alias("pos"), meaning.alias("meaning")))


def is_headword(line: Column) -> Column:
    """A line that begins an entry: a letter first, little Hangul, two Latin letters, no pronunciation."""
    bare = strip(F.regexp_replace(line, r"[*★]+", ""))
    hangul = F.length(F.regexp_replace(bare, "[^\\x{AC00}-\\x{D7A3}]", ""))
    latin = F.length(F.regexp_replace(bare, "[^A-Za-z]", ""))
    return bare.rlike("^[A-Za-z]") & (hangul <= F.length(bare) * 0.3) & (latin >= 2) & ~line.rlike(r"\[[^\]]+\]")


def is_comic_page(page: Column) -> Column:
    """Fewer than five lines with text, or no headword line."""
    lines = F.filter(F.split(page, "\n"), lambda x: strip(x) != "")
    return (F.size(lines) < 5) | ~F.exists(lines, is_headword)


def star_tier(line: Column) -> Column:
    """Frequency of a line by its stars, the most first; '' for none."""
    return F.when(line.rlike(r"★{3}|\*{3}"), "★★★").when(line.rlike(r"★{2}|\*{2}"), "★★").when(line.rlike(r"★|\*"), "★").otherwise("")


def page_day(page: Column) -> Column:
    """Day in the first five lines of a page, null if none."""
    head = F.array_join(F.slice(F.split(page, "\n"), 1, 5), "\n")
    return F.nullif(F.regexp_extract(head, r"(?i)\bday\s*0*(\d{1,2})\b", 1), F.lit("")).cast("int")


def page_topic(page: Column) -> Column:
    """The Hangul word (2 to 10 letters) in the line nearest to the line of the day, upper lines first."""
    lines = F.split(page, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)\bday\s*\d")), True)
    words = F.flatten(
        F.transform(
            lines,
            lambda x, i: F.transform(
                F.filter(F.regexp_extract_all(x, F.lit(f"({_HANGUL})"), F.lit(1)), lambda w: F.length(w).between(2, 10)),
                lambda w: F.struct(F.abs(i + 1 - at).alias("d"), i.alias("i"), w.alias("w")),
            ),
        )
    )
    near = F.array_min(F.filter(words, lambda s: s["d"] <= 5))
    return F.when(at > 0, near["w"])


def filled_html(sentence: Column, answer: Column) -> Column:
    """Escaped sentence with its first blank, in whatever form, as the answer in bold;
    the answer in brackets behind it if there is no blank."""
    text = escape_html(F.regexp_replace(F.regexp_replace(sentence, r"\^s ", "'s "), r"\^ ", "'s "))
    mark = F.concat(F.lit("<b>"), escape_html(answer), F.lit("</b>"))
    out = F.concat(text, F.lit(" [→ "), mark, F.lit("]"))
    for blank in reversed(["-------", "—■", "——", "........", "—"]):
        at = F.instr(text, blank)
        filled = F.concat(F.substring(text, F.lit(1), at - 1), mark, F.substring(text, at + len(blank), F.length(text)))
        out = F.when(at > 0, F.regexp_replace(F.regexp_replace(filled, r"(\S)(<b>)", "$1 $2"), r"(</b>)(\S)", "$1 $2")).otherwise(out)
    return out


def fenced_json(reply: Column, schema: str) -> Column:
    """JSON out of a reply with a code fence or words around it; null if there is none."""
    found = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(found != "", F.from_json(found, schema))
