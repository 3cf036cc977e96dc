"""Text cut off by field limits or in transfer (problem 7)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .scans import inspect_texts, learn_noise, scan_texts

#: A source's field limit is the length at which unlike open ends pile up: so
#: many times as many as at the lengths within ``LIMIT_SPAN`` of it, on average,
#: and ``LIMIT_LEAST`` at least.
LIMIT_PEAK = 10
LIMIT_SPAN = 10
LIMIT_LEAST = 5
#: A last word pair goes on to take new forms if more than this share of its
#: known longer ends stand alone (see ``learn_ends``): the next end is then
#: more likely new than known.
NEW_SHARE = 0.5
#: Where fewer than this share of a source's texts have a full stop, the lack
#: of one tells nothing.
STOPS_SHARE = 0.5

_CLOSERS = "\"'”’»」』)\\]*_"
#: Ends that need no second look: a full stop in any form, closing marks, blanks.
CLOSED = rf"[.!?。．！？][{_CLOSERS}]*\s*$"
ELLIPSIS = r"(?:…|\.{3,})\s*$"
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "‘": "’", "「": "」"}
_word = re.compile(r"[^\W\d_]+|\d+")


def cut_texts(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """(field_name, record_id, feed, text) of the fields that may be cut."""
    ex = entries.select("feed", F.explode("examples").alias("e")).select(
        F.lit("examples.sentence").alias("field_name"), F.col("e.ex_id").cast("string").alias("record_id"), "feed", F.col("e.sentence").alias("text")
    )
    tr = questions.select(F.lit("questions.translation").alias("field_name"), F.col("id").alias("record_id"), "feed", F.col("translation").alias("text"))
    return ex.unionByName(tr).where("text is not null and record_id is not null")


def open_end(text: Column) -> Column:
    """No full stop at the end, or an ellipsis. Blank texts have no end to lose."""
    open_ = lambda t: ~t.rlike(CLOSED) | t.rlike(ELLIPSIS)
    near = F.substring(text, -40, 40)
    # the end is in the last characters unless these are nothing but closing marks and blanks
    ended = F.when(near.rlike(rf"[{_CLOSERS}\s]{{30}}$"), open_(text)).otherwise(open_(near))
    return ended & (near.rlike(r"\S") | text.rlike(r"\S"))


_BRACKETS = "()[]{}“”「」‘"
_inner = rf"[^{re.escape(_BRACKETS)}]*+"
_CLOSED_PAIR = "|".join(re.escape(a) + _inner + re.escape(b) for a, b in _PAIRS.items() if a != "‘")


def may_be_unclosed(text: Column) -> Column:
    """Whether the automaton could find something open in a text with a full stop at
    its end: an opening mark outside plain pairs, or marks that pair with
    themselves in an odd number."""
    size = lambda mark, within: F.length(within) - F.length(F.replace(within, F.lit(mark), F.lit("")))
    opening = rf"[{re.escape(''.join(_PAIRS))}]"
    bracket = text.rlike(opening) & F.regexp_replace(text, _CLOSED_PAIR, "").rlike(opening)
    single = F.replace(text, F.lit("**"), F.lit(""))
    stars = text.contains("*") & ((size("**", text) % 4 != 0) | (size("*", single) % 2 != 0))
    return bracket | text.contains('"') & (size('"', text) % 2 != 0) | stars


def end_phrase(text: str) -> tuple[str, str]:
    """(the last four words, the last two), numbers made alike."""
    words = ["#" if w.isdigit() else w for w in _word.findall(text.lower())[-4:]]
    return " ".join(words), " ".join(words[-2:])


def _last_words(text: Column, n: int) -> Column:
    """The last ``n`` words in the JVM (letters and digits of any script), numbers made alike."""

    def words(part: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.lower(part), r"[^\p{L}\p{N}]+", " "))
        digits = lambda w: F.regexp_replace(F.regexp_replace(w, r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " "), r"\p{N}+", "#")
        return F.transform(F.array(bare), lambda w: F.when(w.rlike(r"\p{N}"), digits(w)).otherwise(w))[0]

    # a text of long words is read as a whole: the first word of its last stretch may be cut
    enough = lambda w: F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit(""))) >= n
    near = F.transform(F.array(words(F.substring(text, -64, 64))), lambda w: F.when(enough(w) | (F.length(text) <= 64), w).otherwise(words(text)))[0]
    return F.substring_index(near, " ", -n)


def unclosed(text: str) -> bool:
    """Stack automaton over brackets, paired quotes, emphasis and escapes: is anything
    still open at the end, or is a character broken off?"""
    stack: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("**", i):
            stack.pop() if stack and stack[-1] == "**" else stack.append("**")
            i += 2
            continue
        if c in _PAIRS:
            if not (c == "‘" and stack and stack[-1] == "’"):
                stack.append(_PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
        i += 1
    stack = [s for s in stack if s != "’"]
    if text.count('"') % 2 and not text.rstrip().endswith('"'):
        stack.append('"')
    broken = re.search(r"�$|\\u[0-9a-fA-F]{0,3}$|\\$|&[a-z]{1,6}$|&#\d*$|[\ud800-\udbff]$|<[a-z/]*$", text.rstrip())
    return bool(stack) or bool(broken) or text.replace("**", "").count("*") % 2 == 1


def stored_counts(texts: DataFrame) -> DataFrame:
    """(field_name, feed, open, len, text_hash, end, n): what is learned from all texts, counted in one pass."""
    is_open = open_end(F.col("text"))
    own = F.when(is_open, F.xxhash64("text"))
    end = F.when(~is_open, _last_words(F.col("text"), 6))
    rows = texts.select("field_name", "feed", is_open.alias("open"), F.when(is_open, F.length("text")).alias("len"), own.alias("text_hash"), end.alias("end"))
    return materialise(rows.groupBy("field_name", "feed", "open", "len", "text_hash", "end").agg(F.count("*").alias("n")), "p7-counts")


def learn_limits(counts: DataFrame) -> DataFrame:
    """(field_name, feed, limit): the field limit of the sources that have one."""
    lengths = counts.where("open").groupBy("field_name", "feed", "len").agg(F.count("*").alias("n"))  # unlike texts
    of_source = Window.partitionBy("field_name", "feed")
    around = of_source.orderBy("len").rangeBetween(-LIMIT_SPAN, LIMIT_SPAN)
    near = (F.sum("n").over(around) - F.col("n")) / (2 * LIMIT_SPAN)
    peak = F.row_number().over(of_source.orderBy(F.desc("n"), F.desc("len"))) == 1
    top = lengths.withColumns({"near": near, "peak": peak}).where("peak")
    return top.where((F.col("n") >= LIMIT_LEAST) & (F.col("n") >= LIMIT_PEAK * F.greatest("near", F.lit(0.5)))).select("field_name", "feed", F.col("len").alias("limit"))


def learn_stops(counts: DataFrame) -> DataFrame:
    """(field_name, feed, stops): the share of a source's texts that end with a full stop."""
    n = F.sum("n")
    return counts.groupBy("field_name", "feed").agg((F.coalesce(F.sum(F.when(~F.col("open"), F.col("n"))), F.lit(0)) / n).alias("stops"))


def learn_ends(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field_name, four) of all ends of closed texts, and (field_name, two, new_share) of their last pairs.

    Counted are unlike ends of six words, not texts, so copies of a text tell
    nothing and the measures don't grow with the corpus. ``new_share`` is the
    Good-Turing estimate that the next end with this pair has four words
    that weren't seen: the share of its longer ends that are the only one
    with their four words.
    """
    six = counts.where("not open").select("field_name", "end").distinct()
    last = lambda n: F.substring_index("end", " ", -n)
    fours = six.select("field_name", last(4).alias("four"), last(2).alias("two")).groupBy("field_name", "four", "two").agg(F.count("*").alias("k"))
    pairs = fours.groupBy("field_name", "two").agg((F.count_if(F.col("k") == 1) / F.sum("k")).alias("new_share"))
    return fours.select("field_name", "four"), pairs


#: What the end of a text tells by itself.
CUT, WHOLE, BY_PHRASE = 1, 0, 2


def judge(text: str, body: str) -> tuple[int, str | None, str | None]:
    """(verdict, last four words, last two) of a text and its continuous ``body``
    without page furniture. The phrases are given where they decide."""
    body = body.rstrip()
    if not body:
        return WHOLE, None, None
    dots = re.search(ELLIPSIS, body)
    stem = body[: dots.start()].rstrip() if dots else body
    if unclosed(stem):
        return CUT, None, None
    if not dots and re.search(CLOSED, body):
        return WHOLE, None, None
    if not dots and re.search(r"\w $", text):  # it stops at the blank before a next word
        return CUT, None, None
    if re.search(r"[.!?。]$", stem):
        return WHOLE, None, None
    return (CUT, None, None) if dots else (BY_PHRASE, *end_phrase(stem))


def find_cuts(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """(field_name, record_id, feed, is_cut) of the texts with an open end or anything to be left open.

    Only those leave the JVM. A text is cut if the automaton finds something
    in it still open, with or without a full stop at its end; if it has exactly
    its source's limit; or if it lacks the full stop that its source mostly
    sets and stops at words that no closed text of its field ends in. A whole
    sentence without its full stop ends in such words and is none. Null and
    blank texts are never cut.

    Phrases, limits and stops stay in tables: the open ends, which are few,
    are joined with them.
    """
    texts = cut_texts(entries, questions)
    counts = stored_counts(texts)
    learned = learn_noise(scan_texts(entries, questions))
    text = F.col("text")
    some = texts.select("*", open_end(text).alias("open")).where(F.col("open") | may_be_unclosed(text))
    some = materialise(some, "p7-open")  # told once, read three times

    def run(batches):
        for x in batches:
            if x.num_rows:
                cut = list(zip(x.column("text").to_pylist(), x.column("repaired").to_pylist()))
                size = pa.array([None if re.search(CLOSED, t) else len(t) for t, _ in cut], pa.int32())
                told = [pa.array(c, k) for c, k in zip(zip(*(judge(t, b) for t, b in cut)), (pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([x.column("field_name"), x.column("record_id"), x.column("feed"), size, *told], names=_JUDGED)

    judged = inspect_texts(some.where("open").drop("open"), learned).mapInArrow(run, "field_name string, record_id string, feed string, size int, told int, four string, two string").alias("j")
    fours, pairs = learn_ends(counts)
    source = lambda t: (F.col("j.field_name") == F.col(f"{t}.field_name")) & F.col("j.feed").eqNullSafe(F.col(f"{t}.feed"))
    phrase = lambda t, c: (F.col("j.field_name") == F.col(f"{t}.field_name")) & (F.col(f"j.{c}") == F.col(f"{t}.{c}"))
    rows = (
        judged.join(learn_limits(counts).alias("l"), source("l"), "left").join(learn_stops(counts).alias("s"), source("s"), "left")
        .join(fours.alias("f"), phrase("f", "four"), "left").join(pairs.alias("p"), phrase("p", "two"), "left")
    )
    strange = F.col("f.four").isNull() & (F.coalesce("p.new_share", F.lit(0.0)) <= NEW_SHARE) & (F.col("s.stops") >= STOPS_SHARE)
    is_cut = F.coalesce(F.col("j.size") == F.col("l.limit"), F.lit(False)) | (F.col("j.told") == CUT) | (F.col("j.told") == BY_PHRASE) & strange
    ended = some.where("not open").select("field_name", "record_id", "feed", "text").mapInArrow(_automaton, "field_name string, record_id string, feed string, is_cut boolean")
    return rows.select("j.field_name", "j.record_id", "j.feed", is_cut.alias("is_cut")).unionByName(ended)


def _automaton(batches):
    for x in batches:
        cut = pa.array([unclosed(t) for t in x.column(3).to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), cut], names=["field_name", "record_id", "feed", "is_cut"])


_JUDGED = ["field_name", "record_id", "feed", "size", "told", "four", "two"]


def cut_records(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """(field_name, record_id) of the cut texts; repeated rows count once."""
    return find_cuts(entries, questions).where("is_cut").select("field_name", "record_id").distinct()


def cut_shares(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """(field_name, feed, n_texts, n_cut, share) per source."""
    texts = cut_texts(entries, questions).groupBy("field_name", "feed").agg(F.count_distinct("record_id").alias("n_texts"))
    cut = find_cuts(entries, questions).where("is_cut").groupBy("field_name", "feed").agg(F.count_distinct("record_id").alias("n_cut"))
    both = texts.alias("t").join(cut.alias("c"), (F.col("t.field_name") == F.col("c.field_name")) & F.col("t.feed").eqNullSafe(F.col("c.feed")), "left")
    n = F.coalesce("n_cut", F.lit(0)).cast("bigint")
    return both.select("t.field_name", "t.feed", "n_texts", n.alias("n_cut"), (n / F.col("n_texts")).alias("share"))
