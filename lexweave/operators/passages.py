"""Passages and lines: segments, choices, carried marks, as-of joins by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lexicon import BLANK

#: Header of a passage block.
HEADER = r"(?i)questions?\s+(\d{2,3})\s*[-–—]\s*(\d{2,3})\s+refer to the following[^\n]*"
#: Lines that belong to no sentence: choices, question stems, page furniture.
SKIP_LINE = r"(?i)^\s*(?:\(?[A-D]\)|\d{3}\.|page \d|part \d|questions? \d|[-—\[]?\s*\d{1,4}\s*[-—\]]?\s*$)"


def lines(passages: DataFrame) -> DataFrame:
    """(id, line_no, line, header_from, header_to): non-empty lines; headers with their question range."""
    rows = passages.select("id", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "line")).where(text.strip(F.col("line")) != "").withColumn("line_no", F.col("line_no").cast("bigint"))
    num = lambda i: F.expr(f"try_cast(nullif(regexp_extract(line, '{HEADER}', {i}), '') as int)".replace("\\", "\\\\"))
    return rows.withColumn("header_from", num(1)).withColumn("header_to", num(2))


def carry_forward(rows: DataFrame, column: str, name: str, by: str, order: str) -> DataFrame:
    """The last non-null value so far, within the group."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(column, ignorenulls=True).over(w))


def segments(rows: DataFrame) -> DataFrame:
    """(id, q_from, q_to, n_lines, n_chars): blocks below each header; lines above any header form a block of their own."""
    filled = carry_forward(carry_forward(rows, "header_from", "q_from", "id", "line_no"), "header_to", "q_to", "id", "line_no")
    return filled.where("header_from is null").groupBy("id", "q_from", "q_to").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def header_ranges(rows: DataFrame) -> DataFrame:
    """(id, q_from, start_line, end_line): each header's stretch ends where the next begins."""
    w = Window.partitionBy("id").orderBy("line_no")
    heads = rows.where("header_from is not null")
    return heads.select("id", F.col("header_from").alias("q_from"), F.col("line_no").alias("start_line"), F.lead("line_no", 1, 1_000_000).over(w).alias("end_line"))


def interval_join(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, line_no, q_from): lines within a header's stretch. The equi-key keeps
    it a hash join; the ranges of one passage are few."""
    r, h = rows.alias("r"), ranges.alias("h")
    on = (F.col("r.id") == F.col("h.id")) & (F.col("r.line_no") > F.col("h.start_line")) & (F.col("r.line_no") < F.col("h.end_line"))
    return r.join(h, on).select("r.id", "r.line_no", "h.q_from")


def blanks(rows: DataFrame) -> DataFrame:
    """(id, line_no, ordinal, q_number, asof_from): each blanked line with its
    header by a backward as-of step and its ordinal below that header."""
    at = carry_forward(carry_forward(rows, "header_from", "q_from", "id", "line_no"), "header_to", "q_to", "id", "line_no")
    hit = at.where(F.col("line").contains(BLANK) & F.col("q_from").isNotNull())
    k = F.row_number().over(Window.partitionBy("id", "q_from").orderBy("line_no"))
    out = hit.select("id", "line_no", k.cast("bigint").alias("ordinal"), (F.col("q_from") + k - 1).alias("q_number"), "q_from", "q_to")
    return out.where("q_number <= q_to").select("id", "line_no", "ordinal", F.col("q_number").cast("bigint").alias("q_number"), F.col("q_from").alias("asof_from"))


def passage_answers(passages: DataFrame) -> DataFrame:
    """(id, q_number, answer): one row per answered question of a passage block's part."""
    rows = passages.select("id", "part", F.explode("answer").alias("q", "answer"))
    lo = F.when(F.col("part") == 6, 131).otherwise(147)
    hi = F.when(F.col("part") == 6, 146).otherwise(200)
    return rows.withColumn("q_number", F.expr("try_cast(q as bigint)")).where(F.col("q_number").between(lo, hi)).select("id", "q_number", "answer")


def answered_blanks(passages: DataFrame) -> DataFrame:
    """(id, q_number, answer): blanks joined with their answers on passage and number."""
    return blanks(lines(passages)).join(passage_answers(passages), ["id", "q_number"]).select("id", "q_number", "answer")


def nearest_header(rows: DataFrame) -> DataFrame:
    """(id, line_no, nearest_line, distance): the header line nearest to each blanked line, the upper one on ties."""
    b = rows.where(F.col("line").contains(BLANK)).select("id", "line_no")
    h = rows.where("header_from is not null").select("id", F.col("line_no").alias("h"))
    d = F.abs(F.col("line_no") - F.col("h"))
    return b.join(h, "id").groupBy("id", "line_no").agg(F.min(F.struct(d.alias("d"), F.col("h").alias("h"))).alias("m")).select(
        "id", "line_no", F.col("m.h").cast("bigint").alias("nearest_line"), F.col("m.d").cast("bigint").alias("distance")
    )


def next_header(rows: DataFrame) -> DataFrame:
    """(id, line_no, next_header): forward as-of, the first header behind each blanked line."""
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    out = rows.withColumn("next_header", F.first("header_from", ignorenulls=True).over(w).cast("bigint"))
    return out.where(F.col("line").contains(BLANK)).select("id", "line_no", "next_header")


def contiguous_blocks(rows: DataFrame, flag: Column) -> DataFrame:
    """(id, n_blocks, n_lines): runs of neighbouring lines for which ``flag`` holds."""
    w = Window.partitionBy("id").orderBy("line_no")
    f = rows.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_p", F.coalesce(F.lag("_f").over(w), F.lit(False)))
    return f.groupBy("id").agg(F.count_if(F.col("_f") & ~F.col("_p")).alias("n_blocks"), F.count_if("_f").alias("n_lines"))


def until_mark(rows: DataFrame, mark: Column) -> DataFrame:
    """(id, n_lines): lines before the first one for which ``mark`` holds."""
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.max(F.coalesce(mark, F.lit(False)).cast("int")).over(w)
    return rows.withColumn("_s", stop).where("_s = 0").groupBy("id").agg(F.count("*").alias("n_lines"))


def first_per_key(rows: DataFrame) -> DataFrame:
    """(q_from, first_id, first_line): over all passages, the first place of each
    header once a header of question 131 or 147 has been seen in its passage."""
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.coalesce(F.col("header_from").isin(131, 147), F.lit(False)).cast("int")).over(w)
    kept = rows.withColumn("_s", seen).where("_s = 1 and header_from is not null")
    return kept.groupBy(F.col("header_from").alias("q_from")).agg(F.min(F.struct("id", "line_no")).alias("m")).select("q_from", F.col("m.id").alias("first_id"), F.col("m.line_no").alias("first_line"))


def passage_sentences(passages: DataFrame) -> DataFrame:
    """(id, pos, sentence): cleaned body lines joined and split into sentences."""
    body = F.array_join(F.filter(F.split("raw_text", "\n"), lambda x: ~x.rlike(SKIP_LINE)), " ")
    return passages.select("id", F.posexplode(text.sentences(body)).alias("pos", "sentence"))


def resolve_blanks(sentences: DataFrame, passages: DataFrame, left: int = 25, ahead: int = 60, behind: int = 80) -> DataFrame:
    """(sent_id, q_number): the question that a blanked sentence of a passage asks.

    ``sentences`` is (sent_id, id, sentence). The blank is found in the passage
    by up to ``left`` characters before it (the blank must follow within
    ``ahead``), else by as many after it (within ``behind`` before). Then a
    label NNN. or NNN) beside the blank counts if it lies in the header's
    range, else the blank's ordinal below its header. Sentences without a
    blank, or whose place isn't found, give no row.
    """
    flat = lambda c: F.lower(text.collapse(text.unbold(c)))
    s = sentences.where(F.col("sentence").rlike("-{5,}")).select("sent_id", "id", flat(F.col("sentence")).alias("s"))
    cut = F.split("s", "-{5,}", 2)
    s = s.select("sent_id", "id", F.right(F.trim(cut[0]), F.lit(left)).alias("a"), F.left(F.trim(cut[1]), F.lit(left)).alias("z"))
    p = passages.select("id", F.regexp_replace(flat(F.col("raw_text")), "-{5,}", BLANK).alias("body"))
    both = s.join(p, "id")
    end = F.when(F.length("a") >= 10, F.instr("body", F.col("a")) + F.length("a")).otherwise(0)
    after = F.when(F.col("a_end") > F.length("a"), F.expr(f"locate('{BLANK}', body, a_end)")).otherwise(0)
    both = both.withColumn("a_end", end).withColumn("b1", after).withColumn("z_at", F.when(F.length("z") >= 10, F.instr("body", F.col("z"))).otherwise(0))
    head = F.substring("body", F.lit(1), F.col("z_at") - 1)
    back = F.when(F.col("z_at") > 0, F.length(head) - F.instr(F.reverse(head), BLANK) - len(BLANK) + 2)
    place = F.when((F.col("b1") > 0) & (F.col("b1") - F.col("a_end") <= ahead), F.col("b1")).when(head.contains(BLANK) & (F.col("z_at") - back <= behind), back)
    at = both.withColumn("at", place).where("at > 0").select("sent_id", "at", F.substring("body", F.lit(1), F.col("at") - 1).alias("before"), F.substring("body", F.col("at") + len(BLANK), F.lit(35)).alias("behind"))
    header = r"questions?\s+(\d{2,3})\s*[-–—]\s*(\d{2,3})\s+refer to the following"
    num = lambda i: F.element_at(F.regexp_extract_all("before", F.lit(header), F.lit(i)), -1).cast("int")
    below = F.element_at(F.split("before", header), -1)
    ordinal = F.size(F.split(below, BLANK)) - 1
    lab = lambda c, pat: F.nullif(F.regexp_extract(c, pat, 1), F.lit("")).cast("int")
    found = at.where(F.size(F.regexp_extract_all("before", F.lit(header), F.lit(1))) > 0).select(
        "sent_id", num(1).alias("lo"), num(2).alias("hi"), ordinal.alias("k"), lab(F.col("behind"), r"^\D{0,3}(\d{3})[.)]").alias("l1"), lab(F.col("before"), r"(\d{3})[.)]\s*$").alias("l2")
    )
    fits = lambda c: F.when(F.col(c).between(F.col("lo"), F.col("hi")), F.col(c))
    q = F.coalesce(fits("l1"), fits("l2"), F.when(F.col("lo") + F.col("k") <= F.col("hi"), F.col("lo") + F.col("k")))
    return found.select("sent_id", q.cast("bigint").alias("q_number")).where("q_number is not null")


def reading_order(blocks: DataFrame, gutter: float = 280.0) -> DataFrame:
    """(page, place, text): blocks (page, x0, y0, text) of two-column pages, left column first, from top to bottom."""
    w = Window.partitionBy("page").orderBy((F.col("x0") >= gutter).cast("int"), "y0", "x0", "text")
    return blocks.select("page", F.row_number().over(w).cast("bigint").alias("place"), "text")


def entry_blocks(rows: DataFrame, is_head: Column) -> DataFrame:
    """(id, block, head, n_lines, gloss): lines (id, line_no, line) cut where an entry
    begins; the first line with Hangul is its gloss. Lines above the first entry are left out."""
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    b = rows.withColumn("block", F.sum(F.coalesce(is_head, F.lit(False)).cast("int")).over(w)).where("block > 0")
    hangul = F.col("line").rlike("[\\x{AC00}-\\x{D7A3}]")
    return b.groupBy("id", "block").agg(
        F.min_by("line", "line_no").alias("head"), F.count("*").alias("n_lines"), F.min_by("line", F.when(hangul, F.col("line_no"))).alias("gloss")
    )
