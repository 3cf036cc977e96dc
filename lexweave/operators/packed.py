"""Several values packed in one text field: infer the delimiters, split, keep the position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidate delimiters that are scored for every source (parameter default).
CANDIDATES = (",", ";", "/", "|", "\t", "\n", "·", "、", "，", "；", "／", "｜", "・", ":", "=")
#: What a candidate needs to be accepted as a delimiter of a source: the share of
#: its splits whose pieces are of one type, the evenness of its piece counts
#: (1 less their standard deviation over their mean), and the share of the
#: source's values that it splits.
MIN_REGULARITY = 0.8
MIN_CONSISTENCY = 0.4
MIN_SUPPORT = 0.005
#: Spans that are never split.
_SHIELD = r'"[^"]*+"|“[^”]*+”|「[^」]*+」|\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)'
#: A numbering mark at the start or after a blank: 1. 1) (1) ①
_NUM = r"(?:(?<![^\s])(?:\(\d{1,2}\)|\d{1,2}[.)])(?=\D)|[①-⑳])"
_MARK = "\x01"


def _cls(chars: Sequence[str]) -> str:
    return "".join("\\" + c if c in "\\]^-[&|/" else {"\t": r"\t", "\n": r"\n"}.get(c, c) for c in chars)


def _numbered(text: Column) -> Column:
    """Numbering marks outside shielded spans become a mark of their own, in
    texts that begin with the mark of number one."""
    begins = text.rlike(r"^\s*+(?:\(1\)|1[.)](?=\D)|①)")
    step = rf"\G((?:(?!{_NUM})(?:{_SHIELD}|[\s\S]))*+){_NUM}"
    return F.when(begins, F.regexp_replace(text, F.lit(step), F.lit("$1" + _MARK))).otherwise(text)


def _tidy(piece: Column) -> Column:
    """Piece without outer blanks and surrounding quotes."""
    blank = r"(?U)^\s+|(?<!\s)\s+$"
    bare = F.regexp_replace(piece, blank, "")
    return F.regexp_replace(F.regexp_replace(bare, r'^(?:"([^"]*+)"|“([^”]*+)”|「([^」]*+)」)$', "$1$2$3"), blank, "")


def split_outside(text: Column, delimiters: Sequence[str]) -> Column:
    """Array of the non-empty tidy pieces between delimiters that lie outside
    quotes and round brackets. Null text gives null, a blank one an empty array.

    The pattern only has possessive loops: its stack use doesn't grow with the text.
    """
    stop = _cls([*delimiters, _MARK])
    piece = rf"(?:{_SHIELD}|[^{stop}])++"
    pieces = F.transform(F.regexp_extract_all(_numbered(text), F.lit(piece), F.lit(0)), _tidy)
    return F.filter(pieces, lambda p: p != "")


def _kind(piece: Column) -> Column:
    """Type of a piece by the scripts in it."""
    return (
        F.when(piece.rlike(r"[A-Za-z]"), 1).otherwise(0)
        + F.when(piece.rlike(r"[가-힣]"), 2).otherwise(0)
        + F.when(piece.rlike(r"^[\d\s.]*+$"), 4).otherwise(0)
    )


def delimiter_scores(values: DataFrame, candidates: Sequence[str] = CANDIDATES) -> DataFrame:
    """(source, delimiter, n, support, consistency, regularity, score) for a frame of (source, value).

    The candidate splits ``n`` values of the source into two pieces or more
    outside shielded spans: ``support`` is their share of all its values.
    ``consistency`` tells how even their piece counts are: 1 less the standard
    deviation over the mean, at least 0. ``regularity`` is the share of them
    whose pieces are all of one type. ``score`` is the product of the last two.
    All are shares of the source's own values, so they don't move with its size.
    """
    rows = values.where("value is not null").withColumn("outside", F.regexp_replace("value", _SHIELD, ""))
    checks = [F.struct(F.lit("").alias("delimiter"), F.lit(1).alias("k"), F.lit(1).alias("kinds"))]  # counts the values
    for c in candidates:
        pieces = split_outside(F.col("value"), [c])
        # a candidate that only stands at an end says nothing
        seen = F.when(F.col("outside").contains(c), F.struct(F.lit(c).alias("delimiter"), F.size(pieces).alias("k"), F.size(F.array_distinct(F.transform(pieces, _kind))).alias("kinds")))
        checks.append(seen)
    found = rows.select("source", F.explode(F.array_compact(F.array(*checks))).alias("c")).where("c.k >= 2 or c.delimiter = ''")
    sums = found.groupBy("source", F.col("c.delimiter").alias("delimiter")).agg(
        F.count("*").alias("n"), F.avg("c.k").alias("mean"), F.stddev_pop("c.k").alias("sd"), F.avg((F.col("c.kinds") == 1).cast("int")).alias("regularity")
    )
    total = F.max(F.when(F.col("delimiter") == "", F.col("n"))).over(Window.partitionBy("source"))  # a row per candidate
    even = F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean"))
    scored = sums.select("source", "delimiter", "n", (F.col("n") / total).alias("support"), even.alias("consistency"), "regularity")
    return scored.where("delimiter <> ''").withColumn("score", F.col("consistency") * F.col("regularity"))


def accepted_delimiters(values: DataFrame, candidates: Sequence[str] = CANDIDATES, min_regularity: float = MIN_REGULARITY) -> dict[str, list[str]]:
    """Per source the accepted delimiters, from all values. What reaches the
    driver is at most one row per source and candidate."""
    good = (F.col("support") >= MIN_SUPPORT) & (F.col("consistency") >= MIN_CONSISTENCY) & (F.col("regularity") >= min_regularity)
    found: dict[str, list[str]] = {}
    for r in delimiter_scores(values, candidates).where(good).collect():
        found.setdefault(r["source"], []).append(r["delimiter"])
    return {k: sorted(v) for k, v in found.items()}


def packed_fields(vocab: DataFrame, questions: DataFrame, candidates: Sequence[str] = CANDIDATES, min_regularity: float = MIN_REGULARITY) -> DataFrame:
    """One row per value of vocab.synonyms, vocab.meaning_kr and questions.vocabulary.

    The array of synonyms is split string by string and flattened in place, so
    no row leaves its task before the final ``distinct``.
    """
    syn = vocab.select(F.explode("synonyms").alias("value")).select(F.lit("synonyms").alias("source"), "value")
    mean = vocab.select(F.lit("meaning_kr").alias("source"), F.col("meaning_kr").alias("value"))
    voc = questions.select(F.lit("vocabulary").alias("source"), F.col("vocabulary").alias("value"))
    acc = accepted_delimiters(syn.unionByName(mean).unionByName(voc), candidates, min_regularity)
    cut = lambda f: lambda v: split_outside(v, acc.get(f, []))
    syn_pieces = F.flatten(F.transform(F.filter("synonyms", lambda s: s.isNotNull()), cut("synonyms")))
    parts = [
        vocab.select(F.col("id").alias("record_id"), F.lit("synonyms").alias("field_name"), syn_pieces.alias("pieces")),
        vocab.select(F.col("id").alias("record_id"), F.lit("meaning_kr").alias("field_name"), cut("meaning_kr")(F.col("meaning_kr")).alias("pieces")),
        questions.select(F.col("id").alias("record_id"), F.lit("vocabulary").alias("field_name"), cut("vocabulary")(F.col("vocabulary")).alias("pieces")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.size("pieces") > 0).distinct()
    return rows.select("record_id", "field_name", F.posexplode("pieces").alias("_p", "piece")).select(
        "record_id", "field_name", (F.col("_p") + 1).cast("bigint").alias("pos"), "piece"
    )
