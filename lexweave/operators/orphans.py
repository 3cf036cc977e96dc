"""References to records that do not exist: missing, deleted or too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .skew import attach_by_key, heavy_keys

_KEY = ["ref_table", "ref_id"]


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def _pad(digits: Column, width: int) -> Column:
    """Digits padded to ``width`` at least (``lpad`` alone would cut longer ones)."""
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def vocab_ref_id(raw: Column) -> Column:
    """Canonical ``hw_NNNN`` of a vocabulary reference; text of another shape
    is kept as its letters and digits (it can't have a target); null and blank stay null."""
    plain = _plain(raw)
    digits = F.regexp_extract(plain, r"^hw0*(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("hw_"), _pad(digits, 4))).when(plain != "", plain)


#: Volume, test, and a question's or part's number, however they are written.
_SOURCE = r"(?i)^[^\p{L}\p{N}]*vol(?:ume)?[^\p{L}\p{N}]*0*(\d+)[^\p{L}\p{N}]*test[^\p{L}\p{N}]*0*(\d+)[^\p{L}\p{N}]*(q|p(?=art))(?:uestion|art)?[^\p{L}\p{N}]*0*(\d+)[^\p{L}\p{N}]*$"
_SEP = "\x01"


def with_source_ref(rows: DataFrame, source: str) -> DataFrame:
    """Rows whose ``source`` names a question or passage, with ref_table and ref_id.

    One pass of one pattern takes a source apart; sources of another shape
    (a page only, null) name no record and are left out.
    """
    parts = F.split(F.regexp_replace(F.col(source), _SOURCE, _SEP.join(["$1", "$2", "$3", "$4"])), _SEP)
    cut = rows.withColumn("_p", parts).where(F.size("_p") == 4)
    vol, test, kind, num = (F.col("_p")[i] for i in range(4))
    head = F.concat(F.lit("vol"), vol, F.lit("_test"), _pad(test, 2))
    is_q = F.lower(kind) == "q"
    return cut.withColumn("ref_table", F.when(is_q, F.lit("questions")).otherwise(F.lit("passages"))).withColumn(
        "ref_id", F.when(is_q, F.concat(head, F.lit("_part5_"), _pad(num, 3))).otherwise(F.concat(head, F.lit("_part"), num, F.lit("_raw")))
    )


def references(entries: DataFrame) -> DataFrame:
    """(ref_table, ref_id, entry_id, at): the references of word-to-examples rows."""
    by_vocab = entries.select(F.lit("vocab").alias("ref_table"), vocab_ref_id(F.col("vocab_id")).alias("ref_id"), "entry_id", F.col("loaded_at").alias("at"))
    sources = entries.select("entry_id", F.col("loaded_at").alias("at"), F.explode("examples.source").alias("_s"))
    by_source = with_source_ref(sources, "_s").select("ref_table", "ref_id", "entry_id", "at")
    return by_vocab.unionByName(by_source).where("ref_id is not null")


def targets(vocab: DataFrame, questions: DataFrame, passages: DataFrame) -> DataFrame:
    """One row per existing id: all rows deleted or not, and the earliest load."""
    rows = [
        t.select(F.lit(n).alias("ref_table"), F.col("id").alias("ref_id"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "loaded_at")
        for n, t in (("vocab", vocab), ("questions", questions), ("passages", passages))
    ]
    return (
        rows[0].unionByName(rows[1]).unionByName(rows[2]).where("ref_id is not null")
        .groupBy(*_KEY).agg(F.every("deleted").alias("all_deleted"), F.min("loaded_at").alias("first_at"))
    )


def key_states(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(ref_table, ref_id, n, state, first_at): the keys that are or may be orphans, one row each.

    References are counted per key and month; from these each key's number,
    earliest and latest load come, and the key meets its target once. Keys that
    would overload a task by their references are bounded in number (see
    ``heavy_keys``); their targets' state is broadcast, all other keys go
    through a shuffled join, and the union of both is the result. ``state`` is
    missing, deleted or late; a late key has at least one reference loaded
    before its target. Without targets every key is missing.
    """
    months = refs.groupBy(*_KEY, _month()).agg(F.count("*").alias("n"), F.min("at").alias("min_at"))
    keys = materialise(months.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("min_at").alias("min_at")), "keys")  # read four times
    heavy = heavy_keys(keys, _KEY, "n").drop("_heavy_n")
    state = targets.withColumn("_hit", F.lit(True))
    hot = keys.join(F.broadcast(heavy), _KEY).join(F.broadcast(state.join(F.broadcast(heavy), _KEY)), _KEY, "left")
    rest = keys.join(F.broadcast(heavy), _KEY, "left_anti").join(state, _KEY, "left")
    what = (
        F.when(F.col("_hit").isNull(), F.lit("missing"))
        .when(F.col("all_deleted"), F.lit("deleted"))
        .when(F.col("first_at") > F.col("min_at"), F.lit("late"))
    )
    cols = [*_KEY, "n", what.alias("state"), "first_at"]
    return hot.select(*cols).unionByName(rest.select(*cols)).where("state is not null")


def _month() -> Column:
    return F.date_format("at", "yyyy-MM").alias("load_month")


def _orphan_rows(refs: DataFrame, states: DataFrame) -> DataFrame:
    """References of orphan keys, without those that were loaded after their late target."""
    rows = attach_by_key(refs, states, _KEY, "n")
    return rows.where((F.col("state") != "late") | (F.col("first_at") > F.col("at")))


def find_orphans(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(ref_table, ref_id, entry_id, reason, load_month), one row per entry and target.

    What a reference is, is decided per key (``key_states``); rows are only
    looked up for the keys that are orphans or may be late. A target is
    ``late`` if it was first loaded after the referring row; a null load time
    is never late.

    Null ids are no references; repeated rows give one row; an empty target
    table makes every reference ``missing``.
    """
    refs = materialise(refs, "refs")  # taken apart once, read twice
    rows = _orphan_rows(refs, materialise(key_states(refs, targets), "states"))
    return rows.select(*_KEY, "entry_id", F.col("state").alias("reason"), _month()).distinct()


def orphan_report(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(ref_table, load_month, reason, n_refs, n_targets): orphans per table and period.

    Only references of orphan keys are counted, once per entry, first per key
    and month; the counts of heavy and other keys meet in the last sum.
    """
    per_key = find_orphans(refs, targets).groupBy(*_KEY, "reason", "load_month").agg(F.count("*").alias("n"))
    return per_key.groupBy("ref_table", "load_month", "reason").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_targets"))
