"""Evaluation passages inside the corpus: rare seeds, local alignment, exact check (problem 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Words of a seed, and consecutive words that make a leak.
SEED_WORDS = 5
LEAK_WORDS = 12
#: Distinct n-grams of the test items up to which they are broadcast (16 bytes
#: each); more of them meet the corpus in a shuffled join.
BROADCAST_GRAMS = 2_000_000
#: Alignment scores of equal words, other words, and gaps.
MATCH, MISMATCH, GAP = 2.0, -1.0, 1.0
#: Words around a seed that the alignment sees beyond the item's own length.
MARGIN = 20
#: Document words that are aligned at once, and pairs that wait for it.
CELLS = 32_768
PAIRS = 4096


def words_of(text: Column) -> Column:
    """Hashes of the unbroken runs of letters and digits, whatever their case, as positive numbers."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 1))


def _grams(words: Column) -> Column:
    """Hashes of all ``SEED_WORDS`` words in a row, by place from 1; words may be fewer."""
    at = F.sequence(F.lit(1), F.size(words) - (SEED_WORDS - 1))
    grams = F.transform(at, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(SEED_WORDS))))
    return F.when(F.size(words) >= SEED_WORDS, grams).otherwise(F.array().cast("array<bigint>"))


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    """(key, name, words): texts with a key of their own; the same id may have several texts, the same text is one."""
    texts = rows.select(F.col(name).cast("bigint").alias(name), "text").where("text is not null and text <> ''")
    return texts.select(F.xxhash64(name, "text").alias("key"), name, words_of(F.col("text")).alias("words"))


def gram_hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc, at, g): where the corpus holds n-grams of the test items. One scan of the corpus."""
    n = grams.count()
    known = F.broadcast(grams) if n <= BROADCAST_GRAMS else grams
    rows = docs.select(F.col("key").alias("doc"), F.posexplode(_grams(F.col("words"))).alias("at", "g"))
    return rows.join(known, "g").select("doc", "at", "g")


def choose_seeds(places: DataFrame, frequency: DataFrame, edited: bool = False) -> DataFrame:
    """(g, item, at, size): the seeds of each item from its n-grams (item, at, g, size) and their
    number of corpus texts (g, n): of every window of ``LEAK_WORDS`` words the
    rarest, so no leak can do without a seed, and frequent phrases start no
    alignment. A window with an n-gram that stands nowhere has no seed: it stands
    nowhere itself.

    An edited copy may hold none of these: a window with a changed word has
    n-grams that stand nowhere, and they are the rarest. With ``edited`` every
    n-gram that stands in the corpus is a seed, whatever its frequency.
    """
    known = places.join(frequency, "g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if edited:
        return known.where("n > 0").select("g", "item", "at", "size")
    wide = LEAK_WORDS - SEED_WORDS
    ahead = Window.partitionBy("item").orderBy("at").rowsBetween(0, wide)
    best = F.min(F.struct("n", "at", "g")).over(ahead)
    windows = known.select("item", "at", "size", best.alias("b")).where(F.col("at") + wide + SEED_WORDS <= F.col("size"))
    return windows.where("b.n > 0").select("b.g", "item", "b.at", "size").distinct()


def align(doc: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    """(Smith-Waterman score, longest run of equal consecutive words) of two word-number arrays."""
    n = len(doc)
    ramp = np.arange(n + 1) * GAP
    prev, best = np.zeros(n + 1), 0.0
    runs, longest = np.zeros(n + 1, np.int32), 0
    for w in item:
        same = doc == w
        cell = np.zeros(n + 1)
        cell[1:] = np.maximum(prev[:-1] + np.where(same, MATCH, MISMATCH), 0)
        np.maximum(cell, prev - GAP, out=cell)
        cell = np.maximum.accumulate(cell + ramp) - ramp
        best = max(best, float(cell.max()))
        prev = cell
        nxt = np.zeros(n + 1, np.int32)
        nxt[1:] = np.where(same, runs[:-1] + 1, 0)
        longest = max(longest, int(nxt.max()))
        runs = nxt
    return best, longest


def align_many(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """``align`` of many (document, item) pairs at once: scores and longest runs in their order.

    Pairs of like length go together, filled up with numbers that equal nothing,
    ``CELLS`` document words at a time.
    """
    scores, longest = np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]) // 32, len(pairs[k][1])))
    at = 0
    while at < len(order):
        end, width = at, 0
        while end < len(order) and (end == at or max(width, len(pairs[order[end]][0])) * (end - at + 1) <= CELLS):
            width = max(width, len(pairs[order[end]][0]))
            end += 1
        part = order[at:end]
        docs = np.full((len(part), width), -1, np.int64)
        items = np.full((max(len(pairs[k][1]) for k in part), len(part), 1), -2, np.int64)
        for row, k in enumerate(part):
            docs[row, : len(pairs[k][0])] = pairs[k][0]
            items[: len(pairs[k][1]), row, 0] = pairs[k][1]
        ramp = np.arange(width + 1, dtype=np.float32) * np.float32(GAP)
        prev, top = np.zeros((len(part), width + 1), np.float32), np.zeros((len(part), width + 1), np.float32)
        runs, most = np.zeros((len(part), width + 1), np.int32), np.zeros((len(part), width + 1), np.int32)
        for w in items:
            same = docs == w
            cell = np.zeros_like(prev)
            np.maximum(prev[:, :-1] + np.where(same, np.float32(MATCH), np.float32(MISMATCH)), 0, out=cell[:, 1:])
            np.maximum(cell, prev - np.float32(GAP), out=cell)
            cell += ramp
            np.maximum.accumulate(cell, axis=1, out=cell)
            cell -= ramp
            np.maximum(top, cell, out=top)
            prev = cell
            nxt = np.zeros_like(runs)
            np.multiply(runs[:, :-1] + 1, same, out=nxt[:, 1:])
            np.maximum(most, nxt, out=most)
            runs = nxt
        scores[part], longest[part] = top.max(axis=1), most.max(axis=1)
        at = end
    return scores, longest


def _regions(met: DataFrame) -> DataFrame:
    """(doc, item, lo, hi): stretches of a document where an item can lie, from the places
    (doc_at, item_at) of its seeds; those that overlap are one."""
    lines = met.select("doc", "item", "size", (F.col("doc_at") - F.col("item_at")).alias("d")).distinct()
    of_pair = Window.partitionBy("doc", "item").orderBy("d")
    new = F.coalesce((F.col("d") - F.lag("d").over(of_pair) > F.col("size") + 2 * MARGIN).cast("int"), F.lit(1))
    marked = lines.withColumn("new", new).withColumn("part", F.sum("new").over(of_pair))
    ends = marked.groupBy("doc", "item", "part", "size").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return ends.select("doc", "item", F.greatest(F.lit(0), F.col("lo") - MARGIN).alias("lo"), (F.col("hi") + F.col("size") + MARGIN).alias("hi"))


_ALIGNED = "doc_id bigint, item_id bigint, score double, longest_run bigint"


def _align_rows(batches):
    """(doc_id, item_id, words of the document, words of the item) to ``_ALIGNED``, many at a time."""
    waiting: list[tuple] = []

    def aligned():
        scores, runs = align_many([(np.array(own), np.array(item)) for _, _, own, item in waiting])
        docs, ids = [w[0] for w in waiting], [w[1] for w in waiting]
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(runs, pa.int64())], names=["doc_id", "item_id", "score", "longest_run"])

    for b in batches:
        own, item = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        waiting.extend(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), own, item))
        if len(waiting) >= PAIRS:
            yield aligned()
    if waiting:
        yield aligned()


def find_leaks(documents: DataFrame, items: DataFrame, edited: bool = True) -> DataFrame:
    """(doc_id, item_id, score, longest_run) of documents aligned with test items.

    ``score`` is the Smith-Waterman score in words over the best stretch;
    ``longest_run`` the most consecutive words in common. The corpus is scanned
    once for the items' n-grams, a join; what it holds of them gives their
    frequencies and, joined with the seeds, the stretches to align. Only
    documents with a seed are read again. Every document that shares
    ``SEED_WORDS`` words in a row with an item is aligned with it; without
    ``edited`` only what may hold ``LEAK_WORDS`` of its words in a row.

    Null and empty texts leak nothing; items under ``LEAK_WORDS`` words can't
    leak; repeated rows give one row.
    """
    docs = _keyed(documents, "doc_id")
    tests = materialise(_keyed(items, "item_id").where(F.size("words") >= LEAK_WORDS).dropDuplicates(["key"]), "p9-items")
    places = tests.select(F.col("key").alias("item"), F.size("words").alias("size"), F.posexplode(_grams(F.col("words"))).alias("at", "g"))
    hits = materialise(gram_hits(docs, places.select("g").distinct()), "p9-hits")
    frequency = hits.groupBy("g", "doc").agg(F.lit(1).alias("o")).groupBy("g").agg(F.count("*").alias("n"))
    seeds = choose_seeds(places, frequency, edited).withColumnRenamed("at", "item_at")
    regions = _regions(hits.withColumnRenamed("at", "doc_at").join(seeds, "g"))
    # a document's stretches are few numbers each; its words are cut once
    of_doc = regions.groupBy("doc").agg(F.collect_list(F.struct("item", "lo", "hi")).alias("parts"))
    cut = docs.join(of_doc.withColumnRenamed("doc", "key"), "key").select(
        "doc_id", F.explode(F.transform("parts", lambda p: F.struct(p["item"].alias("item"), F.slice("words", (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")).alias("own")))).alias("p")
    )
    pairs = cut.select("doc_id", F.col("p.item").alias("key"), "p.own").join(tests, "key").select("doc_id", "item_id", "own", "words")
    aligned = pairs.mapInArrow(_align_rows, _ALIGNED)
    return aligned.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"))


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where at least ``LEAK_WORDS`` consecutive words of the item stand in the document."""
    return find_leaks(documents, items, edited=False).where(F.col("longest_run") >= LEAK_WORDS).select("doc_id", "item_id")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_docs, n_edited, best_score): documents that hold the item's words
    in a run, and those whose alignment alone shows an edited copy (at least
    ``LEAK_WORDS`` matches' worth of score). A copy without ``SEED_WORDS`` words of
    the item left in a row has no seed and isn't seen."""
    rows = find_leaks(documents, items)
    run = F.col("longest_run") >= LEAK_WORDS
    return rows.groupBy("item_id").agg(
        F.count_if(run).alias("n_docs"), F.count_if(~run & (F.col("score") >= MATCH * LEAK_WORDS)).alias("n_edited"), F.max("score").alias("best_score")
    )
