import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import leaks, queries

from ..compare import assert_same, views

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
DOC = "doc_id long, text string, item_id long"
EVAL = "item_id long, text string, kind string"


def test_fixture(spark):
    w = ITEM.split()
    docs = [
        (1, "x " + ITEM + " y", 0), (2, " - ".join(w[:12]).upper(), 0), (3, " ".join(w[:11]), 0), (4, " ".join(w[:6] + ["no"] + w[6:]), 0),
        (5, None, 0), (6, "", 0), (7, "\n".join(w[3:]), 0), (1, "x " + ITEM + " y", 0), (8, "filler " * 20000 + ITEM.replace(" ", "  ,"), 0),
    ]
    items = [(10, ITEM, "a"), (11, "too short an item", "a"), (12, None, "a"), (13, "alpha " * 14, "a")]
    d, e = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, EVAL)
    assert sorted(map(tuple, leaks.leaked(d, e).collect())) == [(1, 10), (2, 10), (7, 10), (8, 10)]
    edited = {r["item_id"]: r["n_edited"] for r in leaks.leak_report(d, e).collect()}
    assert edited[10] >= 1


def test_many_items_meet_the_corpus_in_a_shuffled_join(spark, monkeypatch):
    w = ITEM.split()
    d = spark.createDataFrame([(1, "x " + ITEM, 0), (2, " ".join(w[:11]), 0), (3, None, 0)], DOC)
    e = spark.createDataFrame([(i, f"item{i} " + ITEM, "a") for i in range(20)], EVAL)
    want = [(1, i) for i in range(20)]
    assert sorted(map(tuple, leaks.leaked(d, e).collect())) == want
    monkeypatch.setattr(leaks, "BROADCAST_GRAMS", 10)
    assert sorted(map(tuple, leaks.leaked(d, e).collect())) == want


def test_same_id_with_several_texts(spark):
    other = " ".join(f"other{i}" for i in range(14))
    d = spark.createDataFrame([(1, ITEM, 0), (1, other, 0), (2, other, 0)], DOC)
    e = spark.createDataFrame([(10, ITEM, "a"), (10, other, "a"), (11, other, "a")], EVAL)
    assert sorted(map(tuple, leaks.leaked(d, e).collect())) == [(1, 10), (1, 11), (2, 10), (2, 11)]


@pytest.mark.parametrize("changed, least", [(1, 0.99), (2, 0.95), (3, 0.6)])
def test_recall_of_edited_copies(spark, changed, least):
    """Copies of 60 words with some of every 12 words changed at random; none has 12 in a row from two on."""
    rng = np.random.default_rng(changed)
    items, docs = [], []
    for n in range(150):
        words = [f"i{n}w{i}" for i in range(60)]
        copy = list(words)
        for at in range(0, 60, 12):
            for i in rng.choice(12, changed, replace=False):
                copy[at + i] = f"c{n}w{at + i}"
        items.append((n, " ".join(words), "a"))
        docs.append((n, "before it " + " ".join(copy) + " and after", 0))
    rows = leaks.find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, EVAL)).where("doc_id = item_id")
    found = rows.where(F.col("score") >= leaks.MATCH * leaks.LEAK_WORDS).count() / 150
    print("recall of", changed, "in 12:", found)
    assert found >= least


def test_empty(spark):
    e, d = spark.createDataFrame([], EVAL), spark.createDataFrame([(1, ITEM, 0)], DOC)
    assert leaks.leaked(d, e).count() == 0
    assert leaks.leaked(spark.createDataFrame([], DOC), spark.createDataFrame([(1, ITEM, "a")], EVAL)).count() == 0


def test_alignment():
    a, b = np.array([1, 2, 3, 9, 4, 5]), np.array([1, 2, 3, 4, 5])
    assert leaks.align(a, b) == (9.0, 3)


def test_edited_copy_without_a_verbatim_one(spark):
    """Every eighth word is changed, and no document holds the rest verbatim."""
    w = [f"word{i}" for i in range(48)]
    copy = [x if i % 8 != 7 else f"other{i}" for i, x in enumerate(w)]
    d = spark.createDataFrame([(1, " ".join(copy), 0), (2, "nothing of the kind is in here", 0)], DOC)
    e = spark.createDataFrame([(10, " ".join(w), "a")], EVAL)
    assert leaks.leaked(d, e).count() == 0
    assert [(r["item_id"], r["n_docs"], r["n_edited"]) for r in leaks.leak_report(d, e).collect()] == [(10, 0, 1)]


def test_common_phrases_are_seeds_of_edited_copies(spark):
    """A copy whose only five words in a row are a phrase of many documents."""
    w = [f"word{i}" for i in range(40)]
    copy = [x if i < 5 or i % 4 else f"other{i}" for i, x in enumerate(w)]
    docs = [(1, " ".join(copy), 0), *((n, " ".join(w[:5]) + f" only {n}", 0) for n in range(2, 60)), (99, " ".join(w[1:7]), 0)]
    d, e = spark.createDataFrame(docs, DOC), spark.createDataFrame([(10, " ".join(w), "a")], EVAL)
    assert [(r["n_docs"], r["n_edited"]) for r in leaks.leak_report(d, e).collect()] == [(0, 1)]


def test_many_alignments_equal_single_ones():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(0, 5, rng.integers(1, 90)), rng.integers(1, 5, rng.integers(12, 40))) for _ in range(900)]
    scores, runs = leaks.align_many(pairs)
    assert list(zip(scores, runs)) == [leaks.align(d, i) for d, i in pairs]


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(queries.queries()["p9_found"](spark, sf), views(sf), queries.oracle_sql()["p9_found"])
