"""Queries that return all rows where those with a fixed SQL return the first few."""

from lexweave.operators import patches
from lexweave.operators import reports as r_ops
from lexweave.plans import reports, study

from .compare import assert_same, views
from .conftest import SF

EX = "word string, ex_id long, sentence string, volume int, test int, part int, question_number int, page int"


def _hot(spark):
    """A word with more examples than fit in a task's share, out of order, and small ones on either side."""
    rows = [("hot", i, f"s{i}", (i * 7) % 5 or None, i % 3, 5, i % 11 or None, (i % 4) * 10 or None) for i in range(3000)]
    return spark.createDataFrame([*rows, ("a", 9001, "x", 2, 1, 5, 1, None), ("z", 9002, "y", 1, 1, 5, 1, None), (None, 9003, "y", 1, 1, 5, 1, None), ("z", 9004, "Y ", 0, 1, 5, 1, None)], EX)


def test_all_examples_of_a_hot_word_in_order(spark):
    ex = _hot(spark)
    got = patches.hybrid_order(ex).collect()
    want = {}
    for r in sorted(ex.collect(), key=lambda r: (r["volume"] or 0, r["page"] or r["test"] * 1000 + (r["question_number"] or 0), r["ex_id"])):
        want.setdefault(r["word"], []).append(r["ex_id"])
    assert sorted((str(r["word"]), r["place"], r["ex_id"]) for r in got) == sorted((str(w), n, i) for w, ids in want.items() for n, i in enumerate(ids, 1))


def test_pages_hold_all_examples_in_order(spark):
    ex = _hot(spark)
    got = sorted((r["page"], r["n_examples"], r["ex_ids"]) for r in patches.word_example_pages(ex, 400).where("word = 'hot'").collect())
    want = [r["ex_id"] for r in sorted(ex.where("word = 'hot'").collect(), key=lambda r: (r["volume"] or 0, r["test"], r["part"], r["question_number"] or 0, r["ex_id"]))]
    assert [i for _, _, ids in got for i in ids] == want and [n for _, n, _ in got] == [400] * 7 + [200]
    assert [r["ex_ids"] for r in patches.word_example_pages(ex).where("word = 'z'").collect()] == [[9002]]


def test_hybrid_order_is_whole(spark):
    sql = study.oracle_sql()["hybrid_sort_examples"]
    assert_same(study.queries()["hybrid_sort_examples_all"](spark, SF), views(SF), sql.removesuffix(" QUALIFY place <= 5"))


def test_ordered_examples_are_as_many_as_counted(spark):
    n = {r["word"]: r["total_count"] for r in reports.queries()["word_examples_dedup_sorted"](spark, SF).collect()}
    got: dict = {}
    for r in reports.queries()["word_examples_ordered"](spark, SF).collect():
        got[r["word"]] = got.get(r["word"], 0) + len(set(r["ex_ids"]))
    assert got == n and max(n.values()) > 5


def test_crosstab_has_every_volume(spark):
    rows = [("a", 1), ("a", 1), ("a", 17), ("b", 17), (None, None), ("b", 6)]
    df = spark.createDataFrame(rows, "category string, volume int")
    got = r_ops.category_pivot(df).collect()
    cells = {(r["category"], r["volume"]): (r["n"], r["total"]) for r in got}
    none = next(c for c, _ in cells if c not in ("a", "b"))
    assert len(got) == len(cells) == 12
    assert {k: v for k, v in cells.items() if v[0]} == {("a", 1): (2, 3), ("a", 17): (1, 3), ("b", 17): (1, 2), ("b", 6): (1, 2), (none, None): (1, 1)}
    wide = {r["category"]: (r["1"], r["6"], r["17"], r["null"], r["total"]) for r in r_ops.category_wide(df).collect()}
    assert wide == {"a": (2, 0, 1, 0, 3), "b": (0, 1, 1, 0, 2), none: (0, 0, 0, 1, 1)}
    assert r_ops.category_pivot(df.limit(0)).count() == 0


def test_crosstab_totals_are_all_questions(spark):
    folder = "/root/testdata/sf0.1"
    got = reports.queries()["category_pivot"](spark, folder)
    assert got.where("volume > 5 and n > 0").count() > 0
    assert got.agg({"n": "sum"}).first()[0] == reports.questions(spark, folder).count()
    assert_same(got, views(folder), reports.oracle_sql()["category_pivot"])


def test_crosstab_of_many_volumes(spark):
    df = spark.range(4000).selectExpr("if(id % 4 = 0, 'a', 'b') as category", "cast(nullif(id % 2000, 7) as int) as volume")
    got = r_ops.category_pivot(df)
    assert got.count() == 2 * 2000 and got.where("volume is null").agg({"n": "sum"}).first()[0] == 2
    assert {tuple(r) for r in got.groupBy("category", "total").agg({"n": "sum"}).collect()} == {("a", 1000, 1000), ("b", 3000, 3000)}
    assert r_ops.category_wide(df.where("volume < 1500")).agg({"total": "sum"}).first()[0] == 2998
