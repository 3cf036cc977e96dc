import json
from collections import defaultdict

from lexweave.llm import queries, typography
from lexweave.session import table

from ..compare import assert_same, views

EX = "entry_id long, examples array<struct<ex_id long, sentence string>>, kind string"
RAW = "raw_id long, payload string"


def _letters(s):
    return "".join(c for c in s if c.isalnum()).lower()


def _pairs(ids_by_key, kind):
    return {(kind, min(ids), i) for ids in ids_by_key.values() for i in ids if i != min(ids)}


def test_pairs_on_fixture(spark):
    ex = [
        (1, [(10, "A **b**, c!"), (11, "a B C"), (12, None), (13, "!!!"), (14, "?"), (15, "")], "x"),
        (2, [(16, "ab  C…"), (17, "abd")], "x"),
        (2, [(16, "ab  C…"), (17, "abd")], "x"),
        (3, None, "x"),
        (4, [], "x"),
    ]
    a = {"w": {"examples": [{"sentence": "Hi There."}], "n": 1}}
    raw = [(1, json.dumps(a)), (2, json.dumps({"w": {"n": 1, "examples": [{"sentence": "hi  there"}]}}, indent=2)), (3, json.dumps({"w": {"n": 2, "examples": []}})), (4, None), (5, "{bad"), (6, "{bad ")]
    e, r = spark.createDataFrame(ex, EX), spark.createDataFrame(raw, RAW)
    got = {tuple(x) for x in typography.duplicate_pairs(e, r).collect()}
    assert got == {("example", 10, 11), ("example", 10, 16), ("raw", 1, 2), ("raw", 5, 6)}
    col = {tuple(x) for x in typography.collapsed(e, r).collect()}
    assert {("example", 10, 3), ("example", 17, 1), ("raw", 1, 2), ("raw", 3, 1)} <= col


def test_empty_and_one_huge_group(spark):
    e0, r0 = spark.createDataFrame([], EX), spark.createDataFrame([], RAW)
    assert typography.duplicate_pairs(e0, r0).count() == 0
    e = spark.createDataFrame([(i, [(i, "Same text" + "!" * (i % 5))], "x") for i in range(1500)] + [(5000 + i, [(5000 + i, f"other {i}")], "x") for i in range(500)], EX)
    assert typography.duplicate_pairs(e, r0).count() == 1499


def test_crowded_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(typography, "BITS_PER_RECORD", 1)
    e = spark.createDataFrame([(i, [(i, f"t {i % 15000}")], "x") for i in range(20000)], EX)
    assert typography.duplicate_pairs(e, spark.createDataFrame([], RAW)).count() == 5000


def test_more_records_take_more_filters(spark, monkeypatch):
    """Ten thousand records in filters for five thousand, in one job and in several: the filters stay as sharp as one large one."""
    e = spark.createDataFrame([(i, [(i, f"t {i % 9000}")], "x") for i in range(10000)], EX)
    r = spark.createDataFrame([(1, "{}"), (2, "{ }")], RAW)
    want = sorted(map(tuple, typography.duplicate_pairs(e, r).collect()))
    assert len(want) == 1001
    monkeypatch.setattr(typography, "SHARD_BITS", 1 << 15)
    for at_once in (16, 2):
        monkeypatch.setattr(typography, "SHARDS_AT_ONCE", at_once)
        keys, shards, bits = typography.stored_keys(e, r)
        assert shards == 4 and bits <= 1 << 16
        repeats, singles = typography.split_possible_repeats(keys, shards, bits)
        assert repeats.count() < 2002 + 150 and repeats.count() + singles.count() == 10002
        assert sorted(map(tuple, typography.duplicate_pairs(e, r).collect())) == want


def test_half_characters_and_deep_json(spark):
    deep = "[" * 100_000 + "]" * 100_000
    raw = [(1, '{"a": "\\ud800"}'), (2, '{"a":"\\ud800"}'), (3, '{"a":"\\udfff"}'), (4, deep), (5, deep + " "), (6, '{"a": NaN}')]
    e, r = spark.createDataFrame([], EX), spark.createDataFrame(raw, RAW)
    assert {tuple(x) for x in typography.duplicate_pairs(e, r).collect()} == {("raw", 1, 2), ("raw", 4, 5)}


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    ex, raw = defaultdict(set), defaultdict(set)
    e, r = table(spark, sf, "word_ets_examples"), table(spark, sf, "word_ets_examples_raw")
    for row in e.select("examples").collect():
        for x in row["examples"] or []:
            if x["sentence"] and _letters(x["sentence"]):
                ex[_letters(x["sentence"])].add(x["ex_id"])

    def canon(v, k=None):
        if isinstance(v, dict):
            return {a: canon(b, a) for a, b in v.items()}
        if isinstance(v, list):
            return [canon(b, k) for b in v]
        return _letters(v) if k == "sentence" and isinstance(v, str) else v

    for row in r.collect():
        raw[json.dumps(canon(json.loads(row["payload"])), sort_keys=True)].add(row["raw_id"])
    want = _pairs(ex, "example") | _pairs(raw, "raw")
    assert {tuple(x) for x in typography.duplicate_pairs(e, r).collect()} == want


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    for name in ("p3_found", "p3_collapsed"):
        assert_same(queries.queries()[name](spark, sf), views(sf), queries.oracle_sql()[name])
