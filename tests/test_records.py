"""References, nesting, skew and packed fields on small fixtures and against brute force."""

import datetime as dt
import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexweave.operators import nested, orphans, packed, salted, skew
from lexweave.plans import records
from lexweave.session import table

D = dt.datetime
ENTRY = "entry_id long, word string, vocab_id string, loaded_at timestamp_ntz, examples array<struct<source string>>"
TARGET = "id string, deleted boolean, loaded_at timestamp_ntz, word string"


def _targets(spark, vocab=(), questions=(), passages=()):
    return orphans.targets(*(spark.createDataFrame(list(t), TARGET) for t in (vocab, questions, passages)))


def test_orphans_reasons_and_spellings(spark):
    day = D(2025, 3, 2)
    rows = [
        (1, "a", " HW-12 ", day, [("Vol 3, TEST 07, Q.115",), ("vol.3 test 7 q115",), ("Vol 3, p.9",), (None,)]),
        (1, "a", " HW-12 ", day, [("Vol 3, TEST 07, Q.115",)]),
        (2, "b", "hw_000013", day, [("VOL 3, Test07, PART 6",)]),
        (3, "c", None, day, None),
        (4, "d", "hw_0014", day, []),
        (5, "e", "hw_12345", None, []),
    ]
    t = _targets(
        spark,
        vocab=[("hw_0012", True, D(2025, 1, 1), "x"), ("hw_0012", True, D(2025, 1, 2), "x"), ("hw_0013", None, D(2025, 3, 3), "x"), ("hw_0014", False, D(2025, 3, 1), "x"), ("hw_12345", False, D(2025, 3, 1), "x")],
        questions=[("vol3_test07_part5_115", False, D(2025, 1, 1), "x")],
    )
    got = {tuple(r) for r in orphans.find_orphans(orphans.references(spark.createDataFrame(rows, ENTRY)), t).collect()}
    assert got == {
        ("vocab", "hw_0012", 1, "deleted", "2025-03"),
        ("vocab", "hw_0013", 2, "late", "2025-03"),
        ("passages", "vol3_test07_part6_raw", 2, "missing", "2025-03"),
    }


def test_orphans_hot_key_and_empty_tables(spark):
    rows = [(i, "w", "hw_0001", D(2025, 1, 1), None) for i in range(3000)] + [(9000 + i, "w", f"hw_{i + 2:04d}", D(2025, 1, 1), None) for i in range(500)]
    refs = orphans.references(spark.createDataFrame(rows, ENTRY))
    assert orphans.find_orphans(refs, _targets(spark)).count() == 3500
    t = _targets(spark, vocab=[("hw_0001", False, D(2026, 1, 1), "x")] + [(f"hw_{i + 2:04d}", False, D(2024, 1, 1), "x") for i in range(500)])
    got = orphans.find_orphans(refs, t)
    assert got.count() == 3000 and got.select("reason").distinct().collect()[0][0] == "late"
    assert orphans.find_orphans(orphans.references(spark.createDataFrame([], ENTRY)), t).count() == 0
    assert {tuple(r)[2:] for r in orphans.orphan_report(refs, t).collect()} == {("late", 3000, 1)}


PAYLOADS = [
    (1, json.dumps({"apply": {"vocab_id": "hw_1", "examples": {"source": " Vol 1 ", "sentence": "s"}, "parts_appeared": 5}})),
    (2, json.dumps([{"word": "a", "examples": [{"source": "x"}, None, {"sentence": "no source"}], "parts_appeared": ["Part6", "7"]}])),
    (3, json.dumps({"meta": {"tool": "t"}, "data": {"entries": [{"word": "b", "examples": json.dumps([{"source": "y"}]), "parts_appeared": []}]}})),
    (4, None),
    (5, "  "),
    (6, "{broken"),
    (7, json.dumps({"c": {"vocab_id": None, "examples": None}})),
    (9, json.dumps({"e": {"examples": {"0": {"source": "u"}, "1": {"source": "v"}}}})),
    (8, json.dumps({"meta": {"rev": 1}, "data": {"entries": {"d": {"parts_appeared": [5, 6]}}}})),
]


def test_nested_shapes(spark):
    raw = spark.createDataFrame(PAYLOADS, "raw_id long, payload string")
    tagged = nested.flatten_payloads(raw)
    path = nested.write_tagged(tagged)
    got = {tuple(r) for r in nested.children(spark, path).collect()}
    assert got == {
        (1, "apply", "example", 1, "Vol 1"), (1, "apply", "part", 1, "5"), (2, "a", "example", 1, "x"), (2, "a", "example", 2, ""),
        (2, "a", "part", 1, "6"), (2, "a", "part", 2, "7"), (3, "b", "example", 1, "y"), (8, "d", "part", 1, "5"), (8, "d", "part", 2, "6"),
        (9, "e", "example", 1, "u"), (9, "e", "example", 2, "v"),
    }
    words = nested.read_flat(spark, path, "word")
    assert words.count() == 6 and nested.read_flat(spark, path, "error").count() == 1
    ex = nested.read_flat(spark, path, "example")
    assert ex.join(words.select(F.col("pk").alias("parent")), "parent").count() == ex.count()


def test_nested_survives_bad_payloads(spark):
    deep = "[" * 200_000 + "]" * 200_000
    raw = [
        (1, '{"a": {"parts_appeared": [NaN, Infinity, 1e999, 6], "examples": [{"source": "s", "page": NaN}]}}'),
        (2, '{"b": {"examples": [{"source": "x\\ud800y"}, "z\\udfff"]}, "\\ud800": {"parts_appeared": ["Part 007"]}}'),
        (3, json.dumps({"c": {"examples": deep, "parts_appeared": {}}})),
        (4, json.dumps({"d": {"examples": {}, "parts_appeared": []}})),
        (5, '{"e": ' + deep + "}"),
        (6, '{"f": {"parts_appeared": [' + "9" * 5000 + "]}}"),
        (7, '{"g": {"parts_appeared": ["' + "9" * 5000 + '", true, null]}}'),
        (8, "[]"), (9, "3"), (10, '{"h": {"vocab_id": ["x"], "chapter": "two", "examples": 7}}'),
    ]
    path = nested.write_tagged(nested.flatten_payloads(spark.createDataFrame(raw, "raw_id long, payload string")))
    got = {tuple(r) for r in nested.children(spark, path).collect()}
    assert got == {
        (1, "a", "part", 1, "6"), (1, "a", "example", 1, "s"), (2, "b", "example", 1, "x?y"), (2, "b", "example", 2, ""), (2, "?", "part", 1, "7"),
        (3, "c", "example", 1, ""), (7, "g", "part", 1, "9" * 5000),
    }
    assert {r["doc_id"] for r in nested.read_flat(spark, path, "error").collect()} == {5, 6}
    assert {(r["doc_id"], r["word"]) for r in nested.read_flat(spark, path, "word").collect()} == {(1, "a"), (2, "b"), (2, "?"), (3, "c"), (4, "d"), (7, "g"), (10, "h")}


def test_nested_found_against_brute_force(spark, sf):
    want = set()
    for rid, payload in table(spark, sf, "word_ets_examples_raw").select("raw_id", "payload").collect():
        root = json.loads(payload)
        entries = root["data"]["entries"] if isinstance(root, dict) and set(root) == {"meta", "data"} else root
        pairs = entries.items() if isinstance(entries, dict) else [(e["word"], e) for e in entries]
        for w, e in pairs:
            xs = e.get("examples") or []
            xs = json.loads(xs) if isinstance(xs, str) else xs
            xs = list(xs.values()) if isinstance(xs, dict) and "sentence" not in xs else xs
            for i, x in enumerate([xs] if isinstance(xs, dict) else xs, 1):
                want.add((rid, w, "example", i, x["source"].strip()))
            ps = e.get("parts_appeared", [])
            for i, p in enumerate(ps if isinstance(ps, list) else [ps], 1):
                want.add((rid, w, "part", i, re.sub(r"\D", "", str(p))))
    got = {tuple(r) for r in records.queries()["p2_found"](spark, sf).collect()}
    assert got == want


def test_nested_typed_rows(spark, sf):
    e = table(spark, sf, "word_ets_examples")
    tagged = nested.flatten_entries(e).cache()
    once = e.dropDuplicates(["entry_id"])
    n = once.agg(F.sum(F.size(F.coalesce("examples", F.array().cast(e.schema["examples"].dataType))))).first()[0]
    assert tagged.where("tag = 'example'").count() == n
    assert tagged.where("tag = 'word'").count() == once.count()


def test_salted_totals(spark):
    rows = [(i, " Hot " if i % 3 == 0 else f"w{i % 50}", 2) for i in range(3000)]
    rows += rows[:300] + [(None, "hot", 1), (99999, None, None)]
    df = spark.createDataFrame(rows, "id long, word string, n int")
    got = {r[0]: (r[1], r[2]) for r in salted.salted_distinct_totals(df, salted.word_key(F.col("word")), F.col("id"), F.col("n"), ("w", "a", "b")).collect()}
    want = defaultdict(dict)
    for i, w, n in rows:
        if i is not None:
            k = w.strip().lower() if w is not None else None
            want[k][i] = max(want[k].get(i, 0), n or 0)
    assert got == {k: (len(v), sum(v.values())) for k, v in want.items()}
    empty = spark.createDataFrame([], "entry_id long, word string, examples array<struct<ex_id long>>")
    assert salted.word_totals(empty).count() == 0


def test_heavy_keys_are_bounded(spark):
    counts = spark.createDataFrame([(i, 1000) for i in range(100)] + [(100, 90_000)], "k long, n long")
    assert [r[0] for r in skew.heavy_keys(counts, ["k"], "n").collect()] == [100]


def test_attach_by_key_with_hot_key(spark):
    rows = spark.createDataFrame([(0, i) for i in range(2000)] + [(i, i) for i in range(1, 200)] + [(None, 1)], "k long, v long")
    per = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    assert skew.attach_by_key(rows, per, ["k"], "n").count() == 2199


VOCAB = "id string, synonyms array<string>, meaning_kr string, loaded_at timestamp_ntz, value int"
QUEST = "id string, vocabulary string, value int"


def _packed(spark, vocab, questions):
    df = packed.packed_fields(spark.createDataFrame(vocab, VOCAB), spark.createDataFrame(questions, QUEST), min_regularity=0.5)
    out = defaultdict(list)
    for r in sorted(map(tuple, df.collect())):
        out[r[0], r[1]].append(r[3])
    return dict(out)


def test_packed_fields(spark):
    now = D(2025, 1, 1)
    vocab = [
        ("h1", ['give, "a; b"', None, " x ", ""], "(사람; 단체가) 하다; “가다, 오다” ;", now, 1),
        ("h1", ['give, "a; b"', None, " x ", ""], "(사람; 단체가) 하다; “가다, 오다” ;", now, 2),
        ("h2", [], "①하나 ② 둘", now, 1),
        ("h3", None, None, now, 1),
        ("h4", ["1) stay 2)  fund"], "  ", now, 1),
        ("h5", ["(1) p (2) q", "only"], "가\t나", now, 1),
    ]
    q = [("q1", "lease 임대차; cancel: 취소하다/fare = 요금", 1), ("q2", None, 1), ("q3", "one: 하나", 1), ("q4", "a: 가,b: 나", 1)]
    got = _packed(spark, vocab, q)
    assert got == {
        ("h1", "synonyms"): ["give", "a; b", "x"],
        ("h1", "meaning_kr"): ["(사람; 단체가) 하다", "가다, 오다"],
        ("h2", "meaning_kr"): ["하나", "둘"],
        ("h4", "synonyms"): ["stay", "fund"],
        ("h5", "synonyms"): ["p", "q", "only"],
        ("h5", "meaning_kr"): ["가", "나"],
        ("q1", "vocabulary"): ["lease 임대차", "cancel: 취소하다", "fare = 요금"],
        ("q3", "vocabulary"): ["one: 하나"],
        ("q4", "vocabulary"): ["a: 가", "b: 나"],
    }


def test_packed_delimiters_need_support_and_even_pieces(spark):
    """One stray slash among many values, and pieces of any number, make no delimiter."""
    stray = [("s", "alpha, beta, gamma")] * 500 + [("s", "one/two")]
    uneven = [("u", ";".join("abcdefghijk"[:k])) for k in (2, 11, 3, 5)]
    df = spark.createDataFrame(stray + uneven, "source string, value string")
    assert packed.accepted_delimiters(df) == {"s": [","]}
    for copies in (3, 10):  # the verdict doesn't move with the size
        assert packed.accepted_delimiters(spark.createDataFrame((stray + uneven) * copies, "source string, value string")) == {"s": [","]}
    scores = {r["delimiter"]: r for r in packed.delimiter_scores(df).where("source = 's'").collect()}
    assert scores["/"]["support"] < 0.005 < scores[","]["support"] and scores[","]["consistency"] == 1.0


def test_packed_very_long_and_empty(spark):
    text = ";".join(f'"v{i}, x"' for i in range(60_000))
    got = _packed(spark, [("h", None, text, D(2025, 1, 1), 1)], [])
    assert len(got["h", "meaning_kr"]) == 60_000
    assert _packed(spark, [], []) == {}


def _plain_split(value: str, delimiters: str) -> list[str]:
    """Character by character, as a check of the pattern."""
    value = value.strip()
    if re.match(r"\(1\)|1[.)]|①", value):
        value = re.sub(r"(?:(?<=\s)|^)(?:\(\d\)|\d[.)])|[①-⑩]", "\x01", value)
    out, cur, close = [], "", None
    for c in value:
        if close:
            cur += c
            close = None if c == close else close
        elif c in '"“(':
            cur, close = cur + c, {'"': '"', "“": "”", "(": ")"}[c]
        elif c in delimiters + "\x01":
            out.append(cur)
            cur = ""
        else:
            cur += c
    out.append(cur)
    tidy = [x.strip() for x in out]
    tidy = [x[1:-1].strip() if len(x) > 1 and (x[0], x[-1]) in {('"', '"'), ("“", "”")} else x for x in tidy]
    return [x for x in tidy if x]


def test_packed_found_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = set()
    for r in table(spark, sf, "vocab").collect():
        if r["meaning_kr"]:
            want |= {(r["id"], "meaning_kr", i, p) for i, p in enumerate(_plain_split(r["meaning_kr"], ",;/|\t\n·、，"), 1)}
        syn = [p for s in r["synonyms"] or [] for p in _plain_split(s, ",;/|\t\n")]
        want |= {(r["id"], "synonyms", i, p) for i, p in enumerate(syn, 1)}
    for r in table(spark, sf, "questions").collect():
        if r["vocabulary"]:
            want |= {(r["id"], "vocabulary", i, p) for i, p in enumerate(_plain_split(r["vocabulary"], ",;/|\t\n"), 1)}
    got = {tuple(r) for r in records.queries()["p5_found"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["p2_words", "p2_examples", "p2_parts"])
def test_flat_tables_link_to_parents(spark, sf, name):
    assert records.queries()[name](spark, sf).count() > 0
