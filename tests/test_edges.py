"""Nulls, empty tables, ties, long texts, clashing columns; sources and sinks; plans."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from lexweave import session
from lexweave.functions import classify, morph, text
from lexweave.operators import cards, exams, filling, markdown, matching, patches, quality, reports
from lexweave.sources import files, sinks
from lexweave.streaming import responses

Q = "id string, volume int, test int, part int, question_number int, sentence string, choices map<string,string>, answer string, category string, explanation string, translation string, vocabulary string, deleted boolean, loaded_at timestamp, token string, n int"
V = "id string, word string, pos string, meaning_kr string, meaning_en string, day int, level string, frequency string, synonyms array<string>, related_words array<string>, example_sentence string, example_translation string, deleted boolean, loaded_at timestamp, rank int"
E = "entry_id long, word string, vocab_id string, total_count int, examples array<struct<ex_id long, sentence string, source string, volume int, test int, page int, question_number int, part int, matched_form string>>, feed string, n_examples int"


@pytest.fixture(scope="module")
def empty(spark):
    return [spark.createDataFrame([], s) for s in (Q, V, E)]


@pytest.fixture(scope="module")
def nulls(spark):
    return [spark.createDataFrame([tuple([f"id{i}"] + [None] * (len(s.split(", ")) - 1)) if s is not E else (i, *[None] * 6) for i in (1, 1, 2)], s) for s in (Q, V, E)]


def _all(q, v, e):
    ex = reports.examples(e)
    toks = reports.question_tokens(q)
    words = matching.vocabulary_words(v)
    forms = matching.word_forms(words)
    counts = reports.example_counts(e)
    sents = q.select("id", "sentence")
    return [
        reports.word_frequency_top(toks), reports.word_frequency_top_per_group(toks, "volume"), reports.category_counts(q), reports.category_pivot(q), reports.category_share(q),
        reports.ordered_categories(q, ["어휘"]), reports.coverage(v, counts), reports.tokens_not_in(toks, v), reports.without_examples(v, counts), reports.word_documents(ex), reports.top_examples(ex),
        patches.chapter_map(v), matching.probe_all(sents, forms), matching.probe_per_field(q, forms), matching.inverted_index(forms), matching.verified_phrases(sents, words),
        quality.issues(q, quality.question_rules(), "q"), quality.issues(v, quality.vocab_rules(), "v"), quality.sequence_gaps(q), quality.wrong_totals(e), quality.fixed_sentences(q),
        patches.update_from_explanation(q), patches.pos_corrections(v), patches.apply_patches(e, patches.repaired_examples(e)), patches.matched_questions(ex, q), patches.sequential_ids(v),
        patches.unique_names(v), patches.canonical_words(e), patches.incremental_merge(ex, ex), patches.word_sets(v, e), exams.allocation(exams.category_sizes(q), 5), exams.stratified_sample(q, 5),
        exams.balanced_sample(v, 5), exams.distractors(v), exams.permuted_options(q), cards.vocab_cards(v, ex), cards.notes(v), cards.page_links(cards.pages(v)), cards.tag_histogram(v),
    ]


def test_empty_tables(empty):
    for df in _all(*empty):
        assert df.count() in (0, 4)  # word_sets has a row per kind


def test_nulls_in_every_column(nulls):
    for df in _all(*nulls):
        df.collect()


def test_ties_are_settled_by_first_occurrence(spark):
    rows = [("q2", 1, "beta alpha"), ("q1", 1, "gamma alpha"), ("q3", 1, "gamma beta")]
    q = spark.createDataFrame([(i, v, 1, 5, 101, s, {}, None, None, None, None, None, None, None, "x", 1) for i, v, s in rows], Q)
    got = [r["token"] for r in reports.word_frequency_top(reports.question_tokens(q)).orderBy("rank").collect()]
    assert got == ["gamma", "alpha", "beta"]


def test_keep_first_and_counts(spark):
    e = spark.createDataFrame(
        [(1, " Go ", None, 9, [(3, "A **x**  y", "s3", 2, 1, None, 1, 5, "x"), (4, "a X Y", "s4", 1, 1, None, 1, 6, "x")], "f", 1), (1, " Go ", None, 9, [(3, "A **x**  y", "s3", 2, 1, None, 1, 5, "x")], "f", 1), (2, "go", None, 0, [], "f", 1)], E
    )
    r = reports.word_documents(reports.examples(e)).collect()
    assert [(x["word"], x["total_count"], x["parts"], x["first_sources"]) for x in r] == [("go", 1, "5", "s3")]
    assert {(x["word"], x["n_examples"]) for x in reports.example_counts(e).collect()} == {("go", 2)}
    assert {x["entry_id"] for x in quality.wrong_totals(e).collect()} == {1}


@pytest.mark.parametrize(
    "choices, want",
    [
        ({"A": "customer", "B": "report", "C": "plan", "D": "staff"}, "비교급/최상급"),
        ({"A": "he", "B": "his", "C": "him", "D": "plan"}, "대명사"),
        ({"A": "who", "B": "which", "C": "plan", "D": "staff"}, "관계대명사"),
        ({"A": "despite", "B": "although", "C": "since", "D": "plan"}, "접속사/전치사"),
        ({"A": "decide", "B": "decision", "C": "decisive", "D": "go"}, "품사"),
        ({"A": "was seen", "B": "seeing", "C": "plan", "D": "sky"}, "동사시제/태"),
        ({"A": "plan"}, "기타문법"),
        (None, "기타문법"),
    ],
)
def test_rule_order(spark, choices, want):
    df = spark.createDataFrame([(choices,)], "c map<string,string>")
    assert df.select(classify.classify_choices(F.col("c"))).first()[0] == want


def test_phrases(spark):
    sents = [("s1", "We are eligible for it"), ("s2", "eligible for it"), ("s3", "They achieve the goal"), ("s4", "agreed"), ("s5", "annual x x x x x report"), ("s6", "the annual report"), ("s7", "behalf of x on")]
    vocab = [(f"h{i}", w, *[None] * 13) for i, w in enumerate(["be eligible for", "achieve one's goal", "agree to do", "annual report", "on behalf of"])]
    got = {tuple(r) for r in matching.verified_phrases(spark.createDataFrame(sents, "id string, sentence string"), matching.vocabulary_words(spark.createDataFrame(vocab, V))).collect()}
    assert got == {("s1", "be eligible for"), ("s3", "achieve one's goal"), ("s4", "agree to do"), ("s6", "annual report"), ("s7", "on behalf of")}


def test_word_forms(spark):
    df = spark.createDataFrame([("apply",), ("cat",), ("ab",), (None,)], "w string")
    got = {r[0]: r[1] for r in df.select("w", morph.family(F.col("w"))).collect()}
    assert {"took", "taken", "taking"} <= set(spark.createDataFrame([("Take",)], "w string").select(morph.variants(F.col("w"))).first()[0])
    assert "applying" in got["apply"] and "cater" in got["cat"] and got["ab"] == []


def test_text_functions(spark):
    one = lambda c, **k: spark.createDataFrame([tuple(k.values())], ", ".join(f"{n} string" for n in k)).select(c).first()[0]
    assert one(text.fill_first(F.col("s"), F.col("a")), s="a ------- b -------", a="$1\\1") == "a $1\\1 b -------"
    assert one(text.bold(F.col("s"), F.col("f")), s="Plan the plans, PLAN.", f="plan") == "**Plan** the plans, **PLAN**."
    assert one(text.unbold(text.bold(F.col("s"), F.col("f"))), s="Plan it", f="plan") == "Plan it"
    assert one(text.escape_html(F.col("s")), s="<a&'\">") == "&lt;a&amp;&#x27;&quot;&gt;"
    assert one(text.dedupe_key(F.col("s")), s=" A **b**\n c ") == "a b c"
    assert one(F.size(text.sentences(F.col("s"))), s="It is a test. (Another one) here! tiny") == 2
    assert one(text.repair(F.col("s")), s="A long enough sentence here. 한글") == "A long enough sentence here."


def test_allocation_sums_up(spark):
    for sizes, count in (([50, 30, 15, 5], 20), ([3, 1, 1], 4), ([1, 1], 10), ([100, 1, 1, 1, 1, 1], 4)):
        df = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate(sizes)], "category string, size long")
        rows = exams.allocation(df, count).collect()
        assert all(1 <= r["alloc"] <= r["size"] for r in rows)
        assert sum(r["alloc"] for r in rows) == max(min(count, sum(sizes)), len(sizes))


def test_row_numbers_without_one_task(spark):
    df = spark.range(5000).withColumn("k", F.expr("(id * 7919) % 1000"))
    got = patches.with_row_number(df, ["k", "id"]).orderBy("k", "id").select("row_no").collect()
    assert [r[0] for r in got] == list(range(1, 5001))


def test_containment_and_normalised_key(spark):
    body = "one two three four five six seven eight"
    key = "id string, key string"
    needles = [("a", "one two three four five six seven"), ("b", "one two three four five six nine"), ("c", "two three"), ("d", "wo three"), ("e", ""), ("f", None), ("g", "eight"), ("h", body)]
    pairs = filling.contained_pairs(spark.createDataFrame(needles, key), spark.createDataFrame([("p1", "zero " + body), ("p2", None), ("p3", "two three")], key))
    assert sorted(map(tuple, pairs.collect())) == [("a", "p1"), ("c", "p1"), ("c", "p3"), ("g", "p1"), ("h", "p1")]
    q = spark.createDataFrame([("q2", "one ------- three", {"A": "two"}, "A"), ("q1", "One two ------- !", {"A": "three"}, "A")], "id string, sentence string, choices map<string,string>, answer string")
    ex = spark.createDataFrame([(7, "ONE two  three.")], "ex_id long, sentence string")
    assert [tuple(r) for r in patches.matched_questions(ex, q).collect()] == [(7, "q1")]


def test_phrases_keep_no_words_of_sentences(spark):
    import glob

    kept = lambda: set(glob.glob(f"{session.scratch_dir(spark).removeprefix('file:')}/phrase-*"))
    text = "if(id % 2 = 0, 'we then comply very fully and keep the new rule of the house', 'with rules we comply and comply one with rules')"
    sentences = spark.range(500).selectExpr("concat('s', id) as id", f"{text} as sentence")
    words = spark.createDataFrame([("comply with", "w1"), ("comply with rules", "w2"), ("be with", "w3"), ("absent rule", "w4")], "word string, first_id string")
    before = kept()
    got = {tuple(r) for r in matching.verified_phrases(sentences, words).collect()}
    assert got == {(f"s{i}", "comply with") for i in range(1, 500, 2)} | {(f"s{i}", "comply with rules") for i in range(1, 500, 2)}
    assert sum(spark.read.parquet(p).count() for p in kept() - before) < 2 * 500
    assert matching.verified_phrases(sentences.limit(0), words).count() == matching.verified_phrases(sentences, words.limit(0)).count() == 0


def test_containment_of_texts_that_begin_alike(spark):
    begun = "according to the notice on this page"
    needles = spark.range(300).selectExpr("concat('n', id) as id", f"concat('{begun} the office n', id, ' is closed') as key")
    bodies = spark.range(200).selectExpr("concat('b', id) as id", f"concat('{begun} the office n', id, ' is closed and {begun} the office n', id + 150, ' is open') as key")
    assert sorted(map(tuple, filling.contained_pairs(needles, bodies).collect())) == sorted((f"n{i}", f"b{i}") for i in range(200))
    assert filling.nominated_pairs(needles, bodies).count() <= 2 * 300  # and not all 300 x 200 pairs


def test_fill_pipeline(spark):
    ex = [("go", 0, "We ------- home."), ("go", 1, "Well, we ------- home. Now."), ("go", 2, "No **blank** here."), ("go", 3, "Nothing ------- this."), ("do", 0, "they ------- it often"), ("do", 1, None)]
    ex = spark.createDataFrame(ex, "word string, idx long, sentence string")
    q = [("q2", "We ------- home.", {"A": "walk"}, "A"), ("q1", "We ------- home.", {"A": "went"}, "A"), ("q3", "I know that they ------- it often!", {"B": "do"}, "B"), ("q4", None, {"A": "x"}, "A"), ("q5", "Bad ------- one", {"A": "x"}, "C")]
    answers = filling.answer_keys(spark.createDataFrame(q, "id string, sentence string, choices map<string,string>, answer string"))
    made = filling.fill_patches(ex, answers)
    assert sorted(map(tuple, made.collect())) == [
        ("do", 0, "they **do** it often", "contained"), ("go", 0, "We **went** home.", "exact"), ("go", 1, "Well, we **went** home. Now.", "contained"),
    ]
    more = made.select("word", "idx", "new_sentence").union(spark.createDataFrame([("go", 99, "out of range")], "word string, idx long, new_sentence string"))
    kept = {(r["word"], r["idx"]): (r["sentence"], r["patched"]) for r in filling.patched_examples(ex, more).collect()}
    assert kept == {("go", 0): ("We **went** home.", True), ("go", 1): ("Well, we **went** home. Now.", True), ("go", 2): ("No **blank** here.", False), ("do", 0): ("they **do** it often", True), ("do", 1): (None, False)}
    assert filling.fill_patches(ex.limit(0), answers).count() == 0 and filling.fill_patches(ex, answers.limit(0)).count() == 0


def test_merges_by_key(spark):
    q = [("a", 1, 1, 101, None, {"A": "x", "B": "y"}), ("b", 1, 1, 102, "A", {"A": "x"}), ("c", 1, 1, 103, None, {"A": "x"}), ("d", 1, None, 104, None, None)]
    q = spark.createDataFrame(q, "id string, volume int, test int, question_number int, answer string, choices map<string,string>")
    key = spark.createDataFrame([(1, 1, 101, " b"), (1, 1, 101, "b "), (1, 1, 102, "B"), (1, 1, 103, "D"), (1, 1, 104, None)], "volume int, test int, question_number int, answer string")
    assert sorted(map(tuple, filling.merged_answers(q, key).collect())) == [("a", "B", "filled"), ("b", "A", "kept"), ("c", None, "invalid"), ("d", None, "open")]
    v = spark.createDataFrame([("1", "n."), ("2", "verb"), ("3", "noun/adj."), ("4", None)], "id string, pos string")
    c = spark.createDataFrame([("1", "noun"), ("2", "noun, verb"), ("3", "what"), ("4", "adverb")], "id string, pos string")
    assert sorted(map(tuple, filling.corrected_pos(v, c).collect())) == [("1", "noun", "unchanged"), ("2", "noun,verb", "updated"), ("3", "adjective,noun", "missing"), ("4", "adverb", "updated")]


def test_decided_pos(spark):
    rows = [("despite", "", None, "preposition"), ("timely", "x", None, "adjective"), ("gladly", "기쁜", None, "adverb"), ("be able to", "할 수 있다", None, "verb"), ("as of", "날짜", None, "noun"), ("firm", "확고한", None, "adjective"),
            ("walk", "걷기", "verb", "noun"), ("create", "", "verb", "verb"), ("portable", "", "noun", "adjective"), ("zorp", "", "verb", "verb"), ("zorp", None, None, "noun"), (None, None, None, "noun"), ("notice", "공지하다", None, "verb")]
    df = spark.createDataFrame(rows, "word string, gloss string, tag string, want string")
    got = df.withColumn("got", morph.decide_pos(F.col("word"), F.col("gloss"), F.col("tag")))
    assert got.where("got <> want").collect() == []


def test_words_without_examples(spark):
    v = spark.createDataFrame([("1", " Go "), ("2", "be"), ("3", None)], "id string, word string")
    counts = spark.createDataFrame([("go", 0), ("be", 2)], "word string, n_examples long")
    assert sorted(map(str, (tuple(r) for r in reports.without_examples(v, counts).collect()))) == ["('1', 'go')", "('3', None)"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    ev = lambda rows: spark.createDataFrame([(i, dt.datetime(2025, 1, d, h), u, "view", 30.0, "{}") for i, d, h, u in rows], responses.EVENTS)
    run = lambda: {(r["day"], r["total"]) for r in responses.run_available(responses.daily_grades(responses.response_stream(spark, str(tmp_path / "in"))), "d", ["day", "category"], folder=str(tmp_path / "out")).collect()}
    ev([(1, 1, 1, 1), (2, 1, 2, 1), (1, 1, 1, 1)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {("2025-01-01", 2)}
    ev([(3, 1, 3, 1), (4, 2, 1, 1)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {("2025-01-01", 3), ("2025-01-02", 1)}
    assert run() == {("2025-01-01", 3), ("2025-01-02", 1)}
    sittings = responses.stream_sessions(responses.response_stream(spark, str(tmp_path / "in")), str(tmp_path / "s"))
    assert sorted((r["start"], r["n"]) for r in sittings.collect()) == [(f"2025-01-01 0{h}:00:00", n) for h, n in ((1, 2), (2, 1), (3, 1))]


def test_pages_only_go_into_mounted_folders(spark):
    with pytest.raises(ValueError):
        sinks.page_files(spark.createDataFrame([("a.md", "x")], "path string, content string"), "s3a://bucket/x")


def test_config(spark, tmp_path):
    (tmp_path / "c.yaml").write_text('# all\nproject:\n  name: "Some: name"  # here\nets:\n  volumes: [1, 2, 3]\n  deep:\n    x: 1\nvocab:\n  total_days: 30\nkinds:\n  - "a"\n  - b\nlast: yes\n')
    assert files.config(spark, str(tmp_path / "c.yaml")) == {
        "project.name": "Some: name", "ets.volumes.0": "1", "ets.volumes.1": "2", "ets.volumes.2": "3", "ets.deep.x": "1", "vocab.total_days": "30", "kinds.0": "a", "kinds.1": "b", "last": "yes",
    }


def test_markdown_blocks(spark):
    text = "#### Use\n- one **b**\n* two\n1. x\n2. y\n\n|a|b|\n|-|-|\n| c | *d* |\n> said\n> [!tip]\n```py\nif a < b:\n- no list"
    got = {r["id"]: r["html"] for r in markdown.page_html(spark.createDataFrame([("1", text), ("2", None), ("3", "")], "id string, body string")).collect()}
    assert got["1"].split("\n") == [
        "<h5 class='vsub'>Use</h5>", "<ul class='vlist'>", "<li>one <strong>b</strong></li>", "<li>two</li>", "</ul>", "<ol class='vlist'>", "<li>x</li>", "<li>y</li>", "</ol>",
        '<table class="vtable"><tbody>', "<tr><td>a</td><td>b</td></tr>", "<tr><td>c</td><td><em>d</em></td></tr>", "</tbody></table>", "<blockquote>said</blockquote>",
        '<pre class="vcode"><code class="lang-py">', "if a &lt; b:", "- no list", "</code></pre>",
    ]
    assert got["2"] is None and got["3"] == ""


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "vol1_part5.json").write_text(json.dumps([{"id": "a", "volume": 1, "choices": {"A": "x"}}, {"id": "b"}]))
    (tmp_path / "vol2_part5.json").write_text("{broken")
    rows = files.volume_of(files.json_arrays(spark, str(tmp_path / "vol*_part5.json"))).orderBy("file", "pos").collect()
    assert [(r["pos"], r["id"], r["file_volume"]) for r in rows] == [(0, "a", 1), (1, "b", 1)]
    (tmp_path / "map.json").write_text(json.dumps({"go": {"n": 1}, "be": {"n": 2}}))
    assert [(r["pos"], r["key"]) for r in files.keyed_documents(spark, str(tmp_path / "map.json")).orderBy("pos").collect()] == [(0, "go"), (1, "be")]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/page_0007.txt").write_text("text\nmore")
    assert [(r["page"], r["text"]) for r in files.page_texts(spark, str(tmp_path / "pages")).collect()] == [(7, "text\nmore")]
    pages = spark.createDataFrame([("day01/go.md", "---\nword: go\nday: 1\n---\n# go\n## Use\nhere\n## Other\nx")], "path string, content string")
    assert sinks.page_files(pages, str(tmp_path / "vault")) == 1
    md = files.markdown_pages(spark, str(tmp_path / "vault"))
    assert md.first()["front"] == {"word": "go", "day": "1"}
    assert [(r["heading"], r["text"]) for r in files.sections(md, ["Use"]).collect()] == [("Use", "here")]
    (tmp_path / "w.csv").write_text("Day 3,go,가다,be,있다\nDay 4,do,하다,,\n")
    assert files.word_sheets(spark, str(tmp_path / "w.csv")).count() == 3
    (tmp_path / "k.json").write_text(json.dumps({"q": "B"}))
    assert [tuple(r) for r in files.answer_key(spark, str(tmp_path / "k.json")).collect()] == [("q", "B")]
    sinks.html_report({"a<b": spark.range(3)}, str(tmp_path / "r.html"))
    assert "a&lt;b" in (tmp_path / "r.html").read_text()
    sinks.batch_files(spark.range(10).withColumn("batch_id", F.col("id") % 2), str(tmp_path / "b"))
    assert {d for d in os.listdir(tmp_path / "b") if d.startswith("batch_id")} == {"batch_id=0", "batch_id=1"}
    assert spark.read.parquet(sinks.next_version(spark.range(2), str(tmp_path / "t"), 1)).count() == 2


def test_plans_stay_in_the_jvm(spark, sf):
    from lexweave.plans import reports as plan
    from lexweave.plans import study

    for name, q in {**plan.queries(), **{k: study.queries()[k] for k in ("token_probe_all", "phrase_match_verified", "dq_issues")}}.items():
        text_plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text_plan and "CartesianProduct" not in text_plan and "NestedLoop" not in text_plan, name


def test_column_pruning_reaches_the_scan(spark, sf):
    from lexweave.plans import records

    plan = records.queries()["p4_found"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    schema = [x for x in plan.split("ReadSchema: ")[1:]]
    assert schema and all("sentence" not in x.split("\n")[0] for x in schema)


def test_resolve_blanks_by_context_and_label(spark):
    from lexweave.operators import passages

    body = "Questions 141-144 refer to the following letter.\nDear guest, we are glad to ------- you here.\nThe hall is 144. ------- today for all of the members.\nQuestions 145-146 refer to the following memo.\nStaff should ------- early on every Monday morning."
    p = spark.createDataFrame([("p", body)], "id string, raw_text string")
    s = spark.createDataFrame(
        [("a", "p", "Dear guest, we are **glad** to ------- you here."), ("b", "p", "The hall is 144. ------- today for all of the members."), ("c", "p", "x ------- early on every Monday morning."), ("d", "p", "no blank"), ("e", "p", "unknown words stand here ------- and nowhere else at all")],
        "sent_id string, id string, sentence string",
    )
    assert {tuple(r) for r in passages.resolve_blanks(s, p).collect()} == {("a", 141), ("b", 144), ("c", 145)}


def test_reading_order_and_entry_blocks(spark):
    from lexweave.functions import pages
    from lexweave.operators import passages

    b = spark.createDataFrame([(1, 300.0, 5.0, "c"), (1, 10.0, 50.0, "b"), (1, 20.0, 5.0, "a")], "page int, x0 double, y0 double, text string")
    assert [r["text"] for r in passages.reading_order(b).orderBy("place").collect()] == ["a", "b", "c"]
    lines = ["머리말", "schedule ★", "[skedʒul]", "일정", "approve", "승인하다"]
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "id string, line_no int, line string")
    got = [(r["head"], r["n_lines"], r["gloss"]) for r in passages.entry_blocks(rows, pages.is_headword(F.col("line"))).orderBy("block").collect()]
    assert got == [("schedule ★", 3, "일정"), ("approve", 2, "승인하다")]


def test_majority_takes_the_first_of_equals(spark):
    v = spark.createDataFrame([("h3", "go", "noun"), ("h1", "Go", "verb"), ("h2", "go", "noun"), ("h0", "go", "verb")], "id string, word string, pos string")
    assert [tuple(r) for r in cards.majority_pos(v).collect()] == [("go", "verb")]


def test_outside_function_in_batches(spark):
    from lexweave.operators import external

    rows = spark.createDataFrame([(i, "noun") for i in range(130)], "id long, pos string")
    done = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    left = external.pending(rows, done, "id")
    assert left.count() == 128
    replies = external.in_batches(left, lambda p: p.assign(pos="verb", n=len(p)), "id long, pos string, n long", size=50, workers=2)
    assert replies.agg(F.max("n")).first()[0] <= 50
    merged = external.merge_replies(rows, replies.select("id", "pos"), "id", "pos")
    assert {(r["pos"], r["count"]) for r in merged.groupBy("pos").count().collect()} == {("verb", 128), ("noun", 2)}
