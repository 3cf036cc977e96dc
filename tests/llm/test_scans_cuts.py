import pytest
from pyspark.sql import functions as F

from lexweave.llm import cuts, scans
from lexweave.session import table

VOCAB = {"the": 900, "meeting": 90, "long-term": 50, "plan": 80, "manager": 70, "reduce": 60, "clients": 50, "short": 99, "and": 500, "office": 90, "product": 60, "schedule": 40, "corner": 30}


@pytest.fixture(scope="module")
def noise():
    return scans.Noise(dict(VOCAB), ["day # word list", "reading section"], last_page=400)


@pytest.mark.parametrize(
    "text, kinds, out",
    [
        ("the mee-\nting plan", {"broken_word"}, "the meeting plan"),
        ("the mee­ ting", {"broken_word"}, "the meeting"),
        ("a long-\nterm plan", set(), None),
        ("short- and long-term", set(), None),
        ("the Zo- lina plan", {"broken_word"}, "the Zolina plan"),
        ("the rnanager met cl1ents", {"misread"}, "the manager met clients"),
        ("recluce the †he", {"misread"}, None),
        ("clients at the corner", set(), None),
        ("room B12 in Q4", set(), None),
        ("the plan\n- 12 -\nof the office", {"page_number"}, "the plan of the office"),
        ("DAY 03  Word List\nthe plan", {"running_head"}, "the plan"),
        ("the READING SECTION plan", {"running_head"}, "the plan"),
        ("see page\n129).", set(), None),
        ("The treaty was signed in\n1984\nand the war ended", set(), None),
        ("the plan\n212\nof the office", {"page_number"}, "the plan of the office"),
        ("the plan\n1001\nof the\n1002\noffice\n1003", {"page_number"}, "the plan of the office"),
        ("the plan\n1984\nof the\n1985\noffice", set(), None),
        ("", set(), ""),
    ],
)
def test_inspect(noise, text, kinds, out):
    got, repaired = noise.inspect(text)
    assert got == kinds
    if out is not None:
        assert repaired == out


def test_prefilter_passes_all_damage(spark, noise):
    texts = ["the mee-\nting", "the mee­ ting", "the rnanager", "cl1ents", "off1ce", "x\n12\ny", "in DAY 3 Word List", "of‐ fice"]
    df = spark.createDataFrame([(t,) for t in texts + ["clients at the corner", "the plan", ""]], "text string")
    got = {r[0] for r in df.where(scans.suspicious(F.col("text"), noise)).collect()}
    assert got == set(texts)


def test_verdicts_do_not_move_with_the_counts():
    """The same corpus a hundred times as large."""
    for text in ("short- and the plan", "the mee- ting", "a long- term plan", "the rnanager met cl1ents", "corn- er of the office"):
        one, many = (scans.Noise({w: n * k for w, n in VOCAB.items()}) for k in (1, 100))
        assert one.inspect(text) == many.inspect(text)


def test_long_texts_and_nulls(spark, noise):
    big = "the meeting plan " * 50_000 + "recluce " + "rn" * 200_000 + " " + "1l" * 200_000
    df = spark.createDataFrame([("f", "1", big), ("f", "2", "")], "field_name string, record_id string, text string")
    rows = {r["record_id"]: list(r["kinds"]) for r in scans.inspect_texts(df, scans.Learned(noise, None)).collect()}
    assert rows == {"1": ["misread"], "2": []}


def _corpus(spark, sf, times=1):
    e, q = table(spark, sf, "word_ets_examples"), table(spark, sf, "questions")
    copies = F.explode(F.sequence(F.lit(1), F.lit(times)))
    return tuple(t.withColumn("_n", copies).drop("_n") for t in (e, q))


def test_copies_of_the_corpus_change_no_verdict(spark, sf):
    """Every row ten times: damage and cuts of each record stay what they were."""
    one, many = _corpus(spark, sf), _corpus(spark, sf, 10)
    assert sorted(map(tuple, scans.damaged(*one).collect())) == sorted(map(tuple, scans.damaged(*many).collect()))
    assert sorted(map(tuple, cuts.cut_records(*one).collect())) == sorted(map(tuple, cuts.cut_records(*many).collect()))


def test_words_that_are_looked_up_count_like_those_sent(spark, monkeypatch):
    e, q = _corpus(spark, "/root/testdata/sf0.01")
    want = sorted(map(tuple, scans.damaged(e, q).collect()))
    assert len(want) > 500
    monkeypatch.setattr(scans, "WORDS_SENT", 300)
    learned = scans.learn_noise(scans.scan_texts(e, q))
    assert 0 < len(learned.noise.vocabulary) <= 300 and learned.rest is not None
    assert sorted(map(tuple, scans.damaged(e, q).collect())) == want


def test_heads_that_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(scans, "HEADS_SENT", 1)
    bodies = ["amber boats drift east", "crows find green hay", "ink jars keep lasting", "many nights open", "paper queens rest softly", "tall urns vanish"]
    rows = [("f", f"{h}{i}", f"{head}\n{b}") for i, b in enumerate(bodies) for h, head in (("a", "Quarterly Gazette 7"), ("b", "Quiet Almanac 8"))]
    texts = spark.createDataFrame(rows, "field_name string, record_id string, text string")
    learned = scans.learn_noise(texts)
    assert learned.noise.heads == ["quarterly gazette #"] and [r["key"] for r in learned.rest.collect()] == ["\nquiet almanac #"]
    got = {r["record_id"]: (list(r["kinds"]), r["repaired"]) for r in scans.inspect_texts(texts, learned).collect()}
    assert got == {r[1]: (["running_head"], r[2].split("\n")[1]) for r in rows}


def test_heads_beyond_those_sent_are_found_by_likeness_and_inside_lines(spark, monkeypatch):
    bodies = ["amber boats drift east", "crows find green hay", "ink jars keep lasting", "many nights open", "paper queens rest softly", "tall urns vanish"]
    heads = [("a", "Quarterly Gazette 7"), ("b", "Quiet Almanac 8"), ("c", "Ha-Noi Zephyr 3")]
    rows = [("f", f"{h}{i}", f"{head}\n{b}") for i, b in enumerate(bodies) for h, head in heads]
    rows += [("f", f"like-{h}", f"{head.replace('i', 'j')}x\nbricks fall down") for h, head in heads]
    rows += [("f", f"in-{h}", f"we saw {head.upper()} yesterday evening") for h, head in heads] + [("f", "no", "a quiet evening by the gazette")]
    texts = spark.createDataFrame(rows, "field_name string, record_id string, text string")
    monkeypatch.setattr(scans, "scan_texts", lambda e, q: e)
    told = lambda: {r["record_id"]: (list(r["kinds"]), r["repaired"]) for r in scans._inspected(texts, texts).collect() if r["kinds"]}
    want = told()
    assert {f"{p}-{h}" for p in ("like", "in") for h, _ in heads} <= set(want) and "no" not in want
    monkeypatch.setattr(scans, "HEADS_SENT", 1)
    assert told() == want


def test_pieces_of_heads_miss_nothing():
    import random

    draw = random.Random(7)
    for _ in range(3000):
        head = "".join(draw.choices("abc #", k=draw.randint(4, 40)))
        form = list(head)
        for _ in range(draw.randint(0, 7)):
            at = draw.randrange(len(form) + 1)
            form[at : at + draw.randint(0, 1)] = draw.choices("abcd", k=draw.randint(0, 1))
        form = "".join(form)
        if len(form) >= 4 and scans.alike(form, [head]):
            assert any(p in form for p in scans.head_pieces(head))


def test_heads_stand_above_unlike_texts(spark):
    """A head may stand at one edge only; lines of one text in many copies, and sentence ends, are none."""
    words = "amber boats crows drift east find green hay ink jars keep lasting many nights open paper queens rest softly tall urns vanish".split()
    heads = [("f", f"h{i}", f"The Gazette, {i}\n{' '.join(words[i : i + 4])}\nwe must leave.") for i in range(18)]
    copies = [("f", f"c{i}", f"Ruby lantern glows\nabove the river and the hills{'!' * i}") for i in range(30)]
    plain = [("f", f"p{i}", f"Before {w} we must leave.") for i, w in enumerate(words)]
    texts = spark.createDataFrame(heads + copies + plain, "field_name string, record_id string, text string")
    assert scans.learn_noise(texts).noise.heads == ["the gazette, #"]


@pytest.mark.parametrize("explicit, bare, want", [([], [], 0), ([3, 9, 40, 77, 120], [5, 1984], 120), ([12, 470, 300, 150, 60], [], 470), ([], [*range(1, 90, 3), 1984], 88), ([], [1984, 2001], 0), ([1984], [], 0)])
def test_last_page(explicit, bare, want):
    assert scans.last_page(explicit, bare) == want


@pytest.mark.parametrize(
    "text, told",
    [
        ("we meet at noon on Friday", cuts.BY_PHRASE),
        ("we meet at noon on Friday ", cuts.CUT),
        ("at noon on **Friday", cuts.CUT),
        ("x (at noon on Friday", cuts.CUT),
        ("at noon on Fr…", cuts.CUT),
        ("It ends here.\n12", cuts.WHOLE),
        ("The manager (see p.", cuts.CUT),
        ('She said "Mr.', cuts.CUT),
        ("The firm (Acme Inc.", cuts.CUT),
        ("The firm (Acme Inc.) met.", cuts.WHOLE),
        ("", cuts.WHOLE),
    ],
)
def test_judge(noise, text, told):
    assert cuts.judge(text, noise.inspect(text)[1])[0] == told


def test_ends_limits_and_stops(spark):
    """A full set of texts by two feeds: one cuts at 30 characters, one sets no full stops."""
    days = "Monday Tuesday Wednesday Thursday Friday".split()
    names = "Ann Bob Cid Dan Eve Flo Gus Hal Ida Jon Kim Lea".split()
    whole = [f"{n} meets the {t} at noon on {d}" for n in names for t in ("team", "board") for d in days]
    rows = [(f"a{i}", "a", w + ".") for i, w in enumerate(whole)]
    rows += [(f"l{i}", "a", (f"{n} met " + "x" * 40)[:30]) for i, n in enumerate(names)]
    rows += [(f"n{i}", "n", w) for i, w in enumerate(whole)]
    rows += [("cut", "a", "Ann meets the team at noon on Fri"), ("stop", "a", "Zoe meets the team at noon on Friday"), ("open", "a", "Ann meets (the team at noon on Friday."), ("bare", "n", "Ann meets the team at noon on Fri"), ("z", None, None), ("blank", "a", " ")]
    entries = spark.createDataFrame([], "feed string, examples array<struct<ex_id: bigint, sentence: string, page: int>>")
    q = spark.createDataFrame([(i, f, t, "x", "x") for i, f, t in rows], "id string, feed string, translation string, sentence string, explanation string")
    for times in (1, 7):
        many = q.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_n")
        assert {r["record_id"] for r in cuts.cut_records(entries, many).collect()} == {"cut", "open", *(f"l{i}" for i in range(12))}


@pytest.mark.parametrize("text, is_open", [("a **b", True), ("a **b** (c)", False), ("“a", True), ("‘a b’", False), ('say "x', True), ("a\\u00e", True), ("ok", False), ("in *June*", False), ("by Foods *", True), ("2 * 3 * 4", False)])
def test_stack(text, is_open):
    assert cuts.unclosed(text) is is_open


def test_open_end_in_the_jvm(spark):
    rows = [("Done.", False), ("Done!”", False), ("Done", True), ("Done…", True), ("Done. ", False), ("", False), ("  ", False), ("끝났다.", False), ("(see page 3).", False)]
    rows += [(t + end, want) for t in ("x", "A word " * 30) for end, want in ((".", False), ("." + ")" * 50, False), (")" * 50, True), ("." + " " * 60, False), (" " * 60, True), ("..." + " " * 45, True), ("..." + " " * 28, True), ("!" + '"' * 29, False), ("…", True))]
    df = spark.createDataFrame(rows, "text string, want boolean").withColumn("got", cuts.open_end(F.col("text")))
    assert df.where("got <> want").count() == 0


def test_the_jvm_passes_all_that_the_automaton_finds(spark):
    texts = ["(a [b) c.", "([).", "(“)”.", '(a " b).', "**a *b*.", "*a.", "(a (b) c.", "‘a.", "“a.", "{a.", "(a) b.", '"a" b.', "**a** b.", "((a) (b)).", "a) b.", "*a* **b**."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    passed = {r[0] for r in df.where(cuts.may_be_unclosed(F.col("text"))).collect()}
    assert {t for t in texts if cuts.unclosed(t)} <= passed and not passed & {"(a) b.", '"a" b.', "**a** b.", "a) b.", "*a* **b**."}


def test_end_phrase_is_the_same_in_both(spark):
    texts = ["moved to room B12.", "by the end of the week", "**x** y (see page 41).", "안에 새 계약서를 승인받지 못했다.", "one", "a " + "x" * 200 + " of " + "y" * 90 + " z."]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("end", cuts._last_words(F.col("text"), 4))
    for r in df.collect():
        assert r["end"] == cuts.end_phrase(r["text"])[0]


def test_whole_tables(spark, sf):
    e, q = table(spark, sf, "word_ets_examples"), table(spark, sf, "questions")
    got = cuts.cut_records(e, q)
    assert got.count() == got.distinct().count() > 0
    assert scans.damaged(e, q).count() > 0
    fixed = scans.repaired(e, q)
    assert fixed.where("text like '%\n%'").count() == 0
    shares = cuts.cut_shares(e, q)
    assert shares.where("n_cut > n_texts or share > 1").count() == 0


def test_empty_tables(spark, sf):
    e, q = table(spark, sf, "word_ets_examples").limit(0), table(spark, sf, "questions").limit(0)
    assert cuts.cut_records(e, q).count() == 0
    assert scans.damaged(e, q).count() == 0
