"""Page parsing on hand-made text."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import pages

C = F.col


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(f(*(C(f"v{i}") for i in range(len(values)))).alias("x")).first()["x"]


def test_questions_and_choices(spark):
    page = "PART 5\n101. The plan ///// today. (A) be (B) is\n(C) are (D) was\n102. Next\n\nword (A) x"
    blocks = one(spark, lambda p: pages.question_blocks(pages.clean_page(p)), page)
    assert [b["number"] for b in blocks] == [101, 102]
    assert one(spark, pages.question_text, blocks[0]["body"]) == "The plan ------- today."
    assert one(spark, pages.choices, blocks[0]["body"]) == {"A": "be", "B": "is", "C": "are", "D": "was"}
    assert one(spark, pages.question_text, blocks[1]["body"]) == "Next ------- word"
    assert one(spark, pages.choices, blocks[1]["body"]) == {"A": "x"}


def test_answer_key(spark):
    got = one(spark, pages.answer_entries, "101 (8) 10 2 (0)\n103 (A")
    assert [(a["number"], a["answer"]) for a in got] == [(101, "B"), (102, "D"), (103, "A")]


def test_explanation(spark):
    x = one(spark, pages.explanation_sections, "TEST 3\n명사 자리\n계속\n해설 하나\n둘\n번역\n셋\n어휘 a 가")
    assert (x["category"], x["explanation"], x["translation"], x["vocabulary"]) == ("명사 자리 계속", "하나 둘", "셋", "a 가")
    assert one(spark, pages.explanation_sections, "only a category") is None
    assert one(spark, pages.explanation_sections, None) is None


@pytest.mark.parametrize(
    "line, want",
    [("ㅁ devoted adj 헌신 적인", ("devoted", "adjective", "헌신, 적인")), ("O take part in 참여", ("take part in", "", "참여")), ("no hangul here", None), ("a b c d e f 가나", None), ("", None)],
)
def test_word_list(spark, line, want):
    x = one(spark, pages.word_list_line, line)
    assert (tuple(x) if x else None) == want


def test_predicates(spark):
    assert one(spark, pages.is_headword, "★★ schedule") and not one(spark, pages.is_headword, "schedule [skedʒul]") and not one(spark, pages.is_headword, "일정 a")
    assert one(spark, pages.star_tier, "go ***") == "★★★" and one(spark, pages.star_tier, "go ★") == "★" and one(spark, pages.star_tier, "go") == ""
    assert one(spark, pages.is_comic_page, "a\nb") and not one(spark, pages.is_comic_page, "schedule\n1\n2\n3\n4")
    assert one(spark, pages.page_day, "x\nDAY 07\ny") == 7 and one(spark, pages.page_day, "x\n\n\n\n\nDAY 7") is None
    assert one(spark, pages.page_topic, "채용\n\nDAY 01\n규칙 따위") == "규칙"


def test_filled_html(spark):
    assert one(spark, pages.filled_html, "a<b ------- c -------", "x&y") == "a&lt;b <b>x&amp;y</b> c -------"
    assert one(spark, pages.filled_html, "a—b", "x") == "a <b>x</b> b"
    assert one(spark, pages.filled_html, "no blank", "x") == "no blank [→ <b>x</b>]"


def test_fenced_json(spark):
    f = lambda c: pages.fenced_json(c, "a int")
    assert one(spark, f, '```json\n{"a": 1}\n```')["a"] == 1
    assert one(spark, f, 'Here: {"a": 2} ok')["a"] == 2
    assert one(spark, f, "none") is None
