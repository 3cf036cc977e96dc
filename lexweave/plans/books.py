"""Queries that write records as book pages and read them back; their SQL is the records themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages, text
from ..operators import reports as r
from ..session import table
from .reports import questions, vocab
from .sql import LIVE_Q, P, V, WORD, strip, white


def _question_pages(s, d):
    """(volume, test, page): the complete questions of a test as one page."""
    q = questions(s, d).where("sentence is not null and size(choices) = 4")
    block = F.concat(F.col("question_number").cast("string"), F.lit(". "), text.collapse("sentence"), *(x for k in "ABCD" for x in (F.lit(f"\n({k}) "), F.col("choices")[k])))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("question_number", "id", block.alias("b")))), lambda x: x["b"])
    return q.where("question_number is not null").groupBy("volume", "test").agg(F.array_join(lines, "\n").alias("page"))


def _parsed_questions(s, d):
    rows = _question_pages(s, d).select("volume", "test", F.explode(pages.question_blocks(F.col("page"))).alias("b"))
    return rows.select("volume", "test", F.col("b.number").alias("number"), pages.question_text(F.col("b.body")).alias("sentence"), *(pages.choices(F.col("b.body"))[k].alias(k.lower()) for k in "ABCD"))


def _answer_pages(s, d):
    p = r.first_copy(table(s, d, "passages"), "id", "loaded_at")
    entry = F.transform(F.map_entries("answer"), lambda e: F.concat(F.regexp_replace(e["key"], r"^(\d{2})(\d)$", "$1 $2"), F.lit(" ("), F.translate(e["value"], "BD", "80"), F.lit(")")))
    return p.where("answer is not null").select("id", F.array_join(entry, "  ").alias("page"))


def _explanations(s, d):
    q = questions(s, d).where("explanation is not null and translation is not null and vocabulary is not null and category is not null")
    block = F.concat(F.lit("TEST 1\n"), F.trim("category"), F.lit("\n해설 "), F.col("explanation"), F.lit("\n번역 "), F.col("translation"), F.lit("\n어휘\n"), F.col("vocabulary"))
    return q.select("id", pages.explanation_sections(block).alias("x")).select("id", "x.*")


def _word_lines(s, d):
    v = vocab(s, d).where("trim(word) rlike '^[A-Za-z]{2,}$' and meaning_kr is not null")
    line = F.concat(F.lit("ㅁ "), text.strip("word"), F.lit(" n. "), F.regexp_replace("meaning_kr", r"\s+", " "))
    return v.select("id", pages.word_list_line(line).alias("x")).where("x is not null").select("id", "x.*")


def _chapter_pages(s, d):
    v = vocab(s, d).where("day is not null").withColumn("no", F.expr("try_cast(regexp_extract(id, '([0-9]+)', 1) as int) div 200"))  # pages of bounded length
    entry = F.concat(text.strip("word"), F.lit(" "), F.coalesce("frequency", F.lit("")), F.lit("\n"), F.regexp_replace(F.coalesce("meaning_kr", F.lit("")), r"\s+", " "))
    return v.groupBy("day", "no").agg(F.concat(F.lit("page\n"), F.format_string("DAY %02d", "day"), F.lit("\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]), "\n")).alias("page"))


def queries() -> dict:
    lines = lambda s, d: _chapter_pages(s, d).select("day", F.explode(F.split("page", "\n")).alias("line"))
    filled = lambda s, d: questions(s, d).where("answer is not null and sentence is not null and map_contains_key(choices, answer)").select("id", pages.filled_html(F.col("sentence"), F.col("choices")[F.col("answer")]).alias("html"))
    return {
        "book_questions": _parsed_questions,
        "book_answer_key": lambda s, d: _answer_pages(s, d).select("id", F.explode(pages.answer_entries(F.col("page"))).alias("a")).select("id", "a.number", "a.answer"),
        "book_explanations": _explanations,
        "book_word_lines": _word_lines,
        "book_days": lambda s, d: _chapter_pages(s, d).select("day", pages.page_day(F.col("page")).alias("found")).distinct(),
        "book_headwords": lambda s, d: lines(s, d).groupBy("day").agg(F.count_if(pages.is_headword(F.col("line"))).alias("n_heads")),
        "book_star_tiers": lambda s, d: lines(s, d).where(pages.is_headword(F.col("line"))).groupBy(pages.star_tier(F.col("line")).alias("tier")).agg(F.count("*").alias("n")),
        "filled_html": filled,
    }


def oracle_sql() -> dict[str, str]:
    q = f"(SELECT * FROM {LIVE_Q} WHERE sentence IS NOT NULL AND len(map_keys(choices)) = 4 AND question_number IS NOT NULL)"
    usable = "sentence IS NOT NULL AND answer IS NOT NULL AND list_contains(map_keys(choices), answer)"
    esc = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
    n_pages = f"(SELECT day, count(DISTINCT try_cast(regexp_extract(id, '([0-9]+)', 1) AS INT) // 200) AS k FROM {V} WHERE day IS NOT NULL GROUP BY day)"
    heads = rf"SELECT day, coalesce(frequency, '') AS f FROM {V} WHERE day IS NOT NULL AND regexp_matches({strip('word')}, '^[A-Za-z]') AND length(regexp_replace(word, '[^A-Za-z]', '', 'g')) >= 2"
    at = "instr(e, '-------')"
    flat = lambda x: strip(rf"regexp_replace(regexp_replace({x}, '[ \t\r]*\n\s*', ' ', 'g'), '\s{{2,}}', ' ', 'g')")
    return {
        "book_questions": f"SELECT volume, test, question_number AS number, {white('sentence')} AS sentence, " + ", ".join(f"nullif({strip(f'choices[{k!r}]')}, '') AS {k.lower()}" for k in "ABCD") + f" FROM {q}",
        "book_answer_key": f"SELECT id, e.key::INT AS number, e.value AS answer FROM (SELECT id, unnest(map_entries(answer)) AS e FROM {P}) WHERE length(e.key) = 3",
        "book_explanations": f"SELECT id, trim(category) AS category, {flat('explanation')} AS explanation, {flat('translation')} AS translation, {flat('vocabulary')} AS vocabulary FROM {LIVE_Q} WHERE explanation IS NOT NULL AND translation IS NOT NULL AND vocabulary IS NOT NULL AND category IS NOT NULL",
        "book_word_lines": rf"SELECT id, {strip('word')} AS word, 'noun' AS pos, array_to_string(regexp_extract_all(meaning_kr, '[\x{{AC00}}-\x{{D7A3}}]+'), ', ') AS meaning FROM {V} WHERE regexp_matches(trim(word), '^[A-Za-z]{{2,}}$') AND regexp_matches(meaning_kr, '[\x{{AC00}}-\x{{D7A3}}]')",
        "book_days": f"SELECT DISTINCT day, day AS found FROM {V} WHERE day IS NOT NULL",
        "book_headwords": f"SELECT day, count(f) + 2 * any_value(k) AS n_heads FROM {n_pages} LEFT JOIN ({heads}) USING (day) GROUP BY day",
        "book_star_tiers": f"SELECT tier, sum(n)::BIGINT AS n FROM (SELECT f AS tier, count(*) AS n FROM ({heads}) GROUP BY 1 UNION ALL SELECT '', 2 * sum(k) FROM {n_pages}) GROUP BY tier",
        "filled_html": rf"""WITH a AS (SELECT id, {esc('sentence')} AS e, '<b>' || {esc('choices[answer]')} || '</b>' AS b FROM {LIVE_Q} WHERE {usable} AND contains(sentence, '-------'))
          SELECT id, regexp_replace(regexp_replace(left(e, {at} - 1) || b || substr(e, {at} + 7), '(\S)(<b>)', '\1 \2', 'g'), '(</b>)(\S)', '\1 \2', 'g') AS html FROM a
          UNION ALL SELECT id, {esc('sentence')} || ' [→ <b>' || {esc('choices[answer]')} || '</b>]' FROM {LIVE_Q} WHERE {usable} AND NOT contains(sentence, '-------') AND NOT contains(sentence, '—') AND NOT contains(sentence, '........')""",
    }
