"""Queries of search, filling and merges, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import exams, filling, matching, passages, patches
from ..operators import reports as r
from ..session import table
from . import study
from .reports import entries, questions, vocab
from .sql import LIVE_Q, P, V, WORD, strip


def _forms(s, d):
    return matching.word_forms(matching.vocabulary_words(vocab(s, d)))


def _blanked(s, d):
    """Examples as a search finds them, still blanked; those of odd questions stand among other words."""
    ex = filling.searched_examples(questions(s, d), _forms(s, d), filled=False)
    noise = F.concat(F.lit("Now read: "), "sentence", F.lit(" (next)"))
    return ex.withColumn("sentence", F.when(F.col("question_number") % 2 == 1, noise).otherwise(F.col("sentence")))


def _patches(s, d):
    # two of three questions have their answers in the key
    return filling.fill_patches(_blanked(s, d), filling.answer_keys(questions(s, d).where("question_number % 3 > 0")))


def _containment(s, d):
    """Sentences of the passages, and the words of answers, inside the passages."""
    p = r.first_copy(table(s, d, "passages"), "id", "loaded_at")
    key = lambda c: text.fuzzy_key(F.col(c))
    needles = passages.passage_sentences(p).select(F.col("sentence").alias("id"), key("sentence").alias("key")).unionByName(
        p.select(F.explode(F.map_values("answer")).alias("a")).where("length(a) > 1").select(F.col("a").alias("id"), key("a").alias("key"))
    ).distinct()
    pairs = filling.contained_pairs(needles, p.select("id", key("raw_text").alias("key")))
    return pairs.groupBy(F.col("body").alias("id")).agg(F.count("*").alias("n_texts"))


def _matched(s, d):
    """Examples of the search in other letters and marks, and the questions they come from."""
    ex = filling.searched_examples(questions(s, d), _forms(s, d))
    other = ex.select(F.concat_ws(":", "word", "idx").alias("ex_id"), F.upper(text.bold(F.col("sentence"), F.col("matched_form"))).alias("sentence"))
    return patches.matched_questions(other, questions(s, d))


def _merged(s, d):
    """Half of the questions without their answers, and a key in other letters that lacks a test and names a choice that isn't there."""
    q = questions(s, d)
    lost = q.withColumn("answer", F.when(F.col("question_number") % 2 == 0, F.col("answer")))
    key = q.where("test <> 2").select("volume", "test", "question_number", F.when(F.col("question_number") % 10 == 4, F.lit("E")).otherwise(F.concat(F.lit(" "), F.lower("answer"))).alias("answer"))
    return filling.merged_answers(lost, key)


def _corrected(s, d):
    """Corrections from what the last entry of the same word says."""
    v = vocab(s, d)
    word = r.word_key(F.col("word"))
    last = v.where("pos is not null").groupBy(word.alias("w")).agg(F.max_by("pos", F.struct("loaded_at", "id")).alias("pos"))
    return filling.corrected_pos(v, v.select("id", word.alias("w")).join(last, "w").select("id", "pos"))


def queries() -> dict:
    return {
        "searched_examples": lambda s, d: filling.searched_examples(questions(s, d), _forms(s, d)),
        "fill_patches": _patches,
        "normalised_key_join": _matched,
        "patched_examples": lambda s, d: filling.patched_examples(_blanked(s, d), _patches(s, d)),
        "containment_join": _containment,
        "merged_answers": _merged,
        "corrected_pos": _corrected,
        "choice_prefixes": lambda s, d: filling.choice_prefixes(questions(s, d)),
        "matched_words_by_day": lambda s, d: r.matched_words(vocab(s, d), r.example_counts(entries(s, d))),
        "rate_tiers": lambda s, d: exams.grades(exams.responses(table(s, d, "events")), "user_id", "category").select("user_id", "category", F.when(F.col("rate") >= 80, "high").when(F.col("rate") >= 50, "middle").otherwise("low").alias("tier")),
    }


_key = lambda x: f"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower({x}), '-{{3,}}', '@@blank@@', 'g'), '**', ''), '[^a-z0-9@]+', ' ', 'g'), ' +', ' ', 'g'))"
_fill = lambda s, a: f"CASE WHEN instr({s}, '-------') > 0 THEN left({s}, instr({s}, '-------') - 1) || {a} || substr({s}, instr({s}, '-------') + 7) ELSE {s} END"
_FOUND = f"""q AS (SELECT *, {_fill('sentence', "coalesce(choices[answer], '-------')")} AS full_sentence FROM {LIVE_Q} WHERE sentence IS NOT NULL),
  sent AS (SELECT id, full_sentence AS sentence FROM q), hit AS (SELECT id, word, arg_min(token, pos) AS token FROM {study._keys(study._tok('sent', 'id'))} JOIN forms USING (form) GROUP BY id, word),
  ex AS (SELECT word, row_number() OVER (PARTITION BY word ORDER BY id) - 1 AS idx, id AS question_id, full_sentence, sentence, format('Vol {{}}, TEST {{:02d}}, Q.{{}}', coalesce(volume, 0), coalesce(test, 0), coalesce(question_number, 0)) AS source,
    volume, test, question_number, 5 AS part, token AS matched_form FROM hit JOIN q USING (id))"""
_FILLED = f"""WITH {study._FORMS}, {_FOUND},
  b AS (SELECT word, idx, CASE WHEN question_number % 2 = 1 THEN 'Now read: ' || sentence || ' (next)' ELSE sentence END AS sentence FROM ex), k AS (SELECT *, {_key('sentence')} AS key FROM b WHERE contains(sentence, '-------')),
  a AS (SELECT {_key('sentence')} AS key, arg_min(choices[answer], id) AS answer, min(id) AS question_id FROM {LIVE_Q} WHERE question_number % 3 > 0 AND sentence IS NOT NULL AND answer IS NOT NULL AND list_contains(map_keys(choices), answer) AND contains(sentence, '-------') GROUP BY 1),
  t AS (SELECT DISTINCT key FROM k), e AS (SELECT key, answer, 'exact' AS how FROM t JOIN a USING (key)),
  c AS (SELECT t.key, arg_min(answer, question_id) AS answer, 'contained' AS how FROM t JOIN a ON contains(' ' || t.key || ' ', ' ' || a.key || ' ') OR contains(' ' || a.key || ' ', ' ' || t.key || ' ') WHERE t.key NOT IN (SELECT key FROM e) GROUP BY t.key),
  p AS (SELECT word, idx, {_fill("replace(sentence, '**', '')", "'**' || answer || '**'")} AS new_sentence, how FROM k JOIN (SELECT * FROM e UNION ALL SELECT * FROM c) USING (key))"""


def oracle_sql() -> dict[str, str]:
    full = study.oracle_sql()
    # the list of parts of speech is that of the corrections' SQL
    pos = full["pos_corrections"].split("array_to_string(", 1)[1].split(", ',') AS pos", 1)[0]
    sent = study.texts._SENT("array_to_string(list_filter(string_split(raw_text, chr(10)), lambda line: NOT " + study.texts._SKIP + "), ' ')")
    c = f"list_transform(map_values(choices), lambda x: regexp_replace(lower({strip('x')}), '[.,;:]+$', ''))"
    heads = "list_transform(list_filter(c, lambda w: length(w) >= 4), lambda w: left(w, 4))"
    return {
        "searched_examples": f"WITH {study._FORMS}, {_FOUND} SELECT word, idx, question_id, full_sentence AS sentence, source, volume, test, question_number, part, matched_form FROM ex",
        "fill_patches": f"{_FILLED} SELECT * FROM p",
        "normalised_key_join": f"WITH {study._FORMS}, {_FOUND}, k AS (SELECT {_key('sentence')} AS key, min(id) AS question_id FROM {study._SENT.removeprefix('sent AS ')} GROUP BY 1) SELECT word || ':' || idx AS ex_id, k.question_id FROM ex JOIN k ON k.key = {_key('ex.full_sentence')} WHERE key <> ''",
        "patched_examples": f"{_FILLED} SELECT word, idx, coalesce(new_sentence, sentence) AS sentence, new_sentence IS NOT NULL AS patched FROM b LEFT JOIN p USING (word, idx) WHERE NOT contains(coalesce(new_sentence, sentence), '-------')",
        "containment_join": f"""WITH p AS (SELECT id, answer, raw_text, {_key('raw_text')} AS body FROM {P}), n AS (SELECT DISTINCT x, {_key('x')} AS key FROM (SELECT unnest({sent}) AS x FROM p UNION ALL SELECT a FROM (SELECT unnest(map_values(answer)) AS a FROM p) WHERE length(a) > 1))
          SELECT id, count(*) AS n_texts FROM p JOIN n ON key <> '' AND contains(' ' || body || ' ', ' ' || key || ' ') GROUP BY id""",
        "merged_answers": f"""WITH k AS (SELECT volume, test, question_number, min(CASE WHEN question_number % 10 = 4 THEN 'E' ELSE answer END) AS key FROM {LIVE_Q} WHERE test <> 2 AND (question_number % 10 = 4 OR answer IS NOT NULL) GROUP BY ALL),
          q AS (SELECT *, CASE WHEN question_number % 2 = 0 THEN answer END AS own, coalesce(list_contains(map_keys(choices), key), false) AS valid FROM {LIVE_Q} LEFT JOIN k USING (volume, test, question_number))
          SELECT id, coalesce(own, CASE WHEN valid THEN key END) AS answer, CASE WHEN own IS NOT NULL THEN 'kept' WHEN key IS NULL THEN 'open' WHEN valid THEN 'filled' ELSE 'invalid' END AS status FROM q""",
        "corrected_pos": f"""WITH v AS (SELECT id, {WORD} AS w, pos AS raw, loaded_at, list_sort({pos}) AS old FROM {V}), l AS (SELECT w, arg_max(old, (loaded_at, id)) AS new FROM v WHERE raw IS NOT NULL GROUP BY w),
          j AS (SELECT id, old, CASE WHEN len(new) > 0 THEN new END AS new FROM v LEFT JOIN l USING (w)) SELECT id, array_to_string(coalesce(new, old), ',') AS pos, CASE WHEN new IS NULL THEN 'missing' WHEN new = old THEN 'unchanged' ELSE 'updated' END AS status FROM j""",
        "choice_prefixes": f"""WITH q AS (SELECT id, {c} AS c FROM {LIVE_Q} WHERE choices IS NOT NULL), m AS (SELECT *, list_min(list_transform(c, lambda w: length(w))) AS short, {heads} AS h FROM q)
          SELECT id, coalesce(left(c[1], list_max(list_filter(range(0, short + 1), lambda i: i = 0 OR len(list_distinct(list_transform(c, lambda w: left(w, i)))) = 1))), '') AS prefix, len(list_filter(h, lambda x: len(list_filter(h, lambda y: y = x)) > 1)) AS n_sharers FROM m""",
        "matched_words_by_day": f"""WITH counts AS (SELECT word, count(DISTINCT ex_id) AS n FROM (SELECT {WORD} AS word, unnest(CASE WHEN len(examples) > 0 THEN list_transform(examples, lambda e: e.ex_id) ELSE [NULL] END) AS ex_id FROM word_ets_examples) GROUP BY word)
          SELECT day, row_number() OVER (PARTITION BY day ORDER BY n DESC, word, id) AS place, word, n AS n_examples FROM (SELECT id, day, {WORD} AS word FROM {V}) JOIN counts USING (word)""",
        "rate_tiers": "SELECT user_id, category, CASE WHEN rate >= 80 THEN 'high' WHEN rate >= 50 THEN 'middle' ELSE 'low' END AS tier FROM (SELECT user_id, category, round(count(*) FILTER (ok) * 1000.0 / count(*)) / 10 AS rate FROM (SELECT user_id, event_type AS category, coalesce(value >= 20.0, false) AS ok FROM events) GROUP BY ALL)",
    }
