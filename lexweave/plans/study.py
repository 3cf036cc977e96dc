"""Queries over words in sentences, quality, patches, exams and cards, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.sql import register
from ..functions.lexicon import CATEGORIES, FAMILY_RULES, LEMMA_ENDINGS, MIN_STEM, PATTERN_MARKERS, PHRASE_PREPOSITIONS, PHRASE_STOP_WORDS, PLACEHOLDERS, POOLED_CATEGORIES, POS_NAMES, POS_SHORT
from ..operators import cards, exams, matching, passages, patches, quality
from ..operators import reports as r
from ..session import table
from . import texts
from .reports import entries, questions, vocab
from .sql import EXAMPLES, LIVE_Q, P, Q, V, WORD, items, strip, white

TOPICS = {"click": ["passages", "notes"], "error": ["errors"], "purchase": ["mail"], "signup": ["notes"], "view": ["mail", "passages"]}


def _all(name):
    return lambda s, d: r.first_copy(table(s, d, name), "id", "loaded_at")


def _sentences(s, d):
    own = table(s, d, "questions").select("id", "sentence", "choices", "answer", "deleted", "loaded_at")  # of the rest nothing is shuffled
    q = r.live(r.first_copy(own, "id", "loaded_at")).where("answer is not null and sentence is not null")
    return q.select("id", text.fill_first(F.col("sentence"), F.coalesce(F.col("choices")[F.col("answer")], F.lit("-------"))).alias("sentence"))


def _words(s, d):
    return matching.vocabulary_words(vocab(s, d))


def _forms(s, d):
    return matching.word_forms(_words(s, d))


def _ex(s, d):
    return r.examples(entries(s, d))


def _resolved(s, d):
    """Blanked lines of the passages, looked up again by their context."""
    p = _all("passages")(s, d)
    rows = passages.lines(p).where("line rlike '-{5,}' and header_from is null")
    return passages.resolve_blanks(rows.select(F.concat_ws(":", "id", "line_no").alias("sent_id"), "id", F.col("line").alias("sentence")), p)


def _long_blanks(q):
    """Questions with their blanks as another source writes them, by test."""
    mark = F.when(F.col("test") % 3 == 0, "________").when(F.col("test") % 3 == 1, " ------------ ").otherwise(".........")
    return q.withColumn("sentence", F.replace("sentence", F.lit("-------"), mark))


def _sql_functions(s, d):
    register(s)
    _ex(s, d).createOrReplaceTempView("lw_examples")
    return s.sql("SELECT word, count(DISTINCT lw_dedupe_key(sentence)) AS n_texts, sum(size(lw_tokens(lw_unbold(sentence)))) AS n_tokens FROM lw_examples GROUP BY word")


def queries() -> dict:
    allq, allv = _all("questions"), _all("vocab")
    ev = lambda s, d: table(s, d, "events")
    resp = lambda s, d: exams.responses(ev(s, d))
    raw = lambda name: lambda s, d: table(s, d, name)
    issues = lambda s, d: quality.issues(allq(s, d), quality.question_rules(), "questions").unionByName(quality.issues(allv(s, d), quality.vocab_rules(), "vocab"))
    old_new = lambda s, d: [r.examples(entries(s, d).where(c)) for c in ("feed <> 'book_scan'", "feed = 'book_scan'")]
    return {
        "token_probe_all": lambda s, d: matching.probe_all(_sentences(s, d), _forms(s, d)),
        "token_probe_per_field": lambda s, d: matching.probe_per_field(questions(s, d), _forms(s, d)),
        "token_probe_first_owner": lambda s, d: matching.probe_all(_sentences(s, d), matching.first_owner(_forms(s, d))),
        "inverted_index": lambda s, d: matching.inverted_index(_forms(s, d)),
        "phrase_specs": lambda s, d: matching.phrase_specs(matching.phrase_tokens(_words(s, d))),
        "phrase_match_verified": lambda s, d: matching.verified_phrases(_sentences(s, d), _words(s, d)),
        "dq_issues": issues,
        "dq_summary": lambda s, d: quality.issue_summary(issues(s, d)),
        "duplicate_ids": lambda s, d: quality.duplicate_ids(raw("questions")(s, d)),
        "repeated_words": lambda s, d: quality.repeated_words(allv(s, d), r.word_key(F.col("word")), "level"),
        "sequence_gaps": lambda s, d: quality.sequence_gaps(allq(s, d)),
        "wrong_totals": lambda s, d: quality.wrong_totals(entries(s, d)),
        "mapping_without_vocab": lambda s, d: quality.mapping_without_vocab(entries(s, d), raw("vocab")(s, d)),
        "fixed_sentences": lambda s, d: quality.fixed_sentences(_long_blanks(allq(s, d))),
        "update_join_coalesce": lambda s, d: patches.update_from_explanation(allq(s, d)),
        "pos_corrections": lambda s, d: patches.pos_corrections(allv(s, d)),
        "patch_apply_by_index": lambda s, d: patches.apply_patches(entries(s, d), patches.repaired_examples(entries(s, d))),
        "chunk_batches": lambda s, d: patches.batches(entries(s, d).select("entry_id").distinct(), ["entry_id"], 80).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_id"), F.max("entry_id").alias("last_id")),
        "sequential_ids": lambda s, d: patches.sequential_ids(allv(s, d)),
        "unique_names": lambda s, d: patches.unique_names(allv(s, d)),
        "canonicalise_case": lambda s, d: patches.canonical_words(entries(s, d)),
        "incremental_merge": lambda s, d: patches.incremental_merge(*old_new(s, d)),
        "word_sets": lambda s, d: patches.word_sets(allv(s, d), entries(s, d)),
        "natural_sort_sources": lambda s, d: patches.natural_order(raw("documents")(s, d), F.col("source")),
        "hybrid_sort_examples": lambda s, d: patches.hybrid_first(_ex(s, d)),
        "hybrid_sort_examples_all": lambda s, d: patches.hybrid_order(_ex(s, d)),
        "stratified_allocation": lambda s, d: exams.allocation(exams.category_sizes(questions(s, d)), 30),
        "stratified_sample": lambda s, d: exams.stratified_sample(questions(s, d), 30),
        "balanced_sample": lambda s, d: exams.balanced_sample(allv(s, d), 40),
        "distractors": lambda s, d: exams.distractors(allv(s, d)),
        "option_permutation": lambda s, d: exams.permuted_options(questions(s, d)),
        "grade_by_category": lambda s, d: exams.grades(resp(s, d), "category"),
        "grade_by_user": lambda s, d: exams.grades(resp(s, d), "user_id"),
        "weak_user_categories": lambda s, d: exams.weak(exams.grades(resp(s, d), "user_id", "category"), 40.0),
        "weak_study_fanout": lambda s, d: exams.study_documents(exams.weak(exams.grades(resp(s, d), "category"), 101.0), TOPICS, raw("documents")(s, d)),
        "sittings": lambda s, d: exams.sittings(resp(s, d)),
        "event_props": lambda s, d: ev(s, d).select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count("k").alias("n")),
        "durations": lambda s, d: ev(s, d).select("event_id", F.format_string("%02d:%02d", F.expr("cast(value as int) * 7 div 60"), F.expr("cast(value as int) * 7 % 60")).alias("mmss"), F.date_format("ts", "yyyyMMdd_HHmm").alias("stamp")),
        "range_bounds": lambda s, d: allq(s, d).groupBy("volume", "test").agg(F.concat_ws("-", F.min("question_number"), F.max("question_number")).alias("range")).select(
            "volume", "test", F.greatest(F.lit(0), F.regexp_extract("range", r"^(\d+)-(\d+)$", 1).cast("int") - 101).alias("start"), F.least(F.lit(30), F.regexp_extract("range", r"^(\d+)-(\d+)$", 2).cast("int") - 100).alias("end")),
        "coverage_tiers": lambda s, d: r.coverage(allv(s, d), r.example_counts(entries(s, d))).select("day", F.when(F.col("pct_hits") >= 50, "high").when(F.col("pct_hits") >= 25, "middle").otherwise("low").alias("tier"), (F.col("pct_hits") * 3.5).cast("int").alias("bar")),
        "tag_histogram": lambda s, d: cards.tag_histogram(allv(s, d)),
        "vocab_cards": lambda s, d: cards.vocab_cards(allv(s, d), _ex(s, d)),
        "notes": lambda s, d: cards.notes(allv(s, d)),
        "pages": lambda s, d: cards.pages(allv(s, d)),
        "page_links": lambda s, d: cards.page_links(cards.pages(allv(s, d))),
        "page_front_matter": lambda s, d: cards.front_matter(cards.pages(allv(s, d))),
        "page_quote_blocks": lambda s, d: cards.quote_blocks(cards.pages(allv(s, d))),
        "majority_pos": lambda s, d: cards.majority_pos(allv(s, d)),
        "volume_histogram": lambda s, d: cards.volume_histogram(_ex(s, d)),
        "chosen_vocab": lambda s, d: exams.chosen(allv(s, d), day=[1, 2, 3], level=["800", "900"]).select("id", "day", "level"),
        "wrong_answers": lambda s, d: exams.wrong_answers(resp(s, d), "error").groupBy("user_id").agg(F.count("*").alias("n")),
        "exam_payload": lambda s, d: exams.exam_payload(questions(s, d)).select("id", F.get_json_object("payload", "$.choices.A").alias("a"), F.get_json_object("payload", "$.answer").alias("answer")),
        "graded_sheet": lambda s, d: exams.graded_sheet(questions(s, d), questions(s, d).select("id", F.when(F.col("question_number") % 2 == 0, F.col("answer")).otherwise("A").alias("user_answer"))),
        "resolved_blanks": _resolved,
        "sql_functions": _sql_functions,
    }


def _family(w: str, col: str, keep: str) -> str:
    """SQL union of a word family: rows (keep, form)."""
    parts = [f"SELECT {keep}, {col} AS form FROM {w} WHERE length({col}) >= 3"]
    for s, es in FAMILY_RULES:
        for e in es:
            parts.append(f"SELECT {keep}, left({col}, length({col}) - {len(s)}) || '{e}' FROM {w} WHERE ends_with({col}, '{s}') AND length({col}) - {len(s)} >= {MIN_STEM}")
    return "(SELECT * FROM (" + " UNION ".join(parts) + ") WHERE length(form) >= 3)"


def _lemma(x: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({x}, '{e}') AND length({x}) - {len(e)} >= 3 THEN left({x}, length({x}) - {len(e)})" for e in LEMMA_ENDINGS) + f" ELSE {x} END"


_WORDSQL = f"words AS (SELECT {WORD} AS word, min(id) AS first_id FROM {V} WHERE {WORD} <> '' GROUP BY 1)"
_FORMS = _WORDSQL + ", single AS (SELECT * FROM words WHERE regexp_matches(word, '^[a-z]+$')), forms AS " + _family("single", "word", "word, first_id")
_SENT = f"""sent AS (SELECT id, CASE WHEN instr(sentence, '-------') > 0 THEN left(sentence, instr(sentence, '-------') - 1) || coalesce(choices[answer], '-------') || substr(sentence, instr(sentence, '-------') + 7) ELSE sentence END AS sentence
  FROM {LIVE_Q} WHERE answer IS NOT NULL AND sentence IS NOT NULL)"""


def _tok(src: str, keep: str, pat: str = "[a-zA-Z]+", least: int = 3) -> str:
    return f"(SELECT * FROM (SELECT {keep}, unnest(regexp_extract_all(sentence, '{pat}')) AS token, unnest(range(len(regexp_extract_all(sentence, '{pat}')))) AS pos FROM {src}) WHERE length(token) >= {least})"


def _keys(tok: str) -> str:
    return f"(SELECT *, lower(token) AS form FROM {tok} UNION SELECT *, {_lemma('lower(token)')} AS form FROM {tok})"


_FIELDS = f"fields AS (SELECT id, answer, unnest(['_', 'A', 'B', 'C', 'D']) AS label, unnest([sentence, choices['A'], choices['B'], choices['C'], choices['D']]) AS sentence FROM {LIVE_Q})"
_PH = "CASE t " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN {v!r}" for k, v in PLACEHOLDERS.items()) + " END"
_TYPE = f"""CASE WHEN starts_with(word, 'be ') THEN 'TYPE_A_BE' WHEN contains(word, 'oneself') THEN 'TYPE_B_ONESELF' WHEN contains(word, 'one''s') THEN 'TYPE_C_ONES' WHEN contains(word, ' to do') THEN 'TYPE_D_TODO'
  WHEN len(string_split_regex(word, ' +')) <= 3 AND len(list_filter(string_split_regex(word, ' +'), lambda t: t IN {items(PHRASE_STOP_WORDS)})) = 0 THEN 'TYPE_E_NOUN_PHRASE' ELSE 'TYPE_F_GENERAL' END"""
_PHRASE = (
    _WORDSQL
    + rf""", pt AS (SELECT phrase, type, t, idx, CASE WHEN t IN {items(PLACEHOLDERS)} THEN 'placeholder' WHEN t IN {items(PATTERN_MARKERS)} THEN 'marker' WHEN t IN {items(PHRASE_STOP_WORDS)} AND t NOT IN {items(PHRASE_PREPOSITIONS)} THEN 'marker' ELSE 'content' END AS role
  FROM (SELECT phrase, type, unnest(l) AS t, unnest(range(len(l))) AS idx FROM (SELECT word AS phrase, {_TYPE} AS type, regexp_extract_all(trim(regexp_replace(word, '\bto\s+do\b', '', 'g')), '[a-zA-Z'']+') AS l FROM words WHERE word LIKE '% %'))),
  spec AS (SELECT phrase, k, CASE WHEN type IN ('TYPE_A_BE', 'TYPE_B_ONESELF') THEN ph ELSE 0 END AS n_ph, CASE WHEN type = 'TYPE_E_NOUN_PHRASE' THEN k WHEN k <= 3 AND preps > 0 THEN k + 1 END AS max_span
    FROM (SELECT phrase, type, count(*) FILTER (role = 'content') AS k, count(*) FILTER (role = 'placeholder') AS ph, count(*) FILTER (role = 'content' AND t IN {items(PHRASE_PREPOSITIONS)} AND length(t) <= 3) AS preps FROM pt GROUP BY ALL) WHERE k > 0)"""
)


def oracle_sql() -> dict[str, str]:
    full = texts.oracle_sql()
    cls = full["rule_classified"].replace(Q, LIVE_Q)
    num = r"'^vol(\d+)_test(\d+)_part(\d+)_(\d{3})$'"
    part = lambda i: f"try_cast(nullif(regexp_extract(id, {num}, {i}), '') AS INT)"
    empty = lambda x: f"coalesce({strip(x)}, '') = ''"
    short = "CASE trim(p) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in POS_SHORT.items()) + " ELSE trim(p) END"
    pos = f"list_filter(list_transform(string_split_regex(regexp_replace(lower(coalesce(pos, '')), '[\\[\\]\"]', '', 'g'), '[/,]'), lambda p: {short}), lambda p: p IN {items(POS_NAMES)})"
    qr = {("id", "pattern"): f"NOT regexp_matches(id, {num})", ("id", "volume"): f"{part(1)} <> volume", ("id", "test"): f"{part(2)} <> test", ("id", "part"): f"{part(3)} <> part", ("test", "range"): "test NOT BETWEEN 1 AND 10",
          ("part", "range"): "part NOT IN (5, 6, 7)", ("question_number", "range"): "question_number NOT BETWEEN 101 AND 200", ("sentence", "empty"): empty("sentence"), ("sentence", "no_blank"): "part = 5 AND NOT contains(sentence, '-------')",
          ("choices", "keys"): "len(list_filter(['A', 'B', 'C', 'D'], lambda k: NOT list_contains(map_keys(choices), k))) > 0", ("choices", "empty"): f"len(list_filter(map_values(choices), lambda c: {empty('c')})) > 0",
          ("answer", "value"): "answer NOT IN ('A', 'B', 'C', 'D')", ("answer", "missing"): "answer IS NULL", ("category", "value"): f"category NOT IN {items(CATEGORIES)}"}
    vr = {("id", "pattern"): r"NOT regexp_matches(id, '^hw_\d{4,}$')", ("word", "empty"): empty("word"), ("word", "blanks"): f"word <> {strip('word')}", ("meaning_kr", "empty"): empty("meaning_kr"), ("day", "range"): "day < 1",
          ("level", "value"): f"level NOT IN {items(quality.LEVELS)}", ("pos", "unknown"): f"pos IS NOT NULL AND len({pos}) = 0"}
    union = " UNION ALL ".join(
        f"SELECT '{'warning' if k in quality.WARNINGS else 'error'}' AS severity, '{f}' AS file, id AS item_id, '{k[0]}' AS field, '{k[1]}' AS rule FROM {src} WHERE {c}" for f, src, rules in (("questions", Q, qr), ("vocab", V, vr)) for k, c in rules.items()
    )
    key = lambda x: f"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower({x}), '-{{3,}}', '@@blank@@', 'g'), '**', ''), '[^a-z0-9@]+', ' ', 'g'), ' +', ' ', 'g'))"
    dkey = "lower(" + white("replace(sentence, '**', '')") + ")"
    exf = lambda c: EXAMPLES.replace("FROM word_ets_examples)", f"FROM word_ets_examples WHERE {c})")
    esc = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
    name = rf"""regexp_replace(lower(regexp_replace({strip('word')}, '[<>:"/\\|?*]', '_', 'g')), '^[. ]+|[. ]+$', '', 'g')"""
    sense = r"trim(string_split(regexp_replace(meaning_kr, '\([^)]*\)', '', 'g'), ',')[1])"
    names = f"SELECT id, day, CASE WHEN k = 1 THEN b ELSE b || '_' || k END AS name FROM (SELECT id, day, {name} AS b, row_number() OVER (PARTITION BY day, {name} ORDER BY id) AS k FROM {V})"
    tag = f"""list_filter([format('day::{{:02d}}', day), CASE level WHEN '기초' THEN 'level::basic' WHEN '800' THEN 'level::800' WHEN '900' THEN 'level::900' END, 'freq::' || length(frequency), 'pos::' || ({pos})[1]], lambda x: x IS NOT NULL)"""
    page = f"""(SELECT a.id, format('day{{:02d}}/{{}}.md', coalesce(b.day, 0), b.name) AS path, concat_ws(chr(10), '---', 'word: ' || {strip('word')}, 'day: ' || coalesce(a.day::VARCHAR, ''), 'level: ' || coalesce(level, ''), '---', '# ' || {strip('word')}, '> ' || coalesce(example_sentence, ''),
      array_to_string(list_transform(coalesce(related_words, []), lambda w: '[[' || coalesce(w, '') || ']]'), ' ')) AS content FROM {V} a JOIN ({names}) b USING (id))"""
    sizes = f"SELECT category, count(*) AS size FROM ({cls}) GROUP BY 1"
    alloc = f"""sizes AS ({sizes}), n AS (SELECT 30 - least((SELECT count(*) FROM sizes WHERE category IN {items(POOLED_CATEGORIES)}), 1) AS n),
      b AS (SELECT category, size, n, least(size, greatest(1, round_even(size * n / (SELECT sum(size) FROM sizes WHERE category NOT IN {items(POOLED_CATEGORIES)}), 0)))::BIGINT AS alloc FROM sizes, n WHERE category NOT IN {items(POOLED_CATEGORIES)}),
      g AS (SELECT *, n - sum(alloc) OVER () AS gap FROM b), m AS (SELECT *, CASE WHEN gap > 0 THEN size - alloc ELSE alloc - 1 END AS room FROM g),
      u AS (SELECT *, coalesce(sum(room) OVER (ORDER BY size DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m),
      plan AS (SELECT category, size, (alloc + sign(gap) * greatest(0, least(room, abs(gap) - used)))::BIGINT AS alloc FROM u
        UNION ALL SELECT category, size, CASE WHEN row_number() OVER (ORDER BY category) = 1 THEN 1 ELSE 0 END FROM sizes WHERE category IN {items(POOLED_CATEGORIES)})"""
    resp = "(SELECT user_id, event_type AS category, ts AS tm, coalesce(value >= 20.0, false) AS is_correct FROM events)"
    rate = "round(count(*) FILTER (is_correct) * 1000.0 / count(*)) / 10"
    rep = texts._CORRUPT
    repaired = full["text_repair"].replace(f"FROM {EXAMPLES}", "FROM (SELECT entry_id || ':' || i AS ex_id, sentence FROM pe)")
    tvals = ", ".join(f"('{c}', {i}, '{t}')" for c, ts in TOPICS.items() for i, t in enumerate(ts, 1))
    return {
        "token_probe_all": f"WITH {_FORMS}, {_SENT} SELECT id, word, arg_min(token, pos) AS token FROM {_keys(_tok('sent', 'id'))} JOIN forms USING (form) GROUP BY id, word",
        "token_probe_per_field": f"WITH {_FORMS}, {_FIELDS} SELECT word, id, label, arg_min(token, pos) AS token, coalesce(label = upper(any_value(answer)), false) AS as_answer FROM {_keys(_tok('fields', 'id, label, answer'))} JOIN forms USING (form) GROUP BY word, id, label",
        "token_probe_first_owner": f"WITH {_FORMS}, {_SENT}, own AS (SELECT form, word FROM forms QUALIFY row_number() OVER (PARTITION BY form ORDER BY first_id, word) = 1) SELECT id, word, arg_min(token, pos) AS token FROM {_keys(_tok('sent', 'id'))} JOIN own USING (form) GROUP BY id, word",
        "inverted_index": f"WITH {_FORMS} SELECT form, count(DISTINCT word) AS n_words, string_agg(DISTINCT word, ',' ORDER BY word) AS words FROM forms GROUP BY form",
        "phrase_specs": f"WITH {_PHRASE} SELECT * FROM spec",
        "phrase_match_verified": f"""WITH {_PHRASE}, {_SENT}, st AS (SELECT id, pos, lower(token) AS token FROM {_tok('sent', 'id', "[a-zA-Z'']+", 1)}),
          cont AS (SELECT * FROM pt WHERE role = 'content'), pf AS (SELECT phrase, idx, 'content' AS role, form FROM {_family('(SELECT * FROM cont WHERE length(t) >= 3)', 't', 'phrase, idx')} UNION SELECT phrase, idx, role, t FROM cont WHERE length(t) < 3
            UNION SELECT phrase, idx, role, unnest({_PH}) FROM pt WHERE role = 'placeholder'),
          k AS (SELECT id, pos, token AS form, true AS surface FROM st UNION SELECT id, pos, {_lemma('token')}, false FROM st),
          f AS (SELECT id, phrase, role, idx, min(pos) AS spot FROM k JOIN pf USING (form) WHERE role = 'content' OR surface GROUP BY ALL),
          g AS (SELECT id, phrase, count(*) FILTER (role = 'content') AS found, count(*) FILTER (role <> 'content') AS found_ph, max(spot) FILTER (role = 'content') - min(spot) FILTER (role = 'content') AS span FROM f GROUP BY ALL)
          SELECT id, phrase FROM g JOIN spec USING (phrase) WHERE found = k AND (n_ph = 0 OR found_ph = n_ph) AND (max_span IS NULL OR span <= max_span)""",
        "dq_issues": union,
        "dq_summary": f"SELECT file, severity, field, rule, count(*) AS n FROM ({union}) GROUP BY ALL",
        "duplicate_ids": "SELECT id, count(*) AS n, strftime(min(loaded_at), '%Y-%m-%d %H:%M:%S') AS first_at FROM questions GROUP BY id HAVING count(*) > 1",
        "repeated_words": f"SELECT level, word, count(DISTINCT id) AS n, min(id) AS first_id FROM (SELECT level, id, {WORD} AS word FROM {V}) GROUP BY level, word HAVING count(DISTINCT id) > 1",
        "sequence_gaps": f"""WITH q AS (SELECT volume, test, list_sort(list(DISTINCT question_number)) AS have FROM {Q} GROUP BY ALL), g AS (SELECT *, list_filter(range(101, list_max(have) + 1), lambda x: NOT list_contains(have, x)) AS gone FROM q)
          SELECT volume, test, len(have) AS n, len(gone) AS n_missing, array_to_string(gone, ',') AS missing FROM g WHERE len(gone) > 0""",
        "wrong_totals": "SELECT DISTINCT entry_id, total_count, coalesce(len(examples), 0)::INT AS n_examples FROM word_ets_examples WHERE total_count IS DISTINCT FROM coalesce(len(examples), 0)",
        "mapping_without_vocab": "SELECT vocab_id, count(DISTINCT entry_id) AS n FROM word_ets_examples WHERE vocab_id IS NOT NULL AND vocab_id NOT IN (SELECT id FROM vocab) GROUP BY 1",
        "fixed_sentences": rf"SELECT id, fixed FROM (SELECT id, sentence, CASE WHEN contains({strip('sentence')}, '-------') THEN {strip('sentence')} ELSE regexp_replace(regexp_replace(regexp_replace({strip('sentence')}, '-{{5,}}', '-------', 'g'), '_{{5,}}', '-------', 'g'), '\.{{5,}}', '-------', 'g') END AS fixed FROM (SELECT * REPLACE (replace(sentence, '-------', CASE test % 3 WHEN 0 THEN '________' WHEN 1 THEN ' ------------ ' ELSE '.........' END) AS sentence) FROM {Q})) WHERE fixed <> sentence",
        "update_join_coalesce": f"""WITH p AS ({full['explanation_parts']}), a AS (SELECT q.id, q.translation AS t, q.vocabulary AS v, coalesce(q.translation, p.translation) AS translation, coalesce(q.vocabulary, p.vocabulary) AS vocabulary FROM {Q} q LEFT JOIN p USING (id))
          SELECT id, translation, vocabulary, (translation IS DISTINCT FROM t OR vocabulary IS DISTINCT FROM v) AS updated FROM a""",
        "pos_corrections": f"""WITH v AS (SELECT id, {WORD} AS word, array_to_string(list_distinct({pos}), ',') AS pos, loaded_at FROM {V}), l AS (SELECT word, pos AS new FROM v WHERE pos <> '' QUALIFY row_number() OVER (PARTITION BY word ORDER BY loaded_at DESC, id DESC) = 1)
          SELECT CASE WHEN new IS NULL THEN 'missing' WHEN new = pos THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n FROM v LEFT JOIN l USING (word) GROUP BY 1""",
        "patch_apply_by_index": f"""WITH once AS (SELECT entry_id, any_value(examples) AS examples FROM word_ets_examples WHERE examples IS NOT NULL GROUP BY entry_id),
          pe AS (SELECT entry_id, unnest(range(len(examples))) AS i, unnest(list_transform(examples, lambda e: e.sentence)) AS sentence FROM once), fix AS ({repaired}),
          j AS (SELECT entry_id, repaired, coalesce(repaired, sentence) AS s FROM pe LEFT JOIN fix ON fix.ex_id = entry_id || ':' || i)
          SELECT entry_id, count(repaired) AS n_patched, count(*) FILTER (s <> '') AS total_count FROM j GROUP BY entry_id HAVING count(repaired) > 0""",
        "chunk_batches": "SELECT ((row_number() OVER (ORDER BY entry_id) - 1) // 80 + 1)::BIGINT AS batch_id, entry_id FROM (SELECT DISTINCT entry_id FROM word_ets_examples)",
        "sequential_ids": f"SELECT id, format('hw_{{:04d}}', row_number() OVER (ORDER BY coalesce(day, 0), {WORD}, id)) AS new_id FROM {V}",
        "unique_names": names,
        "canonicalise_case": f"SELECT word, arg_min(s, entry_id) AS canonical, count(DISTINCT s) AS n_spellings FROM (SELECT entry_id, {WORD} AS word, {strip('word')} AS s FROM word_ets_examples) GROUP BY word",
        "incremental_merge": f"""WITH b AS (SELECT *, 0 AS new FROM {exf("feed <> 'book_scan'")} UNION ALL SELECT *, 1 AS new FROM {exf("feed = 'book_scan'")}), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY word, {dkey} ORDER BY new, ex_id) = 1)
          SELECT word, count(*) AS total_count, sum(new)::BIGINT AS n_added, coalesce(string_agg(DISTINCT part::VARCHAR, ',' ORDER BY part::VARCHAR), '') AS parts FROM o GROUP BY word""",
        "word_sets": f"""WITH a AS (SELECT DISTINCT {WORD} AS word FROM {V} WHERE word IS NOT NULL), b AS (SELECT DISTINCT {WORD} AS word FROM word_ets_examples WHERE word IS NOT NULL)
          SELECT 'union' AS kind, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_vocab', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_entries', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
        "natural_sort_sources": "WITH d AS (SELECT DISTINCT source AS label, try_cast(nullif(regexp_extract(source, '([0-9]+)', 1), '') AS INT) AS n FROM documents WHERE source IS NOT NULL) SELECT row_number() OVER (ORDER BY n IS NULL, coalesce(n, 0), label) AS place, label FROM d",
        "hybrid_sort_examples": f"SELECT word, row_number() OVER (PARTITION BY word ORDER BY coalesce(volume, 0), coalesce(nullif(page, 0), coalesce(test, 0) * 1000 + coalesce(question_number, 0)), ex_id) AS place, ex_id FROM {EXAMPLES} QUALIFY place <= 5",
        "stratified_allocation": f"WITH {alloc} SELECT * FROM plan",
        "stratified_sample": f"WITH {alloc} SELECT category, id FROM (SELECT c.category, id, alloc, row_number() OVER (PARTITION BY c.category ORDER BY md5(id || '|7'), id) AS r FROM ({cls}) c JOIN plan USING (category)) WHERE r <= alloc",
        "balanced_sample": f"""WITH v AS (SELECT id, coalesce(day, 0) AS day, md5(id || '|7') AS o FROM {V}), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY o, id) > greatest(1, 40 // (SELECT count(DISTINCT day) FROM v)) AS filled FROM v)
          SELECT id, day, filled FROM k ORDER BY filled, o, id LIMIT 40""",
        "distractors": f"""WITH v AS (SELECT id, {sense} AS sense, coalesce(({pos})[1], 'none') AS pos FROM {V} WHERE meaning_kr IS NOT NULL), p AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY sense ORDER BY id, pos) = 1),
          r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY md5(id || '|' || sense), id) AS r, count(*) OVER (PARTITION BY pos) AS size FROM p)
          SELECT a.id, k AS place, b.sense AS distractor FROM (SELECT *, unnest([1, 2, 3])::BIGINT AS k FROM r) a JOIN r b ON a.pos = b.pos AND b.r = (a.r - 1 + k) % a.size + 1 WHERE k < a.size""",
        "option_permutation": f"""WITH o AS (SELECT id, choices[answer] AS right_one, list_transform(list_sort(list_transform(list_filter(map_entries(choices), lambda e: e.key IN ('A', 'B', 'C', 'D')), lambda e: {{'o': md5(id || '|' || e.key || '|7'), 'k': e.key, 'v': e.value}})), lambda x: x.v) AS l FROM {LIVE_Q} WHERE answer IS NOT NULL)
          SELECT id, array_to_string(l, '|') AS options, nullif(substr('ABCD', list_position(l, right_one)::INT, 1), '') AS new_answer FROM o""",
        "grade_by_category": f"SELECT category, count(*) AS total, count(*) FILTER (is_correct) AS correct, {rate} AS rate FROM {resp} GROUP BY category",
        "grade_by_user": f"SELECT user_id, count(*) AS total, count(*) FILTER (is_correct) AS correct, {rate} AS rate FROM {resp} GROUP BY user_id",
        "weak_user_categories": f"SELECT user_id, category, count(*) AS total, count(*) FILTER (is_correct) AS correct, {rate} AS rate FROM {resp} GROUP BY ALL HAVING {rate} < 40",
        "weak_study_fanout": f"SELECT g.category, m.topic_rank::BIGINT AS topic_rank, doc_id FROM (SELECT category FROM {resp} GROUP BY category HAVING {rate} < 101) g JOIN (VALUES {tvals}) m(category, topic_rank, topic) USING (category) JOIN documents d ON regexp_extract(d.source, '_([a-z]+)$', 1) = m.topic WHERE {strip("coalesce(text, '')")} <> ''",
        "sittings": f"""WITH s AS (SELECT *, coalesce((epoch_us(tm) // 1000000 - lag(epoch_us(tm) // 1000000) OVER (PARTITION BY user_id ORDER BY tm) > 1800)::INT, 0) AS new FROM {resp}), t AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING)::BIGINT AS sitting FROM s)
          SELECT user_id, sitting, count(*) AS n, count(*) FILTER (is_correct) AS correct FROM t GROUP BY ALL""",
        "event_props": "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS sum_k, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1",
        "durations": "SELECT event_id, format('{:02d}:{:02d}', trunc(value)::INT * 7 // 60, trunc(value)::INT * 7 % 60) AS mmss, strftime(ts, '%Y%m%d_%H%M') AS stamp FROM events",
        "range_bounds": f"SELECT volume, test, greatest(0, min(question_number) - 101) AS start, least(30, max(question_number) - 100) AS end FROM {Q} GROUP BY ALL".replace("AS end", 'AS "end"'),
        "coverage_tiers": "WITH c AS (" + __import__("lexweave.plans.reports", fromlist=["x"]).oracle_sql()["coverage_by_day"] + ") SELECT day, CASE WHEN pct_hits >= 50 THEN 'high' WHEN pct_hits >= 25 THEN 'middle' ELSE 'low' END AS tier, trunc(pct_hits * 3.5)::INT AS bar FROM c",
        "tag_histogram": f"SELECT tag, count(*) AS n FROM (SELECT unnest({tag}) AS tag FROM {V}) GROUP BY tag",
        "vocab_cards": rf"""WITH o AS (SELECT * FROM {EXAMPLES} QUALIFY row_number() OVER (PARTITION BY word, {dkey} ORDER BY ex_id) = 1), k AS (SELECT word, regexp_replace(sentence, '\*\*(.+?)\*\*', '\1', 'g') AS s, row_number() OVER (PARTITION BY word ORDER BY CASE WHEN part = 5 THEN 0 ELSE 1 END, coalesce(volume, 99), ex_id) AS rank FROM o),
          g AS (SELECT word, count(*) AS n, string_agg(s, chr(10) ORDER BY rank) FILTER (rank <= 3) AS examples FROM k GROUP BY word)
          SELECT id, v.word, level, coalesce(n, 0) AS n_examples, coalesce(examples, '') AS examples FROM (SELECT id, {WORD} AS word, coalesce(nullif(level, ''), frequency, 'none') AS level FROM {V}) v LEFT JOIN g USING (word)""",
        "notes": f"SELECT sha256(id) AS guid, concat_ws(chr(31), {strip('word')}, " + ", ".join(f"coalesce({esc(c)}, '')" for c in ("meaning_kr", "meaning_en", "example_sentence", "example_translation")) + f") AS fields, array_to_string({tag}, ' ') AS tags FROM {V}",
        "pages": f"SELECT * FROM {page}",
        "page_links": rf"SELECT DISTINCT id, target FROM (SELECT id, unnest(regexp_extract_all(content, '\[\[([^\]|]+)\]\]', 1)) AS target FROM {page})",
        "page_front_matter": f"SELECT id, nullif({strip('word')}, '') AS word, day, nullif(level, '') AS level FROM {V}",
        "page_quote_blocks": f"SELECT id, 1::BIGINT AS n_quotes FROM {V}",
        "majority_pos": f"SELECT word, pos FROM (SELECT {WORD} AS word, id, unnest(list_distinct({pos})) AS pos FROM {V}) GROUP BY word, pos QUALIFY row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, min(id), pos) = 1",
        "volume_histogram": f"SELECT coalesce(volume, try_cast(nullif(regexp_extract(source, '(?i)vol[^0-9]*([0-9]+)', 1), '') AS INT)) AS volume, count(*) AS n FROM {EXAMPLES} GROUP BY 1",
        "chosen_vocab": f"SELECT id, day, level FROM {V} WHERE day IN (1, 2, 3) AND level IN ('800', '900')",
        "wrong_answers": f"SELECT user_id, count(*) AS n FROM {resp} WHERE NOT is_correct AND category = 'error' GROUP BY 1",
        "exam_payload": f"SELECT id, choices['A'] AS a, answer FROM {LIVE_Q}",
        "graded_sheet": f"SELECT category, count(*) AS total, count(*) FILTER (is_correct) AS correct, {rate} AS rate FROM (SELECT c.category, coalesce(CASE WHEN q.question_number % 2 = 0 THEN q.answer ELSE 'A' END = q.answer, false) AS is_correct FROM {LIVE_Q} q JOIN ({cls}) c USING (id) WHERE q.answer IS NOT NULL) GROUP BY category",
        "resolved_blanks": f"WITH {texts._CARRIED}, m AS (SELECT *, sum(len(string_split(line, '-------')) - 1) OVER (PARTITION BY id, q_from ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM c WHERE header_from IS NULL) SELECT id || ':' || line_no AS sent_id, (q_from + coalesce(k, 0))::BIGINT AS q_number FROM m WHERE contains(line, '-------') AND q_from + coalesce(k, 0) <= q_to",
        "sql_functions": rf"SELECT word, count(DISTINCT lower({white('replace(sentence, ' + repr('**') + ', ' + repr('') + ')')})) AS n_texts, sum(len(regexp_extract_all(regexp_replace(regexp_replace(sentence, '\*\*(.+?)\*\*', '\1', 'g'), '-{{2,}}', ' ', 'g'), '[a-zA-Z]+')))::BIGINT AS n_tokens FROM {EXAMPLES} GROUP BY word",
    } | {"chunk_batches": "SELECT batch_id, count(*) AS n, min(entry_id) AS first_id, max(entry_id) AS last_id FROM (SELECT ((row_number() OVER (ORDER BY entry_id) - 1) // 80 + 1)::BIGINT AS batch_id, entry_id FROM (SELECT DISTINCT entry_id FROM word_ets_examples)) GROUP BY batch_id"}
