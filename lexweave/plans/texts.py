"""Text queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, morph, text
from ..functions.lexicon import AUXILIARIES, CATEGORY_KEYWORDS, COMPARATIVES, CONJUNCTIONS, FAMILY_RULES, DEFAULT_ENDINGS, GLOSS_ADJECTIVE, GLOSS_ADJECTIVE_WEAK, GLOSS_NO_NOUN, GLOSS_POS, IRREGULAR, LEMMA_ENDINGS, LY_ADJECTIVES, MIN_STEM, OTHER_CATEGORY, PHRASE_STOP_WORDS, PREPOSITIONS, PRONOUNS, RELATIVES, SUFFIX_POS, WORD_POS
from ..operators import passages as p
from ..operators import reports as r
from ..session import table
from .reports import entries, questions, vocab
from .sql import EXAMPLES, LIVE_Q, P, Q, V, WORD, items, strip, white


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _passages(spark, sf):
    return r.first_copy(table(spark, sf, "passages"), "id", "loaded_at")


def _ex(spark, sf):
    return r.examples(entries(spark, sf))


def _words(spark, sf):
    """Distinct single words of the vocabulary."""
    return vocab(spark, sf).select(r.word_key(F.col("word")).alias("word")).where("word rlike '^[a-z]+$'").distinct()


def queries() -> dict:
    q, v = questions, vocab
    allq = lambda s, d: r.first_copy(table(s, d, "questions"), "id", "loaded_at")
    lines = lambda s, d: p.lines(_passages(s, d))
    filled = lambda: text.fill_first(F.col("sentence"), F.col("choices")[F.col("answer")])
    usable = "sentence is not null and answer is not null and map_contains_key(choices, answer)"
    parts = ("explanation", "translation", "vocabulary")
    ex3 = lambda: [c.alias(n) for c, n in zip(text.split_explanation(F.col("explanation")), parts)]
    return {
        "sentence_split_stats": lambda s, d: _docs(s, d).select("source", F.explode(text.sentences(F.col("text"))).alias("x")).groupBy("source").agg(F.count("*").alias("n_sentences"), F.sum(F.length("x")).alias("n_chars")),
        "passage_segments": lambda s, d: p.segments(lines(s, d)),
        "passage_sentences": lambda s, d: p.passage_sentences(_passages(s, d)).groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("n_chars")),
        "line_skip_counts": lambda s, d: lines(s, d).groupBy("id").agg(F.count_if(F.col("line").rlike(p.SKIP_LINE)).alias("n_skipped"), F.count("*").alias("n_lines")),
        "asof_backward_blanks": lambda s, d: p.blanks(lines(s, d)),
        "asof_forward_header": lambda s, d: p.next_header(lines(s, d)),
        "nearest_header": lambda s, d: p.nearest_header(lines(s, d)),
        "interval_join_lines": lambda s, d: p.interval_join(lines(s, d), p.header_ranges(lines(s, d))),
        "answered_blanks": lambda s, d: p.answered_blanks(_passages(s, d)),
        "contiguous_blank_blocks": lambda s, d: p.contiguous_blocks(lines(s, d), F.col("line").contains("-------")),
        "lines_until_second_block": lambda s, d: p.until_mark(lines(s, d), F.col("header_from").isin(135, 151)),
        "first_header_place": lambda s, d: p.first_per_key(lines(s, d)),
        "filled_sentences": lambda s, d: q(s, d).where(usable).select("id", filled().alias("filled")),
        "bold_matched_form": lambda s, d: _ex(s, d).select("ex_id", text.bold(text.unbold(F.col("sentence")), F.regexp_extract("matched_form", "^[A-Za-z]+$", 0)).alias("bolded")),
        "unbold_sentences": lambda s, d: _ex(s, d).select("ex_id", text.unbold(F.col("sentence")).alias("plain")),
        "dedupe_key_groups": lambda s, d: _ex(s, d).groupBy(text.dedupe_key(F.col("sentence")).alias("key")).agg(F.count("*").alias("n"), F.min("ex_id").alias("first_id")).where("n > 1"),
        "corrupt_text_flag": lambda s, d: _ex(s, d).where(text.is_corrupt(F.col("sentence"))).select("ex_id"),
        "text_repair": lambda s, d: _ex(s, d).where(text.is_corrupt(F.col("sentence"))).select("ex_id", text.repair(F.col("sentence")).alias("repaired")),
        "explanation_parts": lambda s, d: allq(s, d).where("explanation is not null").select("id", *ex3()),
        "answer_letters": lambda s, d: _passages(s, d).select("id", F.explode("answer").alias("k", "a")).groupBy(text.fix_answer(F.col("a")).alias("answer")).agg(F.count("*").alias("n")),
        "html_escaped_gloss": lambda s, d: v(s, d).select("id", text.escape_html(F.col("meaning_kr")).alias("html")),
        "inline_html_examples": lambda s, d: _ex(s, d).select("ex_id", text.inline_html(F.col("sentence")).alias("html")),
        "file_names": lambda s, d: v(s, d).select("id", text.file_name(F.col("word")).alias("name")),
        "first_sense": lambda s, d: v(s, d).select("id", text.first_sense(F.col("meaning_kr")).alias("sense")),
        "gloss_pos": lambda s, d: v(s, d).select("id", morph.gloss_pos(F.col("meaning_kr")).alias("pos")),
        "word_family": lambda s, d: _words(s, d).select("word", F.explode(morph.family(F.col("word"))).alias("form")),
        "word_variants": lambda s, d: _words(s, d).select("word", F.explode(morph.variants(F.col("word"))).alias("form")),
        "fallback_lemma": lambda s, d: _words(s, d).select("word", morph.lemma(F.col("word")).alias("lemma")),
        "decided_pos": lambda s, d: v(s, d).select("id", morph.decide_pos(F.col("word"), F.col("meaning_kr")).alias("pos")),
        "suffix_pos": lambda s, d: _words(s, d).select("word", morph.suffix_pos(F.col("word")).alias("pos")),
        "phrase_types": lambda s, d: v(s, d).where("trim(word) like '% %'").select("id", morph.phrase_type(r.word_key(F.col("word"))).alias("type")),
        "rule_classified": lambda s, d: allq(s, d).select("id", classify.classify_choices(F.col("choices")).alias("category")),
        "category_normalised": lambda s, d: allq(s, d).select("id", classify.normalise_category(F.trim("category")).alias("category")),
    }


_LINES = r"""lines AS (SELECT id, line_no, line, try_cast(nullif(regexp_extract(line, '(?i)questions?\s+(\d{2,3})\s*[-–—]\s*(\d{2,3})\s+refer to the following[^\n]*', 1), '') AS INT) AS header_from,
  try_cast(nullif(regexp_extract(line, '(?i)questions?\s+(\d{2,3})\s*[-–—]\s*(\d{2,3})\s+refer to the following[^\n]*', 2), '') AS INT) AS header_to
  FROM (SELECT id, unnest(string_split(raw_text, chr(10))) AS line, unnest(range(len(string_split(raw_text, chr(10))))) AS line_no FROM """ + P + r") WHERE regexp_replace(line, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g') <> '')"
_CARRIED = _LINES + """, c AS (SELECT *, last_value(header_from IGNORE NULLS) OVER w AS q_from, last_value(header_to IGNORE NULLS) OVER w AS q_to FROM lines WINDOW w AS (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT id, line_no, row_number() OVER (PARTITION BY id, q_from ORDER BY line_no) AS ordinal, q_from, q_to FROM c WHERE contains(line, '-------') AND q_from IS NOT NULL)"""
_SKIP = r"regexp_matches(line, '(?i)^\s*(?:\(?[A-D]\)|\d{3}\.|page \d|part \d|questions? \d|[-—\[]?\s*\d{1,4}\s*[-—\]]?\s*$)')"
_SENT = lambda x: f"list_filter(string_split(regexp_replace({white(x)}, '([.!?])\\s+([A-Z\"(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: length(s) >= 10)"
_UNBOLD = r"regexp_replace(sentence, '\*\*(.+?)\*\*', '\1', 'g')"
_CORRUPT = r"""(regexp_matches(sentence, '[\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{2190}-\x{21FF}\x{25A0}-\x{27BF}\x{2500}-\x{257F}\x{00}-\x{08}\x{0E}-\x{1F}]')
  OR regexp_matches(sentence, '[^A-Za-z0-9_\s.,;:!?''"()\-/]{3,}'))"""
_ESC = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_WORDS = f"(SELECT DISTINCT {WORD} AS word FROM {V} WHERE regexp_matches({WORD}, '^[a-z]+$'))"
_SENSE = r"trim(string_split(regexp_replace(meaning_kr, '\([^)]*\)', '', 'g'), ',')[1])"


def oracle_sql() -> dict[str, str]:
    fam = " UNION ".join(
        ["SELECT word, word AS form FROM w WHERE length(word) >= 3"]
        + [
            f"SELECT word, left(word, length(word) - {len(s)}) || '{e}' FROM w WHERE ends_with(word, '{s}') AND length(word) - {len(s)} >= {MIN_STEM}"
            for s, es in FAMILY_RULES
            for e in es
        ]
    )
    var = " UNION ".join(
        ["SELECT word, word AS form FROM w"]
        + [f"SELECT word, form FROM w JOIN (VALUES {', '.join(f'({k!r}, {x!r})' for k, v in IRREGULAR.items() for x in v)}) i(k, form) ON i.k = w.word"]
        + [f"SELECT word, word || '{e}' FROM w" for e in DEFAULT_ENDINGS]
        + [f"SELECT word, left(word, length(word) - 1) || '{e}' FROM w WHERE regexp_matches(word, '[^aeiou]y$') AND length(word) > 2" for e in "ies ied ier iest".split()]
        + [f"SELECT word, left(word, length(word) - 1) || '{e}' FROM w WHERE ends_with(word, 'e') AND length(word) > 2" for e in "ing ed er est ion ions".split()]
        + [f"SELECT word, word || right(word, 1) || '{e}' FROM w WHERE regexp_matches(word, '[^aeiou][aeiou][^aeiouywh]$')" for e in "ing ed er".split()]
    )
    case = lambda rules, other: "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x in rules) + f" ELSE {other} END"
    lem = case([(f"ends_with(word, '{e}') AND length(word) - {len(e)} >= 3", f"left(word, length(word) - {len(e)})") for e in LEMMA_ENDINGS], "word")
    suf = case([(f"ends_with(word, '{s}') AND length(word) > {len(s) + 2}", f"'{pos}'") for s, pos in SUFFIX_POS], "NULL")
    glo = case([(f"regexp_matches({_SENSE}, '{pat}')", f"'{pos}'") for pos, pat in GLOSS_POS], "NULL")
    w = WORD
    typ = case([(f"starts_with({w}, 'be ')", "'TYPE_A_BE'"), (f"contains({w}, 'oneself')", "'TYPE_B_ONESELF'"), (f"contains({w}, 'one''s')", "'TYPE_C_ONES'"), (f"contains({w}, ' to do')", "'TYPE_D_TODO'"),
                (f"len(string_split_regex({w}, ' +')) <= 3 AND len(list_filter(string_split_regex({w}, ' +'), lambda t: t IN {items(PHRASE_STOP_WORDS)})) = 0", "'TYPE_E_NOUN_PHRASE'")], "'TYPE_F_GENERAL'")
    share = lambda m: f"len(list_filter(c, lambda w: w IN {items(m)})) / nullif(len(c), 0)"
    has = lambda m: f"len(list_filter(string_split_regex(w, ' +'), lambda t: t IN {items(m)})) > 0"
    heads = "list_transform(list_filter(c, lambda w: length(w) >= 4), lambda w: left(w, 4))"
    cls = case(
        [("c IS NULL OR len(c) < 2", f"'{OTHER_CATEGORY}'"), (f"{share(PRONOUNS)} >= 0.75", "'대명사'"),
         (f"{share(RELATIVES)} >= 0.5 AND len(c) >= 3 AND len(list_filter(c, lambda w: w IN {items(RELATIVES)})) >= 2", "'관계대명사'"),
         (f"{share(PREPOSITIONS + CONJUNCTIONS)} >= 0.75", "'접속사/전치사'"),
         (f"len(list_filter(c, lambda w: {has(COMPARATIVES)} OR (length(w) > 4 AND (ends_with(w, 'er') OR ends_with(w, 'est'))))) > 0", "'비교급/최상급'"),
         (f"len(list_filter(h, lambda x: len(list_filter(h, lambda y: y = x)) >= 2)) >= 3", "'품사'"),
         (f"len(list_filter(c, lambda w: {has(AUXILIARIES)} OR (NOT contains(w, ' ') AND (ends_with(w, 'ed') OR ends_with(w, 'ing'))))) >= 2", "'동사시제/태'")], "'어휘'")
    norm = case([(f"contains(trim(category), '{k}')", f"'{n}'") for n, ks in CATEGORY_KEYWORDS.items() for k in ks], f"'{OTHER_CATEGORY}'")
    bv, usable = r"string_split(explanation, '[어휘]')", "sentence IS NOT NULL AND answer IS NOT NULL AND list_contains(map_keys(choices), answer)"
    rep = r"regexp_replace(regexp_replace(sentence, '斤([a-z])', 'fr\1', 'g'), '[\x{2190}-\x{21FF}\x{25A0}-\x{27BF}\x{2500}-\x{257F}\x{00}-\x{08}\x{0E}-\x{1F}]', '', 'g')"
    return {
        "sentence_split_stats": f"SELECT source, count(*) AS n_sentences, sum(length(x))::BIGINT AS n_chars FROM (SELECT source, unnest({_SENT('text')}) AS x FROM documents) GROUP BY source",
        "passage_segments": f"WITH {_CARRIED} SELECT id, q_from, q_to, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM c WHERE header_from IS NULL GROUP BY ALL",
        "passage_sentences": f"""SELECT id, count(*) AS n, sum(length(x))::BIGINT AS n_chars FROM (SELECT id, unnest({_SENT("array_to_string(list_filter(string_split(raw_text, chr(10)), lambda line: NOT " + _SKIP + "), ' ')")}) AS x FROM {P}) GROUP BY id""",
        "line_skip_counts": f"WITH {_LINES} SELECT id, count(*) FILTER ({_SKIP}) AS n_skipped, count(*) AS n_lines FROM lines GROUP BY id",
        "asof_backward_blanks": f"WITH {_CARRIED} SELECT id, line_no, ordinal, q_from + ordinal - 1 AS q_number, q_from AS asof_from FROM b WHERE q_from + ordinal - 1 <= q_to",
        "asof_forward_header": f"WITH {_LINES} SELECT a.id, a.line_no, h.header_from::BIGINT AS next_header FROM (SELECT * FROM lines WHERE contains(line, '-------')) a ASOF LEFT JOIN (SELECT * FROM lines WHERE header_from IS NOT NULL) h ON a.id = h.id AND a.line_no < h.line_no",
        "nearest_header": f"WITH {_LINES} SELECT a.id, a.line_no, h.line_no AS nearest_line, abs(a.line_no - h.line_no) AS distance FROM lines a JOIN lines h ON a.id = h.id AND contains(a.line, '-------') AND h.header_from IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.id, a.line_no ORDER BY abs(a.line_no - h.line_no), h.line_no) = 1",
        "interval_join_lines": f"WITH {_CARRIED} SELECT id, line_no, q_from FROM c WHERE q_from IS NOT NULL AND header_from IS NULL",
        "answered_blanks": f"""WITH {_CARRIED}, a AS (SELECT id, part, unnest(map_entries(answer)) AS e FROM {P})
          SELECT b.id, q_from + ordinal - 1 AS q_number, e.value AS answer FROM b JOIN a ON a.id = b.id AND try_cast(e.key AS BIGINT) = q_from + ordinal - 1
          WHERE q_from + ordinal - 1 <= q_to AND try_cast(e.key AS BIGINT) BETWEEN CASE WHEN part = 6 THEN 131 ELSE 147 END AND CASE WHEN part = 6 THEN 146 ELSE 200 END""",
        "contiguous_blank_blocks": f"WITH {_LINES}, f AS (SELECT id, contains(line, '-------') AS f, coalesce(lag(contains(line, '-------')) OVER (PARTITION BY id ORDER BY line_no), false) AS p FROM lines) SELECT id, count(*) FILTER (f AND NOT p) AS n_blocks, count(*) FILTER (f) AS n_lines FROM f GROUP BY id",
        "lines_until_second_block": f"WITH {_LINES}, s AS (SELECT id, max(CASE WHEN header_from IN (135, 151) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS s FROM lines) SELECT id, count(*) AS n_lines FROM s WHERE s = 0 GROUP BY id",
        "first_header_place": f"WITH {_LINES}, s AS (SELECT *, max(CASE WHEN header_from IN (131, 147) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS s FROM lines) SELECT header_from AS q_from, id AS first_id, line_no AS first_line FROM s WHERE s = 1 AND header_from IS NOT NULL QUALIFY row_number() OVER (PARTITION BY header_from ORDER BY id, line_no) = 1",
        "filled_sentences": f"SELECT id, CASE WHEN instr(sentence, '-------') > 0 THEN left(sentence, instr(sentence, '-------') - 1) || choices[answer] || substr(sentence, instr(sentence, '-------') + 7) ELSE sentence END AS filled FROM {LIVE_Q} WHERE {usable}",
        "bold_matched_form": rf"SELECT ex_id, CASE WHEN regexp_matches(matched_form, '^[A-Za-z]+$') THEN regexp_replace({_UNBOLD}, '(?i)\b(' || matched_form || ')\b', '**\1**', 'g') ELSE {_UNBOLD} END AS bolded FROM {EXAMPLES}",
        "unbold_sentences": f"SELECT ex_id, {_UNBOLD} AS plain FROM {EXAMPLES}",
        "dedupe_key_groups": f"SELECT lower({white(chr(40) + 'replace(sentence, ' + repr('**') + ', ' + repr('') + ')' + chr(41))}) AS key, count(*) AS n, min(ex_id) AS first_id FROM {EXAMPLES} GROUP BY 1 HAVING count(*) > 1",
        "corrupt_text_flag": f"SELECT ex_id FROM {EXAMPLES} WHERE {_CORRUPT}",
        "text_repair": rf"""WITH a AS (SELECT ex_id, {rep} AS o FROM {EXAMPLES} WHERE {_CORRUPT}), b AS (SELECT *, trim(regexp_extract(o, '^([^\x{{AC00}}-\x{{D7AF}}]*)', 1)) AS h FROM a),
          c AS (SELECT *, length(regexp_extract(h, '(?s)^(.*[.!?])', 1)) AS z FROM b),
          d AS (SELECT ex_id, CASE WHEN NOT regexp_matches(o, '[\x{{AC00}}-\x{{D7AF}}]') THEN o WHEN length(h) <= 15 THEN '' WHEN z - 1 > length(h) * 0.4 THEN left(h, z) ELSE h END AS o FROM c)
          SELECT ex_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(o, '[\x{{4E00}}-\x{{9FFF}}]', '', 'g'), '  +', ' ', 'g')), '[\s\-_=.]{{3,}}$', '.')) AS repaired FROM d""",
        "explanation_parts": f"""WITH a AS (SELECT id, explanation, instr(explanation, '[어휘]') AS v FROM {Q} WHERE explanation IS NOT NULL), b AS (SELECT id, CASE WHEN v > 0 THEN left(explanation, v - 1) ELSE explanation END AS h, CASE WHEN v > 0 THEN substr(explanation, v + 4) END AS voc FROM a),
          c AS (SELECT *, instr(h, '[번역]') AS t FROM b) SELECT id, {strip("CASE WHEN t > 0 THEN left(h, t - 1) ELSE h END")} AS explanation, {strip("CASE WHEN t > 0 THEN substr(h, t + 4) END")} AS translation, {strip("voc")} AS vocabulary FROM c""",
        "answer_letters": f"SELECT replace(replace(a, '8', 'B'), '0', 'D') AS answer, count(*) AS n FROM (SELECT unnest(map_values(answer)) AS a FROM {P}) GROUP BY 1",
        "html_escaped_gloss": f"SELECT id, {_ESC('meaning_kr')} AS html FROM {V}",
        "inline_html_examples": rf"""SELECT ex_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_ESC('sentence')}, '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g'), '\*([^*]+)\*', '<em>\1</em>', 'g'),
          '`([^`]+)`', '<code>\1</code>', 'g'), '\[\[([^\]|]+)\]\]', '<span class="wikilink">\1</span>', 'g') AS html FROM {EXAMPLES}""",
        "file_names": rf"""SELECT id, regexp_replace(lower(regexp_replace({strip('word')}, '[<>:"/\\|?*]', '_', 'g')), '^[. ]+|[. ]+$', '', 'g') AS name FROM {V}""",
        "first_sense": f"SELECT id, {_SENSE} AS sense FROM {V}",
        "gloss_pos": f"SELECT id, {glo} AS pos FROM {V}",
        "word_family": f"WITH w AS {_WORDS} SELECT * FROM ({fam}) WHERE length(form) >= 3",
        "word_variants": f"WITH w AS {_WORDS} {var}",
        "fallback_lemma": f"SELECT word, {lem} AS lemma FROM {_WORDS}",
        "suffix_pos": f"SELECT word, {suf} AS pos FROM {_WORDS}",
        "decided_pos": f"""WITH a AS (SELECT id, lower({strip('word')}) AS w, coalesce({_SENSE}, '') AS sense, {glo} AS by_gloss FROM {V}),
          b AS (SELECT id, w AS word, CASE WHEN by_gloss IS NOT NULL THEN by_gloss WHEN regexp_matches(sense, '{GLOSS_ADJECTIVE}') OR (length(sense) >= 2 AND NOT ends_with(sense, '다') AND regexp_matches(sense, '{GLOSS_ADJECTIVE_WEAK}')) THEN 'adjective' END AS told,
            sense <> '' AND NOT regexp_matches(sense, '{GLOSS_NO_NOUN}') AS noun FROM a), c AS (SELECT *, {suf} AS by_end FROM b)
          SELECT id, coalesce(CASE WHEN contains(word, ' ') THEN told {' '.join(f"WHEN word = '{k}' THEN '{x}'" for k, x in WORD_POS.items())} WHEN ends_with(word, 'ly') AND length(word) > 3 THEN CASE WHEN word IN {items(LY_ADJECTIVES)} THEN 'adjective' ELSE 'adverb' END
            WHEN told IS NOT NULL THEN told WHEN noun AND (by_end = 'noun' OR by_end IS NULL) THEN 'noun' ELSE by_end END, 'noun') AS pos FROM c""",
        "phrase_types": f"SELECT id, {typ} AS type FROM {V} WHERE trim(word) LIKE '% %'",
        "rule_classified": f"SELECT id, {cls} AS category FROM (SELECT *, {heads} AS h FROM (SELECT id, list_transform(map_values(choices), lambda x: regexp_replace(lower({strip('x')}), '[.,;:]+$', '')) AS c FROM {Q}))",
        "category_normalised": f"SELECT id, {norm} AS category FROM {Q}",
    }
