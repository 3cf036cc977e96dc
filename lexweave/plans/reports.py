"""Report queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..functions.lexicon import CATEGORIES, POS_NAMES, POS_SHORT, STOP_WORDS
from ..operators import patches
from ..operators import reports as r
from ..session import table
from .sql import EXAMPLES, LIVE_Q, V, WORD, items


def questions(spark, sf):
    return r.live(r.first_copy(table(spark, sf, "questions"), "id", "loaded_at"))


def vocab(spark, sf):
    return r.first_copy(table(spark, sf, "vocab"), "id", "loaded_at")


def entries(spark, sf):
    return table(spark, sf, "word_ets_examples")


def _tokens(spark, sf):
    return r.question_tokens(questions(spark, sf))


def queries() -> dict:
    q, v, e = questions, vocab, entries
    return {
        "word_frequency_top": lambda s, d: r.word_frequency_top(_tokens(s, d)),
        "word_frequency_per_volume_top10": lambda s, d: r.word_frequency_top_per_group(_tokens(s, d), "volume"),
        "vocabulary_size_by_volume": lambda s, d: r.vocabulary_size(_tokens(s, d), "volume"),
        "category_counts_rollup": lambda s, d: r.category_counts(q(s, d)),
        "category_pivot": lambda s, d: r.category_pivot(q(s, d)),
        "category_share_within_volume": lambda s, d: r.category_share(q(s, d)),
        "volume_test_cube": lambda s, d: r.category_cube(q(s, d)),
        "ordered_categories": lambda s, d: r.ordered_categories(q(s, d), CATEGORIES),
        "coverage_by_day": lambda s, d: r.coverage(v(s, d), r.example_counts(e(s, d))),
        "tokens_not_in_vocab_top": lambda s, d: r.tokens_not_in(_tokens(s, d), v(s, d)),
        "vocab_top_by_examples": lambda s, d: r.top_words(r.example_counts(e(s, d))),
        "vocab_without_examples": lambda s, d: r.without_examples(v(s, d), r.example_counts(e(s, d))),
        "level_histogram": lambda s, d: r.histogram(v(s, d), F.col("level"), "level"),
        "pos_histogram": lambda s, d: r.histogram(v(s, d), F.explode_outer(classify.pos_list(F.col("pos"))), "pos"),
        "examples_top5_priority": lambda s, d: r.top_examples(r.examples(e(s, d))),
        "word_examples_dedup_sorted": lambda s, d: r.word_documents(r.examples(e(s, d))),
        "word_examples_ordered": lambda s, d: patches.word_example_pages(r.examples(e(s, d))),
        "chapter_map": lambda s, d: patches.chapter_map(v(s, d)),
    }


_TOKENS = f"""toks AS (
  SELECT id, volume, list_filter(flatten(list_transform([sentence, choices['A'], choices['B'], choices['C'], choices['D']],
    lambda t: coalesce(list_transform(regexp_extract_all(regexp_replace(t, '-{{2,}}', ' ', 'g'), '[a-zA-Z'']+'), lambda w: lower(w)), []))),
    lambda w: w NOT IN {items(STOP_WORDS)} AND length(w) > 1) AS l FROM {LIVE_Q}),
t AS (SELECT id, volume, unnest(l) AS token, unnest(range(len(l))) AS pos FROM toks)"""
_CAT = "coalesce(nullif(trim(category), ''), '(미분류)')"
_COUNTS = f"counts AS (SELECT word, count(DISTINCT ex_id) AS n_examples FROM (SELECT {WORD} AS word, unnest(CASE WHEN len(examples) > 0 THEN list_transform(examples, lambda e: e.ex_id) ELSE [NULL] END) AS ex_id FROM word_ets_examples) GROUP BY word)"
_KEY = r"lower(trim(regexp_replace(replace(sentence, '**', ''), '[ \t\n\r\x0B\f]+', ' ', 'g')))"


def oracle_sql() -> dict[str, str]:
    short = "CASE trim(p) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in POS_SHORT.items()) + " ELSE trim(p) END"
    pos = f"list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(lower(coalesce(pos, '')), '[\\[\\]\"]', '', 'g'), '[/,]'), lambda p: {short}), lambda p: p IN {items(POS_NAMES)}))"
    return {
        "word_frequency_top": f"""WITH {_TOKENS}, c AS (SELECT token, count(*) AS n, min({{'id': id, 'pos': pos}}) AS f FROM t GROUP BY token)
          SELECT row_number() OVER (ORDER BY n DESC, f) AS rank, token, n, round(n * 100.0 / (SELECT sum(n) FROM c), 4)::DOUBLE AS pct FROM c ORDER BY n DESC, f LIMIT 100""",
        "word_frequency_per_volume_top10": f"""WITH {_TOKENS}, c AS (SELECT volume, token, count(*) AS n, min({{'id': id, 'pos': pos}}) AS f FROM t GROUP BY ALL)
          SELECT volume, row_number() OVER (PARTITION BY volume ORDER BY n DESC, f) AS rank, token, n FROM c QUALIFY rank <= 10""",
        "vocabulary_size_by_volume": f"WITH {_TOKENS} SELECT volume, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM t GROUP BY volume",
        "category_counts_rollup": f"SELECT volume, category, count(*) AS n FROM (SELECT volume, {_CAT} AS category FROM {LIVE_Q}) GROUP BY ROLLUP (volume, category)",
        "category_pivot": f"""WITH q AS (SELECT {_CAT} AS category, volume FROM {LIVE_Q}), v AS (SELECT DISTINCT volume FROM q), n AS (SELECT category, volume, count(*) AS n FROM q GROUP BY ALL), t AS (SELECT category, count(*) AS total FROM q GROUP BY 1)
          SELECT t.category, v.volume, coalesce(n.n, 0) AS n, t.total FROM t, v LEFT JOIN n ON n.category = t.category AND n.volume IS NOT DISTINCT FROM v.volume""",
        "category_share_within_volume": f"SELECT volume, {_CAT} AS category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY volume), 4)::DOUBLE AS pct FROM (SELECT volume, {_CAT} AS category FROM {LIVE_Q}) GROUP BY volume, category",
        "volume_test_cube": f"SELECT volume, test, grouping(volume, test)::BIGINT AS level, count(*) AS n FROM {LIVE_Q} GROUP BY CUBE (volume, test)",
        "ordered_categories": f"""SELECT row_number() OVER (ORDER BY CASE WHEN spot IS NOT NULL THEN 0 WHEN category <> '(미분류)' THEN 1 ELSE 2 END, coalesce(spot, 0), category) AS place, category, n
          FROM (SELECT {_CAT} AS category, list_position({str(CATEGORIES)}, {_CAT}) AS spot, count(*) AS n FROM {LIVE_Q} GROUP BY ALL)""",
        "coverage_by_day": f"""WITH {_COUNTS} SELECT day, count(*) AS total, count(n_examples) AS matched, count(*) FILTER (n_examples > 0) AS with_hits,
          round(count(n_examples) * 100.0 / count(*), 4)::DOUBLE AS pct, round(count(*) FILTER (n_examples > 0) * 100.0 / count(*), 4)::DOUBLE AS pct_hits
          FROM (SELECT day, {WORD} AS word FROM {V}) LEFT JOIN counts USING (word) GROUP BY day""",
        "tokens_not_in_vocab_top": f"""WITH {_TOKENS}, m AS (SELECT * FROM t WHERE token NOT IN (SELECT {WORD} FROM {V} WHERE word IS NOT NULL)),
          top AS (SELECT token, count(*) AS n FROM m GROUP BY token ORDER BY n DESC, token LIMIT 30),
          f AS (SELECT DISTINCT token, id FROM m QUALIFY dense_rank() OVER (PARTITION BY token ORDER BY id) <= 5)
          SELECT token, n, (SELECT string_agg(id, ',' ORDER BY id) FROM f WHERE f.token = top.token) AS first_ids FROM top""",
        "vocab_top_by_examples": f"WITH {_COUNTS} SELECT * FROM counts ORDER BY n_examples DESC, word LIMIT 20",
        "vocab_without_examples": f"WITH {_COUNTS} SELECT id, word FROM (SELECT id, {WORD} AS word FROM {V}) ANTI JOIN (SELECT word FROM counts WHERE n_examples > 0) USING (word)",
        "level_histogram": f"SELECT coalesce(level, 'none') AS level, count(*) AS n FROM {V} GROUP BY 1",
        "pos_histogram": f"SELECT coalesce(pos, 'none') AS pos, count(*) AS n FROM (SELECT unnest(CASE WHEN len(l) > 0 THEN l ELSE [NULL] END) AS pos FROM (SELECT {pos} AS l FROM {V})) GROUP BY 1",
        "examples_top5_priority": f"SELECT word, row_number() OVER (PARTITION BY word ORDER BY CASE WHEN part = 5 THEN 0 ELSE 1 END, coalesce(volume, 99), ex_id) AS rank, ex_id FROM {EXAMPLES} QUALIFY rank <= 5",
        "word_examples_dedup_sorted": f"""WITH once AS (SELECT * FROM {EXAMPLES} QUALIFY row_number() OVER (PARTITION BY word, {_KEY} ORDER BY ex_id) = 1),
          k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY coalesce(volume, 0), coalesce(test, 0), coalesce(part, 0), coalesce(question_number, 0), ex_id) AS r FROM once)
          SELECT word, count(*) AS total_count, coalesce(string_agg(DISTINCT part::VARCHAR, ',' ORDER BY part::VARCHAR), '') AS parts,
            coalesce(string_agg(trim(source), ';' ORDER BY r) FILTER (r <= 3), '') AS first_sources FROM k GROUP BY word""",
        "chapter_map": f"SELECT day, page, count(*) AS n_words, string_agg(w, ',' ORDER BY n) AS words FROM (SELECT coalesce(day, -1) AS day, trim(word) AS w, row_number() OVER (ORDER BY coalesce(day, -1), id) AS n, ((n - 1) // 500 + 1)::BIGINT AS page FROM {V}) GROUP BY day, page",
    }
