"""Queries of the general record problems (references, nesting, skew, packed fields)."""

from __future__ import annotations

from ..operators import nested, orphans, packed, salted
from ..session import spread, table
from . import records_sql
from .sql import WORD


def _t(names, f):
    return lambda spark, sf: f(*(table(spark, sf, n) for n in names))


_REF = ("word_ets_examples", "vocab", "questions", "passages")


def _orphans(entries, vocab, questions, passages):
    return orphans.find_orphans(orphans.references(entries), orphans.targets(vocab, questions, passages))


def _report(entries, vocab, questions, passages):
    return orphans.orphan_report(orphans.references(entries), orphans.targets(vocab, questions, passages))


def _children(spark, sf):
    """Children of the raw files, from their written emission."""
    tagged = nested.flatten_payloads(spread(table(spark, sf, "word_ets_examples_raw")), tags=("example", "part"))
    return nested.children(spark, nested.write_tagged(tagged))


def _flat(tag):
    """A flat table of raw files and typed entries together, from a written emission of its tag alone."""

    def run(spark, sf):
        tagged = nested.flatten_payloads(spread(table(spark, sf, "word_ets_examples_raw")), tags=(tag,))
        rows = tagged.unionByName(nested.flatten_entries(table(spark, sf, "word_ets_examples"), (tag,)).select(*tagged.columns))
        return nested.read_flat(spark, nested.write_tagged(rows), tag)

    return run


def queries() -> dict:
    return {
        "p1_found": _t(_REF, _orphans),
        "p1_report": _t(_REF, _report),
        "p2_found": _children,
        "p2_words": _flat("word"),
        "p2_examples": _flat("example"),
        "p2_parts": _flat("part"),
        "p4_found": _t(("word_ets_examples",), salted.word_totals),
        "p4_with_vocab": _t(("word_ets_examples", "vocab"), salted.word_totals_with_vocab),
        "p5_found": _t(("vocab", "questions"), packed.packed_fields),
    }


_PLAIN = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_NUM = lambda i: f"regexp_extract(p, '^vol0*([0-9]+)test0*([0-9]+)(q|part)0*([0-9]+)$', {i})"
_REFS = f"""v AS (SELECT entry_id, loaded_at, {_PLAIN.format("vocab_id")} AS p FROM word_ets_examples), s AS (SELECT entry_id, loaded_at, {_PLAIN.format("e.source")} AS p FROM (SELECT entry_id, loaded_at, unnest(examples) AS e FROM word_ets_examples)),
  refs AS (SELECT 'vocab' AS ref_table, CASE WHEN regexp_matches(p, '^hw[0-9]+$') THEN 'hw_' || format('{{:04d}}', regexp_extract(p, '^hw([0-9]+)$', 1)::BIGINT) ELSE p END AS ref_id, entry_id, loaded_at FROM v WHERE p <> ''
    UNION SELECT CASE WHEN {_NUM(3)} = 'q' THEN 'questions' ELSE 'passages' END, 'vol' || {_NUM(1)} || '_test' || format('{{:02d}}', {_NUM(2)}::BIGINT) || '_part' || CASE WHEN {_NUM(3)} = 'q' THEN '5_' || format('{{:03d}}', {_NUM(4)}::BIGINT) ELSE {_NUM(4)} || '_raw' END, entry_id, loaded_at FROM s WHERE {_NUM(3)} <> ''),
  t AS (SELECT ref_table, id AS ref_id, bool_and(coalesce(deleted, false)) AS gone, min(loaded_at) AS first_at FROM (SELECT 'vocab' AS ref_table, id, deleted, loaded_at FROM vocab UNION ALL SELECT 'questions', id, deleted, loaded_at FROM questions UNION ALL SELECT 'passages', id, deleted, loaded_at FROM passages) GROUP BY ALL),
  found AS (SELECT DISTINCT ref_table, ref_id, entry_id, CASE WHEN t.first_at IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_at > loaded_at THEN 'late' END AS reason, strftime(loaded_at, '%Y-%m') AS load_month FROM refs LEFT JOIN t USING (ref_table, ref_id))"""
_TOTALS = f"""totals AS (SELECT word, count(*) AS n_entries, sum(n)::BIGINT AS n_examples FROM (SELECT {WORD} AS word, entry_id, max(coalesce(len(examples), 0)) AS n FROM word_ets_examples GROUP BY ALL) GROUP BY word)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_REFS} SELECT * FROM found WHERE reason IS NOT NULL",
        "p1_report": f"WITH {_REFS} SELECT ref_table, load_month, reason, count(*) AS n_refs, count(DISTINCT ref_id) AS n_targets FROM found WHERE reason IS NOT NULL GROUP BY ALL",
        "p2_found": records_sql.CHILDREN,
        "p2_words": records_sql.WORDS,
        "p2_examples": records_sql.EXAMPLES,
        "p2_parts": records_sql.PARTS,
        "p5_found": records_sql.packed(),
        "p4_found": f"WITH {_TOTALS} SELECT * FROM totals",
        "p4_with_vocab": f"""WITH {_TOTALS}, v AS (SELECT {WORD} AS word, count(DISTINCT id) AS n_vocab_ids, count(DISTINCT day) AS n_days FROM vocab GROUP BY 1)
          SELECT word, coalesce(n_entries, 0) AS n_entries, coalesce(n_examples, 0) AS n_examples, coalesce(n_vocab_ids, 0) AS n_vocab_ids, coalesce(n_days, 0) AS n_days FROM totals FULL JOIN v USING (word)""",
    }
