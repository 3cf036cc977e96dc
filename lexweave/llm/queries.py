"""Queries of the training-text problems, by name."""

from __future__ import annotations

from ..session import spread, table
from . import bpe, cuts, leaks, pii, scans, typography


def _t(names, f):
    return lambda spark, sf: f(*(spread(table(spark, sf, n)) for n in names))


_EX = ("word_ets_examples", "word_ets_examples_raw")
_SCAN = ("word_ets_examples", "questions")
_LEAK = ("documents", "eval_items")


def queries() -> dict:
    return {
        "p3_found": _t(_EX, typography.duplicate_pairs),
        "p3_collapsed": _t(_EX, typography.collapsed),
        "p6_found": _t(_SCAN, scans.damaged),
        "p6_repaired": _t(_SCAN, scans.repaired),
        "p7_found": _t(_SCAN, cuts.cut_records),
        "p7_shares": _t(_SCAN, cuts.cut_shares),
        "p8_ids": _t(("documents",), bpe.encode_documents),
        "p8_token_counts": _t(("documents",), lambda d: bpe.token_counts(bpe.encode_documents(d), d)),
        "p9_found": _t(_LEAK, leaks.leaked),
        "p9_report": _t(_LEAK, leaks.leak_report),
        "p10_found": _t(("documents",), pii.found),
        "p10_redacted": _t(("documents",), pii.redact),
    }


_GRAMS = r"""SELECT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {src}) WHERE len(w) >= 12"""


#: Equal texts, and equal leaves of the payloads with their paths in order.
_KEYS = r"""WITH x AS (SELECT DISTINCT e.ex_id AS id, regexp_replace(lower(e.sentence), '[^\p{L}\p{N}]+', '', 'g') AS k FROM (SELECT unnest(examples) AS e FROM word_ets_examples) WHERE e.sentence IS NOT NULL),
  leaves AS (SELECT raw_id, t.fullkey AS path, t.type AS type, CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN '' WHEN t.type = 'VARCHAR' THEN json_extract_string(t.value, '$') ELSE t.value::VARCHAR END AS val FROM word_ets_examples_raw, json_tree(payload::JSON) t),
  c AS (SELECT raw_id, string_agg(path || chr(1) || type || chr(1) || CASE WHEN ends_with(path, '.sentence') THEN regexp_replace(lower(val), '[^\p{L}\p{N}]+', '', 'g') ELSE coalesce(val, '') END, chr(2) ORDER BY path) AS k FROM leaves GROUP BY raw_id),
  a AS (SELECT 'example' AS kind, id, k FROM x WHERE k <> '' UNION ALL SELECT DISTINCT 'raw', raw_id, k FROM c), m AS (SELECT kind, id, min(id) OVER (PARTITION BY kind, k) AS id_a FROM a)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"{_KEYS} SELECT kind, id_a, id AS id_b FROM m WHERE id <> id_a",
        "p3_collapsed": f"{_KEYS} SELECT kind, id_a AS id, count(*) AS n_copies FROM m GROUP BY kind, id_a",
        "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(key='doc_id', src='documents')}) JOIN ({_GRAMS.format(key='item_id', src='eval_items')}) USING (g)",
    }
