"""SQL of the nested-record and packed-field queries."""

from __future__ import annotations

#: Children of an optional JSON field in whatever shape, as a list.
_LIST = """CASE json_type({x}) WHEN 'ARRAY' THEN from_json({x}, '["JSON"]') WHEN 'OBJECT' THEN CASE WHEN json_exists({x}, '$.sentence') THEN [{x}] ELSE map_values(from_json({x}, '"MAP(VARCHAR, JSON)"')) END
  WHEN 'NULL' THEN [] WHEN 'VARCHAR' THEN from_json(json_extract_string({x}, '$'), '["JSON"]') ELSE [{x}] END"""

#: Word records of the raw files with their place in the document.
_RECORDS = """p AS (SELECT raw_id, payload::JSON AS p FROM word_ets_examples_raw),
  r AS (SELECT raw_id, CASE WHEN json_exists(p, '$.data.entries') THEN json_extract(p, '$.data.entries') ELSE p END AS r FROM p),
  m AS (SELECT raw_id, map_entries(from_json(r, '"MAP(VARCHAR, JSON)"')) AS l FROM r WHERE json_type(r) = 'OBJECT'), a AS (SELECT raw_id, from_json(r, '["JSON"]') AS l FROM r WHERE json_type(r) = 'ARRAY'),
  w AS (SELECT raw_id, n, e.key AS word, e.value AS v FROM (SELECT raw_id, unnest(l) AS e, unnest(range(1, len(l) + 1)) AS n FROM m)
    UNION ALL SELECT raw_id, n, json_extract_string(v, '$.word'), v FROM (SELECT raw_id, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS n FROM a))"""
_CHILD = f"""WITH {_RECORDS},
  c AS (SELECT raw_id, n, word, 'example' AS child_kind, {_LIST.format(x="json_extract(v, '$.examples')")} AS l FROM w WHERE json_exists(v, '$.examples')
    UNION ALL SELECT raw_id, n, word, 'part', {_LIST.format(x="json_extract(v, '$.parts_appeared')")} FROM w WHERE json_exists(v, '$.parts_appeared')),
  x AS (SELECT raw_id, n, word, child_kind, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS pos FROM c),
  once AS (SELECT * FROM word_ets_examples QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at) = 1)"""
_DIGITS = "regexp_replace(json_extract_string(x, '$'), '[^0-9]', '', 'g')"

CHILDREN = f"""{_CHILD} SELECT DISTINCT raw_id, word, child_kind, pos, CASE child_kind WHEN 'example' THEN trim(json_extract_string(x, '$.source')) ELSE {_DIGITS} END AS child_text FROM x"""

_field = lambda v, n, t="VARCHAR": f"TRY_CAST(json_extract_string({v}, '$.{n}') AS {t}) AS {n}"
WORDS = f"""{_CHILD} SELECT raw_id AS doc_id, 'r' || raw_id || '/w' || n AS pk, NULL::VARCHAR AS parent, word, n AS pos, {_field('v', 'vocab_id')}, {_field('v', 'chapter', 'INT')}, {_field('v', 'total_count', 'INT')} FROM w
  UNION ALL SELECT entry_id, 'e' || entry_id || '/w1', NULL, word, 1, vocab_id, chapter, total_count FROM once"""
_EX_FIELDS = {"ex_id": "BIGINT", "sentence": "VARCHAR", "source": "VARCHAR", "volume": "INT", "test": "INT", "page": "INT", "question_number": "INT", "part": "INT", "matched_form": "VARCHAR"}
EXAMPLES = f"""{_CHILD} SELECT raw_id AS doc_id, 'r' || raw_id || '/w' || n || '/e' || pos AS pk, 'r' || raw_id || '/w' || n AS parent, word, pos, {', '.join(_field('x', f, t) for f, t in _EX_FIELDS.items())} FROM x WHERE child_kind = 'example'
  UNION ALL SELECT entry_id, 'e' || entry_id || '/w1/e' || pos, 'e' || entry_id || '/w1', word, pos, {', '.join('e.' + f for f in _EX_FIELDS)} FROM (SELECT entry_id, word, unnest(examples) AS e, unnest(range(1, len(examples) + 1)) AS pos FROM once)"""
PARTS = f"""{_CHILD} SELECT raw_id AS doc_id, 'r' || raw_id || '/w' || n || '/p' || pos AS pk, 'r' || raw_id || '/w' || n AS parent, word, pos, {_DIGITS}::INT AS part, {_DIGITS} AS number FROM x WHERE child_kind = 'part'
  UNION ALL SELECT entry_id, 'e' || entry_id || '/w1/p' || pos, 'e' || entry_id || '/w1', word, pos, p, p::VARCHAR FROM (SELECT entry_id, word, unnest(parts_appeared) AS p, unnest(range(1, len(parts_appeared) + 1)) AS pos FROM once)"""


def _pieces(value: str, delimiters: str) -> str:
    """Pieces of a value between delimiters outside quotes and round brackets."""
    marked = rf"CASE WHEN regexp_matches({value}, '^\s*(?:\(1\)|1[.)]|①)') THEN regexp_replace({value}, '(?:^|\s)(?:\(\d{{1,2}}\)|\d{{1,2}}[.)])|[①-⑳]', chr(1), 'g') ELSE {value} END"
    found = rf"""regexp_extract_all({marked}, '(?:"[^"]*"|“[^”]*”|\([^()]*\)|[^{delimiters}\x01])+')"""
    bare = r"""regexp_replace(p, '^\s+|\s+$', '', 'g')"""
    tidy = rf"""regexp_replace(regexp_replace({bare}, '^(?:"([^"]*)"|“([^”]*)”)$', '\1\2'), '^\s+|\s+$', '', 'g')"""
    return f"list_filter(list_transform({found}, lambda p: {tidy}), lambda p: p <> '')"


def packed() -> str:
    """The delimiters are those that the fields' values use (the query infers them)."""
    rows = f"""SELECT id AS record_id, 'synonyms' AS field_name, flatten(list_transform(list_filter(synonyms, lambda v: v IS NOT NULL), lambda v: {_pieces('v', ',;/|' + chr(92) + 't' + chr(92) + 'n')})) AS l FROM vocab
      UNION SELECT id, 'meaning_kr', {_pieces('meaning_kr', ',;/|·、，' + chr(92) + 't' + chr(92) + 'n')} FROM vocab
      UNION SELECT id, 'vocabulary', {_pieces('vocabulary', ',;/|' + chr(92) + 't' + chr(92) + 'n')} FROM questions"""
    return f"SELECT record_id, field_name, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS piece FROM ({rows}) WHERE len(l) > 0"
