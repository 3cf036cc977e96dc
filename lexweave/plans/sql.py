"""Pieces that the SQL of several queries shares."""

from __future__ import annotations

from collections.abc import Iterable


def items(words: Iterable[str]) -> str:
    """Words as a SQL list."""
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


WHITE = r"[ \t\n\r\x0B\f]"
Q = "(SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
LIVE_Q = f"(SELECT * FROM {Q} WHERE NOT coalesce(deleted, false))"
V = "(SELECT * FROM vocab QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
P = "(SELECT * FROM passages QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
WORD = r"lower(regexp_replace(word, '^\s+|\s+$', '', 'g'))"
EX = f"""(SELECT * FROM (SELECT {WORD} AS word, unnest(examples, recursive := true) FROM word_ets_examples)
  QUALIFY row_number() OVER (PARTITION BY ex_id ORDER BY ex_id) = 1)"""
EXAMPLES = f"(SELECT {WORD} AS word, e.* FROM (SELECT word, unnest(examples) AS e FROM word_ets_examples) QUALIFY row_number() OVER (PARTITION BY e.ex_id ORDER BY e.ex_id) = 1)"


def white(x: str) -> str:
    """Collapsed white space."""
    return f"trim(regexp_replace({x}, '{WHITE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"
