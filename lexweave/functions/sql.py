"""The text functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (arguments, result, body)
FUNCTIONS = {
    "lw_collapse": ("s STRING", "STRING", r"trim(regexp_replace(s, r'\s+', ' '))"),
    "lw_dedupe_key": ("s STRING", "STRING", r"lower(trim(regexp_replace(replace(s, '**', ''), r'\s+', ' ')))"),
    "lw_tokens": ("s STRING", "ARRAY<STRING>", r"transform(regexp_extract_all(regexp_replace(s, '-{2,}', ' '), r'[a-zA-Z]+', 0), t -> lower(t))"),
    "lw_word_key": ("s STRING", "STRING", r"lower(regexp_replace(s, r'^\s+|\s+$', ''))"),
    "lw_unbold": ("s STRING", "STRING", r"regexp_replace(s, r'\*\*(.+?)\*\*', '$1')"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for the session; they are inlined by the optimizer, not called."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
