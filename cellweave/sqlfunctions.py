"""The engine's scalar functions for use from SQL text: one call registers them for a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_WS = r"(?U)[\\s\\x1c-\\x1f]"
_CLEAN = f"regexp_replace(regexp_replace(coalesce(x, ''), '{_WS}+', ' '), '^ | $', '')"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(x, '')), '\\([^)]*\\)', ' '), '[^a-z0-9\\s]', ' '), '\\s+', ' '))"
_TOKENS = "array_distinct(filter(split({0}, ' '), t -> t <> ''))"

# Name -> (arguments, return type, body). They are SQL functions, so Catalyst sees through them.
FUNCTIONS = {
    "cw_clean_text": ("x STRING", "STRING", _CLEAN),
    "cw_match_form": ("x STRING", "STRING", _NORM),
    "cw_jaccard": ("a STRING, b STRING", "DOUBLE", f"size(array_intersect({_TOKENS.format('a')}, {_TOKENS.format('b')})) / greatest(1, size(array_union({_TOKENS.format('a')}, {_TOKENS.format('b')})))"),
    "cw_candidate": ("label STRING, description STRING, kind STRING", "STRING", "concat('<', label, ' [DESCRIPTION] ', coalesce(nullif(trim(description), ''), 'None'), ' [TYPE] ', coalesce(nullif(trim(kind), ''), 'None'), '>')"),
    "cw_short_marker": ("x STRING", "STRING", "replace(x, '[DESCRIPTION]', '[DESC]')"),
    "cw_estimated_tokens": ("x STRING", "INT", f"CASE WHEN size(filter(split(coalesce(x, ''), '{_WS}+'), t -> t <> '')) = 0 THEN 0 ELSE greatest(1, cast(floor(size(filter(split(coalesce(x, ''), '{_WS}+'), t -> t <> '')) * 1.3) as int)) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
