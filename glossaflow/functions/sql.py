"""The native steps as functions of Spark SQL, for sessions that are driven by SQL alone.

``register`` creates temporary functions, each an SQL expression or query, so
that the optimizer sees through them: they take part in pruning and code
generation as if they had been written out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import spans
from . import text as tx


def _quoted(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _chars(value: str) -> str:
    return "concat(" + ", ".join(f"char({ord(c)})" for c in value) + ")"


_URL, _MARK = _quoted(spans.URL_PATTERN), f"'{spans.MARK}'"
_TRIMMED = _chars(tx.TRIMMED)
_START, _END = f"'{tx.START}'", f"'{tx.END}'"
_WRAPPED = f"(?s)\\Q{tx.START}\\E(.*?)\\Q{tx.END}\\E"


def _nested(text: str, pairs) -> str:
    for a, b in pairs:
        text = f"replace({text}, {_quoted(a)}, {_quoted(b)})"
    return text


#: Name to parameters, type and body.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "is_blank": ("t STRING", "BOOLEAN", f"btrim(t, {_TRIMMED}) = ''"),
    "wrap_marks": ("t STRING", "STRING", f"concat({_START}, char(10), t, char(10), {_END})"),
    "unwrap_marks": ("t STRING", "STRING", f"CASE WHEN t RLIKE {_quoted(_WRAPPED)} THEN btrim(regexp_extract(t, {_quoted(_WRAPPED)}, 1), {_TRIMMED}) END"),
    "tag_json": ("t STRING", "STRING", _nested("t", tx.JSON_TAGS.items())),
    "untag_json": ("t STRING", "STRING", _nested("t", [(b, a) for a, b in tx.JSON_TAGS.items()])),
    "holds_marks": ("t STRING", "BOOLEAN", f"t RLIKE '{spans.MARK}[0-9]+{spans.MARK}'"),
    "addresses": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, {_URL}, 0)"),
    "protect_addresses": ("t STRING", "STRING", f"array_join(transform(split(t, {_URL}, -1), (x, i) -> CASE WHEN i = 0 THEN x ELSE concat({_MARK}, CAST(i - 1 AS STRING), {_MARK}, x) END), '')"),
    "restore_spans": ("t STRING, found ARRAY<STRING>", "STRING", f"aggregate(transform(found, (v, i) -> struct(concat({_MARK}, CAST(i AS STRING), {_MARK}) AS mark, v AS span)), t, (acc, e) -> replace(acc, e.mark, e.span))"),
}

#: Name to parameters, columns and query.
TABLES: dict[str, tuple[str, str, str]] = {
    "segments": ("t STRING", "pos INT, segment STRING, address STRING", f"SELECT p.pos, p.col, get(regexp_extract_all(t, {_URL}, 0), p.pos) FROM (SELECT posexplode(split(t, {_URL}, -1))) AS p"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the functions for this session and returns their names. segments(t) is for FROM and LATERAL: a row for each stretch of text between addresses, with the address after it."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return [prefix + x for x in (*FUNCTIONS, *TABLES)]
