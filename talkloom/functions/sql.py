"""The scalar text functions for SQL users, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from talkloom.functions import text as T


def _r(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def media_kind_sql(m: str, n: str) -> str:
    cases = " ".join(f"when lower(coalesce({m}, '')) rlike {_r(by_type)}" + (f" or lower(coalesce({n}, '')) rlike {_r(by_name)}" if by_name else "") + f" then '{label}'" for label, by_type, by_name in T.MEDIA_KINDS)
    return f"case {cases} else '{T.OTHER_MEDIA}' end"


def human_size_sql(b: str) -> str:
    return (
        f"case when {b} is null or {b} = 0 then '?B' when {b} < 1024 then concat(format_string('%.0f', cast({b} as double)), 'B') when {b} < 1048576 then concat(format_string('%.1f', bround({b} / 1024D, 1)), 'KB')"
        f" when {b} < 1073741824 then concat(format_string('%.1f', bround({b} / 1048576D, 1)), 'MB') else concat(format_string('%.1f', bround({b} / 1073741824D, 1)), 'GB') end"
    )


FUNCTIONS = {
    "strip_noise(t STRING)": f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {_r(T.ANSI)}, ''), {_r(T.REMINDER)}, ''), r'(?m)^[^\\n]*\\r', ''), r'\\n{{3,}}', '\\n\\n')",
    "truncate_text(t STRING, n INT)": f"if(length(t) > n, concat(substring(t, 1, greatest(0, n - {len(T.TRUNCATED)})), '{T.TRUNCATED}'), t)",
    "estimate_tokens(t STRING)": f"coalesce(regexp_count(t, r'{T.WORD_RUN}') + regexp_count(t, r'(?U)[^\\sA-Za-z0-9_]'), 0)",
    "sha8(t STRING)": "substring(sha2(encode(t, 'UTF-8'), 256), 1, 8)",
    "normalise_blanks(t STRING)": "trim(regexp_replace(t, r'(?U)\\s+', ' '))",
    "tokenize_text(t STRING)": f"concat(transform(regexp_extract_all(t, r'({T.WORD_RUN})', 1), w -> lower(w)), flatten(transform(regexp_extract_all(t, r'({T.CJK_RUN})', 1), r -> if(length(r) = 1, array(r), transform(sequence(1, greatest(length(r) - 1, 1)), i -> substring(r, i, 2))))))",
    "media_kind(m STRING, n STRING)": media_kind_sql("m", "n"),
    "human_size(b DOUBLE)": human_size_sql("b"),
}


def register_search(spark: SparkSession, docs: str = "docs") -> str:
    """A table function over a view of searched texts (event_id, session_key, ts, doc): ``search_texts(q, n)``.

    It gives the n newest events whose text holds the phrase, without regard to case.
    """
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION search_texts(q STRING, n INT) RETURNS TABLE (event_id STRING, session_key STRING, ts STRING, snippet STRING)
        RETURN SELECT event_id, session_key, ts, snippet FROM (SELECT event_id, session_key, ts, substring(doc, greatest(1, instr(lower(doc), lower(q)) - 40), 120) AS snippet,
          row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id) AS r FROM {docs} WHERE contains(lower(doc), lower(q))) WHERE r <= n"""
    )
    return "search_texts"


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
