"""DuckDB SQL of the parsers, the quarantine and the exports, from the raw tables by JSON functions and patterns."""

from __future__ import annotations

_ROLES = "CASE lower({r}) WHEN '1' THEN 'user' WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN '2' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' END"
_CUT_MARK = " …[truncated]"


def _role(r: str) -> str:
    return _ROLES.replace("{r}", r)


def _file(source: str) -> str:
    return rf"'{source}:' || regexp_extract(locator, '([^/]+?)(?:\.\w+)?(?:::.*)?$', 1)"


def _content(c: str) -> str:
    """Text of a content that is one string or a list of text blocks (the tables have no others)."""
    text = f"array_to_string(list_filter(list_transform(CAST({c} AS JSON[]), lambda b: CASE WHEN b->>'$.type' IN ('text', 'input_text', 'output_text') THEN coalesce(b->>'$.text', '') ELSE '' END), lambda t: t <> ''), chr(10))"
    return f"CASE json_type({c}) WHEN 'ARRAY' THEN {text} WHEN 'NULL' THEN NULL ELSE {c}->>'$' END"


def _filled(c: str) -> str:
    return f"CASE WHEN trim({c}, ' ') <> '' THEN {c} END"


_ROWS = "raw_ AS (SELECT id AS raw_id, source_kind, locator, decode(payload) AS payload, CASE WHEN json_valid(decode(payload)) THEN CAST(decode(payload) AS JSON) END AS j FROM raw_records)"
_NONE = "CAST(NULL AS VARCHAR)"
_COLUMNS = "raw_id, source_kind, locator, session_key, native_id, ts, actor, kind, text, cwd, git_branch, cc_version, model, title, error"

TRANSCRIPT = f"""SELECT raw_id, source_kind, locator, coalesce('claude_code:' || (j->>'$.sessionId'), {_file('claude_code')}) AS session_key,
    CASE WHEN j->>'$.type' = 'summary' THEN coalesce(j->>'$.leafUuid', j->>'$.uuid') ELSE j->>'$.uuid' END AS native_id, j->>'$.timestamp' AS ts,
    CASE WHEN j->>'$.type' IN ('user', 'assistant') THEN j->>'$.type' ELSE 'system' END AS actor, CASE WHEN j->>'$.type' IN ('user', 'assistant') THEN 'message' ELSE 'meta' END AS kind,
    CASE WHEN j->>'$.type' IN ('user', 'assistant') THEN {_content("(j->'$.message.content')")} WHEN j->>'$.type' = 'summary' THEN '[summary] ' || coalesce(j->>'$.summary', '') ELSE substr(payload, 1, 300) END AS text,
    j->>'$.cwd' AS cwd, j->>'$.gitBranch' AS git_branch, j->>'$.version' AS cc_version, j->>'$.message.model' AS model, {_NONE} AS title, CASE WHEN j IS NULL THEN 'not JSON' END AS error
  FROM raw_ WHERE source_kind = 'claude_code'"""
_AT = lambda f: f"coalesce(j->>'$.payload.{f}', j->>'$.{f}')"
ROLLOUT = f"""SELECT raw_id, source_kind, locator, {_file('codex')}, {_AT('call_id')}, j->>'$.timestamp',
    CASE {_AT('type')} WHEN 'function_call' THEN 'assistant' WHEN 'function_call_output' THEN 'tool' ELSE {_AT('role')} END,
    CASE {_AT('type')} WHEN 'function_call' THEN 'tool_use' WHEN 'function_call_output' THEN 'tool_result' ELSE 'message' END,
    CASE {_AT('type')} WHEN 'function_call' THEN '[tool_use ' || coalesce({_AT('name')}, 'None') || '] ' || coalesce({_AT('arguments')}, '{{}}') WHEN 'function_call_output' THEN coalesce({_AT('output')}, '')
      ELSE coalesce({_content("(j->'$.payload.content')")}, {_content("(j->'$.content')")}) END,
    {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, CASE WHEN j IS NULL THEN 'not JSON' WHEN {_AT('type')} IN ('message', 'function_call', 'function_call_output') THEN NULL ELSE 'unknown shape' END
  FROM raw_ WHERE source_kind = 'codex_cli'"""
_BUBBLE = f"coalesce({_filled('(j->>' + chr(39) + '$.text' + chr(39) + ')')}, {_filled('(j->>' + chr(39) + '$.richText' + chr(39) + ')')}, {_content('(j->' + chr(39) + '$.content' + chr(39) + ')')})"
KEY_VALUES = f"""SELECT raw_id, source_kind, locator, {_file('cursor')}, j->>'$.bubbleId', j->>'$.createdAt', {_role("(j->>'$.type')")}, 'message', {_BUBBLE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE},
    CASE WHEN j IS NULL THEN 'not JSON' WHEN {_BUBBLE} IS NULL THEN 'no text' END FROM raw_ WHERE source_kind = 'cursor_ide'"""
_GROLE = "coalesce(j->>'$.role', j->>'$.type')"
_GTEXT = f"coalesce({', '.join(_filled('(j->>' + chr(39) + '$.' + n + chr(39) + ')') for n in ('text', 'content', 'message.content'))})"
CONFIGURABLE = f"""SELECT raw_id, source_kind, locator, {_file('generic')}, {_NONE}, coalesce(j->>'$.at', j->>'$.time', j->>'$.timestamp', j->>'$.ts'), coalesce({_role(_GROLE)}, {_GROLE}), 'message', {_GTEXT},
    {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, CASE WHEN j IS NULL THEN 'not JSON' WHEN coalesce({_role(_GROLE)}, {_GROLE}) IN ('user', 'assistant', 'tool', 'system') AND {_GTEXT} IS NOT NULL THEN NULL ELSE 'unknown shape' END
  FROM raw_ WHERE source_kind = 'generic_jsonl'"""
_BOX = f"coalesce(coalesce(j->>'$.source', 'inbox') || ':' || (j->>'$.session'), {_file('inbox')})"
INBOX = f"""SELECT raw_id, source_kind, locator, session_key, CAST(row_number() OVER (PARTITION BY raw_id, m ORDER BY n) - 1 AS VARCHAR), coalesce(m->>'$.ts', captured), CASE WHEN lower(m->>'$.role') IN ('user', 'human') THEN 'user' ELSE 'assistant' END, 'message', m->>'$.text',
    {_NONE}, {_NONE}, {_NONE}, {_NONE}, CASE WHEN n = 1 THEN title END, {_NONE}
  FROM (SELECT raw_id, source_kind, locator, {_BOX} AS session_key, coalesce(j->>'$.captured_at', j->>'$.capturedAt') AS captured, j->>'$.title' AS title, unnest(CAST(j->'$.messages' AS JSON[])) AS m, generate_subscripts(CAST(j->'$.messages' AS JSON[]), 1) AS n FROM raw_ WHERE source_kind = 'chatgpt_web' AND json_type(j->'$.messages') = 'ARRAY')
  WHERE regexp_matches(m->>'$.text', '[^\\s\\x{{0b}}\\x{{85}}\\p{{Z}}]')
  UNION ALL SELECT raw_id, source_kind, locator, {_file('inbox')}, NULL, NULL, NULL, 'message', NULL, {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, 'not JSON' FROM raw_ WHERE source_kind = 'chatgpt_web' AND j IS NULL
  UNION ALL SELECT raw_id, source_kind, locator, {_BOX}, 'note', coalesce(j->>'$.captured_at', j->>'$.capturedAt'), 'system', 'meta', CASE WHEN length(j->>'$.note') > 2000 THEN substr(j->>'$.note', 1, {2000 - len(_CUT_MARK)}) || '{_CUT_MARK}' ELSE j->>'$.note' END,
    {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE} FROM raw_ WHERE source_kind = 'chatgpt_web' AND trim(j->>'$.note', ' ') <> ''"""
_LINES = r"'\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]'"
_WS = r"[\s\x{0b}\x{85}\p{Z}]"
MARKDOWN = f"""SELECT raw_id, source_kind, locator, {_file('aider')} || '-' || session_no, CAST(island AS VARCHAR), {_NONE}, role, 'message', text, {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}, {_NONE}
  FROM (SELECT raw_id, source_kind, locator, session_no, island, role, regexp_replace(string_agg(regexp_replace(line, '^#### ', ''), chr(10) ORDER BY n), '^{_WS}+|{_WS}+$', '', 'g') AS text FROM
    (SELECT *, sum(CASE WHEN before IS DISTINCT FROM {{'s': session_no, 'r': role}} THEN 1 ELSE 0 END) OVER (PARTITION BY raw_id ORDER BY n) AS island FROM
      (SELECT *, lag({{'s': session_no, 'r': role}}) OVER (PARTITION BY raw_id ORDER BY n) AS before FROM
        (SELECT *, sum(CASE WHEN starts_with(line, '# aider chat started at ') THEN 1 ELSE 0 END) OVER (PARTITION BY raw_id ORDER BY n) AS session_no, CASE WHEN starts_with(line, '#### ') THEN 'user' ELSE 'assistant' END AS role FROM
          (SELECT raw_id, source_kind, locator, unnest(regexp_split_to_array(payload, {_LINES})) AS line, generate_subscripts(regexp_split_to_array(payload, {_LINES}), 1) AS n FROM raw_ WHERE source_kind = 'aider'))
        WHERE NOT starts_with(line, '# aider chat started at ')))
    GROUP BY ALL) WHERE text <> ''"""
PARSED = f"{_ROWS}, parsed AS ({TRANSCRIPT} UNION ALL {ROLLOUT} UNION ALL {KEY_VALUES} UNION ALL {CONFIGURABLE} UNION ALL {INBOX} UNION ALL {MARKDOWN})"

_F = '(?:"(?:[^"]|"")*"|[^",\\r\\n]*)'
# DuckDB reads commas before a closing bracket, which RFC 8259 does not allow.
_STRICT = "(json_valid({t}) AND NOT regexp_matches(regexp_replace({t}, '\"(?:[^\"\\\\]|\\\\.)*\"', '0', 'g'), ',\\s*[}}\\]]'))"
_STAMP = "\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ"


def _stamp(c: str) -> str:
    return f"coalesce(json_type({c}) = 'VARCHAR' AND regexp_full_match({c}->>'$', '{_STAMP}') AND try_strptime({c}->>'$', '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL, false)"


def _one_of(c: str, *names: str) -> str:
    return f"coalesce(json_type({c}) = 'VARCHAR' AND {c}->>'$' IN ({', '.join(repr(n) for n in names)}), false)"


def _some(c: str) -> str:
    return f"coalesce(json_type({c}) = 'VARCHAR' AND {c}->>'$' <> '', false)"


_GOOD = f"""CASE source_kind
    WHEN 'claude_code' THEN {_one_of("(j->'$.type')", 'user', 'assistant', 'summary', 'system')} AND {_some("(j->'$.sessionId')")} AND {_stamp("(j->'$.timestamp')")}
    WHEN 'codex_cli' THEN {_one_of("(j->'$.role')", 'user', 'assistant', 'system')} AND coalesce(json_type(j->'$.content') = 'ARRAY', false) AND {_stamp("(j->'$.timestamp')")}
    WHEN 'chatgpt_web' THEN {_some("(j->'$.session')")} AND coalesce(json_type(j->'$.messages') = 'ARRAY' AND json_array_length(j->'$.messages') > 0, false) AND {_stamp("(j->'$.captured_at')")}
    WHEN 'generic_jsonl' THEN {_one_of("(j->'$.role')", 'user', 'assistant', 'tool', 'system')} AND coalesce(json_type(j->'$.n') = 'UBIGINT', false) AND {_stamp("(j->'$.at')")} ELSE true END"""
JUDGED = f"""q0 AS (SELECT id, source_kind, try(decode(coalesce(payload, ''))) AS t FROM quarantine),
  q1 AS (SELECT *, CASE WHEN source_kind = 'cursor_ide' THEN regexp_replace(t, '(?:\\r\\n|\\n|\\r)$', '') END AS b, CASE WHEN source_kind IS DISTINCT FROM 'cursor_ide' AND {_STRICT.format(t='t')} THEN CAST(t AS JSON) END AS j FROM q0),
  q2 AS (SELECT *, list_transform(regexp_extract(b, '^({_F}),({_F}),({_F}),({_F})$', ['a', 'b', 'c', 'd']) :: VARCHAR[], lambda f: f) AS none_ FROM q1 WHERE false),
  q3 AS (SELECT *, list_transform(range(1, 5), lambda i: CASE i WHEN 1 THEN regexp_extract(b, '^({_F}),({_F}),({_F}),({_F})$', 1) WHEN 2 THEN regexp_extract(b, '^({_F}),({_F}),({_F}),({_F})$', 2) WHEN 3 THEN regexp_extract(b, '^({_F}),({_F}),({_F}),({_F})$', 3) ELSE regexp_extract(b, '^({_F}),({_F}),({_F}),({_F})$', 4) END) AS raw_fields FROM q1),
  q4 AS (SELECT *, list_transform(raw_fields, lambda f: CASE WHEN starts_with(f, '"') THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) AS f FROM q3),
  judged AS (SELECT id, source_kind, t, CASE WHEN t IS NULL THEN 'bad_encoding'
      WHEN source_kind = 'cursor_ide' THEN CASE WHEN NOT regexp_full_match(b, '{_F}(?:(?:,|\\r\\n|\\n|\\r){_F})*') THEN 'broken_quoting' WHEN b = '' OR NOT regexp_full_match(b, '{_F},{_F},{_F},{_F}') THEN 'column_count'
        WHEN NOT (regexp_full_match(f[1], '[0-9]+') AND regexp_full_match(f[2], 'composerData:[^:]+|bubbleId:[^:]+:[^:]+') AND {_STRICT.format(t='f[3]')} AND coalesce(json_type(CASE WHEN json_valid(f[3]) THEN CAST(f[3] AS JSON) END) = 'OBJECT', false)
          AND regexp_full_match(f[4], '{_STAMP}') AND try_strptime(f[4], '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL) THEN 'invalid_value' END
      WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'bad_json' WHEN NOT ({_GOOD}) THEN 'invalid_value' END AS reason FROM q4)"""
JUDGED = "\n".join(line for line in JUDGED.split("\n") if not line.lstrip().startswith("q2 AS"))


def _member(name: str, value: str | None = None) -> str:
    return f"""CASE WHEN {value or name} IS NOT NULL THEN '"{name}":' || to_json({value or name}) END"""


def export_sql(events: str) -> str:
    fields = ", ".join(_member(n) for n in ("event_id", "session_key", "source_kind", "seq", "ts", "actor", "kind", "text", "native_id", "locator"))
    return f"WITH {events} SELECT session_key, seq, '{{' || concat_ws(',', {fields}) || '}}' AS line FROM ev"


def export_sessions_sql(placed: str) -> str:
    cells = ", ".join(_member(n) for n in ("pos", "event_id", "ts", "actor", "kind", "text"))
    head = ", ".join(_member(n) for n in ("session_key", "block", "title", "first_ts", "last_ts"))
    return f"""WITH {placed}, b AS (SELECT session_key, (pos - 1) // 1000 AS block, count(*) AS n_events, string_agg('{{' || concat_ws(',', {cells}) || '}}', ',' ORDER BY pos) AS cells FROM pl GROUP BY ALL)
      SELECT session_key, block, n_events, '{{' || concat_ws(',', {head}, '"events":[' || cells || ']') || '}}' AS line FROM b LEFT JOIN (SELECT session_key, title, first_ts, last_ts FROM sessions) USING (session_key)"""


ORACLES = {
    "parsed_events": f"WITH {PARSED} SELECT {_COLUMNS} FROM parsed",
    "parsed_counts": f"WITH {PARSED} SELECT source_kind, kind, actor, error, count(*) AS n FROM parsed GROUP BY ALL",
    "markdown_sessions": f"WITH {PARSED} SELECT raw_id, session_key, native_id, actor, text FROM parsed WHERE source_kind = 'aider'",
    "p2_found": f"WITH {JUDGED} SELECT DISTINCT id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_loaded": f"WITH {JUDGED} SELECT id, source_kind, t AS record FROM judged WHERE reason IS NULL",
    "p2_reasons": f"WITH {JUDGED} SELECT source_kind, coalesce(reason, 'loads') AS outcome, count(*) AS n FROM judged GROUP BY ALL",
}
