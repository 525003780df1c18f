"""DuckDB SQL of the log queries, written against the tables and not against our own plans."""

from __future__ import annotations

from talkloom.functions import text as T
from talkloom.operators import salience
from talkloom.plans import source_sql, stamp_sql
from talkloom.plans.log_queries import CUTOFF, INDEXED, PHRASE, PROJECT, QUERY

_WS = r"[\s\x{0b}\x{85}\p{Z}]"
_INK = r"[^\s\x{0b}\x{85}\p{Z}]"
_LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_q(f'^{_WS}+|{_WS}+$')}, '', 'g')"


def _clean(c: str) -> str:
    ansi = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
    reminder = rf"(?s)<system-reminder>.*?</system-reminder>{_WS}*"
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, {_q(ansi)}, '', 'g'), {_q(reminder)}, '', 'g'), {_q('(?m)^[^' + chr(92) + 'n]*' + chr(92) + 'r')}, '', 'g'), {_q(chr(92) + 'n{3,}')}, chr(10)||chr(10), 'g')"


def _cut(c: str, n: int, marker: str = T.TRUNCATED) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {max(0, n - len(marker))}) || {_q(marker)} ELSE {c} END"


def _tokens(c: str) -> str:
    return (
        f"list_concat(list_transform(regexp_extract_all({c}, '[A-Za-z0-9_]+'), lambda w: lower(w)), "
        f"flatten(list_transform(regexp_extract_all({c}, {_q(_CJK)}), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"
    )


EV = """ev AS (
  SELECT event_id, session_key, source_kind, seq, ts, lower(trim(actor, ' ')) AS actor, kind, text, hints, native_id, locator, raw_id, ingested_at, json_extract_string(hints, '$.file_path') AS file_path
  FROM chat_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at NULLS FIRST, session_key NULLS FIRST, source_kind NULLS FIRST, seq NULLS FIRST, ts NULLS FIRST) = 1)"""
DATED = EV + ", evs AS (SELECT *, ts AS stamp FROM ev), " + stamp_sql.instants("evs", "dt")
SESSIONS = "ses AS (SELECT *, last_ts AS stamp FROM sessions), " + stamp_sql.instants("ses", "sd")
_CUT = f"epoch_us(TIMESTAMPTZ '{CUTOFF}')"
PL = EV + """, pl AS (
  SELECT ev.*, row_number() OVER w AS pos, count(*) OVER (PARTITION BY session_key) AS session_size FROM ev
  WINDOW w AS (PARTITION BY session_key ORDER BY coalesce(seq, -4611686018427387904), coalesce(ts, ''), event_id))"""
DD = PL + f""", keyed AS (SELECT pl.*, {_strip('text')} AS body FROM pl),
  dd AS (SELECT keyed.*, first_value(event_id) OVER f AS first_id, coalesce(length(body) >= {salience.DEDUP_CHARS} AND row_number() OVER f > 1, false) AS deduped FROM keyed
  WINDOW f AS (PARTITION BY session_key, body ORDER BY pos))"""
MD = f"""mg AS (SELECT CAST(doc_id AS VARCHAR) AS event_id, title AS file_path, text, {_strip('text')} AS body, doc_id AS pos FROM documents),
  md AS (SELECT mg.*, first_value(event_id) OVER f AS first_id, coalesce(length(body) >= {salience.DEDUP_CHARS} AND row_number() OVER f > 1, false) AS deduped FROM mg WINDOW f AS (PARTITION BY body ORDER BY pos))"""
DOCS = EV + f""", att AS (
  SELECT event_id, string_agg('[添付 ' || substr(sha256, 1, 12) || ']' || chr(10) || substr(text, 1, 4000), chr(10) ORDER BY sha256) AS x
  FROM blob_refs JOIN blob_texts USING (sha256) WHERE length(text) > 0 GROUP BY event_id),
  docs AS (SELECT ev.*, concat_ws(chr(10), {_clean('ev.text')}, att.x) AS doc FROM ev LEFT JOIN att USING (event_id))"""
TH = DD + f""", th0 AS (SELECT dd.*, {_clean('text')} AS clean FROM dd WHERE actor IN ('user', 'assistant') AND NOT deduped),
  th AS (SELECT * FROM th0 WHERE regexp_matches(clean, {_q(_INK)}))"""


def _bm25(terms: list[str]) -> str:
    """CTE ``hits`` with the score of documents that hold every term (terms cannot overlap themselves)."""
    f = [f"(length(lower(doc)) - length(replace(lower(doc), {_q(t.lower())}, ''))) // {len(t)} AS f{i}" for i, t in enumerate(terms)]
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END)"
    score = " ".join(f"- {idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avglen))" for i in range(len(terms)))
    return DOCS + f""", fr AS (SELECT docs.*, {', '.join(f)}, greatest(0, length(doc) - 2) AS len FROM docs),
      st AS (SELECT count(*) AS n, avg(len) AS avglen, {stats} FROM fr),
      hits AS (SELECT fr.*, 0.0 {score} AS score FROM fr, st WHERE {' AND '.join(f'f{i} > 0' for i in range(len(terms)))})"""


def _snip(c: str, term: str) -> str:
    return f"substr({c}, greatest(1, instr({c}, {_q(term)}) - 40), 120)"


def _hits(pattern: str, cap: int) -> str:
    lines = f"list_transform(regexp_split_to_array(clean, {_q(_LINE_END)}), lambda s: {_strip('s')})"
    return f"list_transform(list_filter({lines}, lambda s: regexp_matches(s, {_q(pattern)}))[1:{salience.LINES_PER_EVENT}], lambda s: {_cut('s', cap)})"


def _salience() -> str:
    parts = [
        f"SELECT session_key, '{cat}' AS category, unnest(h) AS text, event_id, pos, generate_subscripts(h, 1) AS line_no FROM (SELECT session_key, event_id, pos, {_hits(p, 240)} AS h FROM cl)"
        for cat, p in salience.RULES.items()
    ]
    return f"""WITH {DD}, cl AS (SELECT session_key, event_id, pos, {_clean('text')} AS clean FROM dd WHERE NOT deduped), al AS ({' UNION ALL '.join(parts)})
      SELECT session_key, category, text, event_id FROM al QUALIFY row_number() OVER (PARTITION BY session_key, category, text ORDER BY pos, line_no) = 1"""


def _errors() -> str:
    fix = f"coalesce(actor = 'assistant' AND regexp_matches(clean, {_q(salience.FIX)}), false)"
    return f"""WITH {DD}, cl AS (SELECT session_key, event_id, pos, actor, {_clean('text')} AS clean FROM dd WHERE NOT deduped),
      e0 AS (SELECT session_key, event_id, pos, CAST({fix} AS INT) AS is_fix, {_hits(salience.ERROR, 200)} AS errors FROM cl),
      e1 AS (SELECT *, coalesce(sum(is_fix) OVER (PARTITION BY session_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM e0),
      er AS (SELECT session_key, turn, pos, event_id AS error_id, unnest(errors) AS error, generate_subscripts(errors, 1) AS line_no FROM e1),
      fx AS (SELECT session_key, turn, event_id AS fix_id FROM e1 WHERE is_fix = 1),
      rk AS (SELECT er.*, fix_id, row_number() OVER (PARTITION BY er.session_key, er.turn ORDER BY pos DESC, line_no DESC) AS r FROM er LEFT JOIN fx USING (session_key, turn))
      SELECT session_key, error_id, error, fix_id, fix_id IS NOT NULL AS solved FROM rk WHERE r <= CASE WHEN fix_id IS NULL THEN 3 ELSE 2 END"""


def _tfidf(tail: str) -> str:
    return f"""WITH {TH}, tk AS (SELECT session_key, event_id, unnest({_tokens('clean')}) AS token FROM th),
      ct AS (SELECT session_key, event_id, token, count(*) AS c FROM tk GROUP BY ALL), ln_ AS (SELECT session_key, event_id, sum(c) AS len FROM ct GROUP BY ALL),
      qt AS (SELECT token, count(*) AS c FROM (SELECT unnest({_tokens(_q(QUERY))}) AS token) GROUP BY token), ql AS (SELECT sum(c) AS len FROM qt),
      dn AS (SELECT session_key, count(*) + 1 AS n FROM th GROUP BY ALL),
      df AS (SELECT session_key, ct.token, count(*) + max(CASE WHEN qt.token IS NULL THEN 0 ELSE 1 END) AS df FROM ct LEFT JOIN qt ON qt.token = ct.token GROUP BY session_key, ct.token),
      rw AS (SELECT session_key, event_id, token, c / len * ln(1 + n / df.df) AS w FROM ct JOIN ln_ USING (session_key, event_id) JOIN df USING (session_key, token) JOIN dn USING (session_key)),
      w AS (SELECT session_key, event_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY session_key, event_id)) AS w FROM rw),
      q0 AS (SELECT session_key, qt.token, qt.c / ql.len * ln(1 + n / coalesce(df.df, 1)) AS q FROM dn CROSS JOIN qt CROSS JOIN ql LEFT JOIN df USING (session_key, token)),
      q AS (SELECT session_key, token, q / sqrt(sum(q * q) OVER (PARTITION BY session_key)) AS q FROM q0),
      cs AS (SELECT session_key, event_id, sum(w * q) AS cosine FROM w JOIN q USING (session_key, token) GROUP BY ALL) {tail}"""


def _redact(c: str) -> str:
    for label, pattern in T.REDACTIONS:
        if label == "url-credential":
            mask = r"\1:[REDACTED:url-credential]@"
        elif label == "assignment":
            mask = r"\1[REDACTED:assignment]"
        else:
            mask = f"[REDACTED:{label}]"
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(mask)}, 'g')"
    return c


def _redact_counts() -> str:
    """Matches of each pattern in turn, on the text that the patterns before have masked."""
    inner = f"SELECT {_q('')} AS l0, text AS t0 FROM ev WHERE text IS NOT NULL"
    for k, (label, pattern) in enumerate(T.REDACTIONS):
        mask = {"url-credential": r"\1:[REDACTED:url-credential]@", "assignment": r"\1[REDACTED:assignment]"}.get(label, f"[REDACTED:{label}]")
        kept = ", ".join(f"n{i}" for i in range(k))
        inner = f"SELECT {kept + ', ' if kept else ''}len(regexp_extract_all(t{k}, {_q(pattern)})) AS n{k}, regexp_replace(t{k}, {_q(pattern)}, {_q(mask)}, 'g') AS t{k + 1} FROM ({inner})"
    rows = " UNION ALL ".join(f"SELECT {_q(label)} AS label, CAST(sum(n{k}) AS BIGINT) AS n FROM r" for k, (label, _) in enumerate(T.REDACTIONS))
    return f"WITH {EV}, r AS ({inner}) SELECT * FROM ({rows}) WHERE n > 0"


def _rules() -> str:
    """Decisions, constraints and fixes of all sessions merged by stamp text, the first of equal ones, twenty of a section."""
    merged = f"""{EV}, pl AS (SELECT ev.* REPLACE ('all' AS session_key), row_number() OVER (ORDER BY coalesce(ts, ''), coalesce(seq, 0), event_id) AS pos FROM ev),
      keyed AS (SELECT pl.*, {_strip('text')} AS body FROM pl),
      dd AS (SELECT keyed.*, coalesce(length(body) >= {salience.DEDUP_CHARS} AND row_number() OVER (PARTITION BY body ORDER BY pos) > 1, false) AS deduped FROM keyed),
      cl AS (SELECT event_id, pos, actor, {_clean('text')} AS clean FROM dd WHERE NOT deduped)"""
    lines = " UNION ALL ".join(f"SELECT '{cat}' AS section, unnest(h) AS text, event_id, pos, generate_subscripts(h, 1) - 1 AS line_no FROM (SELECT event_id, pos, {_hits(salience.RULES[cat], 240)} AS h FROM cl)" for cat in ("decision", "constraint"))
    fix = f"coalesce(actor = 'assistant' AND regexp_matches(clean, {_q(salience.FIX)}), false)"
    fix_line = f"list_filter(list_transform(regexp_split_to_array(clean, {_q(_LINE_END)}), lambda s: {_strip('s')}), lambda s: regexp_matches(s, {_q(salience.FIX)}))[1]"
    blank = lambda c: f"trim(regexp_replace({c}, {_q(_WS + '+')}, ' ', 'g'), ' ')"
    return f"""WITH {merged}, al AS ({lines}), lf AS (SELECT section, text, event_id, pos, line_no, {blank('text')} AS norm FROM al QUALIFY row_number() OVER (PARTITION BY section, text ORDER BY pos, line_no) = 1),
      e0 AS (SELECT event_id, pos, CAST({fix} AS INT) AS is_fix, CASE WHEN {fix} THEN {_cut(fix_line, 200)} END AS fix, {_hits(salience.ERROR, 200)} AS errors FROM cl),
      e1 AS (SELECT *, coalesce(sum(is_fix) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM e0),
      er AS (SELECT turn, pos, event_id, unnest(errors) AS error, generate_subscripts(errors, 1) - 1 AS line_no FROM e1),
      fx AS (SELECT turn, fix FROM e1 WHERE is_fix = 1),
      rk AS (SELECT er.*, fix, row_number() OVER (PARTITION BY turn ORDER BY pos DESC, line_no DESC) AS r FROM er JOIN fx USING (turn)),
      ef AS (SELECT 'error_fix' AS section, 'ERR: ' || error || chr(10) || ' → FIX: ' || coalesce(fix, '') AS text, event_id, pos, line_no, 'fix::' || {blank("coalesce(fix, '')")} AS norm FROM rk WHERE r <= 2),
      ev_ AS (SELECT *, CASE section WHEN 'decision' THEN 1 WHEN 'constraint' THEN 2 ELSE 3 END AS place FROM (SELECT * FROM lf UNION ALL SELECT * FROM ef) WHERE norm <> ''),
      f1 AS (SELECT * FROM ev_ QUALIFY row_number() OVER (PARTITION BY norm ORDER BY place, pos, line_no, text) = 1)
      SELECT section, row_number() OVER (PARTITION BY section ORDER BY pos, line_no, text) AS rank, text, event_id FROM f1 QUALIFY rank <= 20"""


def _mirror() -> str:
    clean = _redact(_clean("text"))
    slug = lambda c: f"regexp_replace(regexp_replace({c}, {_q('[^A-Za-z0-9_' + chr(92) + 'p{L}' + chr(92) + 'p{N}-]+')}, '-', 'g'), '^-+|-+$', '', 'g')"
    key = "list_last(string_split(session_key, ':'))"
    return f"""WITH {PL}, b AS (SELECT session_key, pos, actor, kind, ts, event_id, {clean} AS clean FROM pl), k AS (SELECT * FROM b WHERE regexp_matches(clean, {_q(_INK)})),
      n0 AS (SELECT session_key, title, first_ts, substr({slug(f"CASE WHEN coalesce(title, '') = '' THEN {key} ELSE title END")}, 1, 60) AS g FROM sessions),
      n AS (SELECT session_key, coalesce(substr(first_ts, 1, 10), 'undated') || '-' || regexp_replace(CASE WHEN g = '' THEN {key} ELSE g END, '-+$', '') || '-' || substr(sha256(session_key), 1, 8) || '.md' AS name,
          '# ' || coalesce(title, session_key) || chr(10) AS head FROM n0),
      l AS (SELECT session_key, pos AS line_no, '## ' || coalesce(actor, 'None') || CASE WHEN kind = 'message' THEN '' ELSE ' (' || kind || ')' END || ' — ' || coalesce(ts, '-') || ' ⟨e:' || substr(event_id, 1, 8) || '⟩' || chr(10) || chr(10) || clean || chr(10) AS line FROM k
        UNION ALL SELECT session_key, 0, head FROM n WHERE session_key IN (SELECT session_key FROM k))
      SELECT session_key, name, line_no, line FROM l JOIN n USING (session_key)"""


def _media(path: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({path}), {_q(by_name)}) THEN {_q(label)}" for label, _, by_name in T.MEDIA_KINDS if by_name)
    return f"CASE {cases} ELSE {_q(T.OTHER_MEDIA)} END"


def _size(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL OR {c} = 0 THEN '?B' WHEN {c} < 1024 THEN printf('%.0f', CAST({c} AS DOUBLE)) || 'B' WHEN {c} < 1048576 THEN printf('%.1f', {c} / 1024.0) || 'KB'
      WHEN {c} < 1073741824 THEN printf('%.1f', {c} / 1048576.0) || 'MB' ELSE printf('%.1f', {c} / 1073741824.0) || 'GB' END"""


def _html(c: str) -> str:
    for tag in ("script", "style"):
        c = f"regexp_replace({c}, {_q(rf'(?is)<{tag}' + chr(92) + rf'b.*?</{tag}' + chr(92) + 's*>')}, ' ', 'g')"
    c = f"regexp_replace({c}, {_q('(?s)<[^>]+>')}, ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, {_q(entity)}, {_q(char)})"
    c = f"regexp_replace({c}, {_q('[ ' + chr(92) + 't' + chr(92) + 'x{a0}]+')}, ' ', 'g')"
    return f"regexp_replace({c}, {_q(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n+')}, chr(10), 'g')"


_USER = f"actor = 'user' AND regexp_matches(coalesce({_clean('text')}, ''), {_q(_INK)})"
_TITLE_LINE = f"regexp_split_to_array({_strip(_clean('text'))}, {_q(_LINE_END)})[1]"
_NAME = r"^\[tool_use (\w+)\]"

ORACLES: dict[str, str] = {
    "ces_events": f"WITH {EV} SELECT event_id, session_key, source_kind, seq, ts, actor, kind, text, file_path, raw_id FROM ev",
    "event_ids": f"""WITH {EV}, fp AS (SELECT *, sha256('text' || coalesce(text, '')) AS fingerprint FROM ev)
      SELECT event_id, fingerprint, substr(sha256(concat_ws('|', source_kind, session_key, coalesce(native_id, locator), kind, fingerprint)), 1, 32) AS content_id FROM fp""",
    "stats_overview": """SELECT 'events' AS metric, count(DISTINCT event_id) AS value FROM chat_events UNION ALL SELECT 'sessions', count(*) FROM sessions
      UNION ALL SELECT 'raw_records', count(*) FROM raw_records UNION ALL SELECT 'raw_bytes', CAST(coalesce(sum(octet_length(payload)), 0) AS BIGINT) FROM raw_records
      UNION ALL SELECT 'blob_texts', count(*) FILTER (WHERE chars > 0) FROM blob_texts UNION ALL SELECT 'quarantine', count(*) FROM quarantine""",
    "stats_per_source": f"WITH {DATED} SELECT source_kind, count(*) AS n, {stamp_sql.iso('min(epoch_us)')} AS oldest FROM dt GROUP BY source_kind",
    "session_rollup": f"""WITH {DATED}, t AS (SELECT session_key, {_cut('line', 60)} AS title FROM (SELECT session_key, {_TITLE_LINE} AS line, ingested_at, event_id FROM ev WHERE {_USER})
        QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY ingested_at NULLS FIRST, event_id) = 1),
      g AS (SELECT session_key, min(source_kind) AS source_kind, count(*) AS n_events, {stamp_sql.iso('min(epoch_us)')} AS first_ts, {stamp_sql.iso('max(epoch_us)')} AS last_ts FROM dt GROUP BY session_key)
      SELECT g.*, t.title FROM g LEFT JOIN t USING (session_key)""",
    "list_sessions": f"WITH {SESSIONS} SELECT session_key, {stamp_sql.iso('epoch_us')} AS last_at, n_events, title FROM sd WHERE lower(source_kind) LIKE '%c%' ORDER BY epoch_us DESC NULLS LAST, session_key LIMIT 30",
    "latest_sessions": f"WITH {SESSIONS} SELECT source_kind, session_key, {stamp_sql.iso('epoch_us')} AS last_at FROM sd WHERE epoch_us IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_kind ORDER BY epoch_us DESC, session_key DESC) = 1",
    "session_tail": f"WITH {PL} SELECT session_key, event_id, pos FROM pl WHERE pos > session_size - 5",
    "since_ts": f"WITH {EV} SELECT session_key, event_id, ts FROM ev WHERE ts > '{CUTOFF}'",
    "since_event": f"WITH {PL}, s AS (SELECT session_key, min(pos) AS p FROM pl WHERE starts_with(event_id, 'a') GROUP BY session_key) SELECT session_key, event_id, pos FROM pl JOIN s USING (session_key) WHERE pos > p",
    "context_around": f"""WITH {PL}, h AS (SELECT session_key, event_id AS hit_id, pos AS hp FROM pl WHERE contains(text, 'KeyError'))
      SELECT hit_id, event_id, pos - hp AS off FROM pl JOIN h USING (session_key) WHERE pos BETWEEN hp - 2 AND hp + 4""",
    "text_metrics": f"""WITH {EV} SELECT event_id, length({_clean('text')}) AS clean_chars,
      coalesce(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + len(regexp_extract_all(text, {_q(r'[^A-Za-z0-9_' + _WS[1:])})), 0) AS tokens,
      CASE WHEN text IS NULL THEN 0 ELSE len({_tokens('text')}) END AS n_terms, CASE WHEN text IS NOT NULL THEN sha256(array_to_string({_tokens('text')}, ' ')) END AS terms_sha, {_cut('text', 40)} AS head FROM ev""",
    "media_kinds": f"WITH {EV} SELECT event_id, {_media('coalesce(file_path, locator)')} AS media, {_size('(octet_length(encode(text)) * 37)')} AS size FROM ev",
    "search_phrase": f"WITH {_bm25([PHRASE.split()[0], PHRASE.split()[1]])} SELECT event_id, session_key, round(score, 6) AS score FROM hits",
    "search_and_short": f"WITH {_bm25(['retries'])} SELECT event_id, round(score, 6) AS score FROM hits WHERE contains(doc, '12')",
    "search_source": f"WITH {_bm25(['quarantine', 'laptop'])} SELECT event_id, round(score, 6) AS score, {_snip('doc', 'quarantine')} AS snippet FROM hits WHERE lower(source_kind) LIKE '%claude%'",
    "search_fallback": f"WITH {EV} SELECT event_id, ts, {_snip('text', 'Q')} AS snippet FROM ev WHERE contains(lower(text), 'q') AND contains(lower(text), 'x')",
    "trigram_postings": f"""WITH {DOCS}, g AS (SELECT event_id, unnest(list_transform(range(1, length(lower(doc)) - 1), lambda i: substr(lower(doc), i, 3))) AS gram FROM docs WHERE length(doc) >= 3)
      SELECT gram, count(DISTINCT event_id) AS n_events, count(*) AS n_total FROM g GROUP BY gram""",
    "exact_dedup": f"WITH {MD} SELECT event_id, first_id FROM md WHERE deduped",
    "version_pairs": f"""WITH {MD}, v AS (SELECT file_path, event_id, text, row_number() OVER f AS version, lead(event_id) OVER f AS next_id FROM md
        WHERE file_path IS NOT NULL AND NOT deduped WINDOW f AS (PARTITION BY file_path ORDER BY pos))
      SELECT file_path, version, event_id, next_id, length(text) >= {salience.FOLD_CHARS} AS folded FROM v WHERE next_id IS NOT NULL""",
    "salience_lines": _salience(),
    "error_fixes": _errors(),
    "artifacts": f"""WITH {DD}, a AS (SELECT session_key, event_id, pos, regexp_extract(text, {_q(_NAME)}, 1) AS name, regexp_extract(text, {_q('(?s)^' + chr(92) + '[tool_use ' + chr(92) + 'w+' + chr(92) + ']' + chr(92) + 's*(' + chr(92) + '{.*)')}, 1) AS body FROM dd WHERE kind = 'tool_use' AND NOT deduped),
      p AS (SELECT session_key, event_id, pos, coalesce(json_extract_string(body, '$.file_path'), json_extract_string(body, '$.path')) AS path FROM a WHERE name IN ({', '.join(_q(w) for w in salience.WRITERS)}) AND json_valid(body))
      SELECT session_key, path, event_id FROM p WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_key, path ORDER BY pos DESC) = 1""",
    "tfidf": _tfidf("SELECT session_key, event_id, count(*) AS n_tokens, round(max(w), 6) AS top_w, round(sum(w), 5) AS sum_w FROM w GROUP BY ALL"),
    "cosine_query": _tfidf("SELECT session_key, event_id, round(cosine, 6) AS cosine FROM cs"),
    "base_score": _tfidf("""SELECT session_key, event_id, i, round(0.55 * i / n + 0.45 * coalesce(cosine, 0), 6) AS base
      FROM (SELECT session_key, event_id, row_number() OVER (PARTITION BY session_key ORDER BY pos) AS i, count(*) OVER (PARTITION BY session_key) AS n FROM th) LEFT JOIN cs USING (session_key, event_id)"""),
    "recall_sessions": f"""WITH {_bm25([PHRASE.split()[0], PHRASE.split()[1]])}, b AS (SELECT session_key, event_id, score FROM hits QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY score, ts DESC NULLS LAST, event_id) = 1)
      SELECT b.session_key, event_id, round(score, 6) AS score, s.title, s.last_ts FROM b LEFT JOIN sessions s USING (session_key)""",
    "evidence": """WITH p AS (SELECT event_id, sha256, text, CASE WHEN instr(text, 'index') > 0 THEN instr(text, 'index') ELSE instr(text, 'TODO') END AS p FROM blob_refs JOIN blob_texts USING (sha256)),
      r AS (SELECT *, greatest(1, p - 100) AS s, least(length(text), p + 179) AS e FROM p WHERE p > 0)
      SELECT event_id, sha256, CASE WHEN s > 1 THEN '…' ELSE '' END || replace(substr(text, s, e - s + 1), chr(10), ' ') || CASE WHEN e < length(text) THEN '…' ELSE '' END AS excerpt FROM r""",
    "html_text": f"SELECT doc_id, {_html('text')} AS text FROM documents",
    "prune_report": f"""WITH {DATED}, qs AS (SELECT *, ts AS stamp FROM quarantine), {stamp_sql.instants('qs', 'qd')} SELECT 'events' AS tbl, count(*) AS n_deleted FROM dt WHERE epoch_us < {_CUT}
      UNION ALL SELECT 'raw_records', count(*) FROM raw_records WHERE epoch_us(ingested_at) < {_CUT} AND id NOT IN (SELECT raw_id FROM dt WHERE raw_id IS NOT NULL AND (epoch_us IS NULL OR epoch_us >= {_CUT}))
      UNION ALL SELECT 'quarantine', count(*) FROM qd WHERE epoch_us < {_CUT}""",
    "prune_survivors": f"WITH {DATED} SELECT session_key, count(*) AS n_events, {stamp_sql.iso('min(epoch_us)')} AS first_ts, {stamp_sql.iso('max(epoch_us)')} AS last_ts FROM dt WHERE epoch_us IS NULL OR epoch_us >= {_CUT} GROUP BY session_key",
    "orphan_blobs": "SELECT sha256, chars FROM blob_texts t WHERE NOT EXISTS (SELECT 1 FROM blob_refs r WHERE r.sha256 = t.sha256)",
    "blob_candidates": "SELECT DISTINCT sha256 FROM blob_refs r WHERE NOT EXISTS (SELECT 1 FROM blob_texts t WHERE t.sha256 = r.sha256 AND t.chars > 0 AND length(t.text) > 0)",
    "raw_of_sessions": f"""WITH {EV} SELECT id, source_kind, locator FROM raw_records WHERE id IN (SELECT raw_id FROM ev WHERE session_key IN (SELECT session_key FROM ev GROUP BY session_key HAVING count(*) >= 20))""",
    "tool_pairs": f"""WITH {PL} SELECT r.session_key, r.event_id, c.event_id AS call_id, regexp_extract(c.text, {_q(_NAME)}, 1) AS tool_name
      FROM (SELECT * FROM pl WHERE kind = 'tool_result') r ASOF JOIN (SELECT * FROM pl WHERE kind = 'tool_use') c ON r.session_key = c.session_key AND r.pos > c.pos""",
    "search_top": f"""WITH {_bm25([PHRASE.split()[0], PHRASE.split()[1]])} SELECT event_id, session_key, ts, actor, {_snip('doc', PHRASE.split()[0])} AS snippet, round(score, 6) AS score FROM hits
      ORDER BY hits.score, event_id LIMIT 10""",
    "search_indexed": f"WITH {DOCS} SELECT event_id, session_key FROM docs WHERE contains(lower(doc), '{INDEXED}')",
    "slim_events": f"WITH {EV}, c AS (SELECT *, coalesce({_clean('text')}, '') AS x FROM ev) SELECT event_id, ts, actor, kind, {_cut('x', 1500)} AS text FROM c",
    "sessions_compact": f"""WITH {PL}, l AS (SELECT *, coalesce({_clean('text')}, '') AS x FROM pl WHERE pos > session_size - 200), m AS (SELECT * REPLACE ({_cut('x', 1500)} AS x) FROM l),
      z AS (SELECT session_key, session_size, pos, length('{{' || concat_ws(',', {', '.join(source_sql._member(n, v) for n, v in (('event_id', 'event_id'), ('ts', 'ts'), ('actor', 'actor'), ('kind', 'kind'), ('text', 'x')))}) || '}}') AS n FROM m),
      w AS (SELECT *, 1 + sum(n + 1) OVER (PARTITION BY session_key ORDER BY pos DESC) <= 60000 AS fits FROM z)
      SELECT session_key, any_value(session_size) AS total, count(*) FILTER (WHERE fits) AS returned, count(*) FILTER (WHERE NOT fits) > 0 AS truncated FROM w GROUP BY session_key""",
    "recent_events": f"""WITH {DATED} SELECT event_id, {stamp_sql.iso('epoch_us')} AS at, seq FROM dt WHERE epoch_us IS NULL OR epoch_us >= {_CUT} - CAST(14 * 86400 AS BIGINT) * 1000000
      ORDER BY epoch_us NULLS FIRST, seq NULLS FIRST, event_id LIMIT 5000""",
    "project_sessions": f"""WITH {EV}, f AS (SELECT session_key, locator FROM ev QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY coalesce(seq, -4611686018427387904), coalesce(ts, ''), event_id) = 1)
      SELECT session_key FROM f WHERE contains(locator, '{PROJECT}') UNION SELECT session_key FROM sessions WHERE contains(concat_ws(' ', session_key, title), '{PROJECT}')""",
    "id_prefix": f"WITH {EV} SELECT event_id, session_key FROM ev WHERE event_id LIKE 'a1%'",
    "blob_lookup": "SELECT event_id, sha256, extractor, chars FROM blob_refs LEFT JOIN blob_texts USING (sha256)",
    "savings": f"""WITH {DD}, d AS (SELECT count(*) AS n, coalesce(sum(length(text)), 0) AS c, coalesce(sum(coalesce(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + len(regexp_extract_all(text, {_q(r'[^A-Za-z0-9_' + _WS[1:])})), 0)), 0) AS t FROM dd WHERE deduped)
      SELECT 'dedup_texts' AS metric, CAST(n AS BIGINT) AS value FROM d UNION ALL SELECT 'dedup_chars', CAST(c AS BIGINT) FROM d UNION ALL SELECT 'dedup_tokens', CAST(t AS BIGINT) FROM d""",
    "latest_tail": f"""WITH {PL}, {SESSIONS}, k AS (SELECT session_key FROM sd WHERE epoch_us IS NOT NULL ORDER BY epoch_us DESC, session_key LIMIT 1)
      SELECT session_key, event_id, pos FROM pl WHERE pos > session_size - 5 AND session_key IN (SELECT session_key FROM k)""",
    "export_events": source_sql.export_sql(EV),
    "export_sessions": source_sql.export_sessions_sql(PL),
    "parsed_ids": f"""WITH {source_sql.PARSED}, p AS (SELECT *, sha256('text' || coalesce(text, '')) AS fp FROM parsed WHERE error IS NULL AND source_kind <> 'chatgpt_web')
      SELECT raw_id, native_id, kind, session_key, source_kind, locator, text, fp AS fingerprint, substr(sha256(concat_ws('|', source_kind, session_key, coalesce(native_id, locator), kind, fp)), 1, 32) AS event_id FROM p""",
    "quarantine_list": "SELECT id, ts, source_kind, locator, error, octet_length(payload) AS payload_bytes FROM quarantine WHERE lower(source_kind) LIKE '%c%' ORDER BY id DESC LIMIT 20",
    "quarantine_unique": "SELECT locator, error, min(id) AS id FROM quarantine GROUP BY locator, error",
    "raw_unique": "SELECT locator, sha256, id FROM raw_records QUALIFY row_number() OVER (PARTITION BY locator, sha256 ORDER BY ingested_at NULLS FIRST, id) = 1",
    "key_prefixes": f"WITH {EV} SELECT split_part(session_key, ':', 1) AS prefix, count(*) AS n FROM ev GROUP BY prefix ORDER BY n DESC, prefix LIMIT 8",
    "redacted": f"WITH {EV} SELECT event_id, {_redact('text')} AS text FROM ev",
    "redact_counts": _redact_counts(),
    "mirror_docs": _mirror(),
    "rules": _rules(),
    "tumbling_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL",
}
