"""DuckDB SQL that reads stamps: format lists and the ICU time zones of DuckDB, unlike the operator."""

from __future__ import annotations

# Hours east of UTC of zone abbreviations.
_HOURS = {"UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "JST": 9, "KST": 9, "AWST": 8, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d %b %Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%b %d, %Y %I:%M:%S %p", "%b %d, %Y %H:%M:%S", "%Y年%m月%d日 %H時%M分%S秒", "%Y%m%d %H%M%S"]
_TIMES = ["%H:%M:%S", "%H:%M", "%I:%M:%S %p", "%I:%M %p"]


def _list(formats: list[str]) -> str:
    return "[" + ", ".join("'" + f + "'" for f in formats) + "]"


def instants(source: str, name: str = "st") -> str:
    """CTEs ending in ``name``: the rows of ``source`` (with stamp and source_kind) and epoch_us, or null."""
    ordered = {o: _list([f"{d} {t}" for d in days for t in _TIMES]) for o, days in {"mdy": ["%m/%d/%y", "%m/%d/%Y"], "dmy": ["%d/%m/%y", "%d/%m/%Y"], "ymd": ["%y/%m/%d"]}.items()}
    abbreviations = " ".join(f"WHEN '{k}' THEN {v * 60}" for k, v in _HOURS.items())
    return rf"""{name}a AS (SELECT s.*, z.tz_name, z.date_order, trim(translate(stamp, '０１２３４５６７８９－／：．，＋　', '0123456789-/:.,+ ')) AS c FROM {source} s LEFT JOIN source_zones z USING (source_kind)),
      {name}b AS (SELECT *, regexp_extract(c, '\[([A-Za-z_/]+)\]$', 1) AS region, regexp_extract(c, ':\d\d(?:[.,]\d+)?\s*([+-]\d\d:?\d\d)$', 1) AS east, regexp_extract(c, ' ([A-Z]{{3,5}})$', 1) AS abbr FROM {name}a),
      {name}c AS (SELECT *, CASE WHEN abbr IN ('AM', 'PM') THEN '' ELSE abbr END AS ab,
          trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(c, '\[[A-Za-z_/]+\]$', ''), east, ''), '(\d)T(\d)', '\1 \2'), 'Z$', ''), ' (UTC|GMT|[A-Z]{{3,5}})$', ''), '(:\d\d),(\d+)$', '\1.\2')) AS b0 FROM {name}b),
      {name}e AS (SELECT *, regexp_replace(regexp_replace(b0, '^(\d{{4}})[/.](\d\d?)[/.](\d\d?) ', '\1-\2-\3 '), '^(\d\d?)[.-](\d\d?)[.-](\d{{2}}|\d{{4}}) ', '\1/\2/\3 ') AS b FROM {name}c),
      {name}f AS (SELECT *, CASE WHEN regexp_matches(b, '^\d\d?/') THEN CASE date_order WHEN 'mdy' THEN try_strptime(b, {ordered['mdy']}) WHEN 'dmy' THEN try_strptime(b, {ordered['dmy']}) ELSE try_strptime(b, {ordered['ymd']}) END
          WHEN regexp_matches(b, '^\d{{8}} \d{{6}}$') OR NOT regexp_matches(b, '^[\d.]+$') THEN try_strptime(b, {_list(_FORMATS)}) END AS wall, CASE WHEN region <> '' THEN region ELSE tz_name END AS zone FROM {name}e),
      {name}g AS (SELECT *, CASE WHEN east = '' AND ab = '' AND NOT regexp_matches(c, 'Z$') AND wall IS NOT NULL THEN epoch_us(timezone(zone, wall)) END AS late FROM {name}f),
      {name} AS (SELECT * EXCLUDE (tz_name, date_order, region, east, abbr, ab, b0, b, wall, zone, late), CASE
          WHEN regexp_matches(c, '^\d{{9,10}}$') THEN CAST(c AS BIGINT) * 1000000 WHEN regexp_matches(c, '^\d{{9,10}}\.\d+$') THEN CAST(round(CAST(c AS DECIMAL(20, 6)) * 1000000) AS BIGINT)
          WHEN regexp_matches(c, '^\d{{12,13}}$') THEN CAST(c AS BIGINT) * 1000 WHEN regexp_matches(c, '^\d{{15,16}}$') THEN CAST(c AS BIGINT) WHEN regexp_matches(c, '^\d{{18,19}}$') THEN CAST(c AS BIGINT) // 1000
          WHEN wall IS NULL THEN NULL
          WHEN east <> '' THEN epoch_us(wall) - (CASE WHEN east[1] = '-' THEN -1 ELSE 1 END) * (CAST(east[2:3] AS BIGINT) * 60 + CAST(right(east, 2) AS BIGINT)) * 60000000
          WHEN regexp_matches(c, 'Z$') THEN epoch_us(wall)
          WHEN ab <> '' THEN epoch_us(wall) - CAST(CASE ab {abbreviations} END AS BIGINT) * 60000000
          -- A wall time that occurs twice is the earlier instant.
          WHEN timezone(zone, make_timestamptz(late - 3600000000)) = wall THEN late - 3600000000 ELSE late END AS epoch_us FROM {name}g)"""


def iso(epoch_us: str) -> str:
    return f"strftime(make_timestamp({epoch_us}), '%Y-%m-%dT%H:%M:%S.%fZ')"


STAMPS = """rows_ AS (SELECT 'chat_events' AS tbl, event_id AS row_key, 'ts' AS col_name, source_kind, ts AS stamp FROM chat_events
      UNION ALL SELECT 'sessions', session_key, 'first_ts', source_kind, first_ts FROM sessions UNION ALL SELECT 'sessions', session_key, 'last_ts', source_kind, last_ts FROM sessions)"""

ORACLES = {
    "p4_found": f"WITH {STAMPS}, {instants('rows_')} SELECT DISTINCT tbl, row_key, col_name, epoch_us FROM st WHERE epoch_us IS NOT NULL AND NOT regexp_full_match(stamp, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ')",
    "p4_normalised": f"""WITH {STAMPS}, {instants('rows_')} SELECT tbl, row_key, col_name, stamp, {iso('epoch_us')} AS utc, CASE WHEN stamp IS NULL OR trim(stamp) = '' THEN 'missing'
      WHEN epoch_us IS NULL THEN 'none' WHEN regexp_full_match(stamp, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ') THEN 'canonical' ELSE 'rewritten' END AS form FROM st""",
    "p4_forms": f"""WITH {STAMPS}, {instants('rows_')}, f AS (SELECT *, CASE WHEN stamp IS NULL OR trim(stamp) = '' THEN 'missing'
      WHEN epoch_us IS NULL THEN 'none' WHEN regexp_full_match(stamp, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ') THEN 'canonical' ELSE 'rewritten' END AS form FROM st) SELECT source_kind, col_name, form, count(*) AS n FROM f GROUP BY ALL""",
}
