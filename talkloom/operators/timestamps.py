"""Problem 4: mixed timestamp spellings and zones to one UTC instant.

Method: every spelling is one branch of a single regular expression with named groups. One
``regexp_replace`` turns a stamp into its components (groups that did not take part are empty),
calendar ranges are validated, and the instant is assembled by integer day arithmetic. All of it
is native column code; no Python worker is started.

Results for special input: null, blank, senseless and impossible stamps give a null instant; an
empty table gives an empty table; extra columns pass through, and the added column names are
parameters; a stamp without zone whose source kind has no usable zone gives null.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"

# Hours east of UTC of the zone abbreviations that stamps carry.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3,
    "MSK": 3, "JST": 9, "KST": 9, "AWST": 8, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

# Full-width digits and punctuation become ASCII before matching.
_WIDE = "０１２３４５６７８９－／：．，＋　ＴｚＺ"
_NARROW = "0123456789-/:.,+ TzZ"

_DATES = "|".join(
    [
        r"(?<ya>\d{4})(?<sep>[-/.])(?<oa>\d{1,2})\k<sep>(?<da>\d{1,2})",
        r"(?<yb>\d{4})年\s?(?<ob>\d{1,2})月\s?(?<db>\d{1,2})日",
        r"(?<n1>\d{1,2})[/.-](?<n2>\d{1,2})[/.-](?<n3>\d{4}|\d{2})",
        r"(?:[A-Za-z]{3,9},?\s+)?(?<dc>\d{1,2})[ -](?<oc>[A-Za-z]{3,9})\.?,?[ -](?<yc>\d{4})",
        r"(?:[A-Za-z]{3,9},?\s+)?(?<od>[A-Za-z]{3,9})\.?\s+(?<dd>\d{1,2})(?:st|nd|rd|th)?,?\s+(?<yd>\d{4})",
    ]
)
_ZONE = r"(?<z>[A-Z]{1,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|z)?(?:\[(?<r>[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
_CLOCK = (
    r"(?:(?:[Tt]|,?\s*|\s+at\s+)(?:(?<h>\d{1,2}):(?<i>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?"
    r"|(?<hj>\d{1,2})時(?:(?<ij>\d{1,2})分(?:(?<sj>\d{1,2})秒)?)?)"
    r"\s*(?<p>[AaPp]\.?[Mm]\.?)?\s*" + _ZONE + r")?"
)
_COMPACT = (
    r"(?<ye>\d{4})(?<oe>\d{2})(?<de>\d{2})(?:[T ]?(?<he>\d{2})(?<ie>\d{2})(?:(?<se>\d{2})(?:[.,](?<fe>\d{1,9}))?)?"
    r"\s?(?<ze>Z|[+-]\d{2}:?\d{2})?)?"
)
_ASCTIME = r"[A-Z][a-z]{2}\s+(?<og>[A-Z][a-z]{2})\s+(?<dg>\d{1,2})\s+(?<hg>\d{2}):(?<ig>\d{2}):(?<sg>\d{2})\s+(?:(?<zg>[A-Z]{3,5})\s+)?(?<yg>\d{4})"
_EPOCH = r"(?<e>\d{9,13}|\d{15,19})(?:\.(?<g>\d{1,9}))?"

#: Named groups by component; of each list at most one takes part in a match.
COMPONENTS = {
    "y": ["ya", "yb", "yc", "yd", "ye", "yg"],
    "mo": ["oa", "ob", "oc", "od", "oe", "og"],
    "d": ["da", "db", "dc", "dd", "de", "dg"],
    "n1": ["n1"], "n2": ["n2"], "n3": ["n3"],
    "h": ["h", "hj", "he", "hg"], "mi": ["i", "ij", "ie", "ig"], "s": ["s", "sj", "se", "sg"],
    "f": ["f", "fe"], "ap": ["p"], "z": ["z", "ze", "zg"], "r": ["r"], "e": ["e"], "g": ["g"],
}
PATTERN = rf"^(?:{_EPOCH}|(?:{_DATES}){_CLOCK}|{_COMPACT}|{_ASCTIME})$"
_EXTRACT = "\u0001" + "\u0001".join("".join(f"${{{g}}}" for g in groups) for groups in COMPONENTS.values())

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _days_from_civil(y: str, m: str, d: str) -> str:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers only."""
    yy = f"({y} - if({m} <= 2, 1, 0))"
    era = f"({yy} div 400)"
    yoe = f"({yy} - {era} * 400)"
    doy = f"((153 * ({m} + if({m} > 2, -3, 9)) + 2) div 5 + {d} - 1)"
    return f"({era} * 146097 + {yoe} * 365 + {yoe} div 4 - {yoe} div 100 + {doy} - 719468)"


def _micros(part: str) -> str:
    """A digit string after the decimal point as microseconds (further digits are cut)."""
    return f"cast(rpad(substring({part}, 1, 6), 6, '0') as bigint)"


def _stage(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """Adds columns behind a generator, so that later references read them and never inline them again."""
    cells = [(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*cells))))


def known_zones() -> list[str]:
    return sorted(available_timezones())


def with_instant(df: DataFrame, stamp: str, tz: Column, date_order: Column, out: str = "epoch_us") -> DataFrame:
    """Adds ``out`` (bigint microseconds since 1970 UTC, or null) and ``out``_form (why or how).

    ``tz`` names the zone of stamps that carry none, ``date_order`` (mdy, dmy, ymd) settles
    all-number dates. A local time that occurs twice is the earlier instant; a skipped one moves
    forward by the length of the gap: both are what ``to_utc_timestamp`` does for a zone region.
    """
    w = f"__{out}"
    df = df.drop(out, f"{out}_form")
    zones = known_zones()
    clean = F.trim(F.translate(F.regexp_replace(F.col(stamp), r"^[\s　]+|[\s　]+$", ""), _WIDE, _NARROW))
    parts = F.split(F.regexp_replace(clean, PATTERN, _EXTRACT), "\u0001", -1)
    df = _stage(df, {w + "q": parts, w + "tz": tz, w + "o": date_order})
    df = _stage(df, {w + "p": f"if(size({w}q) = {len(COMPONENTS) + 1} and get({w}q, 0) = '', {w}q, null)"})
    part = {name: f"get({w}p, {i + 1})" for i, name in enumerate(COMPONENTS)}
    hit = f"({w}p is not null)"
    number = lambda text: f"try_cast(nullif({text}, '') as bigint)"
    n1, n2, n3 = (number(part[k]) for k in ("n1", "n2", "n3"))
    long_year = f"length({part['n3']}) = 4"
    short = f"if({long_year}, {n3}, 2000 + {n3})"
    named = f"locate(lower(substring({part['mo']}, 1, 3)), '{_MONTHS}')"
    month_word = f"if({part['mo']} rlike '^[A-Za-z]' and {named} % 3 = 1, ({named} + 2) div 3, null)"
    order = f"{w}o"
    all_numbers = f"{part['n1']} <> ''"
    exprs = {
        "y": f"case when {all_numbers} then case when {order} in ('mdy', 'dmy') then {short} when {order} = 'ymd' and not {long_year} then 2000 + {n1} end else {number(part['y'])} end",
        "m": f"case when {all_numbers} then case {order} when 'mdy' then {n1} when 'dmy' then {n2} when 'ymd' then {n2} end when {part['mo']} rlike '^[A-Za-z]' then {month_word} else {number(part['mo'])} end",
        "d": f"case when {all_numbers} then case {order} when 'mdy' then {n2} when 'dmy' then {n1} when 'ymd' then {n3} end else {number(part['d'])} end",
        "h": f"coalesce({number(part['h'])}, 0)",
        "mi": f"coalesce({number(part['mi'])}, 0)",
        "s": f"coalesce({number(part['s'])}, 0)",
    }
    df = _stage(df, {w + name: f"if({hit}, {text}, null)" for name, text in exprs.items()})
    y, m, d, h, mi, s = (w + k for k in ("y", "m", "d", "h", "mi", "s"))
    dim = f"case when {m} in (4, 6, 9, 11) then 30 when {m} = 2 then if({y} % 4 = 0 and ({y} % 100 <> 0 or {y} % 400 = 0), 29, 28) else 31 end"
    half = f"{part['ap']} <> ''"
    hour = f"if({half}, {h} % 12 + if(lower({part['ap']}) like 'p%', 12, 0), {h})"
    valid = f"({y} between 1 and 9999 and {m} between 1 and 12 and {d} between 1 and ({dim}) and {h} between if({half}, 1, 0) and if({half}, 12, 23) and {mi} <= 59 and {s} <= 59)"
    local = f"(({_days_from_civil(y, m, d)} * 86400 + {hour} * 3600 + {mi} * 60 + {s}) * 1000000 + if({part['f']} = '', 0, {_micros(part['f'])}))"
    zone = f"upper({part['z']})"
    digits = f"regexp_replace({zone}, '[^0-9]', '')"
    offset_min = f"(cast(substring({digits}, 1, 2) as bigint) * 60 + coalesce({number(f'substring({digits}, 3, 2)')}, 0)) * if({zone} like '%-%', -1, 1)"
    table = "map(" + ", ".join(f"'{k}', {v * 60}" for k, v in ABBREVIATIONS.items()) + ")"
    df = _stage(df, {
        w + "local": f"if({valid}, {local}, null)",
        w + "off": f"case when {zone} rlike '[+-]' then if(abs({offset_min}) <= 1080 and coalesce({number(f'substring({digits}, 3, 2)')}, 0) <= 59, {offset_min}, null) when {zone} <> '' then {table}[{zone}] end",
    })
    own = F.expr(f"nullif({part['r']}, '')")
    region = F.when(own.isNotNull(), own).otherwise(F.col(w + "tz"))
    region = F.when(region.isin(zones), region)
    by_region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col(w + "local")), region))
    digits_e = f"length({part['e']})"
    epoch = F.expr(
        f"case when {digits_e} <= 11 then {number(part['e'])} * 1000000 + if({part['g']} = '', 0, {_micros(part['g'])})"
        f" when {digits_e} <= 14 then {number(part['e'])} * 1000 when {digits_e} <= 17 then {number(part['e'])} else {number(part['e'])} div 1000 end"
    )
    instant = (
        F.when(~F.expr(hit), None)
        .when(F.expr(f"{part['e']} <> ''"), epoch)
        .when(F.expr(f"{zone} <> ''"), F.col(w + "local") - F.col(w + "off") * 60_000_000)
        .otherwise(by_region)
    )
    form = (
        F.when(F.col(stamp).isNull() | (F.trim(F.col(stamp)) == ""), "missing")
        .when(~F.expr(hit), "senseless")
        .when(F.col(out).isNull(), "impossible")
        .when(F.col(stamp).rlike(CANONICAL), "canonical")
        .otherwise("rewritten")
    )
    df = _stage(df, {out: instant.cast("bigint")})
    helpers = [c for c in df.columns if c.startswith(w)]
    return df.withColumn(out + "_form", form).drop(*helpers)


def normalise(rows: DataFrame, zones: DataFrame, stamp: str, source_kind: str = "source_kind", out: str = "epoch_us") -> DataFrame:
    """:func:`with_instant` with zone and date order looked up by source kind.

    ``zones`` has one row for each source kind; Spark broadcasts it only when its size is under
    the session's threshold, else the join shuffles. Repeated source kinds in ``zones`` count once.
    """
    z = zones.select(
        F.col("source_kind").alias("__zk"), F.col("tz_name").alias("__ztz"), F.col("date_order").alias("__zo")
    ).groupBy("__zk").agg(F.min("__ztz").alias("__ztz"), F.min("__zo").alias("__zo"))
    joined = rows.join(z, rows[source_kind] == z["__zk"], "left")
    return with_instant(joined, stamp, F.col("__ztz"), F.col("__zo"), out).drop("__zk", "__ztz", "__zo")
