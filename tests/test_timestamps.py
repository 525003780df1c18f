from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from talkloom.operators.timestamps import normalise

ZONES = [("us", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy"), ("jp", "Asia/Tokyo", "ymd"), ("xx", "No/Where", "mdy")]


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2025-01-02T03:04:05Z", "us", utc(2025, 1, 2, 3, 4, 5)),
    (" 2025-01-02T03:04:05Z ", "us", utc(2025, 1, 2, 3, 4, 5)),
    ("01/02/2025 03:04:05 PM", "us", utc(2025, 1, 2, 20, 4, 5)),
    ("12/31/25 12:00 AM", "us", utc(2025, 12, 31, 5)),
    ("01/02/2025 03:04", "de", utc(2025, 2, 1, 2, 4)),
    ("25/02/03 04:05", "jp", utc(2025, 2, 2, 19, 5)),
    ("2025-11-02 01:30:00", "us", utc(2025, 11, 2, 5, 30)),  # occurs twice: the earlier
    ("2025-11-02 01:30:00 EST", "us", utc(2025, 11, 2, 6, 30)),  # the stamp tells
    ("2025-03-09 02:30:00", "us", utc(2025, 3, 9, 7, 30)),  # skipped: forward by an hour
    ("2025-01-02T03:04:05[Asia/Tokyo]", "us", utc(2025, 1, 1, 18, 4, 5)),
    ("Thu, 02 Jan 2025 03:04:05 -0800", "de", utc(2025, 1, 2, 11, 4, 5)),
    ("Jan 2, 2025 3:04:05 AM", "us", utc(2025, 1, 2, 8, 4, 5)),
    ("2025年1月2日 3時04分05秒", "jp", utc(2025, 1, 1, 18, 4, 5)),
    ("２０２５－０１－０２　０３：０４：０５", "jp", utc(2025, 1, 1, 18, 4, 5)),
    ("20250102T030405Z", "us", utc(2025, 1, 2, 3, 4, 5)),
    ("2025-01-02 03:04:05,250", "de", utc(2025, 1, 2, 2, 4, 5) + 250_000),
    ("1735787045", "us", 1735787045 * 10**6),
    ("1735787045123", "us", 1735787045123 * 10**3),
    ("1735787045123456", "us", 1735787045123456),
    ("1735787045.5", "us", 1735787045_500_000),
    ("2025-02-29 00:00:00", "us", None),
    ("2024-02-29", "jp", utc(2024, 2, 28, 15)),
    ("2025-13-01T00:00:00Z", "us", None),
    ("2025-01-01T24:00:00Z", "us", None),
    ("13:00 PM", "us", None),
    ("yesterday 14:03", "us", None),
    ("", "us", None),
    (None, "us", None),
    ("-", "us", None),
    ("2025-01-02 03:04:05", "xx", None),  # no usable zone
    ("2025-01-02 03:04:05", None, None),
    ("x" * 100_000, "us", None),
]


def test_cases(spark):
    zones = spark.createDataFrame(ZONES, "source_kind string, tz_name string, date_order string")
    rows = spark.createDataFrame([(i, t, k, "kept") for i, (t, k, _) in enumerate(CASES)], "i int, t string, source_kind string, epoch_us string")
    found = {r.i: r.epoch_us for r in normalise(rows, zones, "t").collect()}  # a clashing column is replaced
    for i, (t, k, want) in enumerate(CASES):
        assert found[i] == want, (t and t[:60], k)


def test_empty_and_repeated(spark):
    zones = spark.createDataFrame(ZONES + ZONES[:1], "source_kind string, tz_name string, date_order string")
    none = spark.createDataFrame([], "t string, source_kind string")
    assert normalise(none, zones, "t").count() == 0
    twice = spark.createDataFrame([("1735787045", "us")] * 2, "t string, source_kind string")
    assert normalise(twice, zones, "t").count() == 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(datetime(1971, 1, 1), datetime(2037, 12, 31)), min_size=1, max_size=40))
def test_against_zoneinfo(spark, times):
    zones = spark.createDataFrame(ZONES, "source_kind string, tz_name string, date_order string")
    rows = [(t.strftime("%Y-%m-%d %H:%M:%S.%f"), k) for t in times for k, _, _ in ZONES[:3]]
    zone = {k: ZoneInfo(z) for k, z, _ in ZONES[:3]}
    for r in normalise(spark.createDataFrame(rows, "t string, source_kind string"), zones, "t").collect():
        local = datetime.fromisoformat(r.t).replace(tzinfo=zone[r.source_kind])
        moved = local.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
        assert r.epoch_us == (moved.days * 86400 + moved.seconds) * 10**6 + moved.microseconds, r


@pytest.mark.parametrize("form", ["%d %b %Y %H:%M:%S", "%A, %d %B %Y %H:%M:%S", "%b %d, %Y %I:%M:%S %p"])
def test_named_months(spark, form):
    zones = spark.createDataFrame(ZONES, "source_kind string, tz_name string, date_order string")
    days = [datetime(2025, m, 11, 13, 5, 6) for m in range(1, 13)]
    rows = spark.createDataFrame([(t.strftime(form), "jp", i) for i, t in enumerate(days)], "t string, source_kind string, i int")
    found = {r.i: r.epoch_us for r in normalise(rows, zones, "t").collect()}
    assert found == {i: int(t.replace(tzinfo=ZoneInfo("Asia/Tokyo")).timestamp()) * 10**6 for i, t in enumerate(days)}
