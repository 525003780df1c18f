import json
from datetime import date, timedelta

import pytest

from talkloom.operators import drift


def build(change_day=40, days=90, per_day=3, noise=True):
    rows, n = [], 0
    for d in range(days):
        day = (date(2025, 1, 1) + timedelta(days=d)).strftime("%Y/%m/%d")
        for k in range(per_day):
            n += 1
            late = d >= change_day
            o = {"id": f"{n:08x}", "who": ["user", "bot"][n % 2], "seen": f"2025-01-01T00:{n % 60:02d}:00Z", "usage": {"in": n}}
            o["branch" if late else "gitBranch"] = f"feat/{n % 7}"
            o["version"] = 2.1 if late else "2.1.7"
            if late:
                o["added"] = n
            else:
                o["gone"] = {"x": "https://a.example/" + str(n)}
            if n % 3 == 0:
                o["optional"] = None if n % 2 else "x"
            o["mixed"] = n if n % 2 else str(n)
            rows.append((n, "k", f"/a/{day}/f.jsonl::{k}", json.dumps(o).encode()))
    return rows


EXPECTED = {
    ("k", "renamed", "gitBranch", "branch"), ("k", "type_changed", "version", ""), ("k", "added", "added", ""), ("k", "removed", "gone.x", ""),
}


@pytest.fixture(scope="module")
def raw(spark):
    bad = [(9001, "k", "/a/2025/01/05/f.jsonl::9", b"{"), (9002, "k", "/a/2025/01/05/f.jsonl::9", None), (9003, "k", "noday", b'{"odd": 1}'), (9004, None, "/a/2025/01/05/f", b"[1]")]
    return spark.createDataFrame(build() + bad, "id bigint, source_kind string, locator string, payload binary")


def test_changes(raw):
    found = {(r.source_kind, r.change_type, r.field_path, r.new_path) for r in drift.drift_report(raw).collect()}
    assert found == EXPECTED


def test_rescue_keeps_everything(spark, raw):
    target = {"k": {"id": "string", "version": "number"}}
    rows = drift.rescue_ingest(raw, target).collect()
    source = {r.id: r.payload for r in raw.collect()}
    for r in rows:
        try:
            want = dict((p, v) for p, _, v in drift.leaves(json.loads(bytes(source[r.id] or b"").decode())))
        except (ValueError, AttributeError):
            assert r.data is None
            continue
        assert {p: json.loads(v) for p, v in {**r.data, **r.rescued}.items()} == want
        assert set(r.data) <= {"id", "version"} and all(isinstance(json.loads(v), (int, float)) for p, v in r.data.items() if p == "version")


def test_consistent_table(raw):
    out = drift.consistent_table(raw)
    rows = {r.id: r for r in out.collect()}
    assert {"f_gitbranch", "f_version", "f_added", "f_usage_in"} <= set(out.columns)
    assert rows[1].f_gitbranch == "feat/1" and rows[260].f_gitbranch == f"feat/{260 % 7}"  # replayed under its first name
    assert rows[1].f_version == "2.1.7" and rows[260].f_version == "2.1"
    assert rows[9001].f_gitbranch is None


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, source_kind string, locator string, payload binary")
    assert drift.drift_report(none).count() == 0
    assert drift.consistent_table(none).count() == 0


def test_too_many_fields_are_an_error(raw, monkeypatch):
    monkeypatch.setattr(drift, "MAX_FIELDS", 2)
    with pytest.raises(ValueError):
        drift.initial_schema(raw)


def test_whole_values_tell_fields_apart(spark):
    """Values alike in their first 40 characters only make no renaming."""
    rows = []
    for n in range(240):
        day = (date(2025, 1, 1) + timedelta(days=n // 3)).strftime("%Y/%m/%d")
        start = "shared words that start every value here "
        o = {"id": n, "place": f"{start}~{n % 5}~{n:04d}~0000~00"} if n < 120 else {"id": n, "remark": f"{start}W" + "xyzw"[n % 4] * 9 + "abcd"[n % 3] * 7}
        rows.append((n, "k", f"/a/{day}/f.jsonl::{n}", json.dumps(o).encode()))
    report = drift.drift_report(spark.createDataFrame(rows, "id bigint, source_kind string, locator string, payload binary"))
    assert {(r.change_type, r.field_path, r.new_path) for r in report.collect()} == {("removed", "place", ""), ("added", "remark", "")}
