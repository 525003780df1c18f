import csv
import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from talkloom.operators.quarantine import csv_reasons, label_batch, split_rows

OK_CSV = '1,composerData:a,"{""t"": 1}",2025-01-02T03:04:05Z'
STAMP = "2025-01-02T03:04:05Z"
CASES = [
    ("cursor_ide", OK_CSV.encode(), None),
    ("cursor_ide", OK_CSV.encode() + b"\r\n", None),
    ("cursor_ide", '1,bubbleId:a:b,"{""t"":\n""x,y""}",2025-01-02T03:04:05Z'.encode(), None),
    ("cursor_ide", OK_CSV.encode() + b"\xe3\x81", "bad_encoding"),
    ("cursor_ide", b'1,composerData:a,"{""t"": 1},2025-01-02T03:04:05Z', "broken_quoting"),
    ("cursor_ide", b'1,composerData:a,"{}"x,2025-01-02T03:04:05Z', "broken_quoting"),
    ("cursor_ide", b'1,composerData:a,a"b,2025-01-02T03:04:05Z', "broken_quoting"),
    ("cursor_ide", b'1,composerData:a,{},2025-01-02T03:04:05Z,', "column_count"),
    ("cursor_ide", b"", "column_count"),
    ("cursor_ide", None, "column_count"),
    ("cursor_ide", OK_CSV.encode() + b"\n" + OK_CSV.encode(), "column_count"),
    ("cursor_ide", "﻿".encode() + OK_CSV.encode(), "invalid_value"),
    ("cursor_ide", b'x,composerData:a,{},2025-01-02T03:04:05Z', "invalid_value"),
    ("cursor_ide", b'1,composerData:,{},2025-01-02T03:04:05Z', "invalid_value"),
    ("cursor_ide", b'1,composerData:a,[],2025-01-02T03:04:05Z', "invalid_value"),
    ("cursor_ide", b'1,composerData:a,{},2025-02-30T03:04:05Z', "invalid_value"),
    ("claude_code", json.dumps({"type": "user", "sessionId": "s", "timestamp": STAMP}).encode(), None),
    ("claude_code", json.dumps({"type": "user", "sessionId": "", "timestamp": STAMP}).encode(), "invalid_value"),
    ("claude_code", b'{"type": NaN}', "bad_json"),
    ("claude_code", b'{"a": 1} x', "bad_json"),
    ("claude_code", b'{"a": 1,}', "bad_json"),
    ("claude_code", b'{"a": "\x01"}', "bad_json"),
    ("claude_code", b"[]", "bad_json"),
    ("codex_cli", json.dumps({"role": "user", "content": [], "timestamp": STAMP}).encode(), None),
    ("codex_cli", json.dumps({"role": "tool", "content": [], "timestamp": STAMP}).encode(), "invalid_value"),
    ("chatgpt_web", json.dumps({"session": "s", "messages": [], "captured_at": STAMP}).encode(), "invalid_value"),
    ("chatgpt_web", json.dumps({"session": "s", "messages": [1], "captured_at": STAMP}).encode(), None),
    ("generic_jsonl", json.dumps({"role": "tool", "n": 0, "at": STAMP}).encode(), None),
    ("generic_jsonl", json.dumps({"role": "tool", "n": True, "at": STAMP}).encode(), "invalid_value"),
    ("generic_jsonl", b'{"role": "tool", "at": "2025-01-02T03:04:05Z", "n": ' + b"9" * 6000 + b"}", None),
    ("generic_jsonl", b"[" * 100_000, "bad_json"),
    ("other", b"{}", None),
    (None, b"{", "bad_json"),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, k, p, "x", "y") for i, (k, p, _) in enumerate(CASES)] * 2, "id bigint, source_kind string, payload binary, reason string, record string")
    out = split_rows(rows).collect()
    assert len(out) == 2 * len(CASES)
    for r in out:
        assert r.reason == CASES[r.id][2], CASES[r.id][:2]
        assert (r.record is None) == (r.reason is not None)


def test_empty(spark):
    assert split_rows(spark.createDataFrame([], "id bigint, source_kind string, payload binary")).count() == 0
    assert label_batch([], []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=12), min_size=1, max_size=6), min_size=1, max_size=8))
def test_written_csv_has_its_columns(records):
    texts = []
    for fields in records:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL).writerow(fields)
        texts.append(out.getvalue())
    for fields, reason in zip(records, csv_reasons(texts)):
        assert (reason == "column_count") == (len(fields) != 4)
        assert reason != "broken_quoting"
