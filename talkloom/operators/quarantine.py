"""Problem 2: rows that load and rows that do not, each of the latter with its first reason.

Method: structural CSV rejects come from the invalid-row callback of ``pyarrow.csv``; all fields
are read as strings; the columns are then checked as vectors and failing cells name the reason.

Results for special input: a null payload counts as an empty one (``column_count`` for CSV,
``bad_json`` for JSON); an unknown or null source kind is read as JSON without required values;
repeated payloads under other ids are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame

from talkloom.functions.strict_json import parse_strict

CSV_KINDS = ("cursor_ide",)
CSV_COLUMNS = ["rowid", "key", "value", "updated_at"]

_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",\r\n]*+)'
_QUOTING = re.compile(rf"{_FIELD}(?:(?:,|\r\n|\n|\r){_FIELD})*+")
_RECORD = re.compile(rf"{_FIELD}(?:,{_FIELD})*+")
_STAMP = re.compile(r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})Z", re.ASCII)
_KEY = r"\A(?:composerData:[^:]+|bubbleId:[^:]+:[^:]+)\z"


def is_stamp(value) -> bool:
    """``YYYY-MM-DDTHH:MM:SSZ`` of a real date and time."""
    m = _STAMP.fullmatch(value) if isinstance(value, str) else None
    if not m:
        return False
    y, mo, d, h, mi, s = map(int, m.groups())
    return y > 0 and 1 <= mo <= 12 and 1 <= d <= monthrange(y, mo)[1] and h < 24 and mi < 60 and s < 60


def _text(value) -> bool:
    return isinstance(value, str) and value != ""


def _one_of(*allowed: str):
    return lambda v: isinstance(v, str) and v in allowed


# The required members of each JSON source.
REQUIRED = {
    "claude_code": {"type": _one_of("user", "assistant", "summary", "system"), "sessionId": _text, "timestamp": is_stamp},
    "codex_cli": {"role": _one_of("user", "assistant", "system"), "content": lambda v: isinstance(v, list), "timestamp": is_stamp},
    "chatgpt_web": {"session": _text, "messages": lambda v: isinstance(v, list) and len(v) > 0, "captured_at": is_stamp},
    "generic_jsonl": {
        "role": _one_of("user", "assistant", "tool", "system"),
        "n": lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0,
        "at": is_stamp,
    },
}


def json_reason(kind: str | None, text: str) -> str | None:
    try:
        value = parse_strict(text)
    except ValueError:
        return "bad_json"
    if not isinstance(value, dict):
        return "bad_json"
    bad = [name for name, ok in REQUIRED.get(kind, {}).items() if not ok(value.get(name))]
    return "invalid_value" if bad else None


def _is_object(text: str) -> bool:
    try:
        return isinstance(parse_strict(text), dict)
    except ValueError:
        return False


def csv_reasons(texts: list[str]) -> list[str | None]:
    """The first reason of each single-record CSV text, or None when it loads."""
    reasons: list[str | None] = [None] * len(texts)
    whole: list[int] = []
    rows: list[str] = []
    for i, text in enumerate(texts):
        body = re.sub(r"(?:\r\n|\n|\r)\Z", "", text)
        if not _QUOTING.fullmatch(body):
            reasons[i] = "broken_quoting"
        elif not body or not _RECORD.fullmatch(body):
            reasons[i] = "column_count"  # nothing, or a line break outside quotes: not one record
        else:
            whole.append(i)
            rows.append(body)
    if not rows:
        return reasons
    # A leading valid row keeps a byte-order mark of the first payload part of its first field.
    block = ("0,k,v,t\n" + "\n".join(rows) + "\n").encode()
    rejected: list[int] = []

    def on_invalid(row) -> str:
        rejected.append(row.number)
        return "skip"

    table = pacsv.read_csv(
        pa.py_buffer(block),
        read_options=pacsv.ReadOptions(column_names=CSV_COLUMNS, use_threads=False, block_size=len(block) + 1),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=on_invalid),
        convert_options=pacsv.ConvertOptions(column_types={c: pa.string() for c in CSV_COLUMNS}, strings_can_be_null=False),
    ).slice(1)
    structural = {number - 2 for number in rejected}  # rows count from 1, and the first is ours
    loaded = [i for k, i in enumerate(whole) if k not in structural]
    for k in structural:
        reasons[whole[k]] = "column_count"
    if len(loaded) != table.num_rows:
        raise RuntimeError(f"{table.num_rows} rows parsed, {len(loaded)} expected")
    good = pc.and_(
        pc.match_substring_regex(table["rowid"], r"\A[0-9]+\z"),
        pc.match_substring_regex(table["key"], _KEY),
    ).to_pylist()
    for i, fine, value, stamp in zip(loaded, good, table["value"].to_pylist(), table["updated_at"].to_pylist()):
        if not (fine and is_stamp(stamp) and _is_object(value)):
            reasons[i] = "invalid_value"
    return reasons


def label_batch(kinds: list[str | None], payloads: list[bytes | None]) -> list[str | None]:
    """The first reason why each payload does not load, None where it does."""
    reasons: list[str | None] = [None] * len(payloads)
    csv_at: list[int] = []
    csv_texts: list[str] = []
    for i, (kind, payload) in enumerate(zip(kinds, payloads)):
        try:
            text = (payload or b"").decode("utf-8")
        except UnicodeDecodeError:
            reasons[i] = "bad_encoding"
            continue
        if kind in CSV_KINDS:
            csv_at.append(i)
            csv_texts.append(text)
        else:
            reasons[i] = json_reason(kind, text)
    for i, reason in zip(csv_at, csv_reasons(csv_texts)):
        reasons[i] = reason
    return reasons


def split_rows(rows: DataFrame, id: str = "id", source_kind: str = "source_kind", payload: str = "payload") -> DataFrame:
    """(id, source_kind, payload text or null, reason or null): one output row for each input row.

    A null ``reason`` means that the row loads; ``record`` then holds its decoded text. No shuffle:
    the work is one pass over Arrow batches.
    """
    picked = rows.select(id, source_kind, payload).toDF("id", "source_kind", "payload")
    schema = f"id {picked.schema['id'].dataType.simpleString()}, source_kind string, record string, reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, payloads = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            reasons = label_batch(kinds, payloads)
            texts = [(p or b"").decode() if r is None else None for p, r in zip(payloads, reasons)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(reasons, pa.string())],
                names=["id", "source_kind", "record", "reason"],
            )

    return picked.mapInArrow(run, schema)
