import base64
import hashlib
import io
import json
import os
import sqlite3
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from talkloom.functions import binary as B
from talkloom.sources import parsers as P
from talkloom.sources.kv_store import KeyValueSource
from talkloom.streaming import ingest

RAW = "id bigint, source_kind string, locator string, payload binary"


def raw(spark, *values, kind="claude_code"):
    rows = [(i, kind, f"/d/2025/01/02/abc.jsonl::{i}", v if isinstance(v, (bytes, type(None))) else json.dumps(v).encode()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RAW)


def test_transcript(spark):
    say = lambda role, content: {"type": role, "sessionId": "s1", "uuid": "u", "timestamp": "t", "message": {"role": role, "content": content}}
    df = P.transcript(raw(
        spark, say("user", "hello"), say("assistant", [{"type": "thinking", "thinking": "no"}, {"type": "text", "text": "a"}, {"type": "tool_use", "id": "1", "name": "Read", "input": {"file_path": "x"}}]),
        say("user", [{"type": "tool_result", "tool_use_id": "1", "content": "out"}]), {"type": "summary", "summary": "sum"}, {"type": "odd", "x": 1}, b"{broken", None,
    ))
    rows = {r.raw_id: r for r in df.collect()}
    assert (rows[0].actor, rows[0].kind, rows[0].text) == ("user", "message", "hello")
    assert (rows[1].kind, rows[1].text) == ("tool_use", 'a\n[tool_use Read] {"file_path":"x"}')
    assert (rows[2].actor, rows[2].kind, rows[2].text) == ("tool", "tool_result", "out")
    assert rows[3].text == "[summary] sum" and rows[4].kind == "meta" and rows[4].error is None
    assert rows[5].error == rows[6].error == "not JSON" and rows[3].session_key == "claude_code:abc"


def fingerprint(blocks):
    """What the ids are made of, in plain Python."""
    h = hashlib.sha256()
    for b in blocks:
        h.update(b["type"].encode())
        if b["type"] in ("text", "tool_result"):
            h.update(b["text"].encode())
        elif b["type"] == "tool_use":
            h.update((json.dumps(b["input"], sort_keys=True, ensure_ascii=False) + str(b["name"])).encode())
        elif b["type"] == "image_b64":
            h.update(b["data"][:64].encode())
    return h.hexdigest()


PNG = base64.b64encode(b"\x89PNG\r\n\x1a\n" + b"\0" * 60).decode()


def test_transcript_blocks(spark):
    """Hints, tool lookup by id, images lifted out of results, fingerprints and the blob store."""
    say = lambda role, content, **more: {"type": role, "sessionId": "s", "uuid": "u", "cwd": "/w", "gitBranch": "b", "version": "2", "message": {"model": "m", "content": content}, **more}
    image = {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": PNG}}
    use = lambda i, name, **inp: {"type": "tool_use", "id": i, "name": name, "input": inp}
    back = lambda i, content: {"type": "tool_result", "tool_use_id": i, "content": content}
    df = P.transcript(raw(
        spark, say("assistant", [use("1", "Read", file_path="a.py", b=2, a="é"), use("2", "Bash", path="x")]), say("user", [back("1", [{"type": "text", "text": "one"}, image, {"type": "text", "text": "two"}])]),
        say("user", [back("2", "out"), back("1", "again")]), say("user", [back("9", "lost")]), say("user", [image, {"type": "text", "text": "see"}]), say("user", [{"type": "image", "source": {"type": "base64", "data": "?!"}}]),
    ))
    rows = {r.raw_id: r for r in df.collect()}
    hints = {k: json.loads(r.hints) for k, r in rows.items()}
    assert hints[0] == {"cwd": "/w", "git_branch": "b", "cc_version": "2", "model": "m"}
    assert (hints[1]["tool_name"], hints[1]["file_path"]) == ("Read", "a.py") and (hints[2]["tool_name"], hints[2]["file_path"]) == ("Bash", "a.py")
    assert "tool_name" not in hints[3]
    sha = hashlib.sha256(base64.b64decode(PNG)).hexdigest()
    line = f"[添付(画像)  image/png 68B sha={sha[:12]}]"
    assert rows[1].text == line + "\none\ntwo" and rows[4].text == line + "\nsee" and rows[5].text == P.BROKEN and rows[1].kind == "tool_result" and rows[4].kind == "message"
    own = [{"type": "tool_use", "name": "Read", "input": {"file_path": "a.py", "b": 2, "a": "é"}}, {"type": "tool_use", "name": "Bash", "input": {"path": "x"}}]
    assert rows[0].fingerprint == fingerprint(own)
    assert rows[1].fingerprint == fingerprint([{"type": "image_b64", "data": PNG}, {"type": "tool_result", "text": "one\ntwo"}])
    blobs = P.blob_store(df).collect()
    assert [(b.sha256, b.mime, b.bytes, bytes(b.content)) for b in blobs] == [(sha, "image/png", 68, base64.b64decode(PNG))]


def test_inbox_attachments(spark):
    """Metadata of attachments survive in the text whether or not their bytes came along."""
    files = [{"name": "n.txt", "mime": "text/plain", "data_b64": base64.b64encode(b"hello").decode()}, {"name": "v.mp4", "mime": "video/mp4", "size": 50 * 1024**2}, {"name": "p.pdf", "url": "https://h/p"}, {}]
    drop = {"source": "w", "session": "s", "title": "T", "messages": [{"role": "human", "text": "look", "attachments": files}, {"role": "model", "text": " "}, {"role": "x", "text": None, "attachments": files[:1]}]}
    rows = sorted(P.inbox(raw(spark, drop, kind="chatgpt_web")).collect(), key=lambda r: r.actor, reverse=True)
    assert [r.actor for r in rows] == ["user", "assistant"] and json.loads(rows[0].hints) == {"title": "T"} and rows[1].hints is None
    sha = hashlib.sha256(b"hello").hexdigest()
    assert rows[0].text.split("\n") == ["look", f"[添付(テキスト) n.txt text/plain 5B sha={sha[:12]}]", "[添付(動画 未取得) v.mp4 video/mp4 50.0MB]", "[添付(PDF) url: https://h/p name=p.pdf]"]
    assert [b.sha256 for r in rows for b in r.blobs] == [sha, sha]
    again = P.inbox(raw(spark, drop, drop, kind="chatgpt_web"))
    assert again.select("session_key", "native_id", "fingerprint").distinct().count() == 2  # dropped again: nothing new


def test_rollout_and_others(spark):
    df = P.rollout(raw(spark, {"timestamp": "t", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}}, {"type": "function_call", "name": "sh", "arguments": "{}", "call_id": "c"}, {"type": "function_call_output", "output": "o"}, {"type": "x"}, kind="codex_cli"))
    rows = [(r.actor, r.kind, r.text, r.error) for r in df.orderBy("raw_id").collect()]
    assert rows[:3] == [("user", "message", "q", None), ("assistant", "tool_use", "[tool_use sh] {}", None), ("tool", "tool_result", "o", None)] and rows[3][3] == "unknown shape"
    kv = P.key_values(raw(spark, {"type": 1, "text": " ", "richText": "r"}, {"type": 2, "content": [{"type": "text", "text": "c"}]}, {"x": 1}, kind="cursor_ide"))
    assert [(r.actor, r.text, r.error) for r in kv.orderBy("raw_id").collect()] == [("user", "r", None), ("assistant", "c", None), (None, None, "no text")]
    box = P.inbox(raw(spark, {"source": "w", "session": "s", "note": "n", "captured_at": "c", "messages": [{"role": "user", "text": "x"}, {"role": "user", "text": "x"}]}, b"?", kind="chatgpt_web"))
    got = sorted((r.native_id or "", r.kind, r.ts, r.error) for r in box.collect() if r.error is None)
    assert [g[0][-2:] for g in got] == [":0", ":1", "te"] and all(g[2] == "c" for g in got)
    assert box.filter("error is not null").count() == 1
    own = P.configurable(raw(spark, {"who": "AI", "m": {"t": "v"}, "at": 1}, {"who": "ghost", "m": {"t": "v"}}, kind="generic_jsonl"), ["who"], ["m.t"])
    assert [(r.actor, r.text, r.error) for r in own.orderBy("raw_id").collect()] == [("assistant", "v", None), ("ghost", "v", "unknown shape")]


def test_markdown(spark):
    text = "# aider chat started at 2025\n#### one\n#### two\nanswer\n\nmore\n# aider chat started at 2026\n#### three\n"
    rows = P.markdown_chat(raw(spark, text.encode(), b"", None, kind="aider")).orderBy("session_key", "native_id").collect()
    assert [(r.session_key[-2:], r.actor, r.text) for r in rows] == [("-1", "user", "one\ntwo"), ("-1", "assistant", "answer\n\nmore"), ("-2", "user", "three")]


def test_chain_and_shapes(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y")], "id string, parent string")
    assert [r.id for r in P.parent_chain(nodes, "c").orderBy("depth").collect()] == ["c", "b", "a"]
    assert P.parent_chain(nodes, "none").count() == 0 and [r.id for r in P.parent_chain(nodes, "x").collect()] == ["x"]
    long = spark.range(300).selectExpr("cast(id as string) id", "cast(id - 1 as string) parent")
    assert P.parent_chain(long, "299").count() == 300 and P.parent_chain(long, "299", limit=99).agg(F.max("depth")).first()[0] == 99
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, parent string")
    assert sorted((r.depth, r.id) for r in P.parent_chain(ring, "a").collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert "a: BIGINT" in P.json_shape(raw(spark, {"a": 1}, {"b": "x"})).first().shape
    m = spark.createDataFrame([("s", i, "x" * i) for i in range(10)], "session_key string, n int, text string")
    assert P.payload_messages(m, most=3, chars=8).filter("was_cut").count() == 1


def test_browser_payloads(spark):
    schema = "session string, title string, captured_at string, url string, n int, role string, text string, attachments array<struct<name:string,mime:string,text:string>>"
    rows = [("s", "T", "c", "u", i, "user", f"m{i}", [("a.pdf", None, "inner")] if i == 404 else None) for i in range(405)]
    out = P.browser_payload(spark.createDataFrame(rows, schema), "claude_web").collect()
    drop = json.loads(out[0].payload)
    assert len(out) == 1 and len(drop["messages"]) == 400 and drop["note"] == "5 older messages left out" and drop["messages"][0]["text"] == "m5"
    events = P.inbox(raw(spark, drop, kind="chatgpt_web"))
    assert events.count() == 401 and events.filter("text like '%a.pdf text/plain 5B%'").count() == 1


def test_empty_sources(spark):
    assert P.parse_all(spark.createDataFrame([], RAW)).count() == 0


def test_key_value_source(spark, tmp_path):
    path = str(tmp_path / "s.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE cursorDiskKV(key TEXT PRIMARY KEY, value TEXT)")
    con.executemany("INSERT INTO cursorDiskKV VALUES(?, ?)", [("bubbleId:a:b", "{}"), ("x", None), ("composerData:a", "{}")])
    con.commit()
    spark.dataSource.register(KeyValueSource)
    df = spark.read.format("kvstore").option("path", path).load()
    assert [r.key for r in df.orderBy("rowid").collect()] == ["bubbleId:a:b", "composerData:a"]
    stream = spark.readStream.format("kvstore").option("path", path).load()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for add, total in (("late", 3), (None, 3)):
        if add:
            con.execute("INSERT INTO cursorDiskKV VALUES(?, '{}')", (add,))
            con.commit()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
        assert spark.read.parquet(out).count() == total


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    line = lambda i: json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "message": {"content": f"m{i}"}})
    (tmp_path / "in" / "a.jsonl").write_text(f"{line(1)}\n{line(2)}\n{{bad\n{line(3)}")  # the last line is not ended
    for _ in range(2):
        ingest.ingest_files(spark, source, out, check).awaitTermination()
    assert spark.read.parquet(out + "/events").count() == 2 and spark.read.parquet(out + "/quarantine").count() == 1 and spark.read.parquet(out + "/raw").count() == 2
    (tmp_path / "in" / "b.jsonl").write_text(f"{line(1)}\n{line(4)}\n")
    ingest.ingest_files(spark, source, out, check).awaitTermination()
    events = spark.read.parquet(out + "/events")
    assert events.count() == 3 and events.filter("native_id = 'u1'").count() == 1  # the same message elsewhere is no new event
    lines = P.read_lines(spark, source)
    assert ingest.write_batch(lines, out, "claude_code") == {"raw": 0, "events": 0, "blobs": 0, "blob_refs": 0, "quarantine": 0}


def test_grown_files_and_attachments(spark, tmp_path):
    """A file that grows is read again: its open line comes in when it has an end, and nothing twice."""
    out, source = str(tmp_path / "out"), tmp_path / "in"
    source.mkdir()
    image = {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": PNG}}
    line = lambda i, content="m": json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "message": {"content": content}})
    (source / "a.jsonl").write_text(f"{line(1)}\n{line(2)}")
    assert ingest.ingest_changed(spark, str(source), out)["events"] == 1
    assert sum(ingest.ingest_changed(spark, str(source), out).values()) == 0
    (source / "a.jsonl").write_text(f"{line(1)}\n{line(2)}\n{line(3, [image])}\n{line(4, [image])}\n")
    os.utime(source / "a.jsonl", (2_000_000_000, 2_000_000_000))
    assert ingest.ingest_changed(spark, str(source), out) == {"raw": 3, "events": 3, "blobs": 1, "blob_refs": 2, "quarantine": 0}
    assert ingest.ingest_changed(spark, str(tmp_path / "in"), out)["events"] == 0
    called = []
    ingest.ingest_files(spark, str(source), str(tmp_path / "o2"), str(tmp_path / "c2"), on_new=called.append).awaitTermination()
    assert [c["events"] for c in called] == [4]


def test_retention_of_stored_tables(spark, tmp_path):
    from datetime import datetime, timezone

    from talkloom.streaming import retention

    out, source = str(tmp_path / "out"), tmp_path / "in"
    source.mkdir()
    image = {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": PNG}}
    line = lambda i, ts, content="m": json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "timestamp": ts, "message": {"content": content}})
    (source / "a.jsonl").write_text("\n".join([line(1, "2024-01-01T00:00:00Z", [image]), line(2, "1767225600"), line(3, None), ""]))
    ingest.ingest_changed(spark, str(source), out)
    zones = spark.createDataFrame([("claude_code", "UTC", "mdy")], "source_kind string, tz_name string, date_order string")
    now = datetime(2026, 1, 2, tzinfo=timezone.utc)
    assert retention.autoprune(spark, out, zones, 30, now, last_run=now) is None
    assert retention.autoprune(spark, out, zones, 30, now) == {"raw": 1, "events": 1, "blobs": 1, "blob_refs": 1, "quarantine": 0} or spark.read.parquet(f"{out}/events").count() == 2
    assert {r.native_id for r in spark.read.parquet(f"{out}/events").collect()} == {"u2", "u3"} and spark.read.parquet(f"{out}/blobs").count() == 0
    assert retention.compact(spark, f"{out}/events") == 1 and spark.read.parquet(f"{out}/events").count() == 2
    assert retention.purge(spark, out, ["raw", "events"]) == ["raw", "events"] and not os.path.exists(f"{out}/raw")
    with pytest.raises(ValueError):
        retention.purge(spark, out, ["../x"])


def test_windows(spark):
    rows = spark.sql("SELECT timestamp '2025-01-01 00:30:00' AS ts, 'a' AS k UNION ALL SELECT timestamp '2025-01-01 01:10:00', 'a'")
    assert ingest.windowed_counts(rows, keys=("k",)).count() == 2 and ingest.windowed_counts(rows, slide="30 minutes").count() == 3
    events = spark.createDataFrame([("s", "2")], "session_key string, ts string").withColumn("ingested_at", F.current_timestamp())
    assert ingest.session_counts(events).first().n_events == 1


def office(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_attachments(spark):
    docx = office(word__document_xml="<w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t xml:space='preserve'>there</w:t></w:r></w:p><w:p><w:t>two &amp; three</w:t></w:p>")
    xlsx = office(xl__workbook_xml="", xl__sharedStrings_xml="<si><t>cell</t></si>")
    pdf = b"%PDF-1.4\n1 0 obj\nstream\nBT (Hi \\(x\\)) Tj [(a) -20 (b)] TJ ET\nendstream"
    cases = [(docx, None, "Hello there\ntwo & three", "docx"), (xlsx, "text/plain", "cell", "xlsx"), (pdf, "", "Hi (x)\nab", "pdf"), ("こんにちは。".encode("cp932"), "text/plain", "こんにちは。", "plain"),
             (b"<html><script>x</script><p>a&lt;b</p></html>", None, "a<b", "html"), (b"\x00\x01\x02" * 50, None, "", ""), (b"", None, "", ""), (None, None, "", ""), (b"PK\x03\x04broken", None, "", "")]
    for data, mime, text, extractor in cases:
        assert B.extract(data, mime) == (text, extractor)
    rows = spark.createDataFrame([(str(i), d, m, None) for i, (d, m, _, _) in enumerate(cases)], "sha256 string, content binary, mime string, name string")
    assert {r.sha256: r.text for r in B.extract_texts(rows).collect()} == {str(i): t for i, (_, _, t, _) in enumerate(cases)}
    assert B.sniff(b"\x89PNG\r\n\x1a\n", "text/plain") == "image/png" and B.sniff(b"zz", "a/b") == "a/b"
    assert B.sniff(b"\xff\xf3abc") == "audio/mpeg" and B.sniff(b"zz", "text/plain; charset=x") == "text/plain" and B.sniff(b"zz", "application/zip") == B.UNKNOWN and B.sniff(b"\0\0\0\x20ftypM4V 12345") == "video/quicktime"
    heads = [b"\x89PNG\r\n\x1a\n", b"\xff\xf2a", b"RIFF1234WEBPx", b"\0\0\0\x20ftypM4A 12345", b"\0\0\0\x20ftypisom12345", b"zz", b"%PDF-1", b"", b"PK\x03\x04broken", b"BMx", b"OggS"]
    typed = spark.createDataFrame([(h, m) for h in heads for m in (None, "A/b; q", "application/zip")], "d binary, m string").withColumn("t", B.sniffed("d", "m")).collect()
    assert all(r.t == B.sniff(bytes(r.d), r.m) for r in typed)
    nested = b"%PDF\nstream\n/F1 12 Tf BT % (no) Tj\n(a (b) \\051\\n) Tj <48> Tj (x) Td (y) ' ET (out) Tj\nendstream stream\n" + zlib.compress(b"BT [(de)-3(fg)] TJ ET") + b"\nendstream"
    assert B.pdf_text(nested) == "a (b) )\n\ny\ndefg" and B.pdf_text(b"stream\nBT (" + b"\x80\x81" * 20 + b") Tj ET endstream") == ""
    sheets = office(xl__workbook_xml='<sheets><sheet name="A &amp; B" sheetId="1"/></sheets>', xl__sharedStrings_xml="<si><t>cell</t></si>")
    slides = office(ppt__slides__slide2_xml="<a:p><a:t>two</a:t></a:p>", ppt__slides__slide1_xml="<a:p><a:t>one</a:t></a:p>")
    assert B.extract(sheets)[0] == "sheets: A & B\ncell" and B.extract(slides)[0] == "[slide1.xml] one\n[slide2.xml] two"
    known = spark.createDataFrame([("0", "docx", 5, "Hello")], "sha256 string, extractor string, chars bigint, text string")
    assert {r.sha256 for r in B.reextract(rows, known).collect()} == {"1", "2", "3", "4"}
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x05\0\x07\x01"
    assert B.image_size(jpeg) == (7, 5) and B.image_size(b"\xff\xd8\xff") is None and B.image_size(b"BM" + b"\0" * 16 + b"\4\0\0\0\6\0\0\0") == (4, 6)
    assert B.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + b"\0\0\0\2\0\0\0\3") == (2, 3) and B.image_size(None) is None


def test_data_uris(spark):
    body = base64.b64encode(b"x" * 300).decode()
    rows = spark.createDataFrame([(1, f"see data:image/png;base64,{body} end"), (2, "data:image/png;base64,QUJD"), (3, None)], "id bigint, text string")
    out = {r.key: r for r in B.lift_data_uris(rows, "id", "text").collect()}
    assert out[1].text.startswith("see [blob image/png 300B sha=") and out[1].blobs[0].bytes == 300
    assert out[2].text == "data:image/png;base64,QUJD" and out[3].text is None
