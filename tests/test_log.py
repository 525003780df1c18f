"""Small fixtures for the log operators, with values worked out by hand or by plain Python."""

import difflib
import json
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import events as E
from talkloom.operators import pack, recall, salience, search
from talkloom.operators.order import running

SCHEMA = "event_id string, session_key string, source_kind string, seq bigint, ts string, actor string, kind string, text string, hints string, native_id string, locator string, raw_id bigint, ingested_at timestamp"


def event(i, text, session="s", actor="user", kind="message", seq=None, ts=None, hints=None, source="claude_code"):
    seq = i if seq is None else seq
    return (f"{i:032x}", session, source, seq, ts or f"2025-01-01T00:{i:02d}:00Z", actor, kind, text, hints, f"n{i}", f"/f::{i}", None, None)


LONG = "word " * 60
EVENTS = [
    event(0, "Please fix the index\nTODO: write tests"),
    event(1, "Traceback here\nError: bad index", actor="tool", kind="tool_result", hints='{"file_path": "a.py"}'),
    event(2, "Error: another", actor="assistant"),
    event(3, "Error: third\nIt is fixed now", actor="assistant"),
    event(4, LONG),
    event(5, LONG),
    event(6, "short"),
    event(7, "short"),
    event(8, '[tool_use Write] {"file_path": "/x/a.py"}', actor="assistant", kind="tool_use"),
    event(9, "Exception: open", actor="assistant"),
    event(10, None),
    event(11, "", session="other", seq=0),
]


@pytest.fixture(scope="module")
def events(spark):
    return E.canonical(spark.createDataFrame(EVENTS + EVENTS[:3], SCHEMA)).cache()


def test_insert_if_absent(events):
    assert events.count() == len(EVENTS)


def test_slices(events):
    assert [r.seq for r in E.tail(events, 2).filter("session_key = 's'").orderBy("pos").collect()] == [9, 10]
    assert E.since_event(events, f"{8:032x}").count() == 2
    assert E.since_event(events, "zz").count() == 0
    hit = events.filter("seq = 0 and session_key = 's'")
    assert sorted(r.off for r in E.context(events, hit, 2, 3).collect()) == [0, 1, 2, 3]


@pytest.fixture(scope="module")
def dated(spark, events):
    return E.with_instant(events, zones(spark)).cache()


def zones(spark):
    return spark.createDataFrame([("claude_code", "America/New_York", "mdy")], "source_kind string, tz_name string, date_order string")


def test_rollup(dated):
    rows = {r.session_key: r for r in E.session_rollup(dated).collect()}
    assert rows["s"].n_events == 11 and rows["s"].title == "Please fix the index"
    assert rows["other"].title is None
    assert (rows["s"].first_ts, rows["s"].last_ts) == ("2025-01-01T00:00:00.000000Z", "2025-01-01T00:10:00.000000Z")


MIXED = ["1735689600", "2025-01-01 00:30:00", "Wed, 01 Jan 2025 09:00:00 +0900", "01/01/2025 01:00:00 AM", "1735693200000", None, "yesterday"]


def test_retention_compares_instants(spark):
    """Stamps of many spellings: as text, epoch numbers would all be older than any ISO cutoff."""
    rows = spark.createDataFrame([event(i, "t", ts=ts)[:4] + (ts,) + event(i, "t")[5:] for i, ts in enumerate(MIXED)], SCHEMA)
    dated = E.with_instant(rows, zones(spark))
    kept = {int(r.event_id, 16) for r in E.prune_survivors(dated, "2025-01-01T01:00:00Z").collect()}
    assert kept == {1, 3, 4, 5, 6}  # 05:30 and 06:00 UTC in New York, 01:00 UTC, and those without instant
    assert E.latest_session(E.session_rollup(dated)).first().session_key == "s"
    with pytest.raises(ValueError):
        E.micros("2025-01-01")


def test_tool_pairs(spark):
    """Several calls, other events in between, and tool ids that say otherwise."""
    use = lambda i, hints=None: event(i, f"[tool_use T{i}] {{}}", actor="assistant", kind="tool_use", hints=hints)
    result = lambda i, hints=None: event(i, "out", actor="tool", kind="tool_result", hints=hints)
    rows = [result(0), use(1), event(2, "wait"), result(3), use(4, '{"tool_use_id": "a"}'), use(5), result(6, '{"tool_use_id": "a"}'), result(7)]
    got = {int(r.event_id, 16): (int(r.call_id, 16), r.tool_name) for r in E.tool_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {3: (1, "T1"), 6: (4, "T4"), 7: (5, "T5")}


def test_salted_join(spark):
    from talkloom.operators.skew import salted_join

    rows = spark.range(5000).selectExpr("if(id < 4000, 'hot', concat('k', id % 7)) as k", "id")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = salted_join(rows, sizes, ["k"], "n", "id", hot_rows=100)
    assert out.count() == 5000 and out.filter("k = 'hot' and n = 4000").count() == 4000


def test_running_splits_hot_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("g"), F.col("id").alias("x"), (F.col("id") % 3).alias("v"))
    out = running(rows, ["g"], [F.col("x")], {"total": F.col("v")}, position="pos", size="n").collect()
    seen = {"hot": 0, "cold": 0}
    for r in sorted(out, key=lambda r: r.x):
        seen[r.g] += r.v
        assert (r.total, r.pos, r.n) == (seen[r.g], r.x + 1 if r.g == "hot" else r.x - 3999, 4000 if r.g == "hot" else 1000)


def test_dedup_and_salience(events):
    d = salience.dedup(E.positions(events)).cache()
    assert [(r.event_id, r.first_id) for r in d.filter("deduped").collect()] == [(f"{5:032x}", f"{4:032x}")]
    lines = {(r.category, r.text) for r in salience.salient_lines(d).collect()}
    assert ("todo", "TODO: write tests") in lines
    fixes = [(r.error, r.solved, r.fix) for r in salience.error_fixes(d).orderBy("pos", "line_no").collect()]
    # the last two errors up to the fix, which counts itself; the open one stays unsolved
    assert fixes == [("Error: another", True, "It is fixed now"), ("Error: third", True, "It is fixed now"), ("Exception: open", False, None)]
    assert [(r.path, r.event_id) for r in salience.artifacts(d).collect()] == [("/x/a.py", f"{8:032x}")]


def sequential_pairs(rows):
    """Errors and fixes by walking through the events."""
    pending, out = [], []
    for i, (errors, fix) in enumerate(rows):
        pending += [(i, e) for e in range(errors)]
        if fix and pending:
            out += [(p, i) for p in pending[-2:]]
            pending = []
    return sorted(out + [(p, None) for p in pending[-3:]], key=repr)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), min_size=1, max_size=14))
def test_error_fix_grouping(spark, rows):
    texts = ["\n".join([f"Error: {i} {e}" for e in range(n)] + (["resolved"] if fix else [])) for i, (n, fix) in enumerate(rows)]
    df = spark.createDataFrame([event(i, t or "-", actor="assistant") for i, t in enumerate(texts)], SCHEMA)
    d = salience.dedup(E.positions(E.canonical(df)))
    got = sorted((((r.pos - 1, r.line_no), None if r.fix_id is None else int(r.fix_id, 16)) for r in salience.error_fixes(d).collect()), key=repr)
    assert got == sequential_pairs(rows)


def test_versions(spark):
    old, new = "\n".join(f"line {i}" for i in range(80)), "\n".join(f"line {i if i != 40 else 'x'}" for i in range(80))
    hint = '{"file_path": "f.py"}'
    df = spark.createDataFrame([event(0, old, kind="tool_result", hints=hint), event(1, new, kind="tool_result", hints=hint)], SCHEMA)
    pairs = salience.versions(salience.dedup(E.positions(E.canonical(df))))
    body = salience.fold(pairs).first().folded_text
    want = "\n".join(difflib.unified_diff(old.splitlines(), new.splitlines(), "f.py (v1)", "f.py (v2)", lineterm="", n=2))
    assert body.split("\n", 1)[1] == want


def test_search(spark, events):
    refs = spark.createDataFrame([("ab" * 32, f"{6:032x}")], "sha256 string, event_id string")
    texts = spark.createDataFrame([("ab" * 32, "plain", 9, "zebra zebra"), ("cd" * 32, None, 0, None)], "sha256 string, extractor string, chars bigint, text string")
    docs = search.search_text(events, refs, texts).cache()
    assert [r.event_id for r in search.search(docs, "ZEBRA").collect()] == [f"{6:032x}"]  # found in the attachment
    assert search.search(docs, "index Er").count() == 1
    assert search.search(docs, "nowhere").count() == 0 and search.search(docs, "").count() == 0
    assert search.search(docs, "Er").count() == 3  # short terms fall back to the text
    scores = [r.score for r in search.search(docs, "error", limit=None).collect()]
    assert scores == sorted(scores) and all(s < 0 for s in scores)
    grams = search.trigrams(docs)
    assert {r.event_id for r in search.search_index(grams, docs, "index").collect()} == {r.event_id for r in docs.filter("doc like '%index%'").collect()}
    assert E.blob_candidates(refs, texts.filter("chars = 0")).count() == 1
    assert E.orphan_blobs(texts, refs).count() == 1
    assert E.evidence(refs, texts, ["zzz", "zebra"]).first().excerpt == "zebra zebra"


def test_pack_and_recall(spark, events, dated):
    body = pack.packs(events, "index", budget=300).filter("session_key = 's'").first()
    assert "決定事項" not in body.body and "TODO: write tests" in body.body and body.used_tokens <= 300
    assert pack.packs(events, budget=5).first().n_selected == 0
    sessions = E.session_rollup(dated)
    refs = spark.createDataFrame([], "sha256 string, event_id string")
    texts = spark.createDataFrame([], "sha256 string, extractor string, chars bigint, text string")
    docs = search.search_text(events, refs, texts)
    out = recall.recall(events, docs, sessions, refs, texts, "index").collect()
    assert len(out) == 1 and "★ tool:" in out[0].body
    assert recall.recall(events, docs, sessions, refs, texts, "nowhere").count() == 0
    rows = recall.rules(events).collect()
    assert {r.section for r in rows} == {"error_fix"}
    once = recall.into_block("# A\n", recall.rules_markdown(rows))
    assert recall.into_block(once, recall.rules_markdown(rows)) == once
    lines = recall.mirror(events, sessions).filter("session_key = 's'").orderBy("line_no").collect()
    assert lines[0].line.startswith("# Please fix") and len({r.name for r in lines}) == 1
    assert recall.export_sessions(events, sessions, block=4).filter("session_key = 's'").count() == 3
    assert recall.export_events(events).count() == len(EVENTS)


def test_mmr_prefers_difference():
    vectors = [{"a": 1.0}, {"a": 1.0}, {"b": 1.0}]
    assert pack.select_diverse([1.0, 0.99, 0.8], vectors, [1, 1, 1], 2) == [0, 2]
    assert pack.select_diverse([1.0, 0.9], vectors[:2], [5, 1], 4) == []  # ends at the first that does not fit
    assert pack.select_diverse([0.5, 0.5], [{}, {}], [1, 1], 2) == [0, 1]  # ties: the earlier first


def test_prune(spark, dated):
    raw = spark.createDataFrame([(1, None)], "id bigint, ingested_at timestamp")
    q = E.with_instant(spark.createDataFrame([("claude_code", "2024-01-01 00:00:00")], "source_kind string, ts string"), zones(spark))
    report = {r.tbl: r.n_deleted for r in E.prune_report(dated, raw, q, "2025-01-01T00:05:00Z").collect()}
    assert report == {"events": 5, "raw_records": 0, "quarantine": 1}
    assert E.reaggregate(E.prune_survivors(dated, "2026-01-01T00:00:00Z")).count() == 0


def test_serving(spark, events, dated):
    from talkloom.operators import serving as V

    sessions = E.session_rollup(dated)
    one = V.get_session(events, sessions, "s", max_events=4).first()
    cells = json.loads(one.events)
    assert (one.total, one.returned, one.truncated) == (11, 4, False) and [c["event_id"][-1] for c in cells] == ["7", "8", "9", "a"]
    short = V.get_session(events, sessions, "s", max_events=11, max_chars=700).first()
    assert short.truncated and len(short.events) <= 700 and json.loads(short.events)[-1]["event_id"][-1] == "a"
    assert V.get_session(events, sessions, "latest:claude", compact=False).count() == 1  # the session with the last stamp
    assert V.get_session(events, sessions, "s", since_event_id=f"{8:032x}", compact=False).count() == 2
    assert V.get_session(events, sessions, "s", since_event_id="zz", compact=False).count() == 0 and V.get_session(events, sessions, "nobody").count() == 0
    assert [r.off for r in V.get_context(events, f"{3:032x}", 1, 1).orderBy("off").collect()] == [-1, 0, 1]
    texts = spark.createDataFrame([("ab", "plain", 3, "abc")], "sha256 string, extractor string, chars bigint, text string")
    blobs = spark.createDataFrame([("ab", "image/png", b"12345"), ("cd", None, b"123456789")], "sha256 string, mime string, content binary")
    assert V.get_blob_text(texts, "ab").first().text == "abc" and V.get_blob_text(texts, "x").count() == 0
    assert V.get_blob_base64(blobs, "ab").first().b64 == "MTIzNDU=" and V.get_blob_base64(blobs, "cd", most=5).first().error == "too large"
    assert V.by_prefix(events, "0" * 31).count() == len(EVENTS)
    assert [r.seq for r in V.recent_events(dated, "2025-01-01T00:12:00+00:00", days=1, limit=3).collect()] == [0, 1, 2]
    assert V.recent(dated, "2026-01-01T00:00:00+00:00", 1).count() == 0
    assert {r.session_key for r in V.project_sessions(events, sessions, "Please fix").collect()} == {"s"}
    assert {r.session_key for r in V.project_sessions(events, sessions, "/f::").collect()} == {"s", "other"}
    assert "Please fix" in V.get_context_pack(dated, now="2025-01-01T01:00:00+00:00").first().body
    deduped = salience.dedup(E.positions(events))
    saved = {r.metric: r.value for r in V.savings(deduped, deduped.filter("seq = 0 and session_key = 's'").selectExpr("text", "'x' as folded_text")).collect()}
    assert saved["dedup_texts"] == 1 and saved["dedup_chars"] == len(LONG) and saved["dedup_tokens"] == 60 and saved["fold_chars"] == len(EVENTS[0][7]) - 1


def test_packs_fold_versions(spark):
    old, new = "\n".join(f"TODO: line {i}" for i in range(80)), "\n".join(f"TODO: line {i if i != 40 else 'x'}" for i in range(80))
    hint = '{"file_path": "f.py"}'
    df = spark.createDataFrame([event(0, old, kind="tool_result", hints=hint), event(1, new, kind="tool_result", hints=hint), event(2, "hello there")], SCHEMA)
    folded = {r.seq: r.text for r in salience.with_folded(salience.dedup(E.positions(E.canonical(df)))).collect()}
    assert folded[0].startswith("[snapshot折り畳み f.py v1") and folded[1] == new and folded[2] == "hello there"
    assert "hello there" in pack.packs(E.canonical(df)).first().body


TEXTS = ["a b  c_1 日本語 é!", "\x1b[31mred\x1b[0m x\r y", "a\n\n\n\nb<system-reminder>x\ny</system-reminder>  z", "", "日 本語テスト ABC", "　​", "x" * 200]


def test_text_functions(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "i int, t string")
    out = {r.i: r for r in rows.select("i", T.estimate_tokens("t").alias("n"), T.tokenize("t").alias("w"), T.strip_noise("t").alias("c"), T.truncate("t", 50).alias("x")).collect()}
    for i, t in enumerate(TEXTS):
        assert out[i].n == len(re.findall(r"[A-Za-z0-9_]+", t)) + len(re.findall(r"[^\sA-Za-z0-9_]", t))
        assert len(out[i].x) <= 50
    assert out[0].w == ["a", "b", "c_1", "日本", "本語"]
    assert out[1].c == " y" and out[2].c == "a\n\nbz"
    assert out[4].w == ["abc", "日", "本語", "語テ", "テス", "スト"]
    assert out[99].n == 0 and out[99].c is None


def test_sizes_and_slugs(spark):
    sizes = [(None, "?B"), (0, "?B"), (5, "5B"), (1023, "1023B"), (1536, "1.5KB"), (9472, "9.2KB"), (5 * 1024**2, "5.0MB"), (3 * 1024**3, "3.0GB")]
    rows = spark.createDataFrame([(n, w) for n, w in sizes], "n bigint, w string").select("w", T.human_size("n").alias("s"), T.media_kind(F.lit("image/png"), F.lit("")).alias("m"), T.slug(F.lit(" a/b c! "), F.lit("f")).alias("g")).collect()
    assert all(r.w == r.s for r in rows) and rows[0].m == "画像" and rows[0].g == "a-b-c"


def test_redaction(spark):
    key = "sk-" + "a1B2" * 6
    rows = [(f"x {key} y", "x [REDACTED:anthropic/openai-key] y"), ("postgres://u:" + "pa55word" + "@h/d", "postgres://u:[REDACTED:url-credential]@h/d"), ("password: " + "h" * 9, "password: [REDACTED:assignment]"), ("the password is short", "the password is short"), (None, None), ("", "")]
    out = spark.createDataFrame(rows, "t string, want string").withColumn("got", T.redact("t")).collect()
    assert all(r.got == r.want for r in out)
    counts = {r.label: r.n for r in salience.redaction_counts(spark.createDataFrame(rows, "text string, want string")).collect()}
    assert counts == {"anthropic/openai-key": 1, "url-credential": 1, "assignment": 1}


def test_sql_functions(spark):
    from talkloom.functions import sql

    assert "strip_noise" in sql.register(spark)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").selectExpr("i", "t", "strip_noise(t) AS c", "estimate_tokens(t) AS n", "truncate_text(t, 50) AS x", "sha8(t) AS s", "normalise_blanks(t) AS b")
    columns = rows.withColumn("c2", T.strip_noise("t")).withColumn("n2", T.estimate_tokens("t")).withColumn("x2", T.truncate("t", 50)).collect()
    assert all((r.c, r.n, r.x) == (r.c2, r.n2, r.x2) and len(r.s) == 8 for r in columns)
    more = rows.selectExpr("tokenize_text(t) AS w", "media_kind('', concat(t, '.mp4')) AS m", "human_size(length(t) * 1000) AS h", "t").withColumn("w2", T.tokenize("t")).withColumn("m2", T.media_kind(F.lit(""), F.concat("t", F.lit(".mp4")))).withColumn("h2", T.human_size(F.length("t") * 1000)).collect()
    assert all((r.w, r.m, r.h) == (r.w2, r.m2, r.h2) for r in more)
    spark.createDataFrame([("a", "s", "2025", "one Two three"), ("b", "s", None, "two"), ("c", "s", "2026", "four")], "event_id string, session_key string, ts string, doc string").createOrReplaceTempView("docs")
    sql.register_search(spark)
    assert [r.event_id for r in spark.sql("SELECT event_id FROM search_texts('TWO', 5) ORDER BY ts DESC NULLS LAST").collect()] == ["a", "b"] and spark.sql("SELECT * FROM search_texts('two', 1)").count() == 1


def test_command_line(capsys, spark, tmp_path):
    from talkloom.__main__ import main
    from tests.conftest import DATA

    main(["key_prefixes", DATA])
    assert "claude_code" in capsys.readouterr().out
    main(["session", DATA, "latest"])
    assert '"returned"' in capsys.readouterr().out
    main(["sessions", DATA, "claude"])
    assert capsys.readouterr().out.count("session_key") > 3
    main(["nothing"])
    assert "Queries:" in capsys.readouterr().out
    main(["key_prefixes", DATA, str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0


def test_pack_similarities_of_whole_texts(spark, monkeypatch):
    """Weights count words of whole texts, with document frequencies over the thread and the query."""
    monkeypatch.setattr(pack, "CANDIDATES", 6)
    words = "alpha beta gamma delta index plan".split()
    texts = [" ".join(words[(i * k + k) % 6] for k in range(1, 5)) + f" own{i}" for i in range(14)]
    texts[12], texts[13] = ("pad " * 1500 + f"{tail} " * 3000 for tail in ("gamma", "delta"))
    rows = spark.createDataFrame([(f"{i:08x}" + "0" * 24, *event(i, t)[1:]) for i, t in enumerate(texts)], SCHEMA)
    scored = {r.event_id[:8]: r for r in pack.base_scores(salience.dedup(E.positions(rows)), "index").collect()}
    docs = [re.findall(r"\w+", t) for t in [*texts, "index"]]
    vectors = {}
    for i, d in enumerate(docs[:-1]):
        w = {t: d.count(t) / len(d) * math.log(1 + len(docs) / sum(t in x for x in docs)) for t in set(d)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors[f"{i:08x}"] = {t: x / norm for t, x in w.items()}
    best = sorted(scored, key=lambda e: (-scored[e].base, scored[e].i))[:6]
    body = pack.packs(rows, "index", budget=800).first().body
    got = re.findall(r"^\*\*.*⟨e:(\w+)⟩$", body, re.M)
    order = pack.select_diverse([scored[e].base for e in best], [vectors[e] for e in best], [1] * 6, len(got))
    assert 1 < len(got) < 6 and set(got) == {best[i] for i in order}
