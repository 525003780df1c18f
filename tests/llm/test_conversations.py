import random

import pytest

from talkloom.llm import conversations as C

SCHEMA = "event_id string, session_key string, seq bigint, actor string, kind string, text string, hints string, native_id string, ingested_at timestamp, reason string, source_kind string, locator string"


def rows(session, *turns):
    return [(f"{session}{i}", session, seq, actor, kind, text, None, None, None, "x", "s", None) for i, (seq, actor, kind, text) in enumerate(turns)]


def M(seq, actor, text="t", kind="message"):
    return (seq, actor, kind, text)


SESSIONS = {
    "good": ([M(0, "user"), M(1, " Assistant ")], None), "note": ([M(-1, "system", kind="meta"), M(0, "USER"), M(1, "assistant")], None),
    "gap": ([M(0, "user"), M(2, "assistant")], "broken"), "twice": ([M(0, "user"), M(0, "assistant")], "broken"), "null_seq": ([M(0, "user"), M(None, "assistant")], "broken"),
    "start": ([M(1, "user"), M(2, "assistant")], "broken"), "who": ([M(0, "user"), M(1, "bot7")], "broken"), "nobody": ([M(0, "user"), M(1, None)], "broken"), "minus": ([M(-2, "user"), M(0, "assistant")], "broken"),
    "blank": ([M(0, "user", "　​"), M(1, "assistant", "\t\n")], "empty"), "nulls": ([M(0, "user", None), M(1, "assistant", None)], "empty"), "tools": ([M(0, "tool", "out"), M(1, "assistant", "x", "tool_use")], "empty"),
    "only_note": ([M(-1, "system")], "empty"), "open": ([M(0, "user"), M(1, "assistant"), M(2, "user")], "no_reply"), "blank_reply": ([M(0, "user"), M(1, "assistant", " ")], "no_reply"),
    "user": ([M(0, "user")], "no_reply"), "answer": ([M(0, "assistant")], None), "tool_reply": ([M(0, "user"), M(1, "tool", "x", "tool_result")], "no_reply"), "long": ([M(0, "user", "x" * 200_000), M(1, "assistant")], None),
}


def test_reasons(spark):
    data = [r for name, (turns, _) in SESSIONS.items() for r in rows(name, *turns)]
    df = spark.createDataFrame(data + data[:4], SCHEMA)  # collected again
    found = {r.session_key: r.reason for r in C.validate(C.once(df)).collect()}
    assert found == {name: reason for name, (_, reason) in SESSIONS.items()}
    kept = C.conversations(df).collect()
    assert {r.session_key for r in kept} == {n for n, (_, r) in SESSIONS.items() if r is None}
    assert [r.role for r in kept if r.session_key == "note"] == ["user", "assistant"]
    assert C.validate(C.once(df.limit(0))).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(110)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(50)] + [("x", "x"), ("a", None)]
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a and b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
        elif a:
            root(a)
    found = {r.node: r.component for r in C.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {v: root(v) for v in parent}


def test_rows_without_key(spark):
    say = lambda i, seq, actor, text, hints=None, key=None: (f"e{i}", key, seq, actor, "message", text, hints, f"n{i}", None, None, "s", None)
    data = [
        say(1, 0, "user", "How does the index work here?"), say(2, 1, "assistant", "> how does  the index work here?\nLike this."), say(3, 2, "user", "thanks", '{"reply_to": "n2"}'), say(4, 3, "assistant", "sure", '{"in_reply_to": "e3"}'),
        say(5, 0, "user", "alone", key=" "), say(6, 0, "user", "keyed", key="k"), say(7, 1, "assistant", "keyed", key="k"),
    ]
    found = {r.session_key: r.reason for r in C.validate(C.once(spark.createDataFrame(data, SCHEMA))).collect()}
    assert found == {"component:e1": None, "component:e5": "no_reply", "k": None}


def test_links_decide(spark, monkeypatch):
    """Without its links each row would be a conversation of its own."""
    from datetime import datetime

    say = lambda i, seq, actor, locator: (f"f{i}", None, seq, actor, "message", f"text {i}", None, None, datetime(2025, 1, 1, i), None, "s", locator)
    data = [say(1, 0, "user", "/x/a.jsonl::0"), say(2, 1, "assistant", "/x/a.jsonl::1"), say(3, None, "user", "/x/b.jsonl::0"), say(4, None, "assistant", "/x/b.jsonl::1"), say(5, 0, "user", None)]
    df = spark.createDataFrame(data, SCHEMA)
    found = {r.session_key: r.reason for r in C.validate(C.once(df)).collect()}
    assert found == {"component:f1": None, "component:f3": None, "component:f5": "no_reply"}  # b.jsonl is numbered by time
    assert sorted((r.session_key, r.turn, r.role) for r in C.conversations(df).collect()) == [("component:f1", 0, "user"), ("component:f1", 1, "assistant"), ("component:f3", 0, "user"), ("component:f3", 1, "assistant")]
    monkeypatch.setattr(C, "links", lambda rows: rows.selectExpr("event_id as a", "event_id as b"))
    assert len(C.validate(C.once(df)).collect()) == 5


def test_components_of_hubs_and_no_convergence(spark, monkeypatch):
    monkeypatch.setattr(C, "HUB_EDGES", 10)
    edges = [("hub", f"h{i:04d}") for i in range(3000)] + [(f"h{i:04d}", f"k{i:04d}") for i in range(0, 3000, 7)]
    df = spark.createDataFrame(edges, "a string, b string")
    found = C.connected_components(df).collect()
    assert {r.component for r in found} == {"h0000"} and len(found) == 3001 + 429
    path = spark.createDataFrame([(f"p{i:03d}", f"p{i + 1:03d}") for i in range(200)], "a string, b string")
    with pytest.raises(RuntimeError):
        C.connected_components(path, max_rounds=1)
