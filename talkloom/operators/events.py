"""The canonical event table: identity, slices, roll-ups, joins and statistics."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import timestamps
from talkloom.operators.order import running

COLUMNS = ["event_id", "session_key", "source_kind", "seq", "ts", "actor", "kind", "text", "hints", "native_id", "locator", "raw_id", "ingested_at"]


def insert_if_absent(rows: DataFrame, key: str = "event_id", columns: list[str] | None = None) -> DataFrame:
    """One row for each key, the earliest collected: what repeated inserts leave in a store."""
    columns = columns or COLUMNS
    rest = [c for c in columns if c not in (key, "ingested_at")]
    first = rows.groupBy(key).agg(F.min(F.struct("ingested_at", *rest)).alias("e"))
    return first.select(key, "e.ingested_at", *[F.col(f"e.{c}").alias(c) for c in rest]).select(*columns)


def canonical(rows: DataFrame) -> DataFrame:
    """Unique events with trimmed, lower-case actors and the hinted file path."""
    events = insert_if_absent(rows)
    return events.withColumn("actor", F.lower(F.trim("actor"))).withColumn("file_path", F.get_json_object("hints", "$.file_path"))


def with_instant(rows: DataFrame, zones: DataFrame, stamp: str = "ts", out: str = "instant") -> DataFrame:
    """Adds the UTC instant (microseconds since 1970) that a stamp of any spelling denotes, or null.

    Stamps are never compared as text: their spellings and zones differ.
    """
    return timestamps.normalise(rows, zones, stamp, out=out).drop(f"{out}_form")


def iso(micros: Column | str) -> Column:
    """An instant in microseconds as UTC text of one form."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_text(instant: int) -> str:
    """An instant in microseconds as ISO text, on the driver."""
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=instant)).isoformat()


def micros(cutoff: str) -> int:
    """An ISO cutoff with zone in microseconds since 1970."""
    when = datetime.fromisoformat(cutoff)
    if when.tzinfo is None:
        raise ValueError(f"cutoff without zone: {cutoff}")
    return (when - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def recomputed_ids(events: DataFrame) -> DataFrame:
    fp = T.text_fingerprint("text")
    cols = [F.col(c) for c in ("source_kind", "session_key", "native_id", "locator", "kind")]
    return events.select("event_id", fp.alias("fingerprint"), T.event_id(*cols, fp).alias("content_id"))


def source_filter(source: str | None) -> Column:
    """Substring of the source kind without regard to case; blank means all."""
    s = (source or "").strip().lower()
    return F.contains(F.lower("source_kind"), F.lit(s)) if s else F.lit(True)


def session_order() -> list[Column]:
    return [F.col("seq").asc_nulls_first(), F.col("ts").asc_nulls_first(), F.col("event_id")]


def positions(events: DataFrame) -> DataFrame:
    """The events with their position (from 1) and the size of their session.

    Only ids and order are sorted and checkpointed; the positions are then joined to the rows.
    """
    order = [F.coalesce("seq", F.lit(-(1 << 62))), F.coalesce("ts", F.lit("")), F.col("event_id")]
    keys = events.select("event_id", "session_key", "seq", "ts")
    placed = running(keys, ["session_key"], order, {}, position="pos", size="session_size")
    return events.join(placed.select("event_id", "pos", "session_size"), "event_id")


def tail(events: DataFrame, n: int) -> DataFrame:
    """The last n events of every session, in order."""
    return positions(events).filter(F.col("pos") > F.col("session_size") - n)


def since_ts(events: DataFrame, ts: str) -> DataFrame:
    """Events with a stamp greater than ``ts`` as a string; those without stamp are left out."""
    return events.filter(F.col("ts") > ts)


def since_event(events: DataFrame, prefix: str) -> DataFrame:
    """Events after the first one whose id starts with the prefix, in its session; none if unknown."""
    placed = positions(events)
    start = placed.filter(F.col("event_id").startswith(prefix)).groupBy("session_key").agg(F.min("pos").alias("__from"))
    return placed.join(start, "session_key").filter(F.col("pos") > F.col("__from")).drop("__from")


def context(events: DataFrame, hits: DataFrame, before: int = 2, after: int = 4) -> DataFrame:
    """Each hit (event_id) with its neighbours in the session; ``hit_id`` names the hit, ``off`` the distance.

    Every hit yields the few positions around it, which join on session and position: an equi-join
    instead of a theta join, so that hot sessions spread over their positions.
    """
    placed = positions(events)
    found = placed.join(hits.select("event_id").distinct(), "event_id", "left_semi").select("session_key", F.col("event_id").alias("hit_id"), "pos")
    around = found.select("session_key", "hit_id", F.col("pos").alias("hit_pos"), F.explode(F.sequence(F.col("pos") - before, F.col("pos") + after)).alias("pos"))
    return placed.join(around, ["session_key", "pos"]).withColumn("off", F.col("pos") - F.col("hit_pos")).drop("hit_pos")


def first_line_title(text: Column) -> Column:
    line = F.element_at(T.lines(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), 1)
    return T.truncate(line, 60)


def session_rollup(events: DataFrame) -> DataFrame:
    """Number of events, first and last instant (see :func:`with_instant`), and title: a title hint, else the first user text.

    ``instant`` is the last one in microseconds, by which sessions are ordered.
    """
    arrival = F.struct("ingested_at", "event_id")
    hint = F.get_json_object("hints", "$.title")
    user = (F.col("actor") == "user") & F.coalesce(T.strip_noise("text"), F.lit("")).rlike(r"(?U)\S")
    title = F.coalesce(
        F.max_by(hint, F.when(hint.isNotNull(), arrival)),
        F.min_by(first_line_title(T.strip_noise("text")), F.when(user, arrival)),
    )
    return events.groupBy("session_key").agg(
        F.min("source_kind").alias("source_kind"), F.count("*").alias("n_events"), iso(F.min("instant")).alias("first_ts"), iso(F.max("instant")).alias("last_ts"), title.alias("title"), F.max("instant").alias("instant")
    )


def list_sessions(sessions: DataFrame, limit: int = 30, source: str | None = None) -> DataFrame:
    """Newest activity first, by the instant of ``last_ts`` (column ``instant``); sessions without one last."""
    return sessions.filter(source_filter(source)).orderBy(F.col("instant").desc_nulls_last(), "session_key").limit(limit)


def latest_session(sessions: DataFrame, source: str | None = None) -> DataFrame:
    """(session_key) of the most recently active session of a source, by instant."""
    return list_sessions(sessions.filter("instant is not null"), 1, source).select("session_key")


def stats(events: DataFrame, sessions: DataFrame, raw: DataFrame, blob_texts: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(metric, value) counts and sums over all tables; each table is read once."""
    one = lambda name, df, agg: df.agg(agg.alias("value")).select(F.lit(name).alias("metric"), F.col("value").cast("bigint").alias("value"))
    parts = [
        one("events", events, F.countDistinct("event_id")),
        one("sessions", sessions, F.count("*")),
        one("raw_records", raw, F.count("*")),
        one("raw_bytes", raw, F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))),
        one("blob_texts", blob_texts, F.count_if(F.col("chars") > 0)),
        one("quarantine", quarantine, F.count("*")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def orphan_blobs(blob_texts: DataFrame, blob_refs: DataFrame) -> DataFrame:
    return blob_texts.join(blob_refs, "sha256", "left_anti")


def blob_candidates(blob_refs: DataFrame, blob_texts: DataFrame) -> DataFrame:
    """Referenced attachments that have no text yet: candidates for another extraction."""
    have = blob_texts.filter("chars > 0 and length(text) > 0")
    return blob_refs.select("sha256").distinct().join(have, "sha256", "left_anti")


def evidence(blob_refs: DataFrame, blob_texts: DataFrame, terms: list[str]) -> DataFrame:
    """(event_id, sha256, excerpt) of attachments in which a term occurs; the first term that does."""
    found = F.coalesce(*[T.excerpt("text", term) for term in terms])
    return blob_refs.join(blob_texts.select("sha256", "text"), "sha256").select("event_id", "sha256", found.alias("excerpt")).filter("excerpt is not null")


def tool_pairs(events: DataFrame) -> DataFrame:
    """Tool results with their tool call: the one with the same tool id, else the latest call before.

    The n-th call and the result that follows n calls pair by a running count of calls, so that
    several calls or other events in between do no harm. Tool ids are hints of the events
    (``tool_use_id``), which the test tables lack.
    """
    called = (F.col("kind") == "tool_use").cast("int")
    rows = events.select("event_id", "session_key", "seq", "ts", "kind", F.get_json_object("hints", "$.tool_use_id").alias("tool_id"), F.regexp_extract("text", r"^\[tool_use (\w+)\]", 1).alias("tool_name"))
    order = [F.coalesce("seq", F.lit(-(1 << 62))), F.coalesce("ts", F.lit("")), F.col("event_id")]
    counted = running(rows.filter("kind in ('tool_use', 'tool_result')"), ["session_key"], order, {"call_no": called})
    calls = counted.filter("kind = 'tool_use'").select("session_key", "call_no", F.col("event_id").alias("call_id"), "tool_name")
    results = counted.filter("kind = 'tool_result'").select("session_key", "event_id", "call_no", "tool_id")
    by_id = counted.filter("kind = 'tool_use' and tool_id is not null").groupBy("session_key", "tool_id").agg(F.min(F.struct("call_no", F.col("event_id").alias("id"), F.col("tool_name").alias("name"))).alias("own"))
    paired = results.join(calls, ["session_key", "call_no"], "left").join(by_id, ["session_key", "tool_id"], "left")
    out = paired.select("session_key", "event_id", F.coalesce("own.id", "call_id").alias("call_id"), F.coalesce("own.name", "tool_name").alias("tool_name"))
    return out.filter("call_id is not null")


def kept_by_prune(events: DataFrame, cutoff: str) -> Column:
    """Events at or after the cutoff, and those whose stamp denotes no instant."""
    return F.col("instant").isNull() | (F.col("instant") >= micros(cutoff))


def prune_report(events: DataFrame, raw: DataFrame, quarantine: DataFrame, cutoff: str) -> DataFrame:
    """What pruning would delete: old events (those without instant stay), unneeded raw rows, old rejects.

    ``events`` and ``quarantine`` have an ``instant`` (see :func:`with_instant`).
    """
    kept = events.filter(kept_by_prune(events, cutoff)).select(F.col("raw_id").alias("id")).filter("id is not null")
    old_raw = raw.filter(F.unix_micros("ingested_at") < micros(cutoff)).join(kept, "id", "left_anti")
    parts = [("events", events.filter(~kept_by_prune(events, cutoff))), ("raw_records", old_raw), ("quarantine", quarantine.filter(F.col("instant") < micros(cutoff)))]
    out = None
    for name, df in parts:
        row = df.agg(F.count("*").alias("n_deleted")).select(F.lit(name).alias("tbl"), "n_deleted")
        out = row if out is None else out.unionByName(row)
    return out


def prune_survivors(events: DataFrame, cutoff: str) -> DataFrame:
    """Events that pruning keeps."""
    return events.filter(kept_by_prune(events, cutoff))


def reaggregate(events: DataFrame) -> DataFrame:
    """Sessions counted again; those without events are gone."""
    return events.groupBy("session_key").agg(F.count("*").alias("n_events"), iso(F.min("instant")).alias("first_ts"), iso(F.max("instant")).alias("last_ts"))
