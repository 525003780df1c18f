"""What a client asks for: sessions, contexts, recent events and attachments, in bounded form."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import events as E
from talkloom.operators import pack

SLIM_CHARS, MAX_EVENTS, MAX_CHARS = 1500, 200, 60_000
RECENT_DAYS, RECENT_EVENTS = 14, 5000
BLOB_BYTES = 5 * 1024 * 1024


def slim_text() -> Column:
    return T.truncate(F.coalesce(T.strip_noise("text"), F.lit("")), SLIM_CHARS)


def slim(events: DataFrame, *extra: str) -> DataFrame:
    """event_id, ts, actor, kind and the first characters of the text, without noise."""
    return events.select(*extra, "event_id", "ts", "actor", "kind", slim_text().alias("text"))


def trimmed(rows: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(session_key, returned, truncated, events): JSON of the newest events of each session that fits.

    ``rows`` are slim rows with session_key and pos, at most ``MAX_EVENTS`` of a session, so that its
    window is bounded. The oldest are left out until the JSON has at most ``max_chars`` characters.
    """
    cell = F.struct("event_id", "ts", "actor", "kind", "text")
    sized = rows.withColumn("cell", F.to_json(cell))
    newest = Window.partitionBy("session_key").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    # Each cell but the first brings a comma, and the brackets count two.
    sized = sized.withColumn("size", F.sum(F.length("cell") + 1).over(newest) + 1)
    fits = F.col("size") <= max_chars
    out = sized.groupBy("session_key").agg(F.count_if(fits).alias("returned"), (F.count_if(~fits) > 0).alias("truncated"), F.array_sort(F.collect_list(F.when(fits, F.struct("pos", "cell"))))["cell"].alias("cells"))
    return out.select("session_key", "returned", "truncated", F.concat(F.lit("["), F.array_join("cells", ","), F.lit("]")).alias("events"))


def sessions_compact(events: DataFrame, max_events: int = MAX_EVENTS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(session_key, total, returned, truncated, events): every session in compact form."""
    last = E.tail(events, max_events)
    total = last.groupBy("session_key").agg(F.max("session_size").alias("total"))
    return total.join(trimmed(slim(last, "session_key", "pos"), max_chars), "session_key")


def get_session(events: DataFrame, sessions: DataFrame, key: str, max_events: int = MAX_EVENTS, since_event_id: str = "", since_ts: str = "", compact: bool = True, max_chars: int = MAX_CHARS) -> DataFrame:
    """One session; ``latest`` or ``latest:<source>`` names the most recently active one (by instant).

    Compact sessions are one row as in :func:`sessions_compact`, others their last events as rows. An
    unknown event id gives no events.
    """
    if key == "latest" or key.startswith("latest:"):
        own = events.join(E.latest_session(sessions, key.partition(":")[2] or None), "session_key", "left_semi")
    else:
        own = events.filter(F.col("session_key") == key)
    if since_event_id:
        own = E.since_event(own, since_event_id).drop("pos", "session_size")
    if since_ts:
        own = E.since_ts(own, since_ts)
    return sessions_compact(own, max_events, max_chars) if compact else E.tail(own, max_events)


def get_context(events: DataFrame, event_id: str, before: int = 2, after: int = 4) -> DataFrame:
    """The slim neighbours of the event with this id or prefix, with the distance ``off``."""
    hits = events.filter(F.col("event_id").startswith(event_id)).orderBy("event_id").limit(1)
    return slim(E.context(events, hits, before, after), "session_key", "off")


def get_blob_text(texts: DataFrame, sha256: str) -> DataFrame:
    """extractor, chars and text of one attachment."""
    return texts.filter(F.col("sha256") == sha256).select("sha256", "extractor", "chars", "text")


def get_blob_base64(blobs: DataFrame, sha256: str, most: int = BLOB_BYTES) -> DataFrame:
    """mime, bytes and Base64 of one attachment; ``error`` instead of the data where it is too large."""
    size = F.octet_length("content")
    fits = size <= most
    return blobs.filter(F.col("sha256") == sha256).select("sha256", "mime", size.cast("bigint").alias("bytes"), F.when(fits, F.base64("content")).alias("b64"), F.when(~fits, "too large").alias("error"))


def by_prefix(events: DataFrame, prefix: str) -> DataFrame:
    """Events with this id or an id that starts with it."""
    return events.filter(F.col("event_id").startswith(prefix))


def recent(events: DataFrame, now: str, days: int = RECENT_DAYS) -> DataFrame:
    """Events of the last days before ``now`` by instant, and those without instant."""
    cutoff = datetime.fromisoformat(now) - timedelta(days=days)
    return events.filter(E.kept_by_prune(events, cutoff.isoformat()))


def recent_events(events: DataFrame, now: str, days: int = RECENT_DAYS, limit: int = RECENT_EVENTS) -> DataFrame:
    """The oldest ``limit`` of the recent events, oldest first; those without instant come first."""
    return recent(events, now, days).orderBy(F.col("instant").asc_nulls_first(), F.col("seq").asc_nulls_first(), "event_id").limit(limit)


def get_context_pack(events: DataFrame, query: str = "", budget: int = pack.BUDGET, session_key: str = "", now: str = "", days: int = RECENT_DAYS) -> DataFrame:
    """The pack of one session, or of all recent events as one thread; those need an ``instant``."""
    if session_key:
        return pack.packs(events.filter(F.col("session_key") == session_key), query, budget)
    rows = recent_events(events, now, days).withColumn("session_key", F.lit("recent"))
    return pack.packs(rows.withColumn("seq", F.lit(0).cast("bigint")).withColumn("ts", E.iso("instant")), query, budget)


def project_sessions(events: DataFrame, sessions: DataFrame, project: str) -> DataFrame:
    """(session_key) of sessions whose key and title, or the locator of whose first event, hold the text."""
    named = sessions.filter(F.contains(F.concat_ws(" ", "session_key", "title"), F.lit(project))).select("session_key")
    order = F.struct(F.coalesce("seq", F.lit(-(1 << 62))), F.coalesce("ts", F.lit("")), "event_id")
    first = events.groupBy("session_key").agg(F.min_by("locator", order).alias("locator"))
    return named.unionByName(first.filter(F.contains("locator", F.lit(project))).select("session_key")).distinct()


def savings(deduped: DataFrame, folded: DataFrame) -> DataFrame:
    """(metric, value): characters and tokens that references and differences save.

    ``folded`` has text and folded_text of folded versions.
    """
    own = deduped.filter("deduped").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(T.estimate_tokens("text")), F.lit(0)).alias("tokens"))
    diff = folded.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text") - F.length("folded_text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(T.estimate_tokens("text") - T.estimate_tokens("folded_text")), F.lit(0)).alias("tokens"))
    rows = [df.selectExpr(f"stack(3, '{name}_texts', n, '{name}_chars', chars, '{name}_tokens', tokens) as (metric, value)") for name, df in (("dedup", own), ("fold", diff))]
    return rows[0].unionByName(rows[1]).withColumn("value", F.col("value").cast("bigint"))
