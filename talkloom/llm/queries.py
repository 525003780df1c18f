"""Queries and SQL of the text problems (1, 3, 5, 6, 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import conversations, leakage, mixing, pii, residue, secrets, truncation
from talkloom.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """All messages and all attachment texts under one key."""
    own = table(spark, d, "chat_events", "event_id", "kind", "text").filter("kind = 'message'").select(F.lit("chat_events").alias("tbl"), F.col("event_id").alias("row_key"), "text")
    blobs = table(spark, d, "blob_texts", "sha256", "text").select(F.lit("blob_texts").alias("tbl"), F.col("sha256").alias("row_key"), "text")
    return own.unionByName(blobs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each text and each type of personal information in it."""
    found = pii.find(_texts(spark, d), ["tbl", "row_key"])
    return found.select("tbl", "row_key", F.explode("spans.type").alias("pii_type")).distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All texts with typed placeholders in place of personal information."""
    return pii.find(_texts(spark, d), ["tbl", "row_key"]).select("tbl", "row_key", F.col("redacted").alias("text"))


def _credentials(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "chat_events", "event_id", "text").select(F.lit("chat_events").alias("tbl"), F.col("event_id").alias("row_key"), "text")
    payload = F.expr("make_valid_utf8(cast(payload as string))")
    raw = table(spark, d, "raw_records", "id", "payload").select(F.lit("raw_records").alias("tbl"), F.col("id").cast("string").alias("row_key"), payload.alias("text"))
    words = secrets.dictionary(events.select("text"), raw.select("text"))
    return secrets.find(events, ["tbl", "row_key"], "text", words).unionByName(secrets.find(raw, ["tbl", "row_key"], "text", words, payload=True))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each text and each type of credential in it."""
    return _credentials(spark, d).select("tbl", "row_key", F.explode("types").alias("secret_type")).distinct()


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    """All texts and payloads with the credential characters masked."""
    return _credentials(spark, d).select("tbl", "row_key", F.col("masked").alias("text"))


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_cut(table(spark, d, "chat_events", "event_id", "source_kind", "text"), ["event_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each event whose text was cut."""
    return _cuts(spark, d).filter(F.col("cut_probability") >= truncation.CUT).select("event_id").distinct()


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts: events with text, cut ones and their share; each event counts once."""
    once = _cuts(spark, d).groupBy("event_id", "source").agg(F.max("cut_probability").alias("p"))
    cut = F.count_if(F.col("p") >= truncation.CUT)
    return once.groupBy(F.col("source").alias("source_kind")).agg(F.count("*").alias("n_texts"), cut.alias("n_cut"), F.round(cut / F.count("*"), 6).alias("cut_share"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each session that must be dropped, with its first reason."""
    return conversations.validate(conversations.once(table(spark, d, "chat_events"))).filter("reason is not null").select("session_key", "reason")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The turns of all kept conversations."""
    return conversations.conversations(table(spark, d, "chat_events"))


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """All rows rebuilt as if none had a session key: each component that must be dropped, with its reason."""
    hidden = table(spark, d, "chat_events").withColumn("session_key", F.lit(None).cast("string"))
    return conversations.validate(conversations.once(hidden)).filter("reason is not null").select("session_key", "reason")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each test item that leaked into a document."""
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "lang", "text")).select("item_id", "doc_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item the number of documents and the longest run."""
    found = leakage.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "lang", "text"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("run").alias("longest_run"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "source", "text")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Each use of a document in the mixture."""
    return mixing.mixture(_documents(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each source."""
    return mixing.report(_documents(spark, d), table(spark, d, "mix_targets"))


def p9_temperature(spark: SparkSession, d: str) -> DataFrame:
    """Weights of plain temperature mixing of the sources."""
    return mixing.temperature(_documents(spark, d), table(spark, d, "mix_targets"))


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.score(table(spark, d, "documents", "doc_id", "text", "title"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document that is residue instead of content."""
    return _residue(spark, d).filter("residue").select("doc_id").distinct()


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents without them."""
    documents = table(spark, d, "documents")
    return documents.join(p10_found(spark, d), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p3_found, p3_masked, p5_found, p5_conversations, p5_rebuilt, p6_found, p6_rates, p8_found, p8_items, p9_mixture, p9_shares, p9_temperature, p10_found, p10_kept)}
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}\p{Cf}]"
_DROPPED = rf"""WITH ev AS (
        SELECT event_id, session_key, seq, lower(regexp_replace(actor, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS role, kind, coalesce(NOT regexp_full_match(text, '{_SPACE}*'), false) AS said
        FROM chat_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at NULLS FIRST) = 1),
      c AS (SELECT * FROM ev WHERE seq IS NULL OR seq <> -1),
      m AS (SELECT session_key, role, seq FROM c WHERE kind = 'message' AND said),
      s AS (SELECT k.session_key, count(c.event_id) AS n, count(c.seq) AS with_seq, count(DISTINCT c.seq) AS seqs, min(c.seq) AS low, max(c.seq) AS high,
          count(*) FILTER (WHERE c.event_id IS NOT NULL AND (c.role IS NULL OR c.role NOT IN ('user', 'assistant', 'tool', 'system'))) AS odd
        FROM (SELECT DISTINCT session_key FROM ev) k LEFT JOIN c USING (session_key) GROUP BY k.session_key),
      t AS (SELECT session_key, max(seq) FILTER (WHERE role = 'user') AS asked, max(seq) FILTER (WHERE role = 'assistant') AS answered FROM m GROUP BY session_key),
      r AS (SELECT session_key, CASE WHEN odd > 0 OR (n > 0 AND (with_seq < n OR seqs < n OR low <> 0 OR high <> n - 1)) THEN 'broken'
          WHEN asked IS NULL AND answered IS NULL THEN 'empty' WHEN coalesce(answered, -1) <= coalesce(asked, -1) THEN 'no_reply' END AS reason FROM s LEFT JOIN t USING (session_key))"""
ORACLES: dict[str, str] = {
    "p5_found": _DROPPED + " SELECT session_key, reason FROM r WHERE reason IS NOT NULL",
    # The components must be the sessions that the hidden keys name; each is known by its smallest event id.
    "p5_rebuilt": _DROPPED + " SELECT 'component:' || (SELECT min(event_id) FROM ev WHERE ev.session_key = r.session_key) AS session_key, reason FROM r WHERE reason IS NOT NULL",
    "p5_conversations": _DROPPED + rf", k AS (SELECT session_key FROM r WHERE reason IS NULL), f AS (SELECT * FROM chat_events WHERE seq <> -1 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at NULLS FIRST) = 1) SELECT session_key, seq AS turn, lower(regexp_replace(actor, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS role, kind, text FROM f WHERE session_key IN (SELECT session_key FROM k)",
}
