"""Queries over the conversation log: each operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import events as E
from talkloom.operators import pack, recall, salience, search, serving
from talkloom.sources import parsers
from talkloom.sources.tables import table
from talkloom.streaming import ingest

PHRASE, TWO_TERMS, SHORT_TERMS, RARE = "token estimator", "quarantine laptop", "retries 12", "Q x"
QUERY = "retention job keeps the lock file"
INDEXED, PROJECT = "estimator", "/2025/07/"
CUTOFF = "2025-07-01T00:00:00Z"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return E.canonical(table(spark, d, "chat_events"))


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_zones")


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Unique events with their instants."""
    return E.with_instant(_events(spark, d), _zones(spark, d))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with the instant of their last stamp."""
    return E.with_instant(table(spark, d, "sessions"), _zones(spark, d), "last_ts")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return search.search_text(_events(spark, d), table(spark, d, "blob_refs"), table(spark, d, "blob_texts"))


def _deduped(spark: SparkSession, d: str) -> DataFrame:
    return salience.dedup(E.positions(_events(spark, d)))


def _documents_as_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as one sequence of results, of which those with one title are versions of a file."""
    docs = table(spark, d, "documents", "doc_id", "title", "text")
    rows = docs.select(F.lit("all").alias("grp"), F.col("doc_id").cast("string").alias("event_id"), F.col("title").alias("file_path"), F.lit("tool_result").alias("kind"), "text", F.col("doc_id").alias("pos"))
    return salience.dedup(rows, "grp")


def ces_events(spark, d):
    """Unique events: what repeated inserts leave."""
    return _events(spark, d).select("event_id", "session_key", "source_kind", "seq", "ts", "actor", "kind", "text", "file_path", "raw_id")


def event_ids(spark, d):
    return E.recomputed_ids(_events(spark, d))


def stats_overview(spark, d):
    return E.stats(*(table(spark, d, t) for t in ("chat_events", "sessions", "raw_records", "blob_texts", "quarantine")))


def stats_per_source(spark, d):
    return _dated(spark, d).groupBy("source_kind").agg(F.count("*").alias("n"), E.iso(F.min("instant")).alias("oldest"))


def session_rollup(spark, d):
    return E.session_rollup(_dated(spark, d)).drop("instant")


def list_sessions(spark, d):
    """The 30 sessions of one family of sources with the newest activity: the limit is the feature."""
    return E.list_sessions(_sessions(spark, d), 30, "c").select("session_key", E.iso("instant").alias("last_at"), "n_events", "title")


def latest_sessions(spark, d):
    """The newest session of each source."""
    s = _sessions(spark, d).filter("instant is not null")
    newest = s.groupBy("source_kind").agg(F.max(F.struct("instant", "session_key")).alias("m"))
    return newest.select("source_kind", "m.session_key", E.iso("m.instant").alias("last_at"))


def session_tail(spark, d):
    return E.tail(_events(spark, d), 5).select("session_key", "event_id", "pos")


def since_ts(spark, d):
    return E.since_ts(_events(spark, d), CUTOFF).select("session_key", "event_id", "ts")


def since_event(spark, d):
    return E.since_event(_events(spark, d), "a").select("session_key", "event_id", "pos")


def context_around(spark, d):
    e = _events(spark, d)
    return E.context(e, e.filter(F.col("text").contains("KeyError")), 2, 4).select("hit_id", "event_id", "off")


def text_metrics(spark, d):
    e = _events(spark, d)
    clean = T.strip_noise("text")
    tokens = T.tokenize("text")
    return e.select("event_id", F.length(clean).alias("clean_chars"), T.estimate_tokens("text").cast("bigint").alias("tokens"), F.coalesce(F.size(tokens), F.lit(0)).cast("bigint").alias("n_terms"), T.sha256(F.array_join(tokens, " ")).alias("terms_sha"), T.truncate("text", 40).alias("head"))


def media_kinds(spark, d):
    path = F.coalesce("file_path", "locator")
    return _events(spark, d).select("event_id", T.media_kind(F.lit(None).cast("string"), path).alias("media"), T.human_size(F.octet_length("text") * 37).alias("size"))


def search_phrase(spark, d):
    return search.search(_docs(spark, d), PHRASE, limit=None).select("event_id", "session_key", F.round("score", 6).alias("score"))


def search_and_short(spark, d):
    return search.search(_docs(spark, d), SHORT_TERMS, limit=None).select("event_id", F.round("score", 6).alias("score"))


def search_source(spark, d):
    return search.search(_docs(spark, d), TWO_TERMS, limit=None, source=" Claude ").select("event_id", F.round("score", 6).alias("score"), "snippet")


def search_fallback(spark, d):
    return search.search(_docs(spark, d), RARE, limit=None).select("event_id", "ts", "snippet")


def search_top(spark, d):
    """The ten best hits: the limit is the feature."""
    return search.search(_docs(spark, d), PHRASE, limit=10).withColumn("score", F.round("score", 6))


def search_indexed(spark, d):
    """Events that hold a term, found by the postings of its trigrams."""
    docs = _docs(spark, d)
    return search.search_index(search.trigrams(docs), docs, INDEXED).select("event_id", "session_key")


def trigram_postings(spark, d):
    return search.trigrams(_docs(spark, d)).groupBy("gram").agg(F.count("*").alias("n_events"), F.sum("n").alias("n_total"))


def exact_dedup(spark, d):
    return _documents_as_versions(spark, d).filter("deduped").select("event_id", "first_id")


def version_pairs(spark, d):
    return salience.versions(_documents_as_versions(spark, d), "grp").select("file_path", F.col("version").cast("bigint").alias("version"), "event_id", "next_id", "folded")


def version_diffs(spark, d):
    return salience.fold(salience.versions(_documents_as_versions(spark, d), "grp"))


def salience_lines(spark, d):
    return salience.salient_lines(_deduped(spark, d)).select("session_key", "category", "text", "event_id")


def error_fixes(spark, d):
    return salience.error_fixes(_deduped(spark, d)).select("session_key", "error_id", "error", "fix_id", "solved")


def artifacts(spark, d):
    return salience.artifacts(_deduped(spark, d)).select("session_key", "path", "event_id")


def tfidf(spark, d):
    w = pack.tfidf(pack.thread(_deduped(spark, d)), QUERY)
    return w.groupBy("session_key", "event_id").agg(F.count("*").alias("n_tokens"), F.round(F.max("w"), 6).alias("top_w"), F.round(F.sum("w"), 5).alias("sum_w"))


def cosine_query(spark, d):
    return pack.cosine(pack.thread(_deduped(spark, d)), QUERY).select("session_key", "event_id", F.round("cosine", 6).alias("cosine"))


def base_score(spark, d):
    return pack.base_scores(_deduped(spark, d), QUERY).select("session_key", "event_id", "i", F.round("base", 6).alias("base"))


def mmr_packs(spark, d):
    return pack.packs(_events(spark, d), QUERY)


def recall_sessions(spark, d):
    """The best hit of each session that a question hits."""
    return recall.hit_sessions(_docs(spark, d), _sessions(spark, d), PHRASE, None).select("session_key", "event_id", F.round("score", 6).alias("score"), "title", "last_ts")


def recall_digests(spark, d):
    """Digests of the three best sessions within the budget: the limits are the feature."""
    refs, texts = table(spark, d, "blob_refs"), table(spark, d, "blob_texts")
    return recall.recall(_events(spark, d), _docs(spark, d), _sessions(spark, d), refs, texts, PHRASE)


def evidence(spark, d):
    return E.evidence(table(spark, d, "blob_refs"), table(spark, d, "blob_texts"), ["index", "TODO"]).select("event_id", "sha256", "excerpt")


def rules(spark, d):
    """Derived rules, at most twenty of a section: the limit is the feature."""
    return recall.rules(_events(spark, d))


def redacted(spark, d):
    return _events(spark, d).select("event_id", T.redact("text").alias("text"))


def redact_counts(spark, d):
    return salience.redaction_counts(_events(spark, d))


def html_text(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.html_text("text").alias("text"))


def prune_report(spark, d):
    quarantine = E.with_instant(table(spark, d, "quarantine", "id", "source_kind", "ts"), _zones(spark, d))
    return E.prune_report(_dated(spark, d), table(spark, d, "raw_records"), quarantine, CUTOFF)


def prune_survivors(spark, d):
    return E.reaggregate(E.prune_survivors(_dated(spark, d), CUTOFF))


def orphan_blobs(spark, d):
    return E.orphan_blobs(table(spark, d, "blob_texts"), table(spark, d, "blob_refs")).select("sha256", "chars")


def blob_candidates(spark, d):
    return E.blob_candidates(table(spark, d, "blob_refs"), table(spark, d, "blob_texts")).select("sha256")


def raw_of_sessions(spark, d):
    """Raw records that events of long sessions came from."""
    e = _events(spark, d)
    long = e.groupBy("session_key").agg(F.count("*").alias("n")).filter("n >= 20").select("session_key")
    ids = e.join(long, "session_key", "left_semi").select(F.col("raw_id").alias("id"))
    return table(spark, d, "raw_records", "id", "source_kind", "locator").join(ids, "id", "left_semi")


def tool_pairs(spark, d):
    return E.tool_pairs(_events(spark, d))


def mirror_docs(spark, d):
    return recall.mirror(_events(spark, d), table(spark, d, "sessions")).select("session_key", "name", "line_no", "line")


def export_events(spark, d):
    return recall.export_events(_events(spark, d))


def export_sessions(spark, d):
    return recall.export_sessions(_events(spark, d), table(spark, d, "sessions"))


def quarantine_list(spark, d):
    """The twenty newest rejects of one family of sources: the limit is the feature."""
    q = table(spark, d, "quarantine").filter(E.source_filter("c"))
    return q.select("id", "ts", "source_kind", "locator", "error", F.octet_length("payload").cast("bigint").alias("payload_bytes")).orderBy(F.desc("id")).limit(20)


def quarantine_unique(spark, d):
    """Rejects as the store keeps them: one for each locator and error."""
    return table(spark, d, "quarantine").groupBy("locator", "error").agg(F.min("id").alias("id"))


def raw_unique(spark, d):
    """Raw records by locator and content, the first collected of each."""
    return table(spark, d, "raw_records", "id", "locator", "sha256", "ingested_at").groupBy("locator", "sha256").agg(F.min(F.struct("ingested_at", "id")).alias("m")).select("locator", "sha256", "m.id")


def key_prefixes(spark, d):
    """The eight most frequent key prefixes: the limit is the feature."""
    p = F.substring_index("session_key", ":", 1)
    return _events(spark, d).groupBy(p.alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(8)


def _parsed(spark, d):
    return parsers.parse_all(table(spark, d, "raw_records"))


def parsed_events(spark, d):
    """All raw records through their source's parser, with their hints; messages of drops have their repetition as id."""
    hint = lambda name: F.get_json_object("hints", f"$.{name}").alias(name)
    repeated = F.when((F.col("source_kind") == "chatgpt_web") & (F.col("kind") == "message"), F.element_at(F.split("native_id", ":"), -1)).otherwise(F.col("native_id"))
    hints = [hint(n) for n in ("cwd", "git_branch", "cc_version", "model", "title")]
    return _parsed(spark, d).select("raw_id", "source_kind", "locator", "session_key", repeated.alias("native_id"), "ts", "actor", "kind", "text", *hints, "error")


def parsed_counts(spark, d):
    return _parsed(spark, d).groupBy("source_kind", "kind", "actor", "error").agg(F.count("*").alias("n"))


def parsed_ids(spark, d):
    """Fingerprints and ids of parsed events; messages of drops, whose ids hash the whole message, are in ``parsed_events``."""
    cols = [F.col(c) for c in ("source_kind", "session_key", "native_id", "locator", "kind")]
    return _parsed(spark, d).filter("error is null and source_kind <> 'chatgpt_web'").select("raw_id", "native_id", "kind", "session_key", "source_kind", "locator", "text", "fingerprint", T.event_id(*cols, F.col("fingerprint")).alias("event_id"))


def markdown_sessions(spark, d):
    return parsers.markdown_chat(table(spark, d, "raw_records").filter("source_kind = 'aider'")).select("raw_id", "session_key", "native_id", "actor", "text")


def json_shapes(spark, d):
    return parsers.json_shape(table(spark, d, "raw_records").filter("source_kind <> 'aider'"))


def sessions_compact(spark, d):
    """Every session as a client gets it: its last 200 events, shortened, up to 60,000 characters of JSON."""
    return serving.sessions_compact(_events(spark, d)).select("session_key", "total", "returned", "truncated")


def slim_events(spark, d):
    return serving.slim(_events(spark, d))


def recent_events(spark, d):
    """The oldest 5,000 events of the last fortnight before the cutoff: the limit is the feature."""
    return serving.recent_events(_dated(spark, d), CUTOFF).select("event_id", E.iso("instant").alias("at"), "seq")


def project_sessions(spark, d):
    return serving.project_sessions(_events(spark, d), table(spark, d, "sessions"), PROJECT)


def id_prefix(spark, d):
    return serving.by_prefix(_events(spark, d), "a1").select("event_id", "session_key")


def blob_lookup(spark, d):
    """Each reference with its attachment's text, if there is one."""
    texts = table(spark, d, "blob_texts", "sha256", "extractor", "chars")
    return table(spark, d, "blob_refs").join(texts, "sha256", "left").select("event_id", "sha256", "extractor", "chars")


def savings(spark, d):
    """What references save in the log: repeated texts of each session."""
    deduped = _deduped(spark, d)
    none = deduped.filter(F.lit(False)).select("text", F.col("text").alias("folded_text"))
    return serving.savings(deduped, none).filter("metric like 'dedup%'")


def latest_tail(spark, d):
    """The last five events of the most recently active session."""
    return serving.get_session(_events(spark, d), _sessions(spark, d), "latest", 5, compact=False).select("session_key", "event_id", "pos")


def tumbling_counts(spark, d):
    """Hourly counts of the event stream by type (an extension: the log has no windows)."""
    return ingest.windowed_counts(table(spark, d, "events"), keys=("event_type",))


QUERIES = {
    f.__name__: f
    for f in (
        ces_events, event_ids, stats_overview, stats_per_source, session_rollup, list_sessions, latest_sessions, session_tail, since_ts, since_event, context_around,
        text_metrics, media_kinds, search_phrase, search_and_short, search_source, search_fallback, search_top, search_indexed, trigram_postings, exact_dedup, version_pairs, version_diffs,
        salience_lines, error_fixes, artifacts, tfidf, cosine_query, base_score, mmr_packs, recall_sessions, recall_digests, evidence, rules, redacted, redact_counts, html_text,
        prune_report, prune_survivors, orphan_blobs, blob_candidates, raw_of_sessions, tool_pairs, mirror_docs, export_events, export_sessions, quarantine_list, quarantine_unique,
        raw_unique, key_prefixes, parsed_events, parsed_counts, parsed_ids, markdown_sessions, json_shapes,
        sessions_compact, slim_events, recent_events, project_sessions, id_prefix, blob_lookup, savings, latest_tail, tumbling_counts,
    )
}
