"""Recall: a question to digests of the sessions that it hits; derived rules; mirrors and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import pack, salience, search
from talkloom.operators.events import positions
from talkloom.operators.order import running
from talkloom.session import cut_lineage

SMALL_SESSION, LINE_CHARS = 12, 260
MAX_HITS, BUDGET = 3, 3500
RULES_BEGIN, RULES_END = "<!-- talkloom:rules:begin -->", "<!-- talkloom:rules:end -->"
DIGEST_LIMITS = {"decision": 3, "error_fix": 2, "todo": 2, "constraint": 2}
DIGEST_LABELS = {"decision": "決定", "error_fix": "エラー→解決", "todo": "TODO", "constraint": "制約"}


def hit_sessions(docs: DataFrame, sessions: DataFrame, query: str, max_hits: int | None = MAX_HITS, source: str | None = None) -> DataFrame:
    """The best hit of each session, for the best ``max_hits`` sessions, newest session (by ``instant``) first."""
    hits = search.search(docs, query, limit=3 * max_hits if max_hits else None, source=source)
    order = [F.col("score").asc_nulls_last(), F.col("ts").desc_nulls_last(), F.col("event_id")]
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("session_key").orderBy(*order))).filter("r = 1").drop("r")
    if max_hits:
        best = best.orderBy(*order).limit(max_hits)
    named = best.join(sessions.select("session_key", "title", "first_ts", "last_ts", "instant"), "session_key", "left")
    return named.orderBy(F.col("instant").desc_nulls_last(), *order)


def event_line(mark: Column) -> Column:
    kind = F.when(F.col("kind") == "message", "").otherwise(F.concat(F.lit("("), "kind", F.lit(") ")))
    clean = T.truncate(F.coalesce(T.strip_noise("text"), F.lit("")), LINE_CHARS)
    return F.concat(mark, F.lit(" "), F.coalesce("actor", F.lit("None")), F.lit(": "), F.coalesce(kind, F.lit("")), clean, F.lit("  ⟨e:"), F.substring("event_id", 1, 8), F.lit("⟩"))


def digests(events: DataFrame, hits: DataFrame, blob_refs: DataFrame | None = None, blob_texts: DataFrame | None = None, terms: list[str] | None = None) -> DataFrame:
    """(session_key, body): the digest of each hit session.

    Small sessions are shown whole; of larger ones the surroundings of the hit, the salient lines of
    the whole session and its end. Every digest is put together from a bounded number of lines.
    """
    own = events.join(hits.select("session_key").distinct(), "session_key", "left_semi")
    placed = positions(own)
    anchor = hits.select("session_key", F.col("event_id").alias("hit_id"))
    at = placed.join(anchor, "session_key").filter("event_id = hit_id").select("session_key", F.col("pos").alias("hit_pos"))
    rows = placed.join(at, "session_key", "left")
    hit = F.col("pos") == F.col("hit_pos")
    small = F.col("session_size") <= SMALL_SESSION
    near = F.col("pos").between(F.col("hit_pos") - 2, F.col("hit_pos") + 2)
    last = F.col("pos") > F.col("session_size") - 2
    shown = rows.filter(small | near | last).filter(T.strip_noise("text").rlike(r"(?U)\S"))
    part = F.when(small, 1).when(near, 1).otherwise(3)
    lines = shown.select("session_key", part.alias("part"), "pos", F.lit(0).alias("line_no"), event_line(F.when(hit, "★").otherwise("・")).alias("line"))
    if blob_refs is not None and blob_texts is not None:
        found = rows.filter(hit).select("session_key", "event_id", "pos")
        excerpts = F.coalesce(*[T.excerpt("text", t) for t in (terms or [""])])
        proof = found.join(blob_refs, "event_id").join(blob_texts.select("sha256", F.col("text")), "sha256").withColumn("x", excerpts).filter("x is not null")
        lines = lines.unionByName(proof.select("session_key", F.lit(1).alias("part"), "pos", F.lit(1).alias("line_no"), F.concat(F.lit("    └ 📎 "), F.substring("sha256", 1, 12), F.lit(": "), "x").alias("line")))
    deduped = placed.withColumn("deduped", F.lit(False)).filter(~small)
    points = pack.section_rows(deduped)
    limits = F.create_map(*[x for k, v in DIGEST_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    labels = F.create_map(*[x for k, v in DIGEST_LABELS.items() for x in (F.lit(k), F.lit(v))])
    places = F.create_map(*[x for i, k in enumerate(DIGEST_LABELS) for x in (F.lit(k), F.lit(i))])
    points = points.filter(F.col("section").isin(*DIGEST_LIMITS)).filter(F.col("rank") <= limits[F.col("section")])
    line = F.concat(F.lit("- ["), labels[F.col("section")], F.lit("] "), T.truncate("text", 200), F.lit("  ⟨e:"), F.substring("event_id", 1, 8), F.lit("⟩"))
    lines = lines.unionByName(points.select("session_key", F.lit(2).alias("part"), (places[F.col("section")] * 100 + F.col("rank")).cast("bigint").alias("pos"), F.lit(0).alias("line_no"), line.alias("line")))
    large = rows.select("session_key", "session_size").distinct()
    heads = {1: "### ★一致箇所", 2: "### セッション全体の要点", 3: "### 終盤"}
    parts = lines.select("session_key", "part").distinct().join(large, "session_key").filter(~small)
    titles = F.create_map(*[x for k, v in heads.items() for x in (F.lit(k), F.lit(v))])
    lines = lines.unionByName(parts.select("session_key", "part", F.lit(-1).cast("bigint").alias("pos"), F.lit(0).alias("line_no"), titles[F.col("part")].alias("line")))
    body = lines.groupBy("session_key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "pos", "line_no", "line")))["line"], "\n").alias("lines"))
    info = hits.select("session_key", "title", "first_ts", "last_ts")
    head = F.concat(F.lit("## "), "session_key", F.when(F.col("title").isNotNull(), F.concat(F.lit(" — "), "title")).otherwise(""))
    span = F.concat(F.lit("("), F.coalesce("first_ts", F.lit("-")), F.lit(" → "), F.coalesce("last_ts", F.lit("-")), F.lit(" / 全"), "session_size", F.lit("イベント)"))
    return body.join(info, "session_key").join(large, "session_key").select("session_key", F.concat_ws("\n", head, span, "lines").alias("body"))


def within_budget(digest: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """Digests in order up to the budget; the first is always shown, the first overflow ends the list."""
    rows = digest.withColumn("cost", T.estimate_tokens("body"))
    by = Window.orderBy(*order)  # a few digests of one question
    rows = rows.withColumn("rank", F.row_number().over(by)).withColumn("used", F.sum("cost").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    end = rows.filter((F.col("used") > budget) & (F.col("rank") > 1)).agg(F.min("rank").alias("__end"))
    return rows.crossJoin(F.broadcast(end)).filter("__end is null or rank < __end").drop("__end")  # one row


def recall(events: DataFrame, docs: DataFrame, sessions: DataFrame, blob_refs: DataFrame, blob_texts: DataFrame, query: str, budget: int = BUDGET, max_hits: int = MAX_HITS, source: str | None = None) -> DataFrame:
    """(rank, session_key, body, cost): digests of the sessions that a question hits."""
    hits = cut_lineage(hit_sessions(docs, sessions, query, max_hits, source))  # a few rows, read several times
    found = digests(events, hits, blob_refs, blob_texts, query.split()).join(hits.select("session_key", "instant"), "session_key")
    return within_budget(found, [F.col("instant").desc_nulls_last(), F.col("session_key")], budget).select("rank", "session_key", "body", "cost")


def rules(events: DataFrame, per_section: int = 20, since: str | None = None) -> DataFrame:
    """(section, rank, text, event_id): decisions, constraints and fixes of all sessions, once each."""
    own = events if since is None else events.filter(F.col("ts").isNull() | (F.substring("ts", 1, 19) >= since))
    merged = own.withColumn("session_key", F.lit("all"))
    keys = merged.select("event_id", "session_key", F.coalesce("ts", F.lit("")).alias("order_ts"), F.coalesce("seq", F.lit(0)).alias("seq"))
    placed = running(keys, ["session_key"], [F.col("order_ts"), F.col("seq"), F.col("event_id")], {}, position="pos")
    placed = merged.join(placed.select("event_id", "pos"), "event_id")
    deduped = salience.dedup(placed)
    lines = salience.salient_lines(deduped).filter("category in ('decision', 'constraint')").select(F.col("category").alias("section"), "text", "event_id", "pos", "line_no", T.normalise_blanks("text").alias("norm"))
    errors = salience.error_fixes(deduped).filter("solved")
    text = F.concat(F.lit("ERR: "), "error", F.lit("\n → FIX: "), F.coalesce("fix", F.lit("")))
    fixes = errors.select(F.lit("error_fix").alias("section"), text.alias("text"), F.col("error_id").alias("event_id"), "pos", "line_no", F.concat(F.lit("fix::"), T.normalise_blanks(F.coalesce("fix", F.lit("")))).alias("norm"))
    rank = F.when(F.col("section") == "decision", 1).when(F.col("section") == "constraint", 2).otherwise(3)
    every = lines.unionByName(fixes).filter("norm <> ''").withColumn("place", rank)
    first = every.groupBy("norm").agg(F.min(F.struct("place", "pos", "line_no", "text", "event_id", "section")).alias("f")).select("f.*")
    order = Window.partitionBy("section").orderBy("pos", "line_no", "text")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_section).select("section", "rank", "text", "event_id")


def rules_markdown(rows: list) -> str:
    """The Markdown of rule rows (section, rank, text, event_id)."""
    titles = {"decision": "決定事項 (Decisions)", "constraint": "制約・前提 (Constraints)", "error_fix": "既知のエラーと対処 (Errors → Fixes)"}
    out: list[str] = []
    for section, heading in titles.items():
        own = sorted((r for r in rows if r.section == section), key=lambda r: r.rank)
        if own:
            out += [f"### {heading}", *[f"- {r.text}  ⟨e:{r.event_id[:8]}⟩" for r in own], ""]
    return "\n".join(out)


def into_block(text: str | None, rules_text: str) -> str:
    """A document with the rules between its markers: replaced where they stand, else appended."""
    block = f"{RULES_BEGIN}\n{rules_text}\n{RULES_END}"
    if text is None:
        return block + "\n"
    start, end = text.find(RULES_BEGIN), text.find(RULES_END)
    if 0 <= start < end:
        return text[:start] + block + text[end + len(RULES_END) :]
    return text.rstrip("\n") + ("\n\n" if text.strip() else "") + block + "\n"


def mirror(events: DataFrame, sessions: DataFrame, masked: bool = True) -> DataFrame:
    """(session_key, name, line_no, line): the Markdown mirror of each session, one row for each entry.

    A session's document is its rows in order; a document of any length is never held in one cell.
    The name has the session's key, so that equal titles do not collide.
    """
    clean = T.strip_noise("text")
    rows = positions(events).withColumn("clean", T.redact(clean) if masked else clean).filter(F.col("clean").rlike(r"(?U)\S"))
    kind = F.when(F.col("kind") == "message", "").otherwise(F.concat(F.lit(" ("), "kind", F.lit(")")))
    entry = F.concat(F.lit("## "), F.coalesce("actor", F.lit("None")), F.coalesce(kind, F.lit("")), F.lit(" — "), F.coalesce("ts", F.lit("-")), F.lit(" ⟨e:"), F.substring("event_id", 1, 8), F.lit("⟩\n\n"), "clean", F.lit("\n"))
    body = rows.select("session_key", F.col("pos").alias("line_no"), entry.alias("line"))
    name = F.concat(F.coalesce(F.substring("first_ts", 1, 10), F.lit("undated")), F.lit("-"), T.slug("title", F.element_at(F.split("session_key", ":"), -1)), F.lit("-"), F.substring(T.sha256("session_key"), 1, 8), F.lit(".md"))
    named = sessions.select("session_key", name.alias("name"), F.concat(F.lit("# "), F.coalesce("title", "session_key"), F.lit("\n")).alias("head"))
    heads = body.select("session_key").distinct().join(named, "session_key").select("session_key", F.lit(0).cast("bigint").alias("line_no"), F.col("head").alias("line"))
    return body.unionByName(heads).join(named.select("session_key", "name"), "session_key").select("session_key", "name", "line_no", "line")


def export_events(events: DataFrame) -> DataFrame:
    """(session_key, seq, line): NDJSON of the events; nothing is masked."""
    fields = ["event_id", "session_key", "source_kind", "seq", "ts", "actor", "kind", "text", "native_id", "locator"]
    return events.select("session_key", "seq", F.to_json(F.struct(*fields)).alias("line"))


def export_sessions(events: DataFrame, sessions: DataFrame, block: int = 1000) -> DataFrame:
    """(session_key, block, n_events, line): NDJSON of sessions with their events in order.

    A session longer than ``block`` events continues in further rows, so that no group is unbounded.
    """
    placed = positions(events).withColumn("block", F.floor((F.col("pos") - 1) / block).cast("bigint"))
    cells = F.struct("pos", "event_id", "ts", "actor", "kind", "text")
    own = placed.groupBy("session_key", "block").agg(F.array_sort(F.collect_list(cells)).alias("events"), F.count("*").alias("n_events"))
    named = own.join(sessions.select("session_key", "title", "first_ts", "last_ts"), "session_key", "left")
    return named.select("session_key", "block", "n_events", F.to_json(F.struct("session_key", "block", "title", "first_ts", "last_ts", "events")).alias("line"))
