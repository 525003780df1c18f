"""Substring full-text search with BM25 ranking over trigram lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators.events import source_filter
from talkloom.session import cut_lineage

K1, B = 1.2, 0.75
#: Characters of an attachment's text that belong to the searched text of its event.
ATTACHMENT_CHARS = 4000


def search_text(events: DataFrame, blob_refs: DataFrame, blob_texts: DataFrame) -> DataFrame:
    """event_id + doc: the event's text and the first part of each attachment, in order of their hashes."""
    parts = blob_refs.join(blob_texts.filter("length(text) > 0").select("sha256", "text"), "sha256")
    part = F.concat(F.lit("[添付 "), F.substring("sha256", 1, 12), F.lit("]\n"), F.substring("text", 1, ATTACHMENT_CHARS))
    # An event has few attachments; parts are cut before they are gathered.
    extra = parts.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("sha256", part.alias("p"))))["p"], "\n").alias("__extra"))
    return events.join(extra, "event_id", "left").withColumn("doc", F.concat_ws("\n", T.strip_noise("text"), "__extra")).drop("__extra")


def _occurrences(doc: Column, term: str) -> Column:
    """Overlapping occurrences without regard to case."""
    quoted = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in term.lower())
    return F.coalesce(F.regexp_count(F.lower(doc), F.lit(f"(?={quoted})")), F.lit(0))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Adds ``score`` (ascending is best) to the documents that hold every term.

    Statistics cover all rows; they are one row, joined to the hits.
    """
    counts = {f"__f{i}": _occurrences(F.col("doc"), t) for i, t in enumerate(terms)}
    rows = docs.withColumns(counts).withColumn("__len", F.greatest(F.lit(0), F.length("doc") - 2))
    totals = rows.agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(c) > 0).alias(f"{c}n") for c in counts])
    hits = rows.filter(" and ".join(f"{c} > 0" for c in counts)).crossJoin(F.broadcast(totals))  # one row against the hits
    score = F.lit(0.0)
    for c in counts:
        idf = F.log((F.col("__n") - F.col(f"{c}n") + 0.5) / (F.col(f"{c}n") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        f = F.col(c).cast("double")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    return hits.withColumn("score", score).drop(*counts, *[f"{c}n" for c in counts], "__len", "__n", "__avg")


def snippet(text: Column | str, term: str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.substring(t, F.greatest(F.lit(1), F.instr(t, term) - 40), F.lit(120))


def search(docs: DataFrame, query: str, limit: int | None = 10, source: str | None = None) -> DataFrame:
    """Events that hold all terms, best first: (event_id, session_key, ts, actor, snippet, score).

    Terms of three characters and more are matched without regard to case and ranked by BM25;
    shorter ones must occur as written. Where that finds nothing, all terms are matched in the
    event's own text, newest first. Filters come before the limit; null ``limit`` gives all hits.
    """
    terms = query.split()
    long_terms, short_terms = [t for t in terms if len(t) >= 3], [t for t in terms if len(t) < 3]
    columns = ["event_id", "session_key", "ts", "actor", "snippet", "score"]
    if long_terms:
        hits = bm25(docs, long_terms).filter(source_filter(source))
        for t in short_terms:
            hits = hits.filter(F.contains("doc", F.lit(t)))
        hits = cut_lineage(hits.select("event_id", "session_key", "ts", "actor", "doc", "score"))  # scored once, then tested and read
        if not hits.isEmpty():
            out = hits.withColumn("snippet", snippet("doc", terms[0])).select(*columns)
            return out.orderBy("score", "event_id").limit(limit) if limit else out
    hits = docs.filter(source_filter(source)) if terms else docs.filter(F.lit(False))
    for t in terms:
        hits = hits.filter(F.contains(F.lower("text"), F.lit(t.lower())))
    out = hits.withColumn("snippet", snippet("text", terms[0] if terms else "")).withColumn("score", F.lit(None).cast("double")).select(*columns)
    return out.orderBy(F.col("ts").desc_nulls_last(), "event_id").limit(limit) if limit else out


def trigrams(docs: DataFrame) -> DataFrame:
    """(gram, event_id, n): the posting table of a trigram index, for repeated searches."""
    t = F.lower("doc")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 2)), lambda i: F.substring(t, i, F.lit(3)))
    rows = docs.filter(F.length("doc") >= 3).select("event_id", F.explode(grams).alias("gram"))
    return rows.groupBy("gram", "event_id").agg(F.count("*").alias("n"))


def search_index(postings: DataFrame, docs: DataFrame, term: str) -> DataFrame:
    """Events that hold a term, by intersecting its trigrams' postings and checking the text."""
    grams = sorted({term.lower()[i : i + 3] for i in range(len(term) - 2)})
    found = postings.filter(F.col("gram").isin(grams)).groupBy("event_id").agg(F.countDistinct("gram").alias("k")).filter(F.col("k") == len(grams))
    return docs.join(found.select("event_id"), "event_id", "left_semi").filter(F.contains(F.lower("doc"), F.lit(term.lower())))
