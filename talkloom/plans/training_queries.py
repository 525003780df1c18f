"""Queries of the general training-data problems (2, 4 and 7) over the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators import drift, quarantine, timestamps
from talkloom.session import spread
from talkloom.sources.tables import table


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.split_rows(spread(table(spark, d, "quarantine", "id", "source_kind", "payload")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each quarantine row that does not load, with its first reason."""
    return _judged(spark, d).filter("reason is not null").select("id", "reason").distinct()


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Each quarantine row that loads after all, with its decoded record."""
    return _judged(spark, d).filter("reason is null").select("id", "source_kind", "record")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rows by source kind and outcome."""
    return _judged(spark, d).groupBy("source_kind", F.coalesce("reason", F.lit("loads")).alias("outcome")).agg(F.count("*").alias("n"))


def _stamps(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "chat_events", "event_id", "source_kind", "ts")
    sessions = table(spark, d, "sessions", "session_key", "source_kind", "first_ts", "last_ts")
    own = events.select(F.lit("chat_events").alias("tbl"), F.col("event_id").alias("row_key"), F.lit("ts").alias("col_name"), "source_kind", F.col("ts").alias("stamp"))
    both = sessions.select(F.lit("sessions").alias("tbl"), F.col("session_key").alias("row_key"), "source_kind", F.expr("stack(2, 'first_ts', first_ts, 'last_ts', last_ts) as (col_name, stamp)"))
    rows = own.unionByName(both)
    return timestamps.normalise(rows, table(spark, d, "source_zones"), "stamp")


def _outcome() -> Column:
    """missing, none (senseless or impossible), canonical or rewritten."""
    return F.when(F.col("epoch_us_form").isin("senseless", "impossible"), "none").otherwise(F.col("epoch_us_form"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each stamp that denotes an instant in another spelling than the canonical one."""
    return _stamps(spark, d).filter("epoch_us_form = 'rewritten'").select("tbl", "row_key", "col_name", "epoch_us").distinct()


def p4_normalised(spark: SparkSession, d: str) -> DataFrame:
    """All stamps with their instant as text in one form (null where there is none)."""
    text = F.date_format(F.timestamp_micros("epoch_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return _stamps(spark, d).select("tbl", "row_key", "col_name", "stamp", text.alias("utc"), _outcome().alias("form"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Stamps by source kind, column and outcome."""
    return _stamps(spark, d).groupBy("source_kind", "col_name", _outcome().alias("form")).agg(F.count("*").alias("n"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records", "id", "source_kind", "locator", "payload").filter("not (source_kind <=> 'aider')")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each lasting change of payload fields."""
    return drift.drift_report(_payloads(spark, d)).select("source_kind", "change_type", "field_path", "new_path").distinct()


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    """The changes with the file day from which (for removals: up to which) they hold."""
    return drift.drift_report(_payloads(spark, d))


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """One consistent table of all JSON payloads."""
    return drift.consistent_table(_payloads(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p2_reasons, p4_found, p4_normalised, p4_forms, p7_found, p7_changes, p7_table)}
