"""Retention of stored tables: pruning, purging and compaction, as rewrites of whole tables."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators import events as E
from talkloom.session import cut_lineage, file_system, table_exists

TABLES = ("raw", "events", "blobs", "blob_refs", "quarantine", "cursors")
#: Bytes of one file after compaction.
FILE_BYTES = 256 << 20


def replace_table(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Writes the rows beside the table and then renames, so that readers find the old or the new one."""
    fresh, old = f"{path}__new", f"{path}__old"
    rows.write.mode("overwrite").parquet(fresh)
    fs, where = file_system(spark, path)
    paths = [file_system(spark, p)[1] for p in (fresh, old)]
    fs.delete(paths[1], True)
    if fs.exists(where):
        fs.rename(where, paths[1])
    fs.rename(paths[0], where)
    fs.delete(paths[1], True)


def prune_store(spark: SparkSession, out: str, zones: DataFrame, cutoff: str) -> dict[str, int]:
    """Deletes what is older than the cutoff (see :func:`talkloom.operators.events.prune_report`); returns the numbers.

    Events without instant stay; of the raw records those go whose events have all gone, attachments
    when no event refers to them any more.
    """
    read = lambda name: spark.read.parquet(f"{out}/{name}") if table_exists(spark, f"{out}/{name}") else None
    events = read("events")
    if events is None:
        return {}
    sizes = {name: df.count() for name in TABLES[:5] if (df := read(name)) is not None}
    dated = E.with_instant(events, zones)
    stays = dated.filter(E.kept_by_prune(dated, cutoff))
    gone = dated.filter(~E.kept_by_prune(dated, cutoff)).select(F.col("raw_id").alias("id")).filter("id is not null")
    gone = cut_lineage(gone.join(stays.select(F.col("raw_id").alias("id")).filter("id is not null"), "id", "left_anti"))
    replace_table(spark, f"{out}/events", stays.select(*events.columns))
    kept = read("events")
    raw, refs, blobs = read("raw"), read("blob_refs"), read("blobs")
    if raw is not None:
        replace_table(spark, f"{out}/raw", raw.join(gone, "id", "left_anti"))
    if refs is not None:
        replace_table(spark, f"{out}/blob_refs", refs.join(kept.select("event_id"), "event_id", "left_semi"))
    if blobs is not None:
        own = read("blob_refs")
        replace_table(spark, f"{out}/blobs", blobs.join(own, "sha256", "left_semi") if own is not None else blobs.limit(0))
    return {name: n - read(name).count() for name, n in sizes.items()}


def autoprune(spark: SparkSession, out: str, zones: DataFrame, days: int, now: datetime, last_run: datetime | None = None) -> dict[str, int] | None:
    """Prunes what is older than ``days``, at most once a day; null where it ran within the last day."""
    if last_run is not None and now - last_run < timedelta(days=1):
        return None
    return prune_store(spark, out, zones, (now - timedelta(days=days)).isoformat())


def purge(spark: SparkSession, out: str, tables: Iterable[str] = TABLES) -> list[str]:
    """Deletes whole tables; returns those that were there."""
    gone = []
    for name in tables:
        if name not in TABLES:
            raise ValueError(f"no table: {name}")
        fs, where = file_system(spark, f"{out}/{name}")
        if fs.delete(where, True):
            gone.append(name)
    return gone


def compact(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES) -> int:
    """Rewrites a table into files of about the given size; returns their number."""
    fs, where = file_system(spark, path)
    n = max(1, -(-fs.getContentSummary(where).getLength() // file_bytes))
    rows = spark.read.parquet(path)
    replace_table(spark, path, rows.coalesce(n) if rows.rdd.getNumPartitions() > n else rows.repartition(n))
    return n
