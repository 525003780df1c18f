"""Incremental ingestion: new and grown files to raw, event, attachment and quarantine tables.

The tables are written one after the other, and a batch that runs again after a failure writes only
what is missing: every table has keys by which a row is added once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.session import table_exists
from talkloom.sources import parsers

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _append_new(batch: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the table does not hold yet; a repeated batch adds nothing.

    The table's scan reads the key columns only.
    """
    spark = batch.sparkSession
    rows = batch.dropDuplicates(keys)
    if table_exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    rows = rows.persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(path)
        return n
    finally:
        rows.unpersist()


def write_batch(lines: DataFrame, out: str, source_kind: str) -> dict[str, int]:
    """One batch of raw lines into ``out``/raw, events, blobs, blob_refs and quarantine; returns what was added."""
    raw = lines.withColumn("source_kind", F.lit(source_kind)).withColumn("sha256", F.sha2("payload", 256))
    parsed = parsers.CATALOGUE[source_kind](raw).persist()
    cols = [F.col(c) for c in ("source_kind", "session_key", "native_id", "locator", "kind")]
    events = parsed.filter("error is null").withColumn("event_id", T.event_id(*cols, F.col("fingerprint")))
    bad = parsed.filter("error is not null").select("source_kind", "locator", "error", "raw_id")
    quarantine = bad.join(raw.select(F.col("id").alias("raw_id"), "payload"), "raw_id").drop("raw_id")
    good = raw.join(bad.select("locator").distinct(), "locator", "left_anti")
    refs = events.select("event_id", F.explode("blobs.sha256").alias("sha256"))
    try:
        return {
            "raw": _append_new(good, f"{out}/raw", ["locator", "sha256"]),
            "events": _append_new(events.drop("blobs", "fingerprint", "error"), f"{out}/events", ["event_id"]),
            "blobs": _append_new(parsers.blob_store(events), f"{out}/blobs", ["sha256"]),
            "blob_refs": _append_new(refs, f"{out}/blob_refs", ["event_id", "sha256"]),
            "quarantine": _append_new(quarantine, f"{out}/quarantine", ["locator", "error"]),
        }
    finally:
        parsed.unpersist()


def closed_lines(files: DataFrame) -> DataFrame:
    """(id, locator ``path::n``, payload) of the lines of whole files; a last line without end waits for the next read."""
    text = F.expr("make_valid_utf8(cast(content as string))")
    closed = F.regexp_replace(text, r"[^\n]*\z", "")
    rows = files.select("path", F.posexplode(F.split(closed, "\n")).alias("n", "line")).filter("trim(line) <> ''")
    locator = F.concat("path", F.lit("::"), "n")
    return rows.select(F.xxhash64(locator).alias("id"), locator.alias("locator"), F.encode("line", "UTF-8").alias("payload"))


def whole_files(files: DataFrame) -> DataFrame:
    """(id, locator, payload) of files that hold one record each (Markdown chats, dropped conversations)."""
    return files.select(F.xxhash64("path").alias("id"), F.col("path").alias("locator"), F.col("content").alias("payload"))


#: Sources whose files hold one record each.
ONE_RECORD = ("aider", "chatgpt_web")


def _records(files: DataFrame, source_kind: str) -> DataFrame:
    return whole_files(files) if source_kind in ONE_RECORD else closed_lines(files)


def ingest_files(spark: SparkSession, source: str, out: str, checkpoint: str, source_kind: str = "claude_code", glob: str = "*.jsonl", once: bool = True, archive: str | None = None, on_new: Callable[[dict[str, int]], None] | None = None):
    """A streaming query that reads new files of a folder; ``once`` ends when all are read.

    Files count as read through the checkpoint, so that each is read once: for files that grow, use
    :func:`ingest_changed`. With ``archive`` read files are moved there after they were committed;
    ``on_new`` is called with the counts of each batch that added events.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if archive:
        files = files.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def each(batch: DataFrame, _: int) -> None:
        added = write_batch(_records(batch, source_kind), out, source_kind)
        if on_new and added["events"]:
            on_new(added)

    writer = files.load(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def ingest_changed(spark: SparkSession, source: str, out: str, source_kind: str = "claude_code", glob: str = "*.jsonl") -> dict[str, int]:
    """Reads the files that are new or were written to since the last call; returns what was added.

    The cursor is the latest modification time that was read: it reaches the file listing, so that
    older files are not opened. A grown file is read whole, and its known lines add nothing; a
    line that had no end before is read now; a file that shrank or was replaced adds what differs.
    """
    cursor = f"{out}/cursors"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(source)
    if table_exists(spark, cursor):
        mark = spark.read.parquet(cursor).filter(F.col("source") == source).agg(F.max("modified")).first()[0]
        files = files.filter(F.col("modificationTime") >= F.lit(mark)) if mark else files
    mark = files.agg(F.max("modificationTime").alias("m")).first().m  # taken before the read: later writes are read again
    if mark is None:
        return {"raw": 0, "events": 0, "blobs": 0, "blob_refs": 0, "quarantine": 0}
    added = write_batch(_records(files, source_kind), out, source_kind)
    spark.createDataFrame([(source, mark)], "source string, modified timestamp").write.mode("append").parquet(cursor)
    return added


def session_counts(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Running state of sessions over a stream of events; without watermark late rows simply count."""
    rows = events.withWatermark("ingested_at", watermark) if watermark else events
    return rows.groupBy("session_key").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def windowed_counts(events: DataFrame, ts: str = "ts", every: str = "1 hour", keys: tuple[str, ...] = (), slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Tumbling or sliding counts, batch or streaming."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    window = F.window(ts, every, slide) if slide else F.window(ts, every)
    return rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
