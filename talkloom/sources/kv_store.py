"""A key-value SQLite store as a Spark data source, batch and incremental by rowid."""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "rowid bigint, key string, value string"


def _snapshot(path: str, folder: str) -> str:
    """A private copy of a live database with its log files."""
    copy = os.path.join(folder, "copy.db")
    for suffix in ("", "-wal", "-shm"):
        if os.path.exists(path + suffix):
            shutil.copyfile(path + suffix, copy + suffix)
    return copy


def read_rows(path: str, table: str, above: int, below: int | None = None) -> Iterator[tuple[int, str, str]]:
    """Rows with a value and rowid in (above, below], in order; a missing table has none."""
    if not table.isidentifier():
        raise ValueError(f"no table name: {table}")
    with tempfile.TemporaryDirectory() as folder:
        con = sqlite3.connect(_snapshot(path, folder))
        try:
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            if not con.execute("SELECT 1 FROM sqlite_master WHERE type='table' AND name=?", (table,)).fetchone():
                return
            for rowid, key, value in con.execute(f"SELECT rowid, key, value FROM {table} WHERE rowid > ? AND (? IS NULL OR rowid <= ?) ORDER BY rowid", (above, below, below)):
                if value is not None:
                    yield int(rowid), str(key), value if isinstance(value, str) else bytes(value).decode("utf-8", "replace")
        finally:
            con.close()


def last_rowid(path: str, table: str) -> int:
    rows = list(read_rows(path, table, -1))
    return rows[-1][0] if rows else 0


class _Range(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.table = options["path"].split(","), options.get("table", "cursorDiskKV")

    def partitions(self):
        return [_Range(p) for p in self.paths]

    def read(self, partition):
        yield from read_rows(partition.path, self.table, -1)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "cursorDiskKV")

    def initialOffset(self):
        return {"rowid": 0}

    def read(self, start):
        rows = list(read_rows(self.path, self.table, int(start["rowid"])))
        return iter(rows), {"rowid": rows[-1][0] if rows else int(start["rowid"])}

    def readBetweenOffsets(self, start, end):
        return read_rows(self.path, self.table, int(start["rowid"]), int(end["rowid"]))

    def commit(self, end):
        pass


class KeyValueSource(DataSource):
    """Options: path (batch: several, separated by commas) and table."""

    @classmethod
    def name(cls):
        return "kvstore"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)
