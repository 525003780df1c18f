"""Thin command line: ``python -m talkloom QUERY DIR [OUT]`` or ``python -m talkloom COMMAND ...``.

Commands over a folder of tables: ``search DIR TEXT``, ``recall DIR TEXT``, ``pack DIR [SESSION]``,
``sessions DIR [SOURCE]``, ``session DIR KEY``, ``context DIR EVENT``, ``rules DIR``; over a store:
``ingest SOURCE OUT KIND``, ``compact OUT TABLE``, ``purge OUT TABLE...``.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession

from talkloom.operators import recall, search, serving
from talkloom.operators import events as E
from talkloom.plans import log_queries, registry
from talkloom.session import local_session, ship_package
from talkloom.sources.tables import table
from talkloom.streaming import ingest, retention


def _sessions(spark: SparkSession, d: str, source: str = "") -> DataFrame:
    return E.list_sessions(log_queries._sessions(spark, d), 20, source).select("session_key", "source_kind", "last_ts", "n_events", "title")


def _recall(spark: SparkSession, d: str, text: str) -> DataFrame:
    refs, texts = table(spark, d, "blob_refs"), table(spark, d, "blob_texts")
    return recall.recall(log_queries._events(spark, d), log_queries._docs(spark, d), log_queries._sessions(spark, d), refs, texts, text, max_hits=4)


def _pack(spark: SparkSession, d: str, session: str = "") -> DataFrame:
    dated = log_queries._dated(spark, d)
    newest = dated.selectExpr("max(instant) as m").first().m
    now = E.iso_text(newest) if newest is not None else "1970-01-01T00:00:00+00:00"
    return serving.get_context_pack(dated, session_key=session, now=now)


COMMANDS = {
    "search": lambda s, d, text: search.search(log_queries._docs(s, d), text),
    "recall": _recall,
    "pack": _pack,
    "sessions": _sessions,
    "session": lambda s, d, key: serving.get_session(log_queries._events(s, d), log_queries._sessions(s, d), key),
    "context": lambda s, d, event: serving.get_context(log_queries._events(s, d), event),
    "ingest": lambda s, source, out, kind: ingest.ingest_changed(s, source, out, kind, "*.md" if kind == "aider" else "*.json*"),
    "compact": lambda s, out, name: {name: retention.compact(s, f"{out}/{name}")},
    "purge": lambda s, out, *names: {"purged": retention.purge(s, out, names or retention.TABLES)},
}


def main(args: list[str]) -> None:
    if len(args) < 2 or args[0] not in {*COMMANDS, *registry.QUERIES}:
        print(__doc__.strip(), "\nQueries:", ", ".join(sorted(registry.QUERIES)))
        return
    spark = SparkSession.getActiveSession() or local_session()
    ship_package(spark)
    if args[0] in COMMANDS:
        out = COMMANDS[args[0]](spark, *args[1:])
        if isinstance(out, DataFrame):
            for row in out.toLocalIterator():
                print(json.dumps(row.asDict(), ensure_ascii=False, default=str))
        else:
            print(json.dumps(out))
        return
    rows = registry.QUERIES[args[0]](spark, args[1])
    if len(args) > 2:
        rows.write.mode("overwrite").parquet(args[2])
    else:
        rows.show(50, truncate=80)


if __name__ == "__main__":
    main(sys.argv[1:])
