"""Problem 7: schemas that drift between files.

Method: rescue-column ingestion. A target schema (field paths and their JSON types) is enforced on
every record; known fields of the right type land in the typed map ``data``; unknown or uncastable
ones are kept as JSON in ``rescued``. Profiles of both give the lasting changes; approved changes
are promoted to columns, and the rescued values are replayed into them.

Results for special input: payloads that are null, empty or no JSON object have null ``data`` and
``rescued`` and count nowhere; records whose locator holds no day load but count for no change;
an empty table gives empty results; repeated records count each time they occur; a null source kind
is a kind of its own in the table, and counts for no change; a schema beyond ``MAX_FIELDS`` is an error.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.strict_json import json_type, parse_strict
from talkloom.session import cut_lineage, spread

#: A change counts as lasting when chance would explain it less often than exp(-EVIDENCE).
EVIDENCE = 14.0
#: Days that a field must be present before an addition and a removal both count.
LASTING_DAYS = 7
#: Most fields of the target schema and most changes, which are read to the driver; beyond, an error is
#: raised: so many paths are data, not a schema.
MAX_FIELDS = 100_000
#: Hash buckets of the two content profiles of a field.
BUCKETS = 64
#: Similarity that two content profiles need for a renaming, and with the same last name.
RENAME_SIMILARITY, SAME_NAME_SIMILARITY = 0.6, 0.3


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, str, object]]:
    """(dotted path, JSON type, value) of each field inside objects; arrays are leaves."""
    stack = [(prefix, value)]
    while stack:
        at, node = stack.pop()
        for name, item in node.items():
            path = f"{at}.{name}" if at else name
            kind = json_type(item)
            if kind == "object":
                stack.append((path, item))
            else:
                yield path, kind, item


def _days(raw: DataFrame, locator: str) -> DataFrame:
    return raw.withColumn("file_day", F.expr(f"nullif(regexp_extract({locator}, '(\\\\d{{4}}/\\\\d{{2}}/\\\\d{{2}})', 1), '')"))


def _fields(rows: DataFrame) -> DataFrame:
    """(source_kind, path, type) of each leaf of each payload, one row for each batch and field."""

    def run(batches):
        for batch in batches:
            seen = set()
            for kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = _object(payload)
                seen |= {(kind, path, t) for path, t, _ in leaves(value or {})}
            cols = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["source_kind", "path", "type"])

    return rows.select("source_kind", "payload").mapInArrow(run, "source_kind string, path string, type string")


def _object(payload: bytes | None) -> dict | None:
    try:
        value = parse_strict((payload or b"").decode("utf-8"))
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _bounded(rows: DataFrame) -> list:
    """All rows, at most ``MAX_FIELDS``; more are an error, never cut."""
    out = rows.limit(MAX_FIELDS + 1).collect()
    if len(out) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields or changes")
    return out


def initial_schema(raw: DataFrame, locator: str = "locator") -> dict[str, dict[str, str]]:
    """The target schema to start from: the fields of each source kind's first file day."""
    days = _days(raw, locator)
    first = days.filter("file_day is not null").groupBy("source_kind").agg(F.min("file_day").alias("file_day"))
    start = days.join(first, ["source_kind", "file_day"], "left_semi")
    found = _fields(start).filter("type <> 'null'").groupBy("source_kind", "path").agg(F.min("type").alias("type"))
    schema: dict[str, dict[str, str]] = {}
    for row in _bounded(found.orderBy("source_kind", "path")):
        schema.setdefault(row.source_kind, {})[row.path] = row.type
    return schema


def rescue_ingest(raw: DataFrame, target: dict[str, dict[str, str]], id: str = "id", locator: str = "locator") -> DataFrame:
    """(id, source_kind, file_day, data, rescued): maps from path to the value's JSON text.

    ``data`` holds the fields that conform to the target schema (nulls conform to any type),
    ``rescued`` all others, so that nothing of a payload is lost.
    """
    rows = spread(_days(raw, locator).select(F.col(id).alias("id"), "source_kind", "file_day", "payload"))
    maps = pa.map_(pa.string(), pa.string())

    def run(batches):
        dump = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
        for batch in batches:
            data, rescued = [], []
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                value = _object(payload)
                if value is None:
                    data.append(None)
                    rescued.append(None)
                    continue
                known, own, rest = target.get(kind, {}), {}, {}
                for path, t, item in leaves(value):
                    (own if known.get(path) == t or (t == "null" and path in known) else rest)[path] = dump(item)
                data.append(list(own.items()))
                rescued.append(list(rest.items()))
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(data, maps), pa.array(rescued, maps)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "source_kind", "file_day", "data", "rescued"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, source_kind string, file_day string, data map<string,string>, rescued map<string,string>")


def drift_profile(ingested: DataFrame) -> DataFrame:
    """(source_kind, path, type, file_day, bucket, n): counts of each field by day and by content.

    Bucket -1 counts by day; buckets from 0 hash the value's shape, from ``BUCKETS`` the value
    itself. A path of null counts records. Partial sums are formed before the shuffle, so that its
    size depends on the number of fields and days only.
    """
    rows = ingested.filter("data is not null and file_day is not null")
    entry = rows.select("source_kind", "file_day", F.explode(F.map_concat("data", "rescued")).alias("path", "value"))
    first = F.substring("value", 1, 1)
    kind = (
        F.when(first == '"', "string").when(first == "[", "array").when(first.isin("t", "f"), "boolean")
        .when(first == "n", "null").otherwise("number")
    )
    shape = F.col("value")
    for pattern, mark in ((r"[0-9a-fA-F]{6,}", "h"), (r"[0-9]+", "9"), (r"[a-z]+", "a"), (r"[A-Z]+", "A"), (r"[^\x00-\x7f]+", "u")):
        shape = F.regexp_replace(shape, pattern, mark)
    shape = F.concat(shape, F.floor(F.log2(F.length("value") + 1)).cast("string"))
    hashed = F.pmod(F.xxhash64("value"), F.lit(BUCKETS)).cast("int") + BUCKETS
    marks = F.array(
        F.struct(F.col("file_day").alias("file_day"), F.lit(-1).alias("bucket")),
        F.struct(F.lit(None).cast("string").alias("file_day"), F.pmod(F.xxhash64(shape), F.lit(BUCKETS)).cast("int").alias("bucket")),
        F.struct(F.lit(None).cast("string").alias("file_day"), hashed.alias("bucket")),
    )
    marked = entry.select("source_kind", "path", kind.alias("type"), F.inline(marks)).filter("bucket = -1 or type <> 'null'")
    fields = marked.groupBy("source_kind", "path", "type", "file_day", "bucket").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    totals = rows.groupBy("source_kind", "file_day").agg(F.count("*").alias("n"))
    return fields.unionByName(totals.select("source_kind", none.alias("path"), none.alias("type"), "file_day", F.lit(-1).alias("bucket"), "n"))


def _significant(n: str, rate: str) -> F.Column:
    """Whether a field of this rate would not be missing from n records by chance."""
    return F.expr(f"-{n} * ln(1 - least({rate}, 0.99)) > {EVIDENCE}")


def _spans(profile: DataFrame, keys: list[str], types: str) -> DataFrame:
    """First and last day of each group, its rate between them, and the records before and after."""
    by_day = profile.filter("path is null").select("source_kind", "file_day", F.col("n").alias("day_n"))
    order = Window.partitionBy("source_kind").orderBy("file_day")
    days = by_day.withColumn("upto", F.sum("day_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("total", F.sum("day_n").over(Window.partitionBy("source_kind")))
    present = profile.filter(f"path is not null and bucket = -1 and {types}").groupBy("source_kind", *keys).agg(
        F.sum("n").alias("n"), F.min("file_day").alias("first_day"), F.max("file_day").alias("last_day")
    )
    start = days.select("source_kind", F.col("file_day").alias("first_day"), (F.col("upto") - F.col("day_n")).alias("n_before"))
    end = days.select("source_kind", F.col("file_day").alias("last_day"), F.col("upto").alias("n_upto"), "total")
    spans = present.join(start, ["source_kind", "first_day"]).join(end, ["source_kind", "last_day"])
    return (
        spans.withColumn("n_after", F.col("total") - F.col("n_upto"))
        .withColumn("rate", (F.col("n") + 0.5) / (F.col("n_upto") - F.col("n_before") + 1))
        .withColumn("came", _significant("n_before", "rate"))
        .withColumn("went", _significant("n_after", "rate"))
        .withColumn("days", F.datediff(F.to_date("last_day", "yyyy/MM/dd"), F.to_date("first_day", "yyyy/MM/dd")) + 1)
        .filter(f"not (came and went) or days >= {LASTING_DAYS}")
    )


def _similarity(profile: DataFrame, gone: DataFrame, new: DataFrame, low: int, high: int, out: str) -> DataFrame:
    """Cosine of the content histograms of each pair of a vanished and a new field of a kind."""
    cells = profile.filter(f"bucket >= {low} and bucket < {high}").groupBy("source_kind", "path", "bucket").agg(F.sum("n").alias("n"))
    norms = cells.groupBy("source_kind", "path").agg(F.sqrt(F.sum(F.col("n") * F.col("n") * F.lit(1.0))).alias("norm"))
    cells = cells.join(norms, ["source_kind", "path"]).select("source_kind", "path", "bucket", (F.col("n") / F.col("norm")).alias("w"))
    old = cells.join(gone.select("source_kind", "path"), ["source_kind", "path"], "left_semi").toDF("source_kind", "old", "bucket", "w1")
    now = cells.join(new.select("source_kind", "path"), ["source_kind", "path"], "left_semi").toDF("source_kind", "new", "bucket", "w2")
    return old.join(now, ["source_kind", "bucket"]).groupBy("source_kind", "old", "new").agg(F.sum(F.col("w1") * F.col("w2")).alias(out))


def changes(profile: DataFrame) -> DataFrame:
    """(source_kind, change_type, field_path, new_path, from_day): each lasting change.

    ``profile`` is small (fields times days) and used several times: it is checkpointed first.
    """
    profile = cut_lineage(profile)
    spans = cut_lineage(_spans(profile, ["path"], "true"))  # small and used often: keeps the plan short
    gone, new = spans.filter("went"), spans.filter("came")
    types = profile.filter("bucket = -1 and path is not null and type <> 'null'").groupBy("source_kind", "path").agg(
        F.array_sort(F.collect_set("type")).alias("types")
    )
    side = lambda df, name: df.join(types, ["source_kind", "path"]).select(
        "source_kind", F.col("path").alias(name), F.col("types").alias(f"{name}_types"), F.col("rate").alias(f"{name}_rate"),
        F.col("first_day").alias(f"{name}_first"), F.col("last_day").alias(f"{name}_last"),
        F.col("n_before").alias(f"{name}_before"), F.col("n_upto").alias(f"{name}_upto"),
    )
    pairs = side(gone, "old").join(side(new, "new"), "source_kind")
    pairs = pairs.filter("old_last <= new_first and arrays_overlap(old_types, new_types)")
    pairs = pairs.withColumn("gap", F.greatest(F.lit(0), F.col("new_before") - F.col("old_upto")))
    pairs = pairs.filter(~_significant("gap", "least(old_rate, new_rate)"))
    pairs = pairs.join(_similarity(profile, gone, new, 0, BUCKETS, "by_shape"), ["source_kind", "old", "new"], "left")
    pairs = pairs.join(_similarity(profile, gone, new, BUCKETS, 2 * BUCKETS, "by_value"), ["source_kind", "old", "new"], "left")
    plain = lambda c: F.regexp_replace(F.lower(F.element_at(F.split(c, r"\."), -1)), "[^a-z0-9]", "")
    one, two = plain(F.col("old")), plain(F.col("new"))
    same = one == two
    near = same | one.contains(two) | two.contains(one)
    likeness = (F.coalesce("by_shape", F.lit(0.0)) + F.coalesce("by_value", F.lit(0.0))) / 2
    rates = F.least("old_rate", "new_rate") / F.greatest("old_rate", "new_rate")
    pairs = pairs.withColumn("alike", likeness).withColumn("same", same)
    pairs = pairs.withColumn("score", likeness + F.when(same, 0.5).when(near, 0.25).otherwise(0.0) + 0.1 * rates)
    pairs = pairs.filter(F.expr(f"alike >= {RENAME_SIMILARITY} or (same and alike >= {SAME_NAME_SIMILARITY})"))
    best = lambda side, other: F.row_number().over(Window.partitionBy("source_kind", side).orderBy(F.desc("score"), other))
    pairs = cut_lineage(pairs.select("source_kind", "old", "new", "new_first", "score"))
    renamed = pairs.withColumn("r1", best("old", "new")).withColumn("r2", best("new", "old")).filter("r1 = 1 and r2 = 1")
    none = F.lit("")
    added = new.join(renamed.select("source_kind", F.col("new").alias("path")), ["source_kind", "path"], "left_anti")
    removed = gone.join(renamed.select("source_kind", F.col("old").alias("path")), ["source_kind", "path"], "left_anti")
    typed = cut_lineage(_spans(profile, ["path", "type"], "type <> 'null'"))
    was = typed.filter("went").select("source_kind", "path", F.col("type").alias("old_type"), "last_day", "n_upto", F.col("rate").alias("old_rate"))
    now = typed.filter("came").select("source_kind", "path", F.col("type").alias("new_type"), "first_day", "n_before", F.col("rate").alias("new_rate"))
    retyped = was.join(now, ["source_kind", "path"]).filter("old_type <> new_type and last_day <= first_day")
    retyped = retyped.withColumn("gap", F.greatest(F.lit(0), F.col("n_before") - F.col("n_upto")))
    retyped = retyped.filter(~_significant("gap", "least(old_rate, new_rate)"))
    columns = ["source_kind", "change_type", "field_path", "new_path", "from_day"]
    parts = [
        added.select("source_kind", F.lit("added"), "path", none, "first_day"),
        removed.select("source_kind", F.lit("removed"), "path", none, "last_day"),
        renamed.select("source_kind", F.lit("renamed"), "old", "new", "new_first"),
        retyped.select("source_kind", F.lit("type_changed"), "path", none, "first_day").dropDuplicates(["source_kind", "path"]),
    ]
    out = parts[0].toDF(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.toDF(*columns))
    return out


def drift_report(raw: DataFrame) -> DataFrame:
    """The changes of a raw table with columns id, source_kind, locator and payload."""
    return changes(drift_profile(rescue_ingest(raw, initial_schema(raw))))


def column_name(path: str) -> str:
    return "f_" + "".join(c if c.isalnum() and c.isascii() else "_" for c in path).lower()


def consistent_table(raw: DataFrame, report: DataFrame | None = None, approve=("added", "renamed", "type_changed")) -> DataFrame:
    """One wide table of all JSON payloads: approved fields promoted, rescued values replayed.

    Each field of the target schema and each approved added field is one column, named after its
    first path; a renamed field is read from all of its names. Numbers and booleans of fields that
    never change type become double and boolean; every other value is a string (arrays as JSON
    text). What is not promoted stays as JSON in ``rescued``.
    """
    target = initial_schema(raw)
    ingested = rescue_ingest(raw, target)
    found = (report if report is not None else changes(drift_profile(ingested))).filter(F.col("change_type").isin(*approve))
    rows = _bounded(found.orderBy("source_kind", "from_day", "field_path", "new_path"))
    aliases: dict[str, list[str]] = {path: [path] for fields in target.values() for path in fields}
    types: dict[str, set[str]] = {}
    for fields in target.values():
        for path, t in fields.items():
            types.setdefault(path, set()).add(t)
    first_name = {path: path for path in aliases}
    for row in rows:
        if row.change_type == "added":
            aliases.setdefault(row.field_path, [row.field_path])
            first_name.setdefault(row.field_path, row.field_path)
            types.setdefault(row.field_path, set()).add("string")
        elif row.change_type == "renamed":
            first = first_name.get(row.field_path, row.field_path)
            first_name[row.new_path] = first
            aliases.setdefault(first, [row.field_path]).append(row.new_path)
        else:
            types.setdefault(first_name.get(row.field_path, row.field_path), set()).add("string")
    promoted = sorted({p for names in aliases.values() for p in names})
    every = F.map_concat("data", "rescued")
    df = ingested.withColumn("__all", every)
    columns, taken = [], {"id", "source_kind", "file_day", "rescued"}
    for path, names in sorted(aliases.items()):
        text = F.coalesce(*[F.element_at("__all", F.lit(n)) for n in dict.fromkeys(names)])
        plain = F.when(F.substring(text, 1, 1) == '"', F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]).when(text != "null", text)
        if types.get(path) == {"number"}:
            plain = plain.try_cast("double")
        elif types.get(path) == {"boolean"}:
            plain = plain.try_cast("boolean")
        name = column_name(path)
        while name in taken:
            name += "_"
        taken.add(name)
        columns.append(plain.alias(name))
    left = F.to_json(F.map_filter("__all", lambda k, v: ~k.isin(promoted)))
    return df.select("id", "source_kind", "file_day", *columns, left.alias("rescued"))
