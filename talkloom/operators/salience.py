"""Deduplication, version folding and rule-based extraction of salient lines."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators.order import running
from talkloom.operators.skew import salted_join

#: Least length of a text that may be replaced by a reference to its first occurrence.
DEDUP_CHARS = 120
#: Least length of a version that is folded into a difference, and the difference's limit.
FOLD_CHARS, DIFF_CHARS = 400, 3500
LINES_PER_EVENT = 4

# The words of each category, English and Japanese.
RULES = {
    "decision": r"(?i)(方針|決定|採用|廃止|やめて|でいく|にする|に決め|Decision|decided|we(?:'|’)ll (?:use|go)|instead of|adopt(?:ed)?)",
    "todo": r"(?i)(TODO|FIXME|やること|残タスク|次にやる|next step|remaining)",
    "constraint": r"(?i)(必ず|してはならない|しないこと|禁止|前提|制約|must(?: not)?|never|always|constraint)",
}
ERROR = r"(?i)(Traceback|Exception|Error[:\s]|エラー|失敗|exit code [1-9]|FAILED)"
FIX = r"(?i)(修正|解決|直した|直す|対応した|fixed|resolved|passed|成功|works now)"
WRITERS = ("Write", "Edit", "MultiEdit", "create_file", "str_replace")


def dedup(placed: DataFrame, group: str = "session_key") -> DataFrame:
    """Adds ``first_id`` and ``deduped``: long texts seen before in the group refer to their first event.

    ``first_id`` is null for texts that do not occur again. The first event of a text is an aggregate
    joined back, so that a text which fills a group is never sorted in one task.
    """
    body = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    # Only long texts can be replaced: short ones have no key, so that a frequent remark gathers nowhere.
    keys = placed.select(group, "event_id", "pos", F.when(F.length(body) >= DEDUP_CHARS, T.sha256(body)).alias("dedup_key")).filter("dedup_key is not null")
    first = keys.groupBy(group, "dedup_key").agg(F.min(F.struct("pos", "event_id")).alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    found = salted_join(keys, first, [group, "dedup_key"], "__n", "event_id").select("event_id", "__first")
    out = placed.join(found, "event_id", "left")
    repeated = F.col("pos") > F.col("__first.pos")
    return out.withColumn("first_id", F.col("__first.event_id")).withColumn("deduped", F.coalesce(repeated, F.lit(False))).drop("__first")


def versions(deduped: DataFrame, group: str = "session_key") -> DataFrame:
    """(group, file_path, version, event_id, next_id, text, next_text, folded) of repeated file results.

    ``folded`` marks versions that are replaced by the difference to the next one.
    """
    own = deduped.filter("kind = 'tool_result' and file_path is not null and not deduped").select(group, "file_path", "pos", "event_id", "text")
    # Numbered by running positions and joined to the next number, so that a hot file is split.
    placed = running(own, [group, "file_path"], [F.col("pos")], {}, position="version")
    after = placed.select(group, "file_path", (F.col("version") - 1).alias("version"), F.col("event_id").alias("next_id"), F.col("text").alias("next_text"))
    rows = placed.join(after, [group, "file_path", "version"]).withColumn("folded", F.length("text") >= FOLD_CHARS)
    return rows.select(group, "file_path", "version", "event_id", "next_id", "text", "next_text", "folded")


def fold(pairs: DataFrame) -> DataFrame:
    """event_id + folded_text: the unified difference to the next version, with two lines of context."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, v, old, new in zip(frame.file_path, frame.version, frame.text, frame.next_text):
                lines = difflib.unified_diff(old.splitlines(), (new or "").splitlines(), f"{path} (v{v})", f"{path} (v{v + 1})", lineterm="", n=2)
                body = "\n".join(lines)
                mark = "\n…[diff省略]"
                body = body if len(body) <= DIFF_CHARS else body[: DIFF_CHARS - len(mark)] + mark
                out.append(f"[snapshot折り畳み {path} v{v}: {len(old)}字 → 次版とのdiffのみ]\n{body}")
            yield pd.DataFrame({"event_id": frame.event_id, "folded_text": out})

    return pairs.filter("folded").select("event_id", "file_path", "version", "text", "next_text").mapInPandas(run, "event_id string, folded_text string")


def with_folded(deduped: DataFrame, group: str = "session_key") -> DataFrame:
    """The rows with the text of folded versions replaced by their differences.

    Without a column ``file_path`` the path is the hint of that name.
    """
    if "file_path" not in deduped.columns:
        deduped = deduped.withColumn("file_path", F.get_json_object("hints", "$.file_path"))
    folded = fold(versions(deduped, group))
    out = deduped.join(folded, "event_id", "left")
    return out.withColumn("text", F.coalesce("folded_text", "text")).drop("folded_text")


def _hits(pattern: str, cap: int) -> Column:
    """The first matching lines of an event, stripped and clipped."""
    stripped = F.transform(T.lines("clean"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    own = F.slice(F.filter(stripped, lambda line: line.rlike(pattern)), 1, LINES_PER_EVENT)
    return F.transform(own, lambda line: T.truncate(line, cap))


def salient_lines(deduped: DataFrame, group: str = "session_key") -> DataFrame:
    """(group, category, text, event_id, pos, line_no): matching lines, the first of equal ones."""
    rows = deduped.filter("not deduped").withColumn("clean", T.strip_noise("text"))
    found = F.array(*[F.struct(F.lit(cat).alias("category"), _hits(pattern, 240).alias("found")) for cat, pattern in RULES.items()])
    each = rows.select(group, "event_id", "pos", F.inline(found)).select(group, "event_id", "pos", "category", F.posexplode("found").alias("line_no", "text"))
    first = each.groupBy(group, "category", "text").agg(F.min(F.struct("pos", "line_no", "event_id")).alias("f"))
    return first.select(group, "category", "text", "f.event_id", "f.pos", "f.line_no")


def error_fixes(deduped: DataFrame, group: str = "session_key") -> DataFrame:
    """(group, pos, error, fix, error_id, fix_id, solved): errors and the next assistant text that fixes.

    Each error line belongs to the first fix at or after it; of each fix the last two errors count,
    after the last fix the last three stay unsolved. Fixes before an event are a running sum.
    """
    rows = deduped.filter("not deduped").withColumn("clean", T.strip_noise("text"))
    fixes = F.coalesce((F.col("actor") == "assistant") & F.col("clean").rlike(FIX), F.lit(False))
    stripped = F.transform(T.lines("clean"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    fix_line = T.truncate(F.element_at(F.filter(stripped, lambda line: line.rlike(FIX)), 1), 200)
    rows = rows.select(group, "event_id", "pos", fixes.cast("int").alias("is_fix"), F.when(fixes, fix_line).alias("fix"), _hits(ERROR, 200).alias("errors"))
    summed = running(rows.filter("is_fix = 1 or size(errors) > 0"), [group], [F.col("pos")], {"upto": F.col("is_fix")})
    summed = summed.withColumn("turn", F.col("upto") - F.col("is_fix"))
    errors = summed.select(group, "turn", "pos", F.col("event_id").alias("error_id"), F.posexplode("errors").alias("line_no", "error"))
    fix = summed.filter("is_fix = 1").select(group, "turn", F.col("event_id").alias("fix_id"), "fix", F.col("pos").alias("fix_pos"))
    # Ranks up to three prune each task's rows before the shuffle.
    latest = Window.partitionBy(group, "turn").orderBy(F.desc("pos"), F.desc("line_no"))
    last = errors.withColumn("rank", F.row_number().over(latest)).filter("rank <= 3")
    joined = last.join(fix, [group, "turn"], "left").filter("fix_id is null or rank <= 2")
    return joined.select(group, "pos", "line_no", "error", "fix", "error_id", "fix_id", "fix_pos", F.col("fix_id").isNotNull().alias("solved"))


def artifacts(events: DataFrame, group: str = "session_key") -> DataFrame:
    """(group, path, event_id, first_pos): files written by tools, with the last event that did."""
    name = F.regexp_extract("text", r"^\[tool_use (\w+)\]", 1)
    body = F.regexp_extract("text", r"(?s)^\[tool_use \w+\]\s*(\{.*)", 1)
    path = F.coalesce(F.get_json_object(body, "$.file_path"), F.get_json_object(body, "$.path"))
    rows = events.filter("kind = 'tool_use' and not deduped").filter(name.isin(*WRITERS)).withColumn("path", path).filter("path is not null")
    return rows.groupBy(group, "path").agg(F.max_by("event_id", "pos").alias("event_id"), F.min("pos").alias("first_pos"))


def redaction_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """(label, n): masked secrets by pattern over all rows."""
    counts = F.array(*[F.struct(F.lit(label).alias("label"), n.cast("bigint").alias("n")) for label, n, _ in T.redact_steps(text)])
    return rows.select(F.inline(counts)).groupBy("label").agg(F.sum("n").alias("n")).filter("n > 0")
