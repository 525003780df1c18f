"""Parsers of the source formats: raw payloads to canonical events.

One function for each source returns the same columns (``EVENT_COLUMNS``), so that a catalogue can
map source kinds to parsers. JSON is read as VARIANT: unknown shapes never fail, they give null
fields; a payload that is no JSON at all gets ``error`` and no event.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from talkloom.functions import binary as B
from talkloom.functions import text as T
from talkloom.functions.sql import human_size_sql, media_kind_sql
from talkloom.session import cut_lineage

EVENT_COLUMNS = ["raw_id", "source_kind", "locator", "session_key", "native_id", "ts", "actor", "kind", "text", "hints", "fingerprint", "blobs", "error"]
#: Attachments of an event: their bytes are kept once each by :func:`blob_store`.
BLOBS = "array<struct<sha256:string,mime:string,bytes:bigint,name:string,content:binary>>"
BLOCK = "array<struct<type:string,text:string,id:string,name:string,input:string,mime:string,data:string,path:string>>"
BROKEN = "[破損したbase64ブロック]"
# The tools whose input names a file.
FILE_TOOLS = ("Read", "Write", "Edit", "MultiEdit", "NotebookRead", "NotebookEdit", "create_file", "str_replace", "view")
TOOL_INPUT_CHARS, TOOL_RESULT_CHARS, BRIEF_CHARS, NOTE_CHARS = 400, 20000, 300, 2000


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _file_session(source: str) -> Column:
    name = F.regexp_extract("locator", r"([^/]+?)(?:\.\w+)?(?:::.*)?$", 1)
    return F.concat(F.lit(f"{source}:"), name)


def _first_text(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


# The expressions over blocks are SQL: as calls of column functions they would take longer to build than to run.
_FIELDS = ("type", "text", "id", "name", "input", "mime", "data", "path")
_FILES = "('image_b64', 'file_b64')"
_NO_BLOCKS = f"cast(array() as {BLOCK})"


def _sql(v: str, path: str, kind: str = "string") -> str:
    return f"try_variant_get({v}, '{path}', '{kind}')"


def _block_sql(kind: str, **cells: str) -> str:
    fields = ", ".join(f"'{k}', {cells.get(k, 'cast(null as string)')}" for k in _FIELDS if k != "type")
    return f"named_struct('type', '{kind}', {fields})"


def _image_sql(b: str) -> str:
    image = _block_sql("image_b64", mime=_sql(b, "$.source.media_type"), data=f"coalesce({_sql(b, '$.source.data')}, '')")
    return f"if({_sql(b, '$.source.type')} = 'base64', array({image}), {_NO_BLOCKS})"


def _blocks_sql(b: str) -> str:
    """The canonical blocks of one content block; thinking and unknown blocks give none.

    Images within a tool result come before it.
    """
    inner = _sql(b, "$.content", "array<variant>")
    texts = f"filter(transform({inner}, c -> if({_sql('c', '$.type')} = 'text', coalesce({_sql('c', '$.text')}, ''), null)), t -> t is not null)"
    result = f"if({inner} is not null, array_join({texts}, '\\n'), coalesce({_sql(b, '$.content')}, ''))"
    images = f"coalesce(flatten(transform(filter({inner}, c -> {_sql('c', '$.type')} = 'image'), c -> {_image_sql('c')})), {_NO_BLOCKS})"
    path = ", ".join(_sql(b, f"$.input.{n}") for n in ("file_path", "path", "notebook_path"))
    tool = _block_sql("tool_use", id=_sql(b, "$.id"), name=_sql(b, "$.name"), input=f"coalesce(to_json({_sql(b, '$.input', 'variant')}), '{{}}')", path=f"coalesce({path})")
    return (
        f"case when {_sql(b, '$.type')} in ('text', 'input_text', 'output_text') then array({_block_sql('text', text='coalesce(' + _sql(b, '$.text') + ', ' + repr('') + ')')})"
        f" when {_sql(b, '$.type')} = 'tool_use' then array({tool})"
        f" when {_sql(b, '$.type')} = 'tool_result' then concat({images}, array({_block_sql('tool_result', text=result, id=_sql(b, '$.tool_use_id'))}))"
        f" when {_sql(b, '$.type')} = 'image' then {_image_sql(b)} else {_NO_BLOCKS} end"
    )


def content_blocks(path: str, v: str = "v") -> str:
    """SQL of the canonical blocks of a content that is one string or a list of blocks; null where it is neither."""
    blocks = _sql(v, path, "array<variant>")
    return f"case when {blocks} is not null then flatten(transform({blocks}, b -> {_blocks_sql('b')})) when {_sql(v, path)} is not null then array({_block_sql('text', text=_sql(v, path))}) end"


def one_block(kind: str, **cells: str) -> str:
    """SQL of a list of one block."""
    return f"array({_block_sql(kind, **cells)})"


def with_blocks(df: DataFrame, blocks: str) -> DataFrame:
    """Adds ``blocks`` (SQL), with the bytes (``content``) and the sniffed type of files.

    They are built behind generators, so that what reads them does not build them again.
    """
    keep = ", ".join(f"'{n}', b.{n}" for n in _FIELDS)
    rest = [c for c in df.columns if c != "blocks"]
    stage = lambda rows, sql: rows.select(*rest, F.expr(f"inline(array(named_struct('blocks', {sql})))"))
    rows = stage(df, f"transform({blocks}, b -> named_struct({keep}, 'content', if(b.type in {_FILES}, try_to_binary(regexp_replace(b.data, r'\\s+', ''), 'base64'), null)))")
    typed = keep.replace("b.mime", f"if(b.content is null, null, {B.sniffed_sql('hex(substring(b.content, 1, 12))', 'octet_length(b.content)', 'b.mime')})")
    return stage(rows, f"transform(blocks, b -> named_struct({typed}, 'content', b.content))")


def _cut_sql(c: str, n: int) -> str:
    return f"if(length({c}) > {n}, concat(substring({c}, 1, {n - len(T.TRUNCATED)}), '{T.TRUNCATED}'), {c})"


#: How a stored attachment is named in the text: its kind, name, type, size and hash always survive.
_BLOB_LINE = (
    f"if(b.content is null, '{BROKEN}', concat('[添付(', {media_kind_sql('b.mime', 'b.name')}, ') ', coalesce(b.name, ''), ' ', coalesce(b.mime, 'None'), ' ',"
    f" {human_size_sql('octet_length(b.content)')}, ' sha=', substring(sha2(b.content, 256), 1, 12), ']'))"
)
_BLOCK_TEXT = (
    f"case b.type when 'text' then coalesce(b.text, '') when 'tool_use' then concat('[tool_use ', coalesce(b.name, 'None'), '] ', {_cut_sql('b.input', TOOL_INPUT_CHARS)})"
    f" when 'tool_result' then {_cut_sql('b.text', TOOL_RESULT_CHARS)} else {_BLOB_LINE} end"
)
#: The plain text of all blocks; the kind that the last tool block gives, else a message; the decoded files.
BLOCKS_TEXT = f"array_join(filter(transform(blocks, b -> {_BLOCK_TEXT}), t -> t <> ''), '\\n')"
BLOCKS_KIND = "coalesce(try_element_at(filter(transform(blocks, b -> b.type), k -> k in ('tool_use', 'tool_result')), -1), 'message')"
BLOCKS_BLOBS = f"cast(transform(filter(blocks, b -> b.content is not null), b -> named_struct('sha256', sha2(b.content, 256), 'mime', b.mime, 'bytes', cast(octet_length(b.content) as bigint), 'name', b.name, 'content', b.content)) as {BLOBS})"


@F.pandas_udf(ArrayType(StringType()))
def _sorted_inputs(inputs: pd.Series) -> pd.Series:
    """Tool inputs as JSON with sorted keys and the usual blanks: what fingerprints are made of."""
    return inputs.map(lambda own: None if own is None else [json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False) for t in own])


def with_fingerprint(df: DataFrame, calls: bool = False) -> DataFrame:
    """Adds ``fingerprint``: SHA-256 over the type and payload of each block.

    Tool inputs count as sorted JSON with the tool's name, images by the first 64 characters of
    their data, other files by their type alone. Only rows that may hold tool inputs (``calls``)
    go through Python.
    """
    if calls:
        df = df.withColumn("__inputs", _sorted_inputs(F.expr("transform(filter(blocks, b -> b.type = 'tool_use'), b -> b.input)")))
    # The n-th tool call takes the n-th sorted input.
    order = "transform(blocks, (b, i) -> size(filter(slice(blocks, 1, i + 1), x -> x.type = 'tool_use')))" if calls else "transform(blocks, b -> 0)"
    own = "get(__inputs, n - 1)" if calls else "b.input"
    payload = f"case b.type when 'tool_use' then concat(coalesce({own}, '{{}}'), coalesce(b.name, 'None')) when 'image_b64' then substring(b.data, 1, 64) when 'file_b64' then '' else coalesce(b.text, '') end"
    whole = f"coalesce(array_join(zip_with(blocks, {order}, (b, n) -> concat(b.type, {payload})), ''), concat('text', coalesce(text, '')))"
    return df.withColumn("fingerprint", F.expr(f"sha2(encode({whole}, 'UTF-8'), 256)")).drop("__inputs")


def blob_store(events: DataFrame) -> DataFrame:
    """(sha256, mime, bytes, name, content): each attachment once, whatever the number of its events."""
    rows = events.select(F.inline("blobs"))
    return rows.groupBy("sha256").agg(F.min("mime").alias("mime"), F.min("bytes").alias("bytes"), F.min("name").alias("name"), F.first("content").alias("content"))


def _hints(**values: Column) -> Column:
    """The hints that are there as JSON, null where none is."""
    text = F.to_json(F.struct(*[F.when(v != "", v).alias(k) for k, v in values.items()]))
    return F.when(text != "{}", text)


def _parsed(raw: DataFrame) -> DataFrame:
    payload = F.expr("make_valid_utf8(cast(payload as string))")
    rows = raw.select(F.col("id").alias("raw_id"), "source_kind", "locator", payload.alias("payload"))
    v = F.try_parse_json("payload")
    return rows.withColumn("v", v).withColumn("error", F.when(F.col("v").isNull(), "not JSON"))


def _finish(df: DataFrame) -> DataFrame:
    """The common columns; sources without blocks are one text block, without hints or attachments."""
    missing = {"hints": F.lit(None).cast("string"), "fingerprint": T.text_fingerprint("text"), "blobs": F.array().cast(BLOBS)}
    return df.withColumns({k: v for k, v in missing.items() if k not in df.columns}).select(*EVENT_COLUMNS)


#: What every record with a tool call or result holds; others need no lookup and no Python.
_TOOLS = r'"tool_(?:use|result)"'


def tool_hints(rows: DataFrame) -> DataFrame:
    """(raw_id, tool_name, file_path) of tool results, from the call of the same tool id before it in the file.

    Of several results in one record the first that is known names the tool and the last the file.
    Only tools that read or write files have one.
    """
    file, line = F.substring_index("locator", "::", 1).alias("file"), F.substring_index("locator", "::", -1).cast("bigint").alias("n")
    uses = rows.select(file, line, F.explode(F.filter("blocks", lambda b: (b["type"] == "tool_use") & b["id"].isNotNull())).alias("b"))
    uses = uses.select("file", F.col("n").alias("use_n"), F.col("b.id").alias("id"), F.col("b.name").alias("tool_name"), F.when(F.col("b.name").isin(*FILE_TOOLS), F.col("b.path")).alias("file_path"))
    results = rows.select("raw_id", file, line, F.posexplode(F.filter("blocks", lambda b: b["type"] == "tool_result")).alias("at", "b"))
    results = results.select("raw_id", "file", "n", "at", F.col("b.id").alias("id"))
    pairs = results.join(uses, ["file", "id"]).filter("use_n < n")
    last = pairs.groupBy("raw_id", "at").agg(F.max_by(F.struct("tool_name", "file_path"), "use_n").alias("u"))
    named = F.when(F.col("u.file_path").isNotNull(), F.col("at"))
    return last.groupBy("raw_id").agg(F.min_by("u.tool_name", "at").alias("tool_name"), F.max_by("u.file_path", named).alias("file_path"))


def transcript(raw: DataFrame) -> DataFrame:
    """Agent transcripts, one JSON object a record: user, assistant and summary lines, others in brief."""
    payload = F.expr("make_valid_utf8(cast(payload as string))")
    tools = F.coalesce(payload.rlike(_TOOLS), F.lit(False))
    called, plain = _talk(raw.filter(tools)), _talk(raw.filter(~tools))
    called = with_fingerprint(called.join(tool_hints(called), "raw_id", "left"), calls=True)
    none = F.lit(None).cast("string")
    plain = with_fingerprint(plain.withColumn("tool_name", none).withColumn("file_path", none))
    v = F.col("v")
    # A version that is a number is kept as it is written.
    version = F.when(F.col("payload").rlike(r'"version":\s*[-0-9]'), F.get_json_object("payload", "$.version")).otherwise(_get(v, "$.version"))
    hints = _hints(cwd=_get(v, "$.cwd"), git_branch=_get(v, "$.gitBranch"), cc_version=version, model=_get(v, "$.message.model"), tool_name=F.col("tool_name"), file_path=F.col("file_path"))
    return _finish(plain.withColumn("hints", hints)).unionByName(_finish(called.withColumn("hints", hints)))


def _talk(raw: DataFrame) -> DataFrame:
    df, v = _parsed(raw), F.col("v")
    type_ = _get(v, "$.type")
    brief = one_block("text", text=f"if({_sql('v', '$.type')} = 'summary', concat('[summary] ', coalesce({_sql('v', '$.summary')}, '')), substring(payload, 1, {BRIEF_CHARS}))")
    df = df.withColumn("talk", F.coalesce(type_.isin("user", "assistant"), F.lit(False)))
    rows = with_blocks(df, f"if(talk, {content_blocks('$.message.content')}, {brief})")
    kind = F.when(F.col("talk"), F.expr(BLOCKS_KIND)).otherwise("meta")
    return rows.withColumns({
        "session_key": F.coalesce(F.concat(F.lit("claude_code:"), _get(v, "$.sessionId")), _file_session("claude_code")),
        "native_id": F.when(type_ == "summary", F.coalesce(_get(v, "$.leafUuid"), _get(v, "$.uuid"))).otherwise(_get(v, "$.uuid")),
        "ts": _get(v, "$.timestamp"), "kind": kind, "actor": F.when(F.col("talk") & (kind == "tool_result"), "tool").when(F.col("talk"), type_).otherwise("system"),
        "text": F.expr(BLOCKS_TEXT), "blobs": F.expr(BLOCKS_BLOBS),
    })


def rollout(raw: DataFrame) -> DataFrame:
    """Rollout records, plain or within a payload envelope: messages, calls and their output."""
    df = _parsed(raw)
    at = lambda field: f"coalesce({_sql('v', '$.payload.' + field)}, {_sql('v', '$.' + field)})"
    df = df.withColumns({"type_": F.expr(at("type")), "call_id": F.expr(at("call_id")), "tool": F.expr(at("name")), "role": F.expr(at("role"))})
    call = one_block("tool_use", id="call_id", name="tool", input=f"coalesce({at('arguments')}, '{{}}')")
    output = one_block("tool_result", id="call_id", text=f"coalesce({at('output')}, '')")
    rows = with_blocks(df, f"case type_ when 'function_call' then {call} when 'function_call_output' then {output} else coalesce({content_blocks('$.payload.content')}, {content_blocks('$.content')}) end")
    type_ = F.col("type_")
    known = F.coalesce(type_.isin("message", "function_call", "function_call_output"), F.lit(False))
    return _finish(with_fingerprint(rows.withColumns({
        "session_key": _file_session("codex"), "native_id": F.col("call_id"), "ts": _get(F.col("v"), "$.timestamp"),
        "kind": F.when(type_ == "function_call", "tool_use").when(type_ == "function_call_output", "tool_result").otherwise("message"),
        "actor": F.when(type_ == "function_call", "assistant").when(type_ == "function_call_output", "tool").otherwise(F.col("role")),
        "text": F.expr(BLOCKS_TEXT), "blobs": F.expr(BLOCKS_BLOBS), "hints": _hints(tool_name=F.when(type_ == "function_call", F.col("tool"))),
        "error": F.coalesce("error", F.when(~known, "unknown shape")),
    })))


ROLES = {"1": "user", "user": "user", "human": "user", "2": "assistant", "ai": "assistant", "assistant": "assistant", "bot": "assistant"}


def role_name(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return names[F.lower(role)]


def key_values(raw: DataFrame) -> DataFrame:
    """Bubbles of a key-value store: text, else rich text, else content blocks."""
    df, v = _parsed(raw), F.col("v")
    df = with_blocks(df, content_blocks("$.content"))
    body = _first_text(_get(v, "$.text"), _get(v, "$.richText"), F.expr(BLOCKS_TEXT))
    return _finish(
        df.withColumn("session_key", _file_session("cursor")).withColumn("native_id", _get(v, "$.bubbleId"))
        .withColumn("ts", _get(v, "$.createdAt")).withColumn("kind", F.lit("message")).withColumn("actor", role_name(_get(v, "$.type")))
        .withColumn("text", body).withColumn("error", F.coalesce("error", F.when(body.isNull(), "no text")))
    )


def _attached_sql(a: str) -> str:
    """The block of one attachment: its data, else the address or the name, type and size that are known."""
    name, mime, url = _sql(a, "$.name"), _sql(a, "$.mime"), _sql(a, "$.url")
    kind = media_kind_sql(mime, name)
    size = human_size_sql(f"coalesce({_sql(a, '$.size', 'double')}, {_sql(a, '$.bytes', 'double')})")
    by_url = f"concat('[添付(', {kind}, ') url: ', {url}, ' name=', coalesce({name}, 'None'), ']')"
    by_name = f"concat('[添付(', {kind}, ' 未取得) ', coalesce({name}, '?'), ' ', coalesce({mime}, ''), ' ', {size}, ']')"
    return (
        f"case when length({_sql(a, '$.data_b64')}) > 0 then {_block_sql('file_b64', name=name, mime=mime, data=_sql(a, '$.data_b64'))}"
        f" when length({url}) > 0 then {_block_sql('text', text=by_url)} when length({name}) > 0 or length({mime}) > 0 then {_block_sql('text', text=by_name)} end"
    )


def inbox(raw: DataFrame) -> DataFrame:
    """Dropped conversations: one row for each message with its attachments, and the note as meta.

    A message's id is a hash of its whole content and the number of equal ones before it, so that a
    later drop of the same conversation adds only what is new. Messages without text and
    attachments are left out. The title is a hint of the first message.
    """
    df, v = _parsed(raw), F.col("v")
    session = F.coalesce(F.concat(F.coalesce(_get(v, "$.source"), F.lit("inbox")), F.lit(":"), _get(v, "$.session")), _file_session("inbox"))
    captured = F.coalesce(_get(v, "$.captured_at"), _get(v, "$.capturedAt"))
    base = df.withColumn("session_key", session).withColumn("captured", captured)
    each = base.select("*", F.posexplode_outer(_get(v, "$.messages", "array<variant>")).alias("at", "m"))
    m = F.col("m")
    sha = F.substring(T.sha256(F.to_json(m)), 1, 16)
    each = each.filter("error is not null or m is not null").withColumn("__sha", sha)
    same = Window.partitionBy("raw_id", "__sha").orderBy("at")  # equal messages of one payload
    each = each.withColumn("__nth", F.row_number().over(same) - 1)
    text = _sql("m", "$.text")
    said = f"if({text} rlike r'(?U)\\S', {one_block('text', text=text)}, {_NO_BLOCKS})"
    files = f"filter(transform({_sql('m', '$.attachments', 'array<variant>')}, a -> {_attached_sql('a')}), b -> b is not null)"
    each = with_blocks(each, f"concat({said}, coalesce({files}, {_NO_BLOCKS}))").filter("error is not null or size(blocks) > 0")
    messages = (
        each.withColumn("native_id", F.when(m.isNotNull(), F.concat(F.lit("m:"), "__sha", F.lit(":"), "__nth")))
        .withColumn("ts", F.coalesce(_get(m, "$.ts"), "captured")).withColumn("kind", F.lit("message"))
        .withColumn("actor", F.when(m.isNotNull(), F.when(F.lower(_get(m, "$.role")).isin("user", "human"), "user").otherwise("assistant")))
        .withColumn("text", F.expr(BLOCKS_TEXT)).withColumn("blobs", F.expr(BLOCKS_BLOBS))
        .withColumn("hints", _hints(title=F.when(F.col("at") == 0, _get(v, "$.title"))))
    )
    notes = (
        base.withColumn("text", T.truncate(_get(v, "$.note"), NOTE_CHARS)).filter(F.trim("text") != "").withColumn("native_id", F.lit("note"))
        .withColumn("ts", F.col("captured")).withColumn("kind", F.lit("meta")).withColumn("actor", F.lit("system"))
    )
    return _finish(with_fingerprint(messages)).unionByName(_finish(notes))


def configurable(raw: DataFrame, role: list[str] | None = None, text: list[str] | None = None, ts: list[str] | None = None) -> DataFrame:
    """Any JSON lines with the given dotted fields; the first that holds something counts."""
    df, v = _parsed(raw), F.col("v")
    first = lambda names: F.coalesce(*[_get(v, f"$.{n}") for n in names])
    actor = F.coalesce(role_name(first(role or ["role", "type"])), first(role or ["role", "type"]))
    body = _first_text(*[_get(v, f"$.{n}") for n in (text or ["text", "content", "message.content"])])
    known = actor.isin("user", "assistant", "tool", "system")
    return _finish(
        df.withColumn("session_key", _file_session("generic")).withColumn("native_id", F.lit(None).cast("string")).withColumn("ts", first(ts or ["at", "time", "timestamp", "ts"]))
        .withColumn("kind", F.lit("message")).withColumn("actor", actor).withColumn("text", body)
        .withColumn("error", F.coalesce("error", F.when(~F.coalesce(known, F.lit(False)) | body.isNull(), "unknown shape")))
    )


def markdown_chat(raw: DataFrame) -> DataFrame:
    """Markdown chats: a session marker starts a session, ``#### `` lines are the user's, others the assistant's.

    Lines are islands of equal session and role; each island is one event.
    """
    payload = F.expr("make_valid_utf8(cast(payload as string))")
    rows = raw.select(F.col("id").alias("raw_id"), "source_kind", "locator", F.posexplode(T.lines(payload)).alias("n", "line"))
    marker = F.col("line").rlike(r"^# aider chat started at ")
    user = F.col("line").startswith("#### ")
    by = Window.partitionBy("raw_id").orderBy("n")  # the lines of one file
    rows = rows.withColumn("session_no", F.sum(marker.cast("int")).over(by)).withColumn("role", F.when(user, "user").otherwise("assistant")).filter(~marker)
    before = F.lag(F.struct("session_no", "role")).over(by)
    rows = rows.withColumn("new", F.coalesce((before != F.struct("session_no", "role")).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by))
    clean = F.regexp_replace("line", r"^#### ", "")
    events = rows.withColumn("line", clean).groupBy("raw_id", "source_kind", "locator", "session_no", "island", "role").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], "\n").alias("body"))
    events = events.withColumn("text", F.regexp_replace("body", r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    return _finish(
        events.withColumn("session_key", F.concat(_file_session("aider"), F.lit("-"), "session_no")).withColumn("native_id", F.col("island").cast("string"))
        .withColumn("ts", F.lit(None).cast("string")).withColumn("actor", F.col("role")).withColumn("kind", F.lit("message")).withColumn("error", F.lit(None).cast("string"))
    )


CATALOGUE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "claude_code": transcript, "codex_cli": rollout, "cursor_ide": key_values, "aider": markdown_chat, "chatgpt_web": inbox, "generic_jsonl": configurable,
}


def parse_all(raw: DataFrame, catalogue: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All raw records through their source's parser."""
    out = None
    for kind, parse in (catalogue or CATALOGUE).items():
        own = parse(raw.filter(F.col("source_kind") == kind))
        out = own if out is None else out.unionByName(own)
    return out


def read_lines(spark, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(id, source_kind null, locator ``path::n``, payload) of text files, with stable line numbers.

    Whole files are read, since distributed text reads lose line numbers; a last line without line
    end is left for the next read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.expr("make_valid_utf8(cast(content as string))")
    closed = F.regexp_replace(text, r"[^\n]*\z", "")
    rows = files.select("path", F.posexplode(F.split(closed, "\n")).alias("n", "line")).filter("trim(line) <> ''")
    locator = F.concat("path", F.lit("::"), "n")
    return rows.select(F.xxhash64(locator).alias("id"), F.lit(None).cast("string").alias("source_kind"), locator.alias("locator"), F.encode("line", "UTF-8").alias("payload"))


def json_shape(raw: DataFrame) -> DataFrame:
    """(source_kind, shape): the merged JSON schema of each source."""
    payload = F.expr("make_valid_utf8(cast(payload as string))")
    return raw.groupBy("source_kind").agg(F.expr("schema_of_variant_agg(v)").alias("shape")) if "v" in raw.columns else json_shape(raw.withColumn("v", F.try_parse_json(payload)))


def parent_chain(nodes: DataFrame, leaf: str, limit: int = 5000) -> DataFrame:
    """(id, depth) from a leaf to its root along ``parent``, at most ``limit`` steps, by doubling.

    Each round joins the known ancestors with the ancestors' own, so that n steps take log2(n)
    joins, not n; the walk stops before a node that it has met.
    """
    jumps = cut_lineage(nodes.filter("id is not null").groupBy("id").agg(F.min("parent").alias("up")))
    found = jumps.filter(F.col("id") == leaf).select("id", F.lit(0).alias("depth"))
    reach = 1
    while True:
        more = found.join(jumps, "id").filter("up is not null").select(F.col("up").alias("id"), (F.col("depth") + reach).alias("depth"))
        more = more.join(nodes.select("id").distinct(), "id", "left_semi")
        before = found.count()
        found = cut_lineage(found.unionByName(more).filter(F.col("depth") <= limit).groupBy("id").agg(F.min("depth").alias("depth")))
        if found.count() == before or reach > limit:
            return found
        jumps = cut_lineage(jumps.join(jumps.toDF("up", "up2"), "up").select("id", F.col("up2").alias("up")))
        reach *= 2


def browser_payload(captures: DataFrame, source: str) -> DataFrame:
    """Conversations captured in a browser as inbox payloads: (session, payload) with the JSON of one drop.

    ``captures`` has session, title, captured_at, url, n, role, text and attachments (array of name,
    mime, extracted text); extracted texts are kept as attachments, the last 400 messages count,
    each up to 100,000 characters, and the note says what was cut.
    """
    kept = payload_messages(captures, "session")
    extracted = F.transform(F.col("attachments"), lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["mime"], F.lit("text/plain")).alias("mime"), F.base64(F.encode(a["text"], "UTF-8")).alias("data_b64")))
    cell = F.struct("n", F.struct("role", "text", F.when(F.size("attachments") > 0, extracted).alias("attachments")).alias("m"))
    total = captures.groupBy("session").agg(F.count("*").alias("total"))
    # At most 400 messages of one conversation are gathered.
    own = kept.groupBy("session").agg(F.array_sort(F.collect_list(cell))["m"].alias("messages"), F.count("*").alias("kept"), F.count_if("was_cut").alias("cut"), F.max("title").alias("title"), F.max("captured_at").alias("captured_at"), F.max("url").alias("url"))
    note = F.concat_ws("; ", F.when(F.col("total") > F.col("kept"), F.format_string("%d older messages left out", F.col("total") - F.col("kept"))), F.when(F.col("cut") > 0, F.format_string("%d messages shortened", "cut")))
    row = F.struct(F.lit("inbox.v1").alias("schema"), F.lit(source).alias("source"), "session", "title", F.when(note != "", note).alias("note"), "captured_at", "url", "messages")
    return own.join(total, "session").select("session", F.to_json(row).alias("payload"))


def payload_messages(messages: DataFrame, session: str = "session_key", most: int = 400, chars: int = 100_000) -> DataFrame:
    """The last messages of each conversation, each cut to a limit, with a flag for what was cut."""
    last = Window.partitionBy(session).orderBy(F.desc("n"))
    rows = messages.withColumn("__r", F.row_number().over(last)).filter(F.col("__r") <= most)
    return rows.withColumn("was_cut", F.length("text") > chars).withColumn("text", F.substring("text", 1, chars)).drop("__r")
