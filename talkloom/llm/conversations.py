"""Problem 5: conversations rebuilt from message rows.

Method: rows with a session key belong to its conversation. Rows without one are put together as
connected components over reply and quote links, and over the file that holds them, by alternating
large-star and small-star joins; a component's smallest event id becomes its key. Conversations
are then ordered and validated with aggregations only, so that no group is ever gathered in one task.

Results for special input: an event id counts once (its earliest collected copy; rows without event
id count each); a session of notes only is ``empty``; null actors are unknown ones; rows without
key and without any link are conversations of their own; where the rows of a component have no seq
at all, they are numbered in the order of their collection; extra columns are ignored; an empty
table gives an empty result; components that do not converge within the bound of rounds are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.operators.order import running
from talkloom.session import cut_lineage

COLUMNS = ["event_id", "session_key", "source_kind", "seq", "actor", "kind", "text", "hints", "native_id", "locator", "ingested_at"]
#: A node with more than this share of all edges (and more than the number) is a hub, whose rows are
#: salted; so there are at most 2 / share hubs.
HUB_SHARE, HUB_EDGES, SALTS = 1e-3, 1000, 32

ACTORS = ("user", "assistant", "tool", "system")
#: White space of any script and zero-width characters.
BLANK = r"(?U)^[\s\p{Z}\p{Cf}\x1c-\x1f]*$"
_EDGE = r"(?U)^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def is_blank(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.isNull() | text.rlike(BLANK)


def speaker(actor: Column | str) -> Column:
    """The actor in lower case without outer blanks."""
    return F.lower(F.regexp_replace(actor, _EDGE, ""))


def _to_smallest(own: DataFrame, edges: int) -> tuple[DataFrame, DataFrame]:
    """(own with the smallest neighbour ``m`` of ``a``, those minima); rows of hubs are salted."""
    least = own.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    hub = F.col("n") > max(HUB_EDGES, int(edges * HUB_SHARE))
    hubs = F.broadcast(least.filter(hub).select("a", F.lit(SALTS).alias("salts")))  # at most 2 / HUB_SHARE rows
    salted = own.join(hubs, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hub, SALTS - 1).otherwise(0))))
    return salted.join(spread.select("a", "m", "salt"), ["a", "salt"]).select("a", "b", "m"), least.select("a", "m")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); the component is its smallest node.

    Alternates large-star (link larger neighbours to the smallest one) and small-star (link the
    node and its smaller neighbours to the smallest one) until the edges stay the same; the number
    of rounds grows with the logarithm of the longest path. Minima are aggregated with partial sums
    and the rows of hubs are salted. More than ``max_rounds`` rounds raise an error.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    e = cut_lineage(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct())

    def star(pairs: DataFrame, large: bool, n: int) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved, least = _to_smallest(both if large else both.filter("b < a"), n)
        linked = (moved.filter("b > a") if large else moved).select(F.col("b").alias("x"), "m")
        if not large:
            linked = linked.unionByName(least.select(F.col("a").alias("x"), "m"))
        return linked.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    def state_of(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = state_of(e)
    for _ in range(max_rounds):
        e = cut_lineage(star(star(e, True, last[0]), False, last[0]))
        state = state_of(e)
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def links(rows: DataFrame) -> DataFrame:
    """(a, b) links of rows without session key: replies named in hints, quoted texts, and files.

    A reply names the parent's event or native id under reply_to, in_reply_to, parent or parent_id;
    a quote is a text whose leading ``> `` lines repeat another text of at least 12 characters; a
    row is also linked to the name of its file within its source, as a node ``file:...``.
    """
    names = ["reply_to", "in_reply_to", "parent", "parent_id"]
    parent = F.coalesce(*[F.get_json_object("hints", f"$.{n}") for n in names])
    replies = rows.select(F.col("event_id").alias("a"), parent.alias("parent")).filter("parent is not null")
    ids = rows.select(F.explode(F.array_distinct(F.array("event_id", "native_id"))).alias("parent"), F.col("event_id").alias("b")).filter("parent is not null")
    by_reply = replies.join(ids, "parent").select("a", "b")
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    block = F.regexp_extract("text", r"^((?:> ?[^\n]*(?:\n|$))+)", 1)
    quoted = plain(F.regexp_replace(block, r"(?m)^> ?", ""))
    quotes = rows.select(F.col("event_id").alias("a"), quoted.alias("q")).filter(F.length("q") >= 12)
    first = rows.select(plain(F.col("text")).alias("q"), "event_id").filter(F.length("q") >= 12).groupBy("q").agg(F.min("event_id").alias("b"))
    name = F.regexp_extract("locator", r"([^/]+?)(?:\.\w+)?::[^/]*$", 1)
    files = rows.filter(name != "").select(F.col("event_id").alias("a"), F.concat_ws("/", F.lit("file:"), "source_kind", name).alias("b"))
    return by_reply.unionByName(quotes.join(first, "q").select("a", "b")).unionByName(files).filter("a <> b")


def with_keys(rows: DataFrame) -> DataFrame:
    """The rows, narrowed to ``COLUMNS``, with ``session_key`` filled in for those that have none."""
    rows = rows.select(*COLUMNS)
    lacking = F.coalesce(F.trim("session_key") == "", F.lit(True))
    orphans = rows.filter(lacking)
    if orphans.isEmpty():
        return rows
    found = connected_components(links(orphans)).select(F.col("node").alias("event_id"), "component")
    keyed = orphans.drop("session_key").join(found, "event_id", "left")
    keyed = keyed.withColumn("session_key", F.concat(F.lit("component:"), F.coalesce("component", "event_id"))).drop("component")
    keyed = cut_lineage(keyed.select(*rows.columns))  # used twice; keeps the plan short
    return rows.filter(~lacking).unionByName(_numbered(keyed))


def _numbered(keyed: DataFrame) -> DataFrame:
    """Rows of components without any seq are numbered in the order of their collection."""
    bare = keyed.groupBy("session_key").agg(F.count("seq").alias("n")).filter("n = 0").select("session_key")
    lost = keyed.join(bare, "session_key", "left_semi")
    if lost.isEmpty():
        return keyed
    first = earliest(lost, ["session_key"]).join(lost.groupBy("event_id").agg(F.min("ingested_at").alias("at")), "event_id")
    placed = running(first, ["session_key"], [F.coalesce(F.col("at").cast("double"), F.lit(0.0)), F.col("event_id")], {}, position="pos")
    numbers = placed.select("event_id", (F.col("pos") - 1).alias("__seq"))
    out = keyed.join(numbers, "event_id", "left").withColumn("seq", F.coalesce("seq", "__seq"))
    return out.select(*keyed.columns)


def once(rows: DataFrame) -> DataFrame:
    """One row for each event id, the earliest collected; narrowed to what validation needs."""
    return _slim(with_keys(rows))


def _slim(keyed: DataFrame) -> DataFrame:
    slim = keyed.select("event_id", "session_key", "seq", speaker("actor").alias("role"), "kind", (~is_blank("text")).alias("said"), "ingested_at")
    return earliest(slim, ["session_key", "seq", "role", "kind", "said"])


def earliest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """event_id and the columns of its earliest collected row; rows without event id stay as they are."""
    cells = [F.col(f"e.{c}").alias(c) for c in columns]
    first = rows.filter("event_id is not null").groupBy("event_id").agg(F.min(F.struct("ingested_at", *columns)).alias("e"))
    return first.select("event_id", *cells).unionByName(rows.filter("event_id is null").select("event_id", *columns))


def validate(events: DataFrame) -> DataFrame:
    """(session_key, n_events, reason): one row for each session; a null reason keeps it."""
    counted = F.col("seq").isNull() | (F.col("seq") != -1)
    message = counted & (F.col("kind") == "message") & F.col("said")
    known = F.coalesce(F.col("role").isin(*ACTORS), F.lit(False))
    by_seq = events.groupBy("session_key", "seq").agg(
        F.count_if(counted).alias("n"),
        F.count_if(counted & ~known).alias("odd"),
        F.max(F.when(message & (F.col("role") == "user"), F.col("seq"))).alias("user_seq"),
        F.max(F.when(message & (F.col("role") == "assistant"), F.col("seq"))).alias("assistant_seq"),
        F.count_if(message & F.col("role").isin("user", "assistant")).alias("talk"),
    )
    own = F.when(F.col("n") > 0, F.col("seq"))
    sessions = by_seq.groupBy("session_key").agg(
        F.sum("n").alias("n_events"), F.sum("odd").alias("odd"), F.sum("talk").alias("talk"),
        F.max("n").alias("most"), F.count(own).alias("distinct_seq"), F.min(own).alias("first"), F.max(own).alias("last"),
        F.count_if(F.col("seq").isNull() & (F.col("n") > 0)).alias("no_seq"),
        F.max("user_seq").alias("user_seq"), F.max("assistant_seq").alias("assistant_seq"),
    )
    whole = (F.col("n_events") == 0) | ((F.col("no_seq") == 0) & (F.col("most") <= 1) & (F.col("first") == 0) & (F.col("last") == F.col("n_events") - 1) & (F.col("distinct_seq") == F.col("n_events")))
    reason = (
        F.when(~F.coalesce(whole, F.lit(False)) | (F.col("odd") > 0), "broken")
        .when(F.col("talk") == 0, "empty")
        .when(F.coalesce(F.col("assistant_seq"), F.lit(-1)) <= F.coalesce(F.col("user_seq"), F.lit(-1)), "no_reply")
    )
    return sessions.select("session_key", "n_events", reason.alias("reason"))


def conversations(rows: DataFrame) -> DataFrame:
    """(session_key, turn, role, kind, text) of the kept conversations, sorted by both keys.

    A kept conversation has each seq from 0 once, so that seq is the turn; the global order comes
    from range partitions, among which a long conversation is split.
    """
    keyed = with_keys(rows)
    kept = validate(_slim(keyed)).filter("reason is null").select("session_key")
    whole = earliest(keyed.filter("seq <> -1"), ["session_key", "seq", "actor", "kind", "text"])
    out = whole.select("session_key", F.col("seq").alias("turn"), speaker("actor").alias("role"), "kind", "text")
    out = out.join(kept, "session_key", "left_semi")
    return out.repartitionByRange("session_key", "turn").sortWithinPartitions("session_key", "turn")
