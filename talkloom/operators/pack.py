"""Budgeted packs: TF-IDF, query similarity, recency and diversity-aware selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators import salience
from talkloom.operators.events import positions
from talkloom.operators.order import running
from talkloom.operators.skew import salted_join
from talkloom.session import cut_lineage

RECENCY, RELEVANCE, DIVERSITY = 0.55, 0.45, 0.35
CANDIDATES, ITEM_CHARS, ITEM_OVERHEAD = 800, 1400, 4
BUDGET = 6000
# The sections of a pack with their titles and row limits.
SECTIONS = [
    ("decision", "決定事項 (Decisions)", 12),
    ("constraint", "制約・前提 (Constraints)", 8),
    ("todo", "未完了 (TODO)", 10),
    ("error_fix", "エラーと解決 (Errors → Fixes)", 8),
    ("artifact", "触ったファイル (Artifacts)", 15),
]
THREAD_TITLE = "## 直近の文脈 (Selected thread)"


def thread(deduped: DataFrame) -> DataFrame:
    """User and assistant texts that say something, without noise."""
    clean = T.strip_noise("text")
    return deduped.filter("actor in ('user', 'assistant') and not deduped").withColumn("clean", clean).filter(F.col("clean").rlike(r"(?U)\S"))


def _counted(rows: DataFrame, group: str) -> DataFrame:
    """(group, event_id, len, token, c): token counts of each row's sorted tokens ``t``, without a shuffle.

    Equal tokens stand together: a run starts where the token before differs, and its length is the
    distance to the next start.
    """
    rows = rows.withColumn("len", F.size("t")).filter("len > 0")
    # Behind a generator, so that the starts are not built anew for each element that reads them.
    rows = rows.select(group, "event_id", "len", "t", F.expr("inline(array(named_struct('s', filter(sequence(0, len - 1), i -> i = 0 or t[i] <> t[i - 1]))))"))
    runs = F.expr("zip_with(s, slice(concat(s, array(len)), 2, size(s)), (a, b) -> struct(t[a] as token, cast(b - a as bigint) as c))")
    return rows.select(group, "event_id", "len", F.inline(runs))


def _weights(rows: DataFrame, query: str, group: str) -> DataFrame:
    """(group, event_id, token, df, w): TF-IDF weights before normalisation; the query is one more document."""
    spark = rows.sparkSession
    tokens = T.tokenize("clean")
    rows = cut_lineage(rows.select(group, "event_id", F.array_sort(tokens).alias("t")))  # read for the counts, their totals and the texts
    counts = _counted(rows, group)
    own = spark.range(1).select(F.explode(F.array_distinct(T.tokenize(F.lit(query)))).alias("token")).withColumn("in_query", F.lit(1))
    docs = rows.groupBy(group).agg((F.count("*") + (1 if query else 0)).alias("n"))
    df = counts.groupBy(group, "token").agg(F.count("*").alias("df0")).join(own, "token", "left")
    df = df.join(docs, group).select(group, "token", "n", (F.col("df0") + F.coalesce("in_query", F.lit(0))).alias("df"))
    return salted_join(counts, df, [group, "token"], "df", "event_id").withColumn("w", F.col("c") / F.col("len") * F.log(1 + F.col("n") / F.col("df")))


def tfidf(rows: DataFrame, query: str, group: str = "session_key", raw: DataFrame | None = None) -> DataFrame:
    """(group, event_id, token, w): TF-IDF weights of length one for each text; ``raw`` where they were weighed before."""
    raw = raw if raw is not None else cut_lineage(_weights(rows, query, group))  # read for the norms and the weights
    norms = raw.groupBy(group, "event_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, [group, "event_id"]).select(group, "event_id", "token", (F.col("w") / F.col("norm")).alias("w"))


def query_weights(raw: DataFrame, query: str, group: str = "session_key") -> DataFrame:
    """(group, token, q): normalised TF-IDF weights of the query in each group with words, from the texts' weights."""
    tokens = raw.sparkSession.range(1).select(T.tokenize(F.lit(query)).alias("t")).select(F.size("t").alias("len"), F.explode("t").alias("token"))
    counts = F.broadcast(tokens.groupBy("token", "len").agg(F.count("*").alias("c")))  # the query's few words
    docs = raw.groupBy(group).agg(F.max("n").alias("n"))
    df = raw.select(group, "token", "df").join(counts.select("token"), "token", "left_semi").groupBy(group, "token").agg(F.max("df").alias("df"))
    every = docs.crossJoin(counts)  # the query's few words for each group
    own = every.join(df, [group, "token"], "left").withColumn("w", F.col("c") / F.col("len") * F.log(1 + F.col("n") / F.coalesce("df", F.lit(1))))
    norms = own.groupBy(group).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return own.join(norms, group).select(group, "token", (F.col("w") / F.col("norm")).alias("q"))


def cosine(rows: DataFrame, query: str, group: str = "session_key", raw: DataFrame | None = None) -> DataFrame:
    """(group, event_id, cosine) of each row whose text shares a word with the query.

    Norms and products come from one aggregation over the weights.
    """
    raw = raw if raw is not None else cut_lineage(_weights(rows, query, group))  # read for the query and the products
    pairs = raw.join(query_weights(raw, query, group), [group, "token"], "left")
    sums = pairs.groupBy(group, "event_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.filter("dot is not null").select(group, "event_id", (F.col("dot") / F.col("norm")).alias("cosine"))


def base_scores(deduped: DataFrame, query: str = "", group: str = "session_key", raw: DataFrame | None = None) -> DataFrame:
    """Thread rows with ``i`` (position among them), ``n`` and ``base`` = recency and relevance."""
    rows = thread(deduped)
    order = running(rows.select(group, "event_id", "pos"), [group], [F.col("pos")], {}, position="i", size="n")
    placed = rows.join(order.select("event_id", "i", "n"), "event_id")
    near = cosine(rows, query, group, raw) if query else None
    if near is not None:
        placed = placed.join(near, [group, "event_id"], "left")
    relevance = F.coalesce("cosine", F.lit(0.0)) * RELEVANCE if query else F.lit(0.0)
    return placed.withColumn("base", RECENCY * F.col("i") / F.col("n") + relevance)


def candidates(scored: DataFrame, group: str = "session_key") -> DataFrame:
    best = Window.partitionBy(group).orderBy(F.desc("base"), F.asc("i"))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= CANDIDATES)


def section_rows(deduped: DataFrame, group: str = "session_key") -> DataFrame:
    """(group, section, rank, text, event_id): the rows of each section up to its limit, in order."""
    lines = salience.salient_lines(deduped, group).select(group, F.col("category").alias("section"), "text", "event_id", "pos", "line_no")
    errors = salience.error_fixes(deduped, group)
    text = F.when(F.col("solved"), F.concat(F.lit("ERR: "), "error", F.lit("\n → FIX: "), F.coalesce("fix", F.lit("")))).otherwise(F.concat(F.lit("ERR(未解決): "), "error"))
    fixes = errors.select(group, F.lit("error_fix").alias("section"), text.alias("text"), F.col("error_id").alias("event_id"), "pos", "line_no", F.coalesce("fix_pos", F.lit(1 << 60)).alias("at"))
    fixes = fixes.groupBy(group, "section", "text").agg(F.min(F.struct("at", "pos", "line_no", "event_id")).alias("f"))
    fixes = fixes.select(group, "section", "text", "f.event_id", (F.col("f.at") * 0 + F.col("f.pos")).alias("pos"), "f.line_no")
    files = salience.artifacts(deduped, group).select(group, F.lit("artifact").alias("section"), F.col("path").alias("text"), "event_id", F.col("first_pos").alias("pos"), F.lit(0).alias("line_no"))
    every = lines.unionByName(fixes).unionByName(files)
    limits = F.create_map(*[x for name, _, cap in SECTIONS for x in (F.lit(name), F.lit(cap))])
    order = Window.partitionBy(group, "section").orderBy("pos", "line_no", "text")
    most = max(cap for _, _, cap in SECTIONS)  # a constant limit prunes before the shuffle
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.filter(F.col("rank") <= limits[F.col("section")]).select(group, "section", "rank", "text", "event_id")


def _tokens(text: str) -> int:
    import re

    return len(re.findall(r"[A-Za-z0-9_]+", text)) + len(re.findall(r"[^\sA-Za-z0-9_]", text))


def select_diverse(base: list[float], vectors: list[dict[str, float]], costs: list[int], left: int) -> list[int]:
    """Indices in order of choice: best score less similarity to the chosen ones, until one does not fit."""
    chosen: list[int] = []
    similar = [0.0] * len(base)
    open_ = list(range(len(base)))
    while open_:
        best = max(open_, key=lambda i: (base[i] - DIVERSITY * similar[i], -i))
        if costs[best] > left:
            break
        chosen.append(best)
        open_.remove(best)
        left -= costs[best]
        for i in open_:
            a, b = (vectors[i], vectors[best]) if len(vectors[i]) <= len(vectors[best]) else (vectors[best], vectors[i])
            similar[i] = max(similar[i], sum(w * b.get(t, 0.0) for t, w in a.items()))
    return chosen


def packs(events: DataFrame, query: str = "", budget: int = BUDGET, title: str = "context pack") -> DataFrame:
    """(session_key, body, used_tokens, n_selected): one Markdown pack for each session.

    Sections and candidates are limited before a session is handed to one pandas call: at most
    53 section rows and 800 candidates, whatever its length.
    """
    deduped = cut_lineage(salience.with_folded(salience.dedup(positions(events))))  # read by each section and the thread
    sections = section_rows(deduped).select("session_key", F.lit(0).alias("part"), "section", F.col("rank").cast("bigint").alias("i"), "text", "event_id", F.lit(None).cast("string").alias("actor"), F.lit(None).cast("string").alias("ts"), F.lit(0.0).alias("base"), F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<double>").alias("weights"))
    # Weights of whole texts, with document frequencies over the whole thread and the query; weighed once.
    raw = cut_lineage(_weights(thread(deduped), query, "session_key"))
    chosen_from = cut_lineage(candidates(base_scores(deduped, query, raw=raw)))
    weights = tfidf(thread(deduped), query, raw=raw).join(chosen_from.select("session_key", "event_id"), ["session_key", "event_id"], "left_semi")
    weights = weights.groupBy("session_key", "event_id").agg(F.sort_array(F.collect_list(F.struct("token", "w"))).alias("v"))
    best = chosen_from.join(weights, ["session_key", "event_id"], "left").select("session_key", F.lit(1).alias("part"), F.col("source_kind").alias("section"), F.col("i").cast("bigint").alias("i"), F.substring("clean", 1, 4 * ITEM_CHARS).alias("text"), "event_id", "actor", "ts", "base", F.col("v.token").alias("words"), F.col("v.w").alias("weights"))
    order = {name: k for k, (name, _, _) in enumerate(SECTIONS)}
    titles = {name: t for name, t, _ in SECTIONS}

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        lines = [f"# {title}", ""]
        used = _tokens("\n".join(lines))
        own = frame[frame.part == 0]
        for name in sorted(set(own.section), key=order.get):
            rows = own[own.section == name].sort_values("i")
            block = [f"## {titles[name]}", *[f"- {t}  ⟨e:{e[:8]}⟩" for t, e in zip(rows.text, rows.event_id)], ""]
            cost = _tokens("\n".join(block))
            if used + cost <= budget:
                lines += block
                used += cost
        items = frame[frame.part == 1].sort_values(["base", "i"], ascending=[False, True]).reset_index(drop=True)
        mark = " …[truncated]"
        texts = [t if len(t) <= ITEM_CHARS else t[: ITEM_CHARS - len(mark)] + mark for t in items.text]
        heads = [f"**{a}** ({s} {t or ''}) ⟨e:{e[:8]}⟩" for a, s, t, e in zip(items.actor, items.section, items.ts, items.event_id)]
        vectors = [{} if t is None else dict(zip(t, w)) for t, w in zip(items.words, items.weights)]
        costs = [_tokens(h + t) + ITEM_OVERHEAD for h, t in zip(heads, texts)]
        chosen = select_diverse(list(items.base), vectors, costs, budget - used)
        used += sum(costs[i] for i in chosen)
        if chosen:
            lines.append(THREAD_TITLE)
            for i in sorted(chosen, key=lambda i: items.i[i]):
                lines += [heads[i], texts[i], ""]
        lines += ["---", f"_{len(chosen)} texts, ~{used}/{budget} tok_"]
        return pd.DataFrame({"session_key": [frame.session_key.iloc[0]], "body": ["\n".join(lines)], "used_tokens": [used], "n_selected": [len(chosen)]})

    return sections.unionByName(best).groupBy("session_key").applyInPandas(build, "session_key string, body string, used_tokens bigint, n_selected bigint")
