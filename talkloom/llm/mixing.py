"""Problem 9: mixing sources to target shares of the total tokens.

Method: temperature mixing. The tokens of each source are counted with a public tokenizer. Every
source gets its target share as far as its repetition limit allows, since one exponent cannot meet
several shares. What the sources that are too small leave open is mixed from the others by
temperature: in proportion to their token shares to the power of an exponent, which is bisected
until the spread has the entropy of those sources' targets; repetition limits hold throughout.
Whatever the exponent, no other mixture is nearer to the targets, as each open token must go
somewhere. :func:`temperature_plan` mixes the whole budget in this way, without the targets' shares.
Weights are realised as block permutations: whole passes over a source, then a hash-ordered part of
one pass that ends at the token budget.

Results for special input: null and empty texts have no tokens and are never used; sources without
target are left out; targets without documents get nothing; repeated document ids are separate
rows, each used at most ``max_repeats`` times; a null repetition limit allows none; more than
``MAX_TARGETS`` targets are an error; empty tables give empty results.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.session import cut_lineage, spread

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Hash buckets of one pass over a source; only the bucket at the budget's end is sorted.
BUCKETS = 4096
#: Most rows of the target table, which is read to the driver; beyond, an error is raised.
MAX_TARGETS = 10_000
#: Bounds of the exponent: 0 makes sources equal, 1 keeps their natural shares, more favours large ones.
EXPONENTS = (0.0, 8.0)
_ENCODERS: dict[int, object] = {}


def _encoder(ranks: bytes):
    key = hash(ranks)
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def count_tokens(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of each document; the vocabulary file (under 1 MB) goes to each task."""
    with open(os.path.join(tokenizers, vocabulary), "rb") as file:
        ranks = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for batch in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return spread(documents.select("doc_id", "source", "text")).mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def entropy(weights: dict[str, float]) -> float:
    """In nats, of the normalised weights."""
    total = sum(weights.values())
    return -sum(w / total * math.log(w / total) for w in weights.values() if w > 0) if total else 0.0


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """The normalised powers of the shares; computed from logarithms, so that no power overflows."""
    logs = {s: exponent * math.log(p) for s, p in shares.items() if p > 0}
    most = max(logs.values(), default=0.0)
    raw = {s: math.exp(v - most) for s, v in logs.items()}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()}


def bisect(inside, low: float, high: float, steps: int = 60) -> float:
    """Where ``inside`` changes between ``low`` (inside) and ``high``; ``high`` if it is inside, too."""
    if inside(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if inside(mid) else (low, mid)
    return low


def fill(base: dict[str, float], most: dict[str, float], left: float, weights: dict[str, float]) -> dict[str, float]:
    """The base and ``left`` more, spread by weight; what exceeds a source's limit goes to the others."""
    out, free = dict(base), {s for s in weights if most[s] > base[s]}
    while left > 1e-9 and free:
        mass = sum(weights[s] for s in free)
        over = [s for s in free if mass <= 0 or out[s] + left * weights[s] / mass >= most[s]]
        if not over:
            for s in free:
                out[s] += left * weights[s] / mass
            break
        for s in over:
            left -= most[s] - out[s]
            out[s] = most[s]
            free.discard(s)
    return out


def temperature_exponent(shares: dict[str, float], goal: float) -> float:
    """The exponent whose weights have the entropy ``goal``, which falls as the exponent grows.

    Entropies out of reach give the nearer bound of ``EXPONENTS``.
    """
    h = lambda a: entropy(tempered(shares, a))
    return bisect(lambda a: h(a) >= goal, *EXPONENTS) if h(EXPONENTS[0]) >= goal else EXPONENTS[0]


def have_and_limits(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int]) -> tuple[dict[str, int], dict[str, float], dict[str, float]]:
    """Tokens, natural shares and most tokens of each source with documents and a positive target."""
    have = {s: tokens[s] for s in targets if tokens.get(s, 0) > 0 and targets[s] > 0}
    whole = sum(have.values())
    return have, {s: n / whole for s, n in have.items()}, {s: float(n * max(0, repeats.get(s) or 0)) for s, n in have.items()}


def budgets(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: int) -> tuple[float | None, dict[str, float]]:
    """Exponent (null where no source is too small) and token budget of each source."""
    have, shares, most = have_and_limits(tokens, targets, repeats)
    if not have or total <= 0:
        return None, {}
    whole = sum(targets[s] for s in have)
    goal = {s: targets[s] / whole for s in have}
    base = {s: min(goal[s] * total, most[s]) for s in have}
    left = total - sum(base.values())
    free = {s: shares[s] for s in have if base[s] < most[s]}
    if left <= 1e-9 * total or not free:
        return None, base
    exponent = temperature_exponent(free, entropy({s: goal[s] for s in free}))
    return exponent, fill(base, most, left, tempered(free, exponent))


def temperature_plan(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: int) -> tuple[float | None, dict[str, float]]:
    """Plain temperature mixing of the whole budget: exponent and token budget of each source.

    The weights share^exponent have the entropy of the targets; what a source may not take within
    its repetition limit goes to the others by weight.
    """
    have, shares, most = have_and_limits(tokens, targets, repeats)
    if not have or total <= 0:
        return None, {}
    exponent = temperature_exponent(shares, entropy({s: targets[s] for s in have}))
    return exponent, fill(dict.fromkeys(have, 0.0), most, float(total), tempered(shares, exponent))


def read_targets(targets: DataFrame) -> dict:
    """The targets by source; more than ``MAX_TARGETS`` are an error, never cut."""
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return {r.source: r for r in rows if r.source is not None}


def source_tokens(counted: DataFrame, goal: dict) -> dict[str, int]:
    own = counted.filter(F.col("source").isin(list(goal)) & (F.col("tokens") > 0))
    return {r.source: r.tokens for r in own.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, counted: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, tokens, copy, order_key): each use of a document, copies numbered from 1.

    ``total`` is the mixture's size in tokens, by default that of all documents whose source has a
    target. Reading in the order of ``order_key`` gives one block of each pass after the other. The
    targets are few (one row for each source, their number is checked) and are read to the driver.
    """
    counted = counted if counted is not None else cut_lineage(count_tokens(documents))
    goal = read_targets(targets)
    sums = source_tokens(counted, goal)
    total = total if total is not None else sum(sums.values())
    _, budget = budgets(sums, {s: r.target_share or 0.0 for s, r in goal.items()}, {s: r.max_repeats for s, r in goal.items()}, total)
    plan = [(s, int(b // sums[s]), int(round(b - (b // sums[s]) * sums[s]))) for s, b in budget.items()]
    spark = documents.sparkSession
    passes = spark.createDataFrame(plan, "source string, passes int, rest bigint")
    rows = counted.filter("tokens > 0").join(F.broadcast(passes), "source")  # at most one row for each target
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), F.col("passes"), F.col("doc_id"))).withColumn("bucket", F.pmod("key", F.lit(BUCKETS)))
    sizes = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(upto.select("source", "bucket", "upto", (F.col("upto") - F.col("n")).alias("before")), ["source", "bucket"])
    inside = F.col("upto") <= F.col("rest")
    edge = (F.col("upto") > F.col("rest")) & (F.col("before") < F.col("rest"))
    ranked = rows.filter(edge).withColumn("run", F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    # The document at the very end is used when more than half of it lies within the budget.
    ended = ranked.withColumn("more", (F.col("before") + F.col("run") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    others = rows.filter(~edge).withColumn("more", inside.cast("int"))
    used = ended.drop("run").unionByName(others).withColumn("copies", F.col("passes") + F.col("more")).filter("copies > 0")
    copies = used.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = F.concat(F.format_string("%04d-", "copy"), F.lower(F.hex(F.xxhash64(F.lit(seed), "copy", "doc_id"))))
    return copies.select("doc_id", "source", "tokens", "copy", order.alias("order_key"))


def report(documents: DataFrame, targets: DataFrame, total: int | None = None, **options) -> DataFrame:
    """(source, available_tokens, target_share, actual_share, passes, most_copies, reached, exponent).

    ``exponent`` is the one that spreads what too small sources leave open, null where none is.
    """
    counted = cut_lineage(count_tokens(documents))
    mixed = mixture(documents, targets, total, counted=counted, **options)
    goal = read_targets(targets)
    sums = source_tokens(counted, goal)
    size = total if total is not None else sum(sums.values())
    exponent, _ = budgets(sums, {s: r.target_share or 0.0 for s, r in goal.items()}, {s: r.max_repeats for s, r in goal.items()}, size)
    own = counted.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.max("copy").alias("most_copies"))
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share")).join(own, "source", "left").join(used, "source", "left")
    rows = rows.withColumn("all_used", F.sum("used_tokens").over(Window.partitionBy()))  # one row for each target
    share = F.coalesce(F.col("used_tokens") / F.col("all_used"), F.lit(0.0))
    return rows.select(
        "source", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), "target_share", share.alias("actual_share"),
        F.coalesce(F.col("used_tokens") / F.col("available_tokens"), F.lit(0.0)).alias("passes"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (share >= F.col("target_share") - 0.005).alias("reached"), F.lit(exponent).cast("double").alias("exponent"),
    )


def temperature(documents: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, token_share, mixture_share, repetition, exponent): the plan of plain temperature mixing."""
    goal = read_targets(targets)
    sums = source_tokens(count_tokens(documents), goal)
    size = total if total is not None else sum(sums.values())
    exponent, plan = temperature_plan(sums, {s: r.target_share or 0.0 for s, r in goal.items()}, {s: r.max_repeats for s, r in goal.items()}, size)
    whole, mixed = sum(sums[s] for s in plan), sum(plan.values())
    rows = [(s, sums[s] / whole, n / mixed if mixed else 0.0, n / sums[s], exponent) for s, n in sorted(plan.items())]
    return documents.sparkSession.createDataFrame(rows, "source string, token_share double, mixture_share double, repetition double, exponent double")
