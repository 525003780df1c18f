"""Problem 6: texts cut off by field limits or broken transfers.

Method: intact values of a bounded sample are cut at random positions (some get a cut mark) to make
positives; a hashed logistic regression is trained on closing characters, punctuation, brackets and
the last words and lines. Every record is scored, and the score is combined with the prior odds of
its length: length histograms over all data give, for each source, the lengths where far more
values end than nearby (field limits). Sample values that a model of the other half of the sample
takes for cut are left out of the final training, and their share is the prior of other lengths.

Results for special input: null, empty and blank texts are not cut; a text is read whole; repeated
rows get equal results; a null source kind is a source of its own; empty tables give empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.models import HashedLogistic, sigmoid
from talkloom.session import bounded_sample, cut_lineage, spread

#: Bound of the sample whose values are cut artificially: rows chosen by a hash of their keys.
SAMPLE_TEXTS = 24000
#: Share of all corpus words from which a word counts as known (so at most 1 / share words).
WORD_SHARE = 2e-5
#: A length is a field limit when its count exceeds the mean of its neighbourhood by this factor.
SPIKE, NEIGHBOURS, LEAST = 5.0, 12, 4
#: Probability from which a value counts as cut. Probabilities are cautious: the rare true cuts of
#: an unlabelled sample pull them down.
CUT = 0.3
#: Up to this many field limits of all sources they are broadcast (under 50 MB), beyond, joined by shuffle.
BROADCAST_LIMITS = 500_000

# Marks that tools put after a cut.
MARKS = ["…", "...", " ...", " [...]", " [truncated]", "… (truncated)", " <output clipped>", "…(以下略)", "…[省略]", " (cut, 12 KB total)", "（略）", " [output truncated]", " <truncated>"]
_MARK = re.compile(
    r"\s*(?:(?:…|\.{3,}|⋯)?\s*(?:\[(?:\.{3}|…|[^\[\]\n]*(?:trunc|clip|cut|snip|omit|more|省略|略)[^\[\]\n]*)\]|\((?:\.{3}|[^()\n]*(?:trunc|clip|cut,|snip|omit|KB|bytes|chars)[^()\n]*)\)|<[^<>\n]*(?:trunc|clip|cut|snip|omit)[^<>\n]*>|[(（\[【][^()（）\n]{0,8}(?:以下略|省略|中略|略|続く)[)）\]】])|…|\.{3,}|⋯)$",
    re.IGNORECASE,
)
_WORD = re.compile(r"[A-Za-z]+|\d+|[぀-ヿ㐀-鿿々ー]+|\s+|.", re.DOTALL)
_SENTENCE = re.compile(r"(?<=[.?!])\s+|(?<=[。？！])\s*|\t|\s\|\s")
_MASK = (1 << 18) - 1


def split_mark(text: str) -> tuple[str, str]:
    """The text without a cut mark at its end, and the mark."""
    m = _MARK.search(text[-80:])
    if not m or not m.group().strip():
        return text, ""
    return text[: len(text) - len(m.group())], m.group()


def _line_mask(tokens: list[str], known: frozenset[str], keep: bool) -> str:
    out = []
    for t in tokens:
        if t.isdigit():
            out.append("9")
        elif t.isascii() and t.isalpha():
            out.append(t.lower() if keep and t.lower() in known else ("W" if t[0].isupper() else "w"))
        elif t.isspace():
            out.append(" ")
        else:
            out.append(t if t.isascii() else ("J" if keep is False else t[-3:]))
    return "".join(out)


def _json_state(text: str) -> str:
    body = re.sub(r"^\[[a-z_]+(?: \w+)?\]\s*(?=[{\[])", "", text)
    if body[:1] not in "{[" or body[:2] in ("[t", "[s") or not re.match(r"[\[{]\s*(?:[\[{\"}\]]|-?\d)", body):
        return ""
    try:
        json.loads(body)
        return "whole"
    except (ValueError, RecursionError):
        return "broken"


def features(text: str, known: frozenset[str]) -> list[int]:
    """Hashed features of the end of a text."""
    s = text.rstrip()
    core, mark = split_mark(s)
    fences = core.count("```")
    inside = fences % 2 == 1
    line = core[core.rfind("\n") + 1 :]
    tokens = _WORD.findall(line[-160:])
    words = [t for t in tokens if not t.isspace()]
    last = words[-1] if words else ""
    kinds = [("9" if w.isdigit() else w.lower() if w.lower() in known else "u") if w.isalnum() and w.isascii() else (w if w.isascii() else "J" + w[-2:]) for w in words[-4:]]
    whole, kept = _line_mask(tokens, known, False), _line_mask(tokens, known, True)
    marked = re.sub(r"\d+", "9", mark.strip())
    said = "words" if re.search(r"\w", marked) or "[" in marked else "dots" if marked else "none"
    state = _json_state(s)
    unclosed = "".join(str(min(max(line.count(a) - line.count(b), -1), 2)) for a, b in ("()", "[]", "{}")) + str(line.count('"') % 2) + str(line.count("`") % 2)
    final = last in ".?!。？！」』】）" and last != ""
    where = "in" if inside else "code" if fences else "json" if state else "text"
    known_last = "k" if last.lower() in known else "d" if last.isdigit() else "J" if not last.isascii() else "u"
    tail = re.search(r"\S*$", line[-120:]).group()
    mixed = f"{bool(re.search('[a-z]', tail))}{bool(re.search('[A-Z]', tail))}{bool(re.search('[0-9]', tail))}"
    script = "k" if "゠" <= core[-1:] <= "ヿ" else "h" if "぀" <= core[-1:] <= "ゟ" else "c" if "㐀" <= core[-1:] <= "鿿" else ""
    out = [
        f"m:{marked}", f"mm:{bool(mark)}:{known_last}", f"mx:{said}", f"mw:{said}:{where}", f"ml:{said}:{core[-1:]}", f"w:{where}", f"c1:{core[-1:]}", f"c1w:{core[-1:]}:{where}:{bool(mark)}", f"c2:{_line_mask(_WORD.findall(core[-6:]), known, False)}",
        f"l:{last.lower() if known_last == 'k' else known_last + str(min(len(last), 6))}", f"k2:{'|'.join(kinds[-2:])}", f"k3:{'|'.join(kinds[-3:])}", f"k4:{'|'.join(kinds)}",
        f"k2m:{'|'.join(kinds[-2:])}:{bool(mark)}", f"u:{unclosed}", f"u2:{unclosed}:{core[-1:]}", f"lm:{whole}", f"lk:{kept}", f"ls:{kept[:14]}:{'|'.join(kinds[-2:])}", f"l0:{kept[:10]}:{core[-1:]}",
        f"fin:{final}:{where}:{bool(mark)}", f"j:{state}", f"jc:{state}:{core[-1:]}", f"len:{min(len(s), 4000).bit_length()}:{final}", f"nl:{'1' if chr(10) in core else '0'}:{final}", f"in:{inside}:{fences > 0}",
        f"e2:{core[-2:]}", f"e4:{core[-4:]}" if not core[-4:].isascii() else "", f"e6:{core[-6:]}" if not core[-6:].isascii() else "", f"sp:{text[-1:].isspace()}",
    ]
    out += [f"tl:{min(len(tail), 40) // 8}:{mixed}:{final}", f"tk:{min(len(tail), 40) // 8}:{mixed}:{'|'.join(kinds[:2])}"]
    if script:
        out += [f"jp:{script}:{where}:{min(len(line), 64).bit_length()}", f"jq:{script}:{core[-1:]}", f"js:{script}:{bool(mark)}"]
    # The plainest signs of a cut count several times, so that they outweigh common line shapes.
    signs = ["open"] * inside + [f"mark:{said}"] * bool(mark) + ["broken"] * (state == "broken") + [f"unended:{script}"] * bool(script and not final and len(s) > 60)
    out += [f"{sign}:{k}" for sign in signs for k in range(8)]
    sentence = _SENTENCE.split(line)[-1]
    opening = [("9" if w.isdigit() else w.lower() if w.lower() in known else "u") if w.isascii() else w[:3] for w in _WORD.findall(sentence[:40]) if not w.isspace()][:3]
    out += [f"s1:{''.join(opening[:1])}:{final}:{bool(mark)}:{where}", f"s2:{'|'.join(opening[:2])}:{final}:{bool(mark)}", f"s3:{'|'.join(opening)}:{final}:{known_last}"]
    if len(s) <= 48:
        out.append(f"all:{s.lower()}")
        out.append(f"all9:{re.sub(r'[0-9]+', '9', s.lower())[-30:]}")
    # Remarks and longer texts end in different ways: each has its own weights.
    kind = "s:" if len(s) <= 30 and "\n" not in s else "l:"
    return [crc32((kind + f).encode("utf-8", "replace")) & _MASK for f in out if f]


def cut_position(text: str, rng: np.random.Generator) -> int:
    """A position where the text stops within something, or 0 where there is none."""
    n = len(text)
    for _ in range(8):
        at = int(rng.integers(max(1, min(n - 1, 12)), n)) if n > 14 else 0
        if at and not re.search(r"(?:[.?!。？！]\s*|\n\s*)$", text[:at]) and not re.match(r"\s*\n|\s*$|[.?!。？！]?\s*$", text[at:]):
            return at
    return 0


class CutModel:
    """Vocabulary, weights and prior of one corpus."""

    def __init__(self, known: frozenset[str]):
        self.known = known
        self.model = HashedLogistic(bits=18, l2=2e-5, epochs=8, rate=0.5)
        self.prior = 0.03
        self.accuracy = 0.0

    def fit(self, texts: list[str], at_limit: list[bool], seed: int = 11) -> CutModel:
        intact = [t for t, limit in zip(texts, at_limit) if t.strip() and not limit]
        if len(intact) < 4:
            return self
        rng = np.random.default_rng(seed)
        whole = [features(t, self.known) for t in intact]
        cuts: list[list[int] | None] = []
        for t in intact:
            at = cut_position(t, rng)
            mark = MARKS[int(rng.integers(len(MARKS)))] if rng.random() < 0.35 else ""
            cuts.append(features(t[:at] + mark, self.known) if at else None)

        def train(which: np.ndarray) -> None:
            rows = [whole[i] for i in which] + [cuts[i] for i in which if cuts[i] is not None]
            self.model.fit(rows, np.array([0.0] * len(which) + [1.0] * (len(rows) - len(which))))

        # Each half is judged by a model of the other one, so that no value vouches for itself.
        halves = [np.arange(k, len(intact), 2) for k in (0, 1)]
        cut = np.zeros(len(intact))
        for _ in range(2):
            suspect = cut >= 0.5
            for own, other in (halves, halves[::-1]):
                train(other[~suspect[other]])
                cut[own] = sigmoid(self.model.score([whole[i] for i in own]))
        prior = 0.05
        for _ in range(50):
            post = prior * cut / (prior * cut + (1 - prior) * (1 - cut) + 1e-12)
            prior = min(max(float(post.mean()), 1e-3), 0.3)
        self.prior = prior
        clean = np.flatnonzero(cut < 0.8)
        held, kept = clean[7::8], np.delete(clean, np.arange(7, len(clean), 8))
        train(kept if len(kept) else clean)
        judged = [cuts[i] for i in held if cuts[i] is not None]
        right = int((self.model.score([whole[i] for i in held]) < 0).sum()) + int((self.model.score(judged) >= 0).sum())
        self.accuracy = right / max(1, len(held) + len(judged))
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-odds of being cut, at even prior odds."""
        return self.model.score([features(t, self.known) for t in texts])


def vocabulary(texts: DataFrame, column: str = "text", share: float = WORD_SHARE) -> frozenset[str]:
    """The words of at least ``share`` of all words of the corpus, counted over all rows."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"([a-z]+)"), F.lit(1))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    kept = counts.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.col("total") * share, F.lit(2)))  # one row against all
    return frozenset(r.w for r in kept.select("w").collect())


def length_limits(rows: DataFrame, source: str, text: str) -> DataFrame:
    """(source, unit, size, prior): lengths in characters or bytes where values of a source pile up.

    ``prior`` is the share of the values of that length that the neighbourhood does not explain.
    """
    picked = rows.filter(F.length(text) > 40).select(F.col(source).alias("source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"))
    sizes = picked.select("source", F.expr("stack(2, 'chars', chars, 'bytes', bytes) as (unit, size)"))
    counts = sizes.groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * NEIGHBOURS)
    spikes = counts.withColumn("around", around).filter((F.col("n") >= LEAST) & (F.col("n") > SPIKE * (F.col("around") + 0.5)))
    prior = F.least(F.lit(0.995), 1 - (F.col("around") + 0.5) / F.col("n"))
    return spikes.select("source", "unit", F.col("size").cast("int").alias("size"), prior.alias("prior"))


def with_limit_prior(rows: DataFrame, source: str, text: str, limits: DataFrame) -> DataFrame:
    """Adds ``limit_prior``: the highest prior of the source's limits that the text's length meets, or 0.

    A limit in bytes may cut a wide character, or a repair of one may add some: texts with wide
    characters meet it from three bytes less up to two more.
    """
    wide = limits.filter("unit = 'bytes'").select("source", F.lit("wide").alias("unit"), F.explode(F.sequence(F.col("size") - 3, F.col("size") + 2)).alias("size"), "prior")
    near = cut_lineage(limits.unionByName(wide).groupBy("source", "unit", "size").agg(F.max("prior").alias("prior")))  # small, read three times
    few = near.count() <= BROADCAST_LIMITS
    rows = rows.withColumns({"__chars": F.length(text), "__bytes": F.octet_length(text)})
    sizes = {"chars": F.col("__chars"), "bytes": F.col("__bytes"), "wide": F.when(F.col("__bytes") > F.col("__chars"), F.col("__bytes"))}
    for unit, size in sizes.items():
        own = near.filter(F.col("unit") == unit).select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("prior").alias(f"__{unit}_prior"))
        own = F.broadcast(own) if few else own  # its number was counted
        rows = rows.join(own, rows[source].eqNullSafe(F.col("__s")) & (size == F.col("__z")), "left").drop("__s", "__z")
    best = F.greatest(F.lit(0.0), *[F.coalesce(f"__{unit}_prior", F.lit(0.0)) for unit in sizes])
    return rows.withColumn("limit_prior", best).drop("__chars", "__bytes", *[f"__{unit}_prior" for unit in sizes])


def find_cut(rows: DataFrame, keys: list[str], text: str = "text", source: str = "source_kind") -> DataFrame:
    """keys + (source, cut_probability): one row for each row with a non-blank text."""
    base = rows.select(*keys, F.col(source).alias("source"), F.col(text).alias("__text")).filter(F.col("__text").rlike(r"[\p{L}\p{N}]"))
    base = with_limit_prior(base, "source", "__text", length_limits(base, "source", "__text"))
    known = vocabulary(base, "__text")
    sample = sorted((r["__text"], r.limit_prior) for r in bounded_sample(base, keys, SAMPLE_TEXTS))
    order = np.random.default_rng(5).permutation(len(sample))
    sample = [sample[i] for i in order]
    model = CutModel(known).fit([t for t, _ in sample], [p > 0.5 for _, p in sample])
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prior = np.maximum(model.prior, batch.column(n + 2).to_numpy(zero_copy_only=False))
            odds = model.score(batch.column(n + 1).to_pylist()) + np.log(prior / (1 - prior))
            probability = sigmoid(odds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(probability, pa.float64())], names=[*keys, "source", "cut_probability"])

    return spread(base).mapInArrow(run, f"{fields}, source string, cut_probability double")
