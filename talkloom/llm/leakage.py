"""Problem 8: passages of evaluation texts inside corpus documents.

Method: winnowing. Of each sliding window of k-gram hashes the smallest is kept on both sides;
shared fingerprints are joined and each hit is extended to the whole shared run. A window of w
k-grams guarantees every shared span of k + w - 1 tokens: 12 words from k = 6, w = 7, and for
Japanese items 30 characters from k = 15, w = 16. Extension compares the tokens themselves, so the
result is exact.

Results for special input: null and empty texts match nothing; items shorter than the least span
match nothing; texts are read whole; equal documents each get their own rows; empty tables give
empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.session import spread

#: (k, w) of words and of characters.
WORDS, CHARS = (6, 7), (15, 16)
#: Up to this many characters of evaluation texts, they go to every task; beyond, a join is used.
MAX_SENT_CHARS = 20_000_000
#: Parts into which the documents of one fingerprint are split in the shuffle join.
SALTS = 16

_CJK = "⺀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[^\W_{_CJK}]+|[{_CJK}]")
_HAS_CJK = re.compile(f"[{_CJK}]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Marks(dict):
    """Code points to themselves, marks and format characters to nothing; filled as they occur."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)) in ("Mn", "Me", "Mc", "Cf") else code
        return self[code]


class _Codes(dict):
    """Hashes of words; emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = crc32(word.encode("utf-8", "replace"))
        return self[word]


_MARKS, _CODES = _Marks(), _Codes()


def plain(text: str) -> str:
    """Case, width and marks removed; apostrophes and format characters vanish within words."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_MARKS)
    return text.casefold().replace("'", "").replace("’", "")


def words(text: str) -> list[str]:
    return _TOKEN.findall(plain(text))


def characters(text: str) -> str:
    return "".join(filter(str.isalnum, plain(text)))


def _numbers(texts: list) -> np.ndarray:
    """A number for each token of all texts: the character itself, or the hash of a word."""
    if isinstance(texts[0], str):
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.fromiter(map(_CODES.__getitem__, chain.from_iterable(texts)), np.uint64, sum(map(len, texts)))


def _gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-gram."""
    n = len(ids) - k + 1
    h = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k if n > 0 else 0):
            h = (h ^ ids[j : j + n]) * _MIX
            h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
    return h


def _winnowed(h: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """Positions that winnowing keeps, the rightmost of equal minima, of windows with the given starts."""
    best, at = h[starts], starts.copy()
    for j in range(1, w):
        value = h[starts + j]
        less = value <= best
        best = np.where(less, value, best)
        at = np.where(less, starts + j, at)
    kept = np.zeros(len(h), bool)
    kept[at] = True
    return np.flatnonzero(kept)


def fingerprints(tokens: list[str] | str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing keeps of one text; of a text with fewer than w k-grams one."""
    h = _gram_hashes(_numbers([tokens]), k)
    if not len(h):
        return h, np.zeros(0, np.int64)
    w = min(w, len(h))
    at = _winnowed(h, np.arange(len(h) - w + 1), w)
    return h[at], at


class EvalSet:
    """The fingerprints and tokens of the evaluation items."""

    def __init__(self, items: list[tuple[int, str | None, str | None]]):
        self.levels = []
        for japanese, cut, (k, w) in ((False, words, WORDS), (True, characters, CHARS)):
            tokens: dict[int, list[str] | str] = {}
            hashes, owners, places = [], [], []
            for item, lang, text in items:
                if not text or is_japanese(lang, text) != japanese:
                    continue
                own = cut(text)
                if len(own) < k + w - 1:
                    continue
                h, at = fingerprints(own, k, w)
                tokens[item] = own
                hashes.append(h)
                owners.append(np.full(len(h), item, np.int64))
                places.append(at)
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            join = lambda parts: (np.concatenate(parts) if parts else np.zeros(0, np.int64))[order]
            self.levels.append((cut, k, w, h[order], join(owners), join(places), tokens))

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(index of the text, item, longest shared run in words or characters), all texts at once."""
        found: dict[tuple[int, int], int] = {}
        for cut, k, w, hashes, owners, places, tokens in self.levels:
            if not len(hashes):
                continue
            own: list[list[str] | str] = []
            index: list[int] = []
            for i, text in enumerate(texts):
                if text and (cut is words or _HAS_CJK.search(text)):
                    parts = cut(text)
                    if len(parts) >= k + w - 1:
                        own.append(parts)
                        index.append(i)
            if not own:
                continue
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            ends = np.cumsum(sizes)
            h = _gram_hashes(_numbers(own), k)
            # Windows lie within one text: their first gram starts at most size - (k + w - 1) after its beginning.
            windows = sizes - (k + w - 2)
            starts = np.repeat(ends - sizes - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
            at = _winnowed(h, starts, w)
            at = at[np.isin(h[at], hashes)]
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            text_of = np.searchsorted(ends, at, "right")
            done: dict[tuple[int, int, int], int] = {}
            for pos, t, a, b in zip(at, text_of, low, high):
                d = int(pos - (ends[t] - sizes[t]))
                for j in range(a, b):
                    item, p = int(owners[j]), int(places[j])
                    if done.get((t, item, d - p), -1) >= d:
                        continue
                    start, end = extend(own[t], tokens[item], d, p)
                    done[(t, item, d - p)] = end
                    if end - start >= k + w - 1:
                        key = (index[t], item)
                        found[key] = max(found.get(key, 0), end - start)
        return [(i, item, n) for (i, item), n in found.items()]


def extend(doc: list[str] | str, item: list[str] | str, d: int, p: int) -> tuple[int, int]:
    """Start and end in the document of the run of equal tokens around a hit."""
    if doc[d] != item[p]:
        return d, d
    start = d
    while start > 0 and start - d + p > 0 and doc[start - 1] == item[start - 1 - d + p]:
        start -= 1
    end = d
    while end < len(doc) and end - d + p < len(item) and doc[end] == item[end - d + p]:
        end += 1
    return start, end


def is_japanese(lang: str | None, text: str) -> bool:
    if lang and lang.lower()[:2] in ("ja", "en"):
        return lang.lower()[:2] == "ja"
    return len(_HAS_CJK.findall(text)) * 2 > len(text)


def leaks(documents: DataFrame, items: DataFrame, max_sent_chars: int = MAX_SENT_CHARS) -> DataFrame:
    """(item_id, doc_id, run): each document that shares a long enough run with an item.

    ``items`` has item_id, lang and text, ``documents`` doc_id and text. Up to ``max_sent_chars``
    characters (counted first) the items' fingerprints are broadcast, and one narrow pass over the
    documents joins, extends and checks all hits. Larger sets of items are joined by a shuffle of
    both sides' fingerprints (:func:`joined_leaks`). Both ways give the same rows.
    """
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    if size <= max_sent_chars:
        known = EvalSet([(r.item_id, r.lang, r.text) for r in items.select("item_id", "lang", "text").distinct().collect()])
        sent = documents.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(item, ids[i], n) for i, item, n in sent.value.matches(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "run"])

        return spread(documents.select("doc_id", "text")).mapInArrow(run, "item_id bigint, doc_id bigint, run bigint")
    return joined_leaks(documents, items)


def joined_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same result by a shuffle join of both sides' fingerprints, then of the candidates' texts.

    A fingerprint that many documents share is salted by the document, so that no task gets them all.
    """

    def marks(rows: DataFrame, key: str, item: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                out: list[tuple[int, int, int]] = []
                for i, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    for level, (cut, (k, w)) in enumerate(((words, WORDS), (characters, CHARS))):
                        if not text or (item and is_japanese(lang, text) != bool(level)):
                            continue
                        h, _ = fingerprints(cut(text), k, w)
                        out += [(i, level, int(v)) for v in np.unique(h).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=[key, "level", "h"])

        return rows.mapInArrow(run, f"{key} bigint, level bigint, h bigint")

    docs = marks(documents.select("doc_id", F.lit(None).cast("string").alias("lang"), "text"), "doc_id", False)
    own = marks(items.select("item_id", "lang", "text").distinct(), "item_id", True)
    docs = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = docs.join(own, ["level", "h", "salt"]).select("item_id", "doc_id").distinct()
    texts = pairs.join(items.select("item_id", "lang", F.col("text").alias("item")), "item_id").join(documents.select("doc_id", "text").distinct(), "doc_id")

    def check(batches):
        for batch in batches:
            out = []
            for i, d, lang, item, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
                out += [(i, d, n) for _, _, n in EvalSet([(i, lang, item)]).matches([text])]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "run"])

    return texts.select("item_id", "doc_id", "lang", "item", "text").mapInArrow(check, "item_id bigint, doc_id bigint, run bigint")
