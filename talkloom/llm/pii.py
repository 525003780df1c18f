"""Problem 1: personal information in free text.

Method: high-recall generators propose overlapping spans of five types; boosted trees score each
span by format and context features; calibrated scores are cut at a threshold. The trees learn from
positive and unlabelled spans: a span is positive where its surroundings name it (a key word, a
trigger such as "reviewed by", the name of the number), or where the same text is named elsewhere;
all others are unlabelled. The features that make a span positive are withheld from the trees, which
must tell by format, by the lexicon and by the remaining context what the named spans have in common;
the probability of being named, divided by its level among named spans, is that of being personal
information. The name lexicon is counted over all texts; training texts are a bounded sample. Every
text is scored.

Results for special input: null and empty texts hold nothing; a text is read whole, whatever its
length; repeated rows and equal texts get equal results; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.models import BoostedTrees, platt, sigmoid
from talkloom.session import bounded_sample, cut_lineage, spread

TYPES = ["email", "phone", "id_number", "address", "person_name"]
PLACEHOLDER = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID_NUMBER>", "address": "<ADDRESS>", "person_name": "<PERSON_NAME>"}

#: Bound of the labelled sample: texts chosen by a hash of their keys.
SAMPLE_TEXTS = 30000
#: Bytes of that sample at most.
SAMPLE_BYTES = 48 << 20
#: Share of all name words at triggers from which a word belongs to the lexicon (so at most 1 / share words).
NAME_SHARE = 1e-5

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D, 0x30FC: 0x30FC}


def narrow(text: str) -> str:
    """Full-width forms as ASCII, position by position."""
    return text if text.isascii() else text.translate(_WIDE)


_AT = r"@|\s@\s|\s?[(\[{<]\s?(?:at|AT|At|アット)\s?[)\]}>]\s?|\sAT\s"
_WORD_DOT = r"\s?[(\[{<]\s?(?:dot|DOT)\s?[)\]}>]\s?|\s(?:DOT|dot)\s"
_DOT = r"\.|\s?[(\[{<]\s?(?:dot|DOT|ドット)\s?[)\]}>]\s?|\s(?:DOT|dot)\s"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._+\-])[A-Za-z0-9][A-Za-z0-9._+\-]*(?:{_AT})[A-Za-z0-9\-]+(?:(?:{_DOT})[A-Za-z0-9\-]+)+|(?<![A-Za-z0-9._+\-])[A-Za-z0-9][A-Za-z0-9._+\-]* at [A-Za-z0-9\-]+(?:(?:{_WORD_DOT})[A-Za-z0-9\-]+)+")
PHONE = re.compile(
    r"(?<![A-Za-z0-9_.+\-/:@#])(?:\+\d{1,3}[ .\-]?)?(?:\(0?\d{1,4}\)[ .\-]?)?\d{1,12}(?:[ .\-]\d{1,8}){0,5}(?:\s?(?:ext\.?|x|内線)\s?\d{1,5})?(?![A-Za-z0-9_@]|[.\-:/]\d)"
)
_ID_WORD = r"SSN|social security(?: (?:number|no\.?))?|tax (?:id|number|no\.?)|TIN|EIN|passport(?: (?:no\.?|number))?|NI number|national insurance(?: number)?|driv(?:ing|er'?s?) licen[cs]e(?: (?:no\.?|number))?|national ID|identity card|マイナンバー|個人番号|旅券番号|パスポート番号|運転免許証?番号|免許証?番号|基礎年金番号|在留カード番号"
ID = re.compile(
    rf"(?<![A-Za-z])(?P<word>(?i:{_ID_WORD}))(?![A-Za-z])[\s:#=は番号]{{0,4}}(?P<num>[A-Z]{{0,3}}[\- ]?\d[\dA-Z]*(?:[ \-](?:\d[\dA-Z]*|[A-Z]\b)){{0,5}})"
    r"|(?<![A-Za-z0-9_\-./])(?:\d{3}[ \-]\d{2}[ \-]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{7,8}|\d{10}[A-Z]|\d{2} \d{3} \d{3} \d{3}|\d{4}[ \-]\d{4}[ \-]\d{4}|DL-\d{4}-\d{4}|\d{12})(?![A-Za-z0-9_\-])",
)
_STREET = r"Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Crescent|Drive|Dr|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Row|Walk|Gardens|Grove|Hill|Quay|Parade|Mews|Rise"
_CAP = r"[A-ZÀ-Þ][A-Za-z0-9À-ɏ'’\-]*"
_TAIL = rf"(?:,? ?(?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?)?(?:,\s{{0,2}}(?:\d{{4,6}} )?{_CAP}(?: \d{{4,6}})?)?"
ADDRESS = re.compile(
    rf"(?<![\w.\-/])(?:{_CAP}(?: {_CAP})? House, )?\d{{1,5}}[A-Za-z]?,? (?:{_CAP} ){{1,4}}(?:{_STREET})\b\.?{_TAIL}"
    rf"|\b{_CAP}(?: {_CAP})?(?:straße|strasse|str\.|weg|platz|gasse|allee|ring)\s\d{{1,5}}[a-z]?\b{_TAIL}"
    rf"|(?<![\w.\-/])\d{{1,5}}(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|quai|allée|impasse|cours)(?: (?:de|des|du|la|le|les|l'))*(?: {_CAP}){{1,3}}{_TAIL}"
    rf"|\bP\.?\s?O\.?\s?Box\s\d+{_TAIL}"
    r"|(?:〒\s?\d{3}-?\d{4}\s?)?[一-鿿ヶ]{1,6}[都道府県][一-鿿ヶぁ-んァ-ン]{1,8}[市区町村郡][一-鿿ヶぁ-んァ-ン]{0,12}\d{1,4}(?:(?:丁目|番地?|号|-)\d{0,4})*"
    r"|〒\s?\d{3}-?\d{4}"
    r"|(?<!\w)\d{1,5} (?:street|lane|road|avenue) of the"
    rf"|\b(?:Street|Lane|Road|Square|Pier|Quay) (?:of|\d+|{_CAP})"
    rf"|\b(?:Street|Lane|Road) \d+"
)
_TOKEN = r"(?:[A-ZÀ-Þ][a-zß-ÿ]+(?:['’\-][A-ZÀ-Þ]?[a-zß-ÿ]+)*|[A-ZÀ-Þ]{2,}(?:-[A-ZÀ-Þ]{2,})*)"
NAME = re.compile(rf"(?<![A-Za-zÀ-ÿ0-9_@.\-/`])(?=(?P<a>{_TOKEN})(?P<mid>(?: [A-Z]\.)? |, )(?P<b>{_TOKEN})(?![A-Za-zÀ-ÿ0-9_@`/]|\.[A-Za-z0-9]))")
_KANJI = "一-鿿々ヶ"
NAME_JA = re.compile(
    rf"(?<![{_KANJI}])(?P<a>[{_KANJI}]{{1,3}}) (?P<b>(?:(?![様氏殿])[{_KANJI}]){{1,3}}|[ぁ-ん]{{2,4}}|[ァ-ン]{{2,4}})(?=[様氏殿]|[^{_KANJI}ァ-ン]|$)"
    rf"|(?<![{_KANJI}])(?P<c>(?:(?![様氏殿])[{_KANJI}]){{2,6}})(?=さん|様|氏|殿|です|は|が|[。、.,:|\t\n]|$)",
)
_BEFORE = re.compile(
    r"(?:[Rr]eviewed by|[Aa]ssignee:?|[Rr]eviewer:?|[Oo]wner:?|[Cc]ontact:?|[Pp]aired with|[Mm]y name is|I am|[Aa]sk|[Rr]egards,?|[Tt]hanks,?|[Ss]igned,?|[Bb]est,?|[Cc]c|担当は|担当者は|担当[:：]|レビュー担当[:：]|報告者は|署名[:：]|氏名[:：]|名前は)\s*$"
)
_AFTER = re.compile(
    r"^(?:さん|様|氏|殿|です。| reported (?:this|it)| about the| on it| and I maintain| (?:will|wrote|said|asked|approved|fixed)\b)"
)

_KEYS = {
    "email": re.compile(r"mail|address is|contact|author|cc |send|連絡先|宛て|メール", re.I),
    "phone": re.compile(r"call|phone|tel|mobile|reach|on-call|number is|fax|電話|携帯|緊急", re.I),
    "id_number": re.compile(_ID_WORD + r"|pasted|record|form also|in clear|貼り付け|書類|備考", re.I),
    "address": re.compile(r"ship|bill|deliver|moved to|address|lives|send|送付|住所|引っ越|届け", re.I),
    "person_name": re.compile(r"review|assign|paired|name|ask|regards|report|担当|依頼|確認", re.I),
}
_COUNTER = re.compile(
    r"ticket|issue|build|commit|version|pinned|range|epoch|listening|\bport\b|run\b|revert|lock file|remote|prompt|tiles|dashboard|importer|board|queue|row count|実行番号|差分|版は|待受|TCK|sha|digest|offset|見出し",
    re.I,
)
_URL = re.compile(r"(?:[a-z][a-z0-9+]*://|git@|ssh )\S*$", re.I)
_SHAPES = [
    re.compile(p)
    for p in (
        r"\+\d{1,3}[ .\-]?[\d(].*", r"\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}.*", r"0\d{4} \d{3} \d{3}.*", r"0\d{2} \d{4} \d{4}.*", r"0\d(?:[. ]\d\d){4}.*",
        r"0\d{1,3}-\d{3,4}-\d{4}.*", r"\(0\d{1,3}\) \d{3,4}[ \-]\d{4}.*", r"0\d{9,10}", r"\d{3}[ \-]\d{2}[ \-]\d{4}", r"[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]",
        r"\d{2} \d{3} \d{3} \d{3}", r"\d{4}[ \-]\d{4}[ \-]\d{4}", r"\d{10}[A-Z]", r"\d{12}", r"[A-Z]{1,2}\d{7,8}", r"DL-\d{4}-\d{4}",
    )
]
_PHONE_SHAPES, _ID_SHAPES = range(0, 8), range(8, 16)

Candidate = tuple[int, int, int, str, re.Match]


def at_trigger(t: str, start: int, end: int) -> bool:
    """Whether the words around a span introduce a person."""
    return bool(_BEFORE.search(t[max(0, start - 24) : start])) or bool(_AFTER.match(t[end : end + 24]))


def candidates(text: str, lexicon: Lexicon | None = None) -> list[Candidate]:
    """(type number, start, end, narrowed text, match) of each proposed span; spans may overlap.

    With a lexicon, runs of kanji without a blank are proposed where both parts of a name are known
    or a trigger introduces them.
    """
    t = narrow(text)
    out: list[Candidate] = []
    if "@" in t or "at" in t or "AT" in t or "アット" in t:
        # Accounts within URLs are no addresses.
        out += [(0, m.start(), m.end(), t, m) for m in EMAIL.finditer(t) if "://" not in re.split(r"\s", t[max(0, m.start() - 80) : m.start()])[-1]]
    for m in PHONE.finditer(t):
        # Neither area nor exchange codes of ten-digit numbers start with 0 or 1.
        if 9 <= sum(c.isdigit() for c in m.group()) <= 20 and not re.match(r"\(?[01]\d\d\)?[ .\-]\d{3}[ .\-]\d{4}$|\(?\d{3}\)?[ .\-][01]\d\d[ .\-]\d{4}$", m.group()):
            out.append((1, m.start(), m.end(), t, m))
    out += [(2, m.start("num") if m["word"] else m.start(), m.end(), t, m) for m in ID.finditer(t)]
    out += [(3, m.start(), m.end(), t, m) for m in ADDRESS.finditer(t)]
    out += [(4, m.start(), m.end("b"), t, m) for m in NAME.finditer(t)]
    if not t.isascii():
        for m in NAME_JA.finditer(t):
            if lexicon is None or not m["c"] or lexicon.pair(m)[0] > 0 or at_trigger(t, m.start(), m.end()):
                out.append((4, m.start(), m.end(), t, m))
    return out


def _tokens(m: re.Match) -> list[tuple[str, str]]:
    """Possible splits of a name candidate into two parts, lower-cased."""
    g = m.groupdict()
    if g.get("c"):
        c = g["c"]
        return [(c[:i], c[i:]) for i in range(1, len(c)) if i <= 3 and len(c) - i <= 3]
    return [(g["a"].lower(), g["b"].lower())]


class Lexicon:
    """How often a word stood in a name at a trigger context, against all of its name candidates."""

    def __init__(self, hits: dict[str, int] | None = None, seen: dict[str, int] | None = None) -> None:
        self.hits: Counter = Counter(hits or {})
        self.seen: Counter = Counter(seen or {})

    def learn(self, texts: list[str | None]) -> Lexicon:
        for text in texts:
            for k, s, e, t, m in candidates(text) if text else ():
                if k != 4 or m.groupdict().get("c"):  # runs without a blank could be split in several ways
                    continue
                strong = at_trigger(t, s, e)
                for w in {m["a"].lower(), m["b"].lower()}:
                    self.seen[w] += 1
                    self.hits[w] += strong
        return self

    def rate(self, word: str, strong: bool = False) -> float:
        """Smoothed rate; a word outside of the lexicon counts by its own context."""
        if word not in self.hits:
            return 1 / 3 if strong else 0.0
        return self.hits[word] / (self.seen[word] + 2.0)

    def pair(self, m: re.Match, strong: bool = False) -> tuple[float, float]:
        """Rates of the weaker and the stronger part in the best split."""
        rates = [(self.rate(a, strong), self.rate(b, strong)) for a, b in _tokens(m)]
        return max(((min(r), max(r)) for r in rates), default=(0.0, 0.0))


def describe(c: Candidate, lexicon: Lexicon, own: bool = False) -> list[float]:
    """Format and context features of one span; ``own``: unknown words count by their own context."""
    k, s, e, t, m = c
    span, left, right = t[s:e], t[max(0, s - 40) : s], t[e : e + 40]
    line_left = left.rsplit("\n", 1)[-1]
    digits = sum(ch.isdigit() for ch in span)
    shape = next((i + 1 for i, p in enumerate(_SHAPES) if p.fullmatch(span)), 0) if k in (1, 2) else 0
    domain = re.split(r"@|[(\[{<]?\s?(?:AT|at|アット)\s?[)\]}>]?", span)[-1] if k == 0 else ""
    weak, strong = lexicon.pair(m, own and at_trigger(t, s, e)) if k == 4 else (0.0, 0.0)
    sentence = re.split(r"(?<=[.!?。])\s|\n", left)[-1] + span + re.split(r"(?<=[.!?。])\s|\n", right)[0]
    return [
        k, e - s, digits, shape, len(re.findall(r"[A-Za-z]", span)), span.count(" "), span.count("-"), span.count("."),
        float(span[:1] == "+"), float(bool(_KEYS[TYPES[k]].search(left[-30:]))), float(bool(_KEYS[TYPES[k]].search(right[:24]))),
        float(bool(_COUNTER.search(sentence))), float(bool(_URL.search(line_left))), float(right[:1] in (":", "/") and right[1:2] not in (" ", "")),
        float(bool(re.search(r"\.\d+$|^\d", domain))), float(bool(re.search(r"^(?:git|dev|root|svc)@", span))),
        float("word" in m.groupdict() and bool(m.groupdict().get("word"))), float(bool(_BEFORE.search(left[-24:]))), float(bool(_AFTER.match(right))),
        weak, strong, float(left[-1:] in ("|", "\t", ",", ";") or left[-2:] in ("| ", ": ")), float(right[:1] in ("|", "\t", ",", ";") or right[:2] == " |"),
        float(bool(re.search(r"〒|[都道府県].*[市区町村郡]|P\.?\s?O\.?\s?Box|stra(?:ß|ss)e|(?:weg|platz|gasse|allee|ring|str\.)\s\d|(?:^|, )\d", span))), float(bool(re.search(r" of the|^(?:Street|Lane|Road|Pier|Square|Quay)\b", span))),
        float(k == 1 and bool(re.match(r"\(?1\d\d\)?[ .\-]", span))), float(digits == 0 and k == 4 and span.isupper()),
    ]


#: Features that name a span (see :func:`named`), and the separators of tables, where nothing is named:
#: the trees do not see them.
NAMING = (9, 10, 16, 17, 18)
WITHHELD = (*NAMING, 21, 22)


def named(x: np.ndarray) -> np.ndarray:
    """Whether the surroundings of each described span name it, outside of URLs."""
    key, trigger, word = x[:, 9].astype(bool) | x[:, 10].astype(bool), x[:, 17].astype(bool) | x[:, 18].astype(bool), x[:, 16].astype(bool)
    return (np.where(x[:, 0] == 4, trigger, key) | word) & (x[:, 12] == 0)


def visible(x: np.ndarray) -> np.ndarray:
    return np.delete(x, WITHHELD, axis=1)


class Detector:
    """Lexicon, and for each type the trees, the level of named spans and the threshold."""

    def __init__(self, lexicon: Lexicon | None = None) -> None:
        self.lexicon = lexicon
        self.trees = [BoostedTrees(rounds=40, depth=4) for _ in TYPES]
        self.scale = [(1.0, 0.0)] * len(TYPES)
        self.level = np.ones(len(TYPES))
        self.cuts = np.full(len(TYPES), 0.5)
        self.report: dict[str, tuple[int, float, float]] = {}

    def fit(self, texts: list[str]) -> Detector:
        """Trees of one half of the texts score the other: those scores give levels and thresholds.

        Then the trees are fitted on all of them. Without a lexicon, one is learned from the texts.
        """
        if self.lexicon is None:
            self.lexicon = Lexicon().learn(texts)
        found = [(i, c) for i, text in enumerate(texts) for c in candidates(text, self.lexicon)]
        if not found:
            return self
        x = np.array([describe(c, self.lexicon) for _, c in found])
        y = named(x)
        # The same number, address or mail named in one text is what it is in every text.
        spans = [(c[0], c[3][c[1] : c[2]]) for _, c in found]
        known = {s for s, positive in zip(spans, y) if positive and s[0] < 4}
        y = np.array([positive or s in known for s, positive in zip(spans, y)], dtype=float)
        y[x[:, 12] > 0] = 0.0
        seen = visible(x)
        half = np.array([crc32(texts[i].encode("utf-8", "replace")) % 2 for i, _ in found])
        for k, name in enumerate(TYPES):
            own = x[:, 0] == k
            if not own.any():
                continue
            raw = np.zeros(len(x))
            sides = [own & (half == h) for h in (0, 1)]
            whole = BoostedTrees(rounds=40, depth=4).fit(seen[own], y[own])
            if all((y[side] > 0).any() for side in sides):
                for train, held in (sides, sides[::-1]):
                    raw[held] = BoostedTrees(rounds=40, depth=4).fit(seen[train], y[train]).score(seen[held])
            else:
                raw[own] = whole.score(seen[own])
            self.scale[k] = platt(raw[own], y[own])
            p, real = sigmoid(self.scale[k][0] * raw[own] + self.scale[k][1]), y[own] > 0
            self.level[k] = float(np.median(p[real])) if real.any() else 1.0
            p = np.minimum(1.0, p / self.level[k])
            self.cuts[k] = self._cut(p)
            said = p >= self.cuts[k]
            self.report[name] = (int(own.sum()), float(p[said].mean()) if said.any() else 1.0, float((said & real).sum() / max(1, real.sum())))
            self.trees[k] = whole
        return self

    @staticmethod
    def _cut(p: np.ndarray) -> float:
        """A threshold in the lower part of the widest gap between the probabilities from 0.1 to 0.6."""
        inner = np.concatenate([[0.1], np.sort(p[(p > 0.1) & (p < 0.6)]), [0.6]])
        gap = int(np.diff(inner).argmax())
        return float(inner[gap] + 0.25 * (inner[gap + 1] - inner[gap]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        out, seen = np.zeros(len(x)), visible(x)
        for k, level in enumerate(self.level):
            own = x[:, 0] == k
            if own.any():
                a, b = self.scale[k]
                out[own] = np.minimum(1.0, sigmoid(a * self.trees[k].score(seen[own]) + b) / level)
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """The selected spans (start, end, type) of each text, without overlaps, in order."""
        lexicon = self.lexicon or Lexicon()
        found = [(i, c) for i, text in enumerate(texts) if text for c in candidates(text, lexicon)]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not found:
            return out
        x = np.array([describe(c, lexicon, own=True) for _, c in found])
        p = self.probability(x)
        keep: dict[int, list[tuple[float, int, int, int]]] = {}
        for (i, c), q in zip(found, p):
            if q >= self.cuts[c[0]]:
                keep.setdefault(i, []).append((q, c[1], c[2], c[0]))
        for i, spans in keep.items():
            taken: list[tuple[int, int, str]] = []
            for _, s, e, k in sorted(spans, key=lambda v: (-round(v[0], 1), -(v[2] - v[1]), v[1])):
                if all(e <= a or s >= b for a, b, _ in taken):
                    taken.append((s, e, TYPES[k]))
            out[i] = sorted(taken)
        return out


# What Python's \s, \w and \d match in text, for Java's patterns; Java may not know the newest characters (Cn).
# The second of each is what they match in ASCII texts, where it is much faster.
_SPACE = (r"\s\x1c-\x1f\x85\p{Z}", r"\s\x1c-\x1f")
_WORD = (r"\p{L}\p{N}\p{Cn}_", r"a-zA-Z0-9_")
_DIGIT = (r"[\p{Nd}\p{Cn}]", r"[0-9]")


def _jvm(pattern: str, ascii: bool = False) -> str:
    """A generator's pattern, whose ``\\s`` and ``\\w`` stand within classes, in Java's syntax."""
    for old, new in (("?P<", "?<"), ("(?i:", "(?i:" if ascii else "(?iu:"), (r"\d", _DIGIT[ascii]), (r"\s", _SPACE[ascii]), (r"\w", _WORD[ascii])):
        pattern = pattern.replace(old, new)
    return pattern


def _patterns(ascii: bool) -> str:
    """What each generator needs to propose a span, but for unspaced kanji names without trigger."""
    space, digit = _SPACE[ascii], _DIGIT[ascii]
    parts = [
        rf"@|[(\[{{<][{space}]?(?:at|AT|At|アット)[{space}]?[)\]}}>]|[{space}]AT[{space}]| at [A-Za-z0-9\-]+[{space}]?[(\[{{<]?[{space}]?(?:dot|DOT)",
        # Phone numbers have nine digits, of which an extension holds at most five.
        rf"{digit}(?:[ .()\-]{{0,2}}{digit}){{8}}|{digit}(?:[ .()\-]{{0,2}}{digit}){{3}}[{space}]?(?:ext\.?|x|内線)[{space}]?{digit}",
        _jvm(ID.pattern, ascii),
        rf"{digit}[A-Za-z]?,? (?:{_jvm(_CAP, ascii)} ){{1,4}}(?:{_STREET})|(?:straße|strasse|str\.|weg|platz|gasse|allee|ring)[{space}]{digit}",
        rf"{digit}(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|quai|allée|impasse|cours) ",
        rf"P\.?[{space}]?O\.?[{space}]?Box[{space}]{digit}",
        rf"{digit} (?:street|lane|road|avenue) of the|(?:Street|Lane|Road|Square|Pier|Quay) (?:of|{digit}|[A-ZÀ-Þ])",
        NAME.pattern.replace("?P<", "?<"),
    ]
    if not ascii:
        parts += [
            rf"〒[{space}]?{digit}{{3}}|[都道府県][一-鿿ヶぁ-んァ-ン]{{1,8}}[市区町村郡][一-鿿ヶぁ-んァ-ン]{{0,12}}{digit}",
            rf"(?<![{_KANJI}])[{_KANJI}]{{1,3}} (?:[{_KANJI}]{{1,3}}|[ぁ-ん]{{2,4}}|[ァ-ン]{{2,4}})|[{_KANJI}]{{2}}(?:さん|様|氏|殿|です。)",
            _BEFORE.pattern.removesuffix(r"\s*$") + rf"[{space}]*[{_KANJI}]{{2}}",
        ]
    return "|".join(parts)


#: Cheap test of narrowed text before any Python runs, and its form for ASCII texts.
PREFILTER, ASCII_PREFILTER = _patterns(False), _patterns(True)
#: Runs of kanji that may be names without a blank; used where the lexicon is too long for a pattern.
ANY_KANJI = rf"[{_KANJI}]{{2}}(?:さん|様|氏|殿|です|は|が|[。、.,:|\t\n]|\z)"
#: What a text needs to teach the lexicon something.
ASCII_NAMES = NAME.pattern.replace("?P<", "?<")
NAMES = ASCII_NAMES + rf"|(?<![{_KANJI}])[{_KANJI}]{{1,3}} (?:[{_KANJI}]{{1,3}}|[ぁ-ん]{{2,4}}|[ァ-ン]{{2,4}})"
#: Words up to which the lexicon is a part of the prefilter.
PATTERN_WORDS = 2000


def prefilter(lexicon: Lexicon | None = None) -> str:
    """A pattern that every text with a candidate passes: a long lexicon only makes it less narrow."""
    if lexicon is None:
        return PREFILTER
    words = sorted(w for w in lexicon.hits if lexicon.hits[w] > 0 and not w.isascii() and all(c.isalpha() for c in w))
    return PREFILTER + "|" + (ANY_KANJI if len(words) > PATTERN_WORDS else "|".join(words)) if words else PREFILTER


def narrowed(column: str) -> Column:
    """As :func:`narrow`, for a column; only texts with wide forms pay for it."""
    wide = "".join(map(chr, _WIDE))
    return F.when(F.col(column).rlike(r"[！-～\u3000\xa0\u2010\u2011\u2013\u2212]"), F.translate(column, wide, "".join(map(chr, _WIDE.values())))).otherwise(F.col(column))


def _passes(column: str, plain: str, wide: str) -> Column:
    """Whether a text matches: ASCII texts the first pattern, others, narrowed, the second."""
    ascii = F.octet_length(column) == F.length(column)
    return F.coalesce(F.when(ascii, F.col(column).rlike(plain)).otherwise(narrowed(column).rlike(wide)), F.lit(False))


def may_hold(column: str, lexicon: Lexicon | None = None) -> Column:
    """Whether a text may have a candidate."""
    return _passes(column, ASCII_PREFILTER, prefilter(lexicon))


def count_names(texts: DataFrame, column: str = "text") -> Lexicon:
    """The lexicon of all texts: partial counts of each batch, summed up.

    Words that never stood at a trigger have rate 0 and are left out, and so are those of less than
    ``NAME_SHARE`` of all such words: they count by their own context.
    """
    own = texts.select(F.col(column).alias("t")).filter(_passes("t", ASCII_NAMES, NAMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            lexicon.learn(batch.column(0).to_pylist())
            if len(lexicon.seen) > 200_000:
                yield lexicon_rows(lexicon)
                lexicon = Lexicon()
        yield lexicon_rows(lexicon)

    counts = spread(own).mapInArrow(run, "word string, hits bigint, seen bigint").groupBy("word").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen"))
    counts = cut_lineage(counts.filter("hits > 0"))  # counted once, read for the total and the words
    total = counts.agg(F.sum("hits").alias("total"))
    kept = counts.crossJoin(F.broadcast(total)).filter(F.col("hits") >= F.col("total") * NAME_SHARE).collect()  # one row against all
    return Lexicon({r.word: r.hits for r in kept}, {r.word: r.seen for r in kept})


def lexicon_rows(lexicon: Lexicon) -> pa.RecordBatch:
    words = list(lexicon.seen)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([lexicon.hits[w] for w in words], pa.int64()), pa.array([lexicon.seen[w] for w in words], pa.int64())], names=["word", "hits", "seen"])


def fit_detector(texts: DataFrame, keys: list[str], column: str = "text") -> Detector:
    """Lexicon over all texts, trees on about ``SAMPLE_TEXTS``; those without any candidate teach nothing."""
    rows = bounded_sample(texts.filter(F.length(column) > 0).select(*keys, F.col(column).alias("__t")), keys, SAMPLE_TEXTS, "__t", SAMPLE_BYTES)
    lexicon = count_names(texts, column)
    return Detector(lexicon).fit([t for t in sorted({r["__t"] for r in rows}) if candidates(t, lexicon)])


def find(rows: DataFrame, keys: list[str], text: str = "text", detector: Detector | None = None) -> DataFrame:
    """keys + (spans, redacted): typed spans of each text and the text with placeholders.

    Texts that cannot hold a candidate are recognised by the JVM; they come back with no spans and
    unchanged. One narrow pass, no shuffle.
    """
    detector = detector or fit_detector(rows, keys, text)
    picked = spread(rows.select(*keys, F.col(text).alias("__text")))
    maybe = may_hold("__text", detector.lexicon)
    fields = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, spans array<struct<start:int,end:int,type:string>>, redacted string"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n).to_pylist()
            spans = detector.spans(texts)
            cells = [[{"start": s, "end": e, "type": k} for s, e, k in own] for own in spans]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(cells, span_type), pa.array([redact(t, own) for t, own in zip(texts, spans)], pa.string())],
                names=[*keys, "spans", "redacted"],
            )

    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,type:string>>")
    plain = picked.filter(~maybe).select(*keys, none.alias("spans"), F.col("__text").alias("redacted"))
    return picked.filter(maybe).mapInArrow(run, schema).unionByName(plain)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its placeholder; everything else stays as it was."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], PLACEHOLDER[k]]
        at = e
    return "".join([*out, text[at:]])
