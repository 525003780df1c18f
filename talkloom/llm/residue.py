"""Problem 10: template residue, filler and error pages.

Method: a regularised linear classifier on hashed n-grams, length and title features. Weak labels
come from response status and phrases (pages, walls, notices, filler) and from placeholder marks
outside code. Labelled residue is learned a second time without the phrases that label it, so that
the model does not only repeat them; it is validated on hosts that it never saw. Units are a document
as a whole and each of its prose paragraphs, since a placeholder may stand in one paragraph of a long
text. There is no field with a response status: states are read from the text.

Results for special input: null and empty texts are no residue; short genuine remarks stay; a text
is read whole; equal rows get equal results; a null title is an empty one; empty tables give empty
results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.models import HashedLogistic, platt, sigmoid, threshold_for
from talkloom.llm.truncation import vocabulary
from talkloom.session import bounded_sample, spread

#: Bound of the weakly labelled sample.
SAMPLE_DOCUMENTS = 8000
#: Share of a document's prose that page phrases must make up for a weak page label.
PAGE_SHARE = 0.66
#: Share of all corpus words from which a word counts as known (so at most 1 / share words).
WORD_SHARE = 1e-4
#: A prose text of at least so many words is filler when at most this share of them is known.
FILLER_WORDS, FILLER_KNOWN = 8, 0.25
#: Characters that residue without its phrases must still have to be learned as such.
LEAST_REST = 12
_BITS = 18
_MASK = (1 << _BITS) - 1

# Response states and the phrases of pages, walls, notices and filler.
_STATES = r"Bad Request|Unauthori[sz]ed|Forbidden|Not Found|Method Not Allowed|Request Time-?out|Gone|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service Unavailable|Gateway Time-?out"
PAGE = re.compile(
    rf"\b[45]\d\d\b[\s\-:]{{0,3}}(?:{_STATES})|(?:{_STATES})[\s.]*(?:</|\n|$)|HTTP ERROR \d|\"(?:code|status)\":\s*[45]\d\d\b|page isn.t working|could not complete the request"
    r"|access denied|do not have permission to view|session has expired|sign in (?:to|again)|log in to continue|forgot password|^(?:e-?mail|user ?name|password)$|not a robot|checking (?:that|your browser)|this takes a few seconds|verify you are human"
    r"|enable (?:java ?script|scripts)|java ?script (?:is )?(?:required|disabled)|works best with java ?script|scripts (?:are|is)? ?switched o|without scripts|need to enable|<noscript"
    r"|we use cookies|accept all|planned maintenance|page you asked for|page (?:was )?not found|was not found on|link you followed|something went wrong|try (?:reloading|again later)|contact the (?:help|support)"
    r"|見つかりませんでした|一時的に接続できません|再度お試しください|アクセス権限がありません|管理者に連絡|JavaScript を有効に|ログインしてください|メンテナンス中|クッキー|ロボットではない",
    re.IGNORECASE | re.MULTILINE,
)
FILLER = re.compile(
    r"lorem ipsum|dolor sit amet|\[object Object\]|^undefined$|\bNaN undefined|(?:\basdf\b ?){2}|qwer qwer|(?:\btest\b ?){3}|sample text|goes here|your (?:description|text|title|name) here|add more detail here|click to edit|replace this text|insert .{1,20} here"
    r"|テスト テスト|ああああ|いいいい|ここに本文を入力|ここに.{1,8}を入力|サンプルテキスト|ダミーテキスト",
    re.IGNORECASE | re.MULTILINE,
)
PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]{1,40}\}\}\}?|\$\{[^{}\n]{1,40}\}|<%=?[^%\n]{1,40}%>|<<[^<>\n]{1,30}>>|\[\[[^\[\]\n]{1,30}\]\]|@@\w[^@\n]{0,28}@@|%[A-Za-z][A-Za-z_ ]{1,28}%|%\([A-Za-z_]\w{0,28}\)[sd]|\$[A-Za-z]\w{1,28}\$|#\{[^{}\n]{1,30}\}|\b__[A-Z][A-Z_ ]{1,28}__"
    r"|\{[A-Za-z_぀-ヿ㐀-鿿][\w ]{1,28}\}|\[[A-Z][A-Z_ ]{2,28}\]|<[A-Z][A-Z_ ]{2,28}>|\b(?:TODO|FIXME|XXX)_[A-Z][A-Z_ ]+|○○[^○\n]{0,12}○○|〇〇[^〇\n]{0,12}〇〇|〔[^〕\n]{1,16}〕|［[^］\n]{1,16}］|｛[^｝\n]{1,16}｝|[（(【\[]ここに[^）)】\]\n]{1,16}[）)】\]]|[【\[][^】\]\n]{1,12}を(?:入力|記入)[】\]]|\bX{3,}\b"
)
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.DOTALL)
_INLINE = re.compile(r"`[^`\n]*`")
_TRACE = re.compile(r"^(?:Trace|Request id|ref)\b.*$|\b(?:Ray|Reference) #?[0-9a-f.]+\s*$|^(?:proxy|nginx|server)/[\d.]+$|^Home \| .*$|</?(?:html|body|head)[^>]*>|^#+\s*$", re.MULTILINE | re.IGNORECASE)
HOST = re.compile(r"\b([a-z0-9\-]+\.(?:example|test|invalid|com|org|net|io)(?:\.[a-z]+)?)\b", re.IGNORECASE)
_HEX = re.compile(r"\b[0-9a-f]{8,}\b")
_DOTTED = re.compile(r"\.(?:example|test|invalid|com|org|net|io)\b", re.IGNORECASE)
_MARKS = re.compile(r"[{}<>$%@#\[\]○〇（【〔［｛]|__|\b(?:TODO|FIXME|XXX)_|X{3}")
_GRAM = re.compile("\ue000|"
    r"[A-Za-z]+|\d|[^\W\d_A-Za-z]|[^\w\s]")


def prose(text: str) -> str:
    """The text without code blocks and inline code."""
    return _INLINE.sub(" `c` ", _FENCE.sub("\n\n", text))


def units(text: str) -> list[tuple[str, float]]:
    """(text, share): the whole prose, then each paragraph that may hold a mark, with its share of it.

    Paragraphs without any mark character cannot be residue by themselves; they count in the whole.
    """
    body = prose(text)
    whole = max(1, len(body.strip()))
    parts = [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]
    return [(body.strip(), 1.0)] + ([(p, len(p) / whole) for p in parts if _MARKS.search(p)] if len(parts) > 1 else [])


def known_share(core: str, known: frozenset[str]) -> float:
    """Share of known words among a text's Latin words; 1 where they are few or not most of it."""
    words = re.findall(r"[A-Za-z]{3,}", core)
    if not known or len(words) < FILLER_WORDS or sum(map(len, words)) < 0.6 * len("".join(core.split())):
        return 1.0
    return sum(w.lower() in known for w in words) / len(words)


def weak_label(unit: str, share: float, known: frozenset[str] = frozenset()) -> int:
    """1 residue, 0 not: placeholder marks in prose, page and filler phrases over most of a text, or no words."""
    if _MARKS.search(unit) and PLACEHOLDER.search(unit):
        return 1
    if share < PAGE_SHARE:
        return 0
    core = _TRACE.sub("", unit).strip()
    if not core:
        return 0
    if known_share(core, known) <= FILLER_KNOWN:
        return 1
    covered = sum(len(line) for line in re.split(r"\n|(?<=[.。])\s*", core) if line and (PAGE.search(line) or FILLER.search(line)))
    return int(covered >= PAGE_SHARE * len(core))


class _Codes(dict):
    """Hashes of tokens without regard to case and of digits; emptied when it grows too large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[token] = crc32(("9" if token.isdigit() else token.lower()).encode("utf-8", "replace"))
        return self[token]


_CODES = _Codes()


def feature_rows(units_: list[tuple[str, float, str | None]], known: frozenset[str] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """(feature, owner) of hashed n-grams, length and title features of all units at once."""
    codes: list[int] = []
    sizes, short, parts = (np.zeros(len(units_), np.int64) for _ in range(3))
    own: list[int] = []
    owners: list[int] = []
    for i, (unit, share, title) in enumerate(units_):
        text = PLACEHOLDER.sub(" \ue000 ", unit) if _MARKS.search(unit) else unit
        text = _HEX.sub(" hex ", text)
        if _DOTTED.search(text):
            text = HOST.sub(" host ", text)
        tokens = _GRAM.findall(text)
        codes += map(_CODES.__getitem__, tokens)
        sizes[i] = len(tokens)
        marked = "\ue000" in text
        size = min(len(unit), 4000).bit_length()
        part = "w" if share >= PAGE_SHARE else "p"
        short[i], parts[i] = size <= 9, part == "w"
        distinct = len(set(tokens)) / max(1, len(tokens))
        rate = known_share(_TRACE.sub("", unit), known)
        names = [f"len:{size}:{part}", f"div:{int(distinct * 5)}:{size}", f"ph:{marked}", f"ph2:{marked}:{size}", f"kn:{int(rate * 8)}", f"kn2:{int(rate * 4)}:{size}:{part}"]
        names += ["nowords", f"nowords:{size}", f"nowords:{part}", f"nowords:{int(distinct * 5)}", f"nowords:{bool(title)}"] * (rate <= FILLER_KNOWN) + [f"t:{w}" for w in re.findall(r"\w+", (title or "none").lower())[:6]]
        own += [_CODES[f"\x00{n}"] & _MASK for n in names]
        owners += [i] * len(names)
    one = np.array(codes, np.int64)
    unit_of = np.repeat(np.arange(len(units_)), sizes)
    two = one[:-1] * 1000003 ^ one[1:]
    three = two[:-1] * 1000003 ^ one[2:]
    keys = []
    for n, grams in ((1, one), (2, two), (3, three)):
        whole = unit_of[: len(grams)] == unit_of[n - 1 :]
        grams = grams[whole]
        keys.append(unit_of[: len(whole)][whole] << _BITS | (grams ^ (grams >> 17)) & _MASK)
    grams = np.sort(np.concatenate(keys))
    grams = grams[np.append(True, grams[1:] != grams[:-1])] if len(grams) else grams
    owner, feature = grams >> _BITS, grams & _MASK
    # Short texts and whole ones have weights of their own, too.
    mine = short[owner] > 0
    again = (feature[mine] * 31 + 7919 * (1 + parts[owner[mine]])) & _MASK
    features = np.concatenate([feature, again, np.array(own, np.int64)])
    owner = np.concatenate([owner, owner[mine], np.array(owners, np.int64)])
    order = np.argsort(owner, kind="stable")
    return features[order], owner[order]


class ResidueModel:
    """Weights, calibration and threshold, with its accuracy on unseen hosts."""

    def __init__(self, known: frozenset[str] = frozenset()) -> None:
        self.known = known
        self.model = HashedLogistic(bits=18, l2=1e-5, epochs=5, rate=0.3)
        self.scale, self.cut, self.unseen = (1.0, 0.0), 0.5, (0, 0.0, 0.0)

    def fit(self, documents: list[tuple[str, str | None]]) -> ResidueModel:
        rows, y, groups = [], [], []
        for text, title in documents:
            host = HOST.search(text)
            group = crc32((host[1].lower() if host else text[:40]).encode("utf-8", "replace")) % 5
            for unit, share in units(text):
                rows.append((unit, share, title))
                y.append(weak_label(unit, share, self.known))
                groups.append(group)
                # Residue also without the phrases of its label, so that the rest is learned as well.
                rest = FILLER.sub(" ", PAGE.sub(" ", unit)).strip() if y[-1] else unit
                if rest != unit and len(rest) >= LEAST_REST:
                    rows.append((rest, share, title))
                    y.append(1)
                    groups.append(group)
        if not rows:
            return self
        feature, owner = feature_rows(rows, self.known)
        rows = np.split(feature, np.searchsorted(owner, np.arange(1, len(rows))))
        labels, group = np.array(y, dtype=float), np.array(groups)
        seen, unseen = np.flatnonzero(group != 0), np.flatnonzero(group == 0)
        if len(seen) and len(unseen):
            self.model.fit([rows[i] for i in seen], labels[seen])
            score = self.model.score([rows[i] for i in unseen])
            self.scale = platt(score, labels[unseen])
            p = sigmoid(self.scale[0] * score + self.scale[1])
            self.cut = min(max(threshold_for(p, labels[unseen], 0.98), 0.57), 0.7)
            said, real = p >= self.cut, labels[unseen] > 0
            self.model.fit(rows, labels)
            self.unseen = (len(unseen), float((said & real).sum() / max(1, said.sum())), float((said & real).sum() / max(1, real.sum())))
        else:
            self.model.fit(rows, labels)
        return self

    def probability(self, documents: list[tuple[str | None, str | None]]) -> np.ndarray:
        """The highest probability among the units of each document."""
        rows, of = [], []
        for i, (text, title) in enumerate(documents):
            for unit, share in units(text) if text and text.strip() else ():
                rows.append((unit, share, title))
                of.append(i)
        out = np.zeros(len(documents))
        if rows:
            score = self.model.score_sparse(*feature_rows(rows, self.known), len(rows))
            np.maximum.at(out, np.array(of), sigmoid(self.scale[0] * score + self.scale[1]))
        return out


def fit_model(documents: DataFrame) -> ResidueModel:
    rows = bounded_sample(documents.filter(F.length("text") > 0).select("doc_id", "text", "title"), ["doc_id"], SAMPLE_DOCUMENTS)
    known = vocabulary(documents, "text", WORD_SHARE)
    return ResidueModel(known).fit(sorted((r.text, r.title or "") for r in rows))


def score(documents: DataFrame, model: ResidueModel | None = None) -> DataFrame:
    """(doc_id, residue_probability, residue) of each document with doc_id, text and title."""
    model = model or fit_model(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(p >= model.cut, pa.bool_())], names=["doc_id", "residue_probability", "residue"])

    return spread(documents.select("doc_id", "text", "title")).mapInArrow(run, "doc_id bigint, residue_probability double, residue boolean")
