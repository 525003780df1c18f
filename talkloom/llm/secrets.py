"""Problem 3: credentials in code, configuration and logs.

Method: literals near assignment contexts (names, headers, URLs, commands, comments, JSON members)
are segmented into dictionary words by Viterbi, each word at the cost of its probability; what no
word explains is the residual. Nothing but a long residual makes a secret, of the type that the
context names; known hash formats are excluded unless a context names a credential. The dictionary
holds every word that makes up at least ``WORD_SHARE`` of all words of both tables, so it has at
most 1 / WORD_SHARE words whatever the corpus size.

Results for special input: null and empty texts hold nothing; texts are read whole; payloads that
are no JSON are read as plain text; equal rows get equal results; empty tables give empty results.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.session import spread

#: Share of all corpus words from which a word belongs to the dictionary.
WORD_SHARE = 1e-4
#: Unexplained letters and digits from which a literal is a secret, by type.
RESIDUAL = {"api_key": 12, "token": 12, "password": 4}
#: Cost of an unexplained letter or digit, in nats: somewhat more than one of 36 equally likely ones.
UNKNOWN = 4.5
MASK = "*"

# The words that name each type in a place (variable, header, comment).
_PASSWORD = r"pass(?:word|wd|phrase|code)?s?|pwd|pw|requirepass|パスワード|暗証番号"
_TOKEN = r"tokens?|bearer|jwt|auth[_\-]?token|sess(?:ion)?(?:[_\-]?id)?|sid"
_API = r"api[_\- ]?keys?|access[_\- ]?keys?(?:[_\- ]?id)?|secret[_\- ]?(?:access[_\- ]?)?keys?|client[_\- ]?secret|app[_\- ]?(?:key|secret)|account[_\- ]?key|license[_\- ]?key|signing[_\- ]?key|encryption[_\- ]?key|key|secrets?|credentials?"
# The prefixes by which issuers mark their credentials.
_PREFIXED = [
    (re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|sk-(?:ant-|proj-|live-|test-)?[A-Za-z0-9_\-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{20,}|SG\.[\w\-]{16,}\.[\w\-]{16,}"), "api_key"),
    (re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[A-Za-z0-9_\-]{16,}|xox[abeprs]-[A-Za-z0-9\-]{10,}|npm_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|pypi-[A-Za-z0-9_\-]{16,}|ya29\.[\w\-]{16,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"), "token"),
]

_VALUE = r"[^\s\"'`<>,;\\]{4,}"
_QUOTED = r"(?P<q>\\?[\"'`])(?P<v1>(?:(?!(?P=q))[^\n]){4,}?)(?P=q)"
_NAMED = re.compile(
    rf"(?P<name>[\w.\-]*(?:{_PASSWORD}|{_API}|{_TOKEN})[\w.\-]*)"
    rf"(?:\\?[\"'\])]{{1,2}})?\s?(?:=>|:=|={{1,3}}|:|\\?[\"'] value=|\\?[\"'],)\s?(?:(?:Bearer|Token|token|bearer)\s)?(?:[brfu]{{1,2}}(?=[\"']))?(?:{_QUOTED}|(?P<v2>{_VALUE}))",
    re.IGNORECASE,
)
_ENV = re.compile(rf"\b(?:ENV|ARG|setx?|setenv|config set)\s+(?P<name>\w*(?:{_PASSWORD}|{_API}|{_TOKEN})\w*)\s+[\"']?(?P<v2>{_VALUE})", re.IGNORECASE)
_XML = re.compile(rf"(?:key|name)=\\?[\"'](?P<name>[\w.\-:]*(?:{_PASSWORD}|{_API}|{_TOKEN})[\w.\-]*)\\?[\"'] value=\\?[\"'](?P<v2>[^\"'\\]{{4,}})", re.IGNORECASE)
_HEADER = re.compile(r"(?P<scheme>Bearer|Token|Basic|Digest)(?:\s|['\"]\s*\+\s*['\"]|\s['\"]\s*\+\s*['\"])+(?P<v2>[A-Za-z0-9._~+/=\-]{8,})")
_URL = re.compile(r"[a-z][a-z0-9+.\-]*://(?P<user>[^\s/:@\"'`]*):(?P<v2>[^\s/\"'`]+?)@(?=[\w.\-\[])", re.IGNORECASE)
_COMMAND = re.compile(
    r"sshpass\s+-p\s*[\"']?(?P<a>[^\s\"']{4,})|curl\b[^\n]*?\s-u\s*[\"']?[\w.@\-]+:(?P<b>[^\s\"']{4,})|(?:--?password|--pass|--passphrase|-passin pass:|--token|--api-key)[= ]\s?[\"']?(?P<c>[^\s\"']{4,})"
    r"|\bmysql\b[^\n]*?\s-p(?P<d>[^\s\"'-][^\s\"']{3,})|\bIDENTIFIED BY\s+[\"'](?P<e>[^\"']{4,})|\blogin\s+\S+\s+password\s+(?P<f>\S{4,})",
    re.IGNORECASE,
)
_PROSE = re.compile(r"(?:\b(?:the |with |my |is |use )?(?P<n1>password|passphrase|passcode|api key|access key|token)(?: is| was)?:? |(?P<n2>パスワード|暗証番号|APIキー|トークン)(?:は|が|[:：])\s?)[\"'「]?(?P<v2>[!-~]{6,})", re.IGNORECASE)
_COMMENT = re.compile(rf"(?:#|//|--|/\*|;)[^\n]*?(?P<name>{_PASSWORD}|{_API}|{_TOKEN})[^\n:=]{{0,40}}[:=]\s?(?P<v2>{_VALUE})", re.IGNORECASE)
_NOTED = re.compile(r"[\"'](?P<v2>[^\s\"']{12,})[\"'][^\n\"']*(?:#|//|/\*)\s*(?P<name>[^\n]*?(?:api key|access key|token|password|secret)[^\n]*)", re.IGNORECASE)
_CALL = re.compile(r"\b\w*(?:[Cc]lient|[Ll]ogin|[Cc]onnect|[Aa]uthenticate|[Aa]uth|[Aa]pi)\(\s*\\?[\"'](?P<v2>[A-Za-z0-9_\-+/=.]{20,})\\?[\"']")
_PEM = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?-----(?P<body>[\s\S]*?)(?:-----END (?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?-----|\Z)"
    r"|PuTTY-User-Key-File-\d:[\s\S]*?Private-Lines: ?\d+(?P<putty>[\s\S]*?)(?:Private-MAC|\Z|\n\n)|(?P<age>AGE-SECRET-KEY-1[A-Z0-9]{20,})"
)
_ENCODED_PEM = re.compile(r"LS0tLS1CRUdJTi[A-Za-z0-9+/=]{24,}")

_REFERENCE = re.compile(
    r"^[$%]|\$\{|\{\{|^<|^\[|%\(|\bos\.|environ|getenv|process\.env|ENV\[|vault|secretsmanager|ssm:|input\(|getpass|prompt\(|secrets?\.|config\.|settings\.|self\.|args\.|^(?:None|null|nil|true|false|undefined)\W*$|\w+\(\S*\)?$|^\w+\.\w+\.\w+$|^--|^/[\w/.\-]+$|^[\w.\-]+/[\w./\-]+\.\w{2,4}$|^https?:",
    re.IGNORECASE,
)
_BLANK = re.compile(r"^[\W_]*$|\*{3,}|[x•●…]{4,}|\.{3}|^<.*>$")
_DIGEST = re.compile(r"^(?:(?:md5|sha\d{1,3})[:\-])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$|^sha\d{3}-[A-Za-z0-9+/=]+$|^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$|^[0-9a-f]{7,12}$|^\d+$|^\d{4}-\d\d-\d\d", re.IGNORECASE)
_PUBLIC = re.compile(r"public|fingerprint|digest|checksum|sha\d|md5|hash|integrity|etag|commit|keyword|tokeni[sz]|token_?(?:count|estimator|limit|type)|max_?tokens?|primary_?key|foreign_?key|key_?(?:id|name|path|file|size|error|word|board|code|scan)|_keys?_|sort_?key|cache_?key|session_?key|pass(?:ed|ing|es|thr|ive)\b|passes", re.IGNORECASE)

# Names of sessions alone, and ids in hyphenated groups of digits: such a value only tells sessions apart.
_SESSION = re.compile(rf"(?!.*(?:{_PASSWORD}|{_API}|token|bearer|jwt|cookie)).*(?:sess|sid)", re.IGNORECASE)
_GROUPS = re.compile(r"[0-9a-f]+(?:-[0-9a-f]+)+", re.IGNORECASE)
_CONTINUED = re.compile(r"[\"']\s*(?:\+|\.|)\s*\\?\s*\n\s*[\"']([^\s\"']{4,})[\"']")
_MEMBER = re.compile(rf"[\w.\-]*(?:{_PASSWORD}|{_API}|{_TOKEN})[\w.\-]*", re.IGNORECASE)

Found = tuple[int, int, str]


def name_type(name: str) -> str:
    """The type that the name of a place gives."""
    n = name.lower()
    if re.search(r"pass|pwd|\bpw\b|パスワード|暗証", n):
        return "password"
    if re.search(r"token|bearer|jwt|session|\bsid\b|トークン|authorization|cookie", n):
        return "token"
    return "api_key"


class Segmenter:
    """Viterbi segmentation of literals into dictionary words, which cost -ln of their probability."""

    def __init__(self, words: dict[str, int]):
        total = max(1, sum(words.values()))
        self.cost = {w: math.log(total / n) for w, n in words.items() if len(w) >= 3}
        self.longest = max((len(w) for w in self.cost), default=0)

    def residual(self, literal: str) -> int:
        """Letters and digits that no dictionary word covers, in the cheapest segmentation."""
        text = literal.lower()
        best = [0.0] + [math.inf] * len(text)
        left = [0] * (len(text) + 1)
        for i in range(1, len(text) + 1):
            plain = text[i - 1].isalnum()
            best[i], left[i] = best[i - 1] + UNKNOWN * plain, left[i - 1] + plain
            for size in range(3, min(self.longest, i) + 1):
                cost = self.cost.get(text[i - size : i])
                if cost is not None and best[i - size] + cost < best[i]:
                    best[i], left[i] = best[i - size] + cost, left[i - size]
        return left[-1]


def _secret(value: str, kind: str, named: bool, words: Segmenter) -> bool:
    """Whether the residual of a literal makes it a secret: no reference, blank or bare digest."""
    if _REFERENCE.search(value) or _BLANK.search(value):
        return False
    if _DIGEST.search(value) and (not named or len(value) < 16 and kind != "password"):
        return False
    return words.residual(value) >= RESIDUAL[kind]


def _decoded(value: str) -> str:
    """The text that a base64 value encodes, or nothing."""
    if len(value) < 12 or len(value) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value):
        return ""
    try:
        text = base64.b64decode(value, validate=True).decode("ascii")
    except ValueError:
        return ""
    return text if text.isprintable() else ""


def scan(text: str, words: Segmenter) -> list[Found]:
    """(start, end, type) of each credential, in order and without overlaps."""
    out: list[Found] = []

    def add(start: int, end: int, kind: str) -> None:
        while end > start and text[end - 1] in ".,;:)]}。":
            end -= 1
        if end > start and all(end <= s or start >= e for s, e, _ in out):
            out.append((start, end, kind))

    for m in _PEM.finditer(text):
        for group in ("body", "putty", "age"):
            if m[group] and len(m[group].strip()) > 8:
                add(m.start(group), m.end(group), "private_key")
    for m in _ENCODED_PEM.finditer(text):
        if b"PRIVATE" in base64.b64decode(m.group()[: len(m.group()) // 4 * 4] or "", validate=False)[:60]:
            add(m.start(), m.end(), "private_key")
    for m in _URL.finditer(text):
        kind = "token" if m["user"].lower() in ("oauth2", "x-access-token", "x-token-auth", "") else "password"
        if _secret(m["v2"], "password", True, words):
            add(m.start("v2"), m.end("v2"), kind)
    for m in _HEADER.finditer(text):
        kind = "token" if m["scheme"] in ("Bearer", "Token", "Digest") else "password"
        if _secret(m["v2"], "token", True, words) or (kind == "password" and ":" in _decoded(m["v2"])):
            add(m.start("v2"), m.end("v2"), kind)
    for m in _COMMAND.finditer(text):
        group = next(g for g in "abcdef" if m[g])
        kind = name_type(m.group()[:14]) if group == "c" else "password"
        if _secret(m[group], kind, True, words):
            add(m.start(group), m.end(group), kind)
    for m in _NOTED.finditer(text):
        kind = name_type(m["name"])
        if _secret(m["v2"], kind, True, words):
            add(m.start("v2"), m.end("v2"), kind)
    for pattern in (_XML, _ENV, _NAMED):
        for m in pattern.finditer(text):
            group = "v2" if m["v2"] else "v1"
            value, name = m[group], m["name"]
            if _PUBLIC.search(name) and not re.search(r"session_?(?:token|secret)|secret_?key_?id", name, re.IGNORECASE):
                continue
            kind = name_type(name)
            if re.search(r"\s", value.strip()):
                continue
            bare = value.rstrip(".,;:)]}。")
            # A literal that continues on the next line is judged as one.
            follow = _CONTINUED.match(text, m.end(group))
            judged = bare + follow[1] if follow else bare
            plain = re.fullmatch(r"(?:.*[_\-.])?keys?|(?:.*[_\-.])?secrets?|pw|pass|sid", name, re.IGNORECASE)
            if plain and group == "v2" and kind != "password" and not re.search(r"[=?&]\s?$", text[max(0, m.start("v2") - 1) : m.start("v2")]) and len(judged) < 20:
                continue
            # A session's id is none, except as the value of a cookie.
            if _SESSION.match(name) and _GROUPS.fullmatch(judged) and not (text[m.start(group) - 1] == "=" and re.search("cookie", text[text.rfind("\n", 0, m.start()) + 1 : m.start()], re.IGNORECASE)):
                continue
            if _secret(judged, kind, True, words):
                add(m.start(group), m.start(group) + len(bare), kind)
                if follow:
                    add(follow.start(1), follow.end(1), kind)
    for m in _COMMENT.finditer(text):
        kind = name_type(m["name"])
        if not _PUBLIC.search(m.group()[:60]) and _secret(m["v2"], kind, True, words):
            add(m.start("v2"), m.end("v2"), kind)
    for m in _PROSE.finditer(text):
        value = re.sub(r"[.,;:)\]}」。\"']+$", "", m["v2"])
        if re.search(r"\d|[a-z][!#$%^&*?~+=].*[A-Z]|[A-Z].*[!#$%^&*?~+=].*[a-z]", value) and _secret(value, name_type(m["n1"] or m["n2"]), True, words):
            add(m.start("v2"), m.start("v2") + len(value), name_type(m["n1"] or m["n2"]))
    for m in _CALL.finditer(text):
        if _secret(m["v2"], "api_key", True, words):
            add(m.start("v2"), m.end("v2"), next((k for p, k in _PREFIXED if p.fullmatch(m["v2"])), "api_key"))
    for pattern, kind in _PREFIXED:
        for m in pattern.finditer(text):
            if not _BLANK.search(m.group()) and words.residual(m.group()) >= RESIDUAL["token"]:
                add(m.start(), m.end(), kind)
    return sorted(out)


def mask(text: str, found: list[Found]) -> str:
    """Each credential character as ``*``; white space, line marks and all else stay."""
    out, at = [], 0
    for s, e, _ in found:
        out += [text[at:s], re.sub(r"(\\+[nrt])|[^\s\"'\\]", lambda m: m[1] or MASK, text[s:e])]
        at = e
    return "".join([*out, text[at:]])


def scan_text(text: str, words: Segmenter) -> tuple[list[str], str]:
    """Types in a text, and the masked text."""
    found = scan(text, words)
    return sorted({k for _, _, k in found}), mask(text, found)


def scan_member(name: str, value: str, words: Segmenter) -> list[Found]:
    """As :func:`scan`, for a JSON string whose member name is its context."""
    found = scan(value, words)
    if found or not value or re.search(r"\s", value.strip()) or not _MEMBER.fullmatch(name) or _PUBLIC.search(name):
        return found
    kind = name_type(name)
    bare = re.sub(r"^(?:Bearer|Basic|Token) ", "", value)
    if _SESSION.match(name) and (_GROUPS.fullmatch(bare) or _DIGEST.search(bare)):
        return []
    return [(len(value) - len(bare), len(value), kind)] if _secret(bare, kind, True, words) else []


def _masked(value, name: str, words: Segmenter, kinds: set[str], changed: dict[str, str]):
    """The JSON value with masked strings; collects their types and what changed. No recursion."""
    root = [value]
    stack: list[tuple] = [(root, 0, name)]
    while stack:
        holder, at, context = stack.pop()
        v = holder[at]
        if isinstance(v, str):
            found = scan_member(context, v, words)
            if found:
                kinds |= {k for _, _, k in found}
                holder[at] = changed[v] = mask(v, found)
        elif isinstance(v, list):
            stack += [(v, i, context) for i in range(len(v))]
        elif isinstance(v, dict):
            # {"name": "DB_PASSWORD", "value": ...} names its value like a member does.
            label = next((v[k] for k in ("name", "key") if isinstance(v.get(k), str)), "")
            stack += [(v, k, label if k.lower() == "value" and label else k) for k in v]
    return root[0]


class _Again(str):
    """A member name that its object already has: equal to itself only, so that no member is lost."""

    __slots__ = ()
    __hash__ = object.__hash__

    def __eq__(self, other: object) -> bool:
        return self is other


def _members(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out: dict[str, object] = {}
    for name, value in pairs:
        out[_Again(name) if name in out else name] = value
    return out


def scan_payload(text: str, words: Segmenter) -> tuple[list[str], str]:
    """As :func:`scan_text`, for a JSON payload: its strings are read decoded, each in the context of
    its member's name, and the payload still parses."""
    if text.lstrip()[:1] not in "{[":
        return scan_text(text, words)
    try:
        value = json.loads(text, object_pairs_hook=_members)
    except (ValueError, RecursionError):
        return scan_text(text, words)
    kinds: set[str] = set()
    changed: dict[str, str] = {}
    value = _masked(value, "", words, kinds, changed)
    if not changed:
        return [], text
    out = text
    for old, new in changed.items():
        for ascii_only in (False, True):
            out = out.replace(json.dumps(old, ensure_ascii=ascii_only), json.dumps(new, ensure_ascii=ascii_only))
    # Strings escaped in another way are not found as written: then the payload is written anew.
    same = json.dumps(json.loads(out, object_pairs_hook=_members)) == json.dumps(value)
    return sorted(kinds), out if same else json.dumps(value, ensure_ascii=False)


#: Java's classes for Python's white space, and for its word characters and all else beyond ASCII.
_SPACES = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_S, _W = rf"[{_SPACES}]", r"[\w.\-[^\x00-\x7f]]"
_SHORT_VALUE = r"[^\s\"'`<>,;\\]{4}"
#: What follows a name in ``_NAMED`` and ``_XML``, or in a JSON member.
_ASSIGNED = (
    rf"(?:(?:\\?[\"'\])]{{1,2}})?{_S}?(?:=|:|\\?[\"'] value=|\\?[\"'],)[=>]{{0,2}}{_S}?(?:[brfu]{{0,2}}\\?[\"'`][^\n]{{4}}|{_SHORT_VALUE})"
    rf"|[:\w.\-[^\x00-\x7f]]*\\?[\"'] value=\\?[\"']|\"\s*:\s*[\"\[]|[^\n:=]{{0,50}}[:=]{_S}?{_SHORT_VALUE})"
)
#: Session ids as JSON members, which neither ``scan`` nor ``scan_member`` takes for secrets.
_ID_MEMBER = r"\"\s*:\s*\"(?:[0-9a-f]+(?:-[0-9a-f]+){1,9}|(?:-?[0-9a-z]){0,11})\"\s*[,}]"
#: Test before any Python runs, for Java. It passes whatever one of the patterns above matches, by parts
#: of them: values are cut to their first characters, leading words and ``\\b`` are dropped, and texts with
#: letters that match ASCII ones without regard to case go to Python at once. No group repeats without
#: bound, which would exhaust Java's stack.
PREFILTER = (
    rf"(?i)(?:p(?:ass|w)|keys?(?: id)?|secret|credential|token|bearer|jwt|パスワード|暗証番号){_W}*+{_ASSIGNED}|s(?:ess|id){_W}*+(?!{_ID_MEMBER}){_ASSIGNED}"
    rf"|\"name\"\s*:\s*\"[ \w.\-[^\x00-\x7f]]*?(?:p(?:ass|w)|key|secret|credential|token|bearer|jwt|sess|sid|パスワード|暗証番号)"
    rf"|(?:ENV|ARG|setx?){_S}+{_W}*?(?:{_PASSWORD}|{_API}|{_TOKEN}){_W}*{_S}+[\"']?{_SHORT_VALUE}"
    rf"|(?-i:Bearer|Token|Basic|Digest)[\"'+{_SPACES}]+[\w.~+/=\-]{{8}}|://[^\s/:@\"'`]*:[^\s/\"'`]+@"
    rf"|sshpass{_S}+-p|curl[^\n]*?{_S}-u|-(?:pass(?:word|phrase)?|token|api-key)[= ]|-passin pass:|mysql[^\n]*?{_S}-p|identified by{_S}+[\"']|login{_S}+[^{_SPACES}]+{_S}+password"
    rf"|[\"'][^\n\"']*(?:#|//|/\*){_S}*[^\n]*?(?:api key|access key|token|password|secret)"
    r"|(?:pass(?:word|phrase|code)|(?:api|access) key|token)(?: is| was)?:? [\"'「]?[!-~]*[0-9!#$%^&*?~+=]|(?:パスワード|暗証番号|APIキー|トークン)(?:は|が|[:：])"
    rf"|(?:client|login|connect|auth|authenticate|api)\({_S}*\\?[\"'][a-z0-9_\-+/=.]{{20}}|(?-i:PRIVATE KEY|PuTTY-User-Key-File-|AGE-SECRET-KEY-1|LS0tLS1CRUdJTi)"
    rf"|(?-i:A(?:KIA|SIA|Iza)|SG\.|sk-|[sr]k_(?:live|test)_|g(?:h[pousr]_|ithub_pat_|lpat-)|xox[abeprs]-|npm_|hf_|pypi-|ya29\.|eyJ){_W}{{10}}"
    r"|[\u017f\u212a\u0130\u0131\x1c-\x1f]"
)


def may_hold(column: str, payload: bool = False) -> Column:
    """Whether the prefilter passes a text, or for a payload also what its JSON strings hold when decoded.

    Payloads with codes of characters (``\\u30d1``), escaped backslashes or backspaces go to Python at once;
    the other escapes are undone in any order.
    """
    seen = F.col(column).rlike(PREFILTER)
    if payload:
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(column, r"\\n", "\n"), r"\\[rtf]", " "), r"\\([\"/])", "$1")
        seen = seen | F.col(column).rlike(r"\\[ub\\]") | (F.contains(F.col(column), F.lit("\\")) & plain.rlike(PREFILTER))
    return F.coalesce(seen, F.lit(False))


def dictionary(*columns: DataFrame) -> dict[str, int]:
    """Counts of the words of at least ``WORD_SHARE`` of all words of the corpus, over all rows.

    Each argument has one text column.
    """
    texts = columns[0].toDF("t")
    for more in columns[1:]:
        texts = texts.unionByName(more.toDF("t"))
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(?<![a-z0-9])([a-z]{3,16})(?![a-z0-9])"), F.lit(1))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    kept = counts.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.col("total") * WORD_SHARE)  # one row against all
    return {r.w: r.n for r in kept.select("w", "n").collect()}


def find(rows: DataFrame, keys: list[str], text: str, words: dict[str, int], payload: bool = False) -> DataFrame:
    """keys + (types, masked): credential types in each text, and the text with them masked.

    Texts without any context are recognised by the JVM and come back unchanged. No shuffle.
    """
    picked = spread(rows.select(*keys, F.col(text).alias("__text")))
    maybe = may_hold("__text", payload)
    fields = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    n, segmenter = len(keys), Segmenter(words)
    one = scan_payload if payload else scan_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [one(t, segmenter) for t in batch.column(n).to_pylist()]
            kinds, masked = [r[0] for r in results], [r[1] for r in results]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(kinds, pa.list_(pa.string())), pa.array(masked, pa.string())], names=[*keys, "types", "masked"]
            )

    plain = picked.filter(~maybe).select(*keys, F.array().cast("array<string>").alias("types"), F.col("__text").alias("masked"))
    return picked.filter(maybe).mapInArrow(run, f"{fields}, types array<string>, masked string").unionByName(plain)
