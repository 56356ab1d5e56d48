"""Secret scan: fixed patterns, and assignment-aware lexing of source and configuration.

The patterns (assign, access, hex) are found over the whole text. Beside them a lexer reads the text as
names, literals and signs; a parser over these tokens makes name-literal pairs of assignments
(``a = "x"``, ``a: str = "x"``, ``d["a"] = "x"``, ``"a": "x"``, ``a => 'x'``, ``a ?= x``, ``A=x`` and
``a: x`` to the end of a line, ``#define A "x"``, ``--a=x``, ``set("a", "x")``, ``<a>x</a>``). A right side may be a
sum of literals and names, and a name stands for what was last assigned to it (for what is assigned to it
first, if only later). A target's sensitivity runs backwards through such names to the literals behind
it; a literal's score is the highest sensitivity that reaches it times how much the value looks like a
secret. Literals of score LEAST and more that no pattern covers are spans of kind ``literal``.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; spans come
by start, then kind as listed in KINDS; repeated rows give repeated results; very long texts are read
whole; an unclosed quote is a sign of its own; names assigned in a circle have no value; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, pieces, table

KINDS = ("assign", "access", "hex", "literal")
#: Score from which a literal is a span.
LEAST = 0.5

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What a text must hold, in lower case, for _ASSIGN to match.
_ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Sensitivity of the words of a name, and of two words that follow each other.
WORDS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passwort": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.6, "authorization": 0.7, "salt": 0.5, "pin": 0.5, "key": 0.4}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("auth", "key"): 0.9, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("master", "key"): 0.9, ("account", "key"): 0.8, ("connection", "string"): 0.7}
#: Words of a name that say that its value describes a secret and is none.
HARMLESS = frozenset("count counts length len size max min limit type types kind name names field fields file path dir url uri label labels title text message hint policy prompt placeholder expires expiry ttl timeout format regex pattern header id index column enabled required valid".split())
#: Values that stand for a secret that is not there.
DUMMIES = re.compile(r"(?i)(?:x+|\*+|\.+|-+|_+|0+|1234567?8?9?0?|change_?me|example.*|placeholder.*|dummy.*|test(?:ing)?|sample|none|null|true|false|undefined|password|passwd|secret|token|todo|tbd|required|optional|default|redacted|your.*|my.*|insert.*|enter.*|string|required|<.*>|\[.*\]|\{.*\}|%.*%|\$.*)")

_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "salt", "pin", "connection")
_TOKEN = re.compile(
    r"""(?P<string>(?<!\w)[rbfuRBFU]{0,2}(?:\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`))
    |(?P<tag><[A-Za-z_][\w.:-]*>[^<>\n]*</)
    |(?P<name>--[A-Za-z][\w-]*|[$@%]?\{?[A-Za-z_][\w$]*(?:(?:\.|->|::|-)[A-Za-z_][\w$]*)*\}?)
    |(?P<line>\n)
    |(?P<sign>:=|\?=|\+=|=>|[=!<>]=|[=:+(),;\[\]{}\#])
    |(?P<other>[^\s"'`=:+(),;\[\]{}\#<]+|["'`<])""",
    re.VERBOSE | re.DOTALL,
)
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_BARE = re.compile(r"[^\s\"'`,;()\[\]{}<>]+(?=[ \t]*(?:[#;][^\n]*|//[^\n]*|,)?[ \t]*(?:\n|\r|\Z))")
_LEADS = re.compile(r"[-*>#/]{1,3}|export|set|env|ENV|ARG|const|let|var")
_ASSIGNERS = frozenset((":=", "?=", "+=", "=", "=>", ":"))
_SETTERS = re.compile(r"(?i)(?:set|put|add|define|with|header|append|insert|store|export|property)")
_RECEIVERS = ("self.", "this.", "os.environ.", "process.env.", "env.", "ENV.")


def sensitivity(name: str) -> float:
    """0 to 1: how likely a value of this name is a secret."""
    words = [w.lower() for w in _CAMEL.findall(name)]
    found = max((WORDS.get(w, 0.0) for w in words), default=0.0)
    found = max([found, *(PAIRS.get(p, 0.0) for p in zip(words, words[1:]))])
    return found * (0.3 if words and not HARMLESS.isdisjoint(words) else 1.0)


def plausibility(value: str, bare: bool = False) -> float:
    """0 to 1: how much a value looks like a secret and not like a word, a place or a blank; ``bare`` for one without quotes."""
    if len(value) < 6 or any(c.isspace() for c in value) or DUMMIES.fullmatch(value):
        return 0.0
    kinds = any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value)
    varied = len(set(value)) / min(len(value), 16)
    prose = 0.5 if bare and not any(c.isdigit() for c in value) else 1.0
    return min(1.0, 0.4 + 0.2 * kinds) * min(1.0, 0.35 + varied) * prose


def _plain(name: str) -> str:
    """A name without what says only where it is looked up."""
    name = name.lstrip("$@%-").strip("{}")
    for r in _RECEIVERS:
        name = name.removeprefix(r)
    return name


class Pairs:
    """The assignments of one text: targets, and the literals and names on their right sides."""

    def __init__(self, text: str):
        self.text = text
        self.kinds, self.spans = [], []
        for m in _TOKEN.finditer(text):
            self.kinds.append(m.lastgroup)
            self.spans.append(m.span())
        #: (target, [(start, end) of literals], [names], how much the value looks like a secret)
        self.made: list[tuple[str, list[tuple[int, int]], list[str], float]] = []
        self._read()

    def _word(self, i: int) -> str:
        return self.text[slice(*self.spans[i])] if i < len(self.spans) else ""

    def _kind(self, i: int) -> str:
        return self.kinds[i] if i < len(self.kinds) else "line"

    def _inside(self, i: int) -> tuple[int, int]:
        """Span of a string between its quotes."""
        start, end = self.spans[i]
        word = self.text[start:end]
        prefix = len(word) - len(word.lstrip("rbfuRBFU"))
        quotes = 3 if word[prefix : prefix + 3] == '"""' else 1
        return start + prefix + quotes, end - quotes

    def _target(self, i: int) -> tuple[str, int]:
        """(name, place after it) if a target begins at i, else ("", i)."""
        if self._kind(i) == "string":
            return self.text[slice(*self._inside(i))], i + 1
        if self._kind(i) != "name":
            return "", i
        name, i = self._word(i), i + 1
        if self._word(i) == "[" and self._kind(i + 1) == "string" and self._word(i + 2) == "]":
            return self.text[slice(*self._inside(i + 1))], i + 3
        if self._word(i) == ":" and self._kind(i + 1) == "name" and self._word(i + 2) == "=":
            return name, i + 2  # a type between
        return name, i

    def _value(self, i: int) -> tuple[list[tuple[int, int]], list[str], str, int]:
        """Literals, names, the literals' text and the place behind a right side that begins at i."""
        literals, names, at = [], [], i
        while True:
            if self._kind(at) == "string":
                literals.append(self._inside(at))
                inner = self.text[slice(*literals[-1])]
                if "${" in inner:
                    names += re.findall(r"\$\{([\w.]+)\}", inner)
                at += 1
            elif self._kind(at) == "name" and self._word(at + 1) not in ("(", ":", "=", ":="):
                if self._word(at + 1) == "[" and self._kind(at + 2) == "string" and self._word(at + 3) == "]":
                    names.append(self.text[slice(*self._inside(at + 2))])
                    at += 4
                else:
                    names.append(self._word(at))
                    at += 1
            else:
                break
            if self._word(at) == "+":
                at += 1
            elif self._kind(at) != "string":
                break
        return literals, names, "".join(self.text[a:b] for a, b in literals), at

    def _add(self, target: str, literals: list, names: list, value: str, bare: bool = False) -> None:
        self.made.append((_plain(target), literals, [_plain(n) for n in names], plausibility(value, bare)))

    def _read(self) -> None:
        i, n = 0, len(self.kinds)
        while i < n:
            if self.kinds[i] == "tag":
                start, end = self.spans[i]
                close = self.text.index(">", start)
                name = self.text[start + 1 : close]
                if self.text.startswith(name + ">", end):
                    self._add(name, [(close + 1, end - 2)], [], self.text[close + 1 : end - 2])
                i += 1
                continue
            target, after = self._target(i)
            if not target:
                i += 1
                continue
            sign = self._word(after)
            if sign in _ASSIGNERS and self._kind(after) == "sign":
                begin = after + 1
                literals, names, value, end = self._value(begin)
                # A value without quotes is a literal only if it ends its line; one word may also be a name.
                open_end = not literals and begin < n and self.kinds[begin] != "line" and self._opens(i)
                bare = _BARE.match(self.text, self.spans[begin][0]) if open_end else None
                if bare:
                    names = [bare.group()] if re.fullmatch(r"\$?\{?[A-Za-z_][\w.]*\}?", bare.group()) else []
                    self._add(target, [bare.span()], names, bare.group(), True)
                elif literals or names:
                    self._add(target, literals, names, value)
                i = begin
            elif sign == "(" and _SETTERS.search(target) and self._kind(after + 1) == "string" and self._word(after + 2) == "," and self._kind(after + 3) in ("string", "name"):
                self._add(self.text[slice(*self._inside(after + 1))], *self._value(after + 3)[:3])
                i = after + 3
            elif target == "define" and self._word(i - 1) == "#" and self._kind(i + 1) == "name" and self._kind(i + 2) == "string":
                self._add(self._word(i + 1), *self._value(i + 2)[:3])
                i += 2
            else:
                i = max(i + 1, after)

    def _opens(self, i: int) -> bool:
        """Whether the target at i is the first of its line, behind at most three marks and words such as "export"."""
        for k in range(i - 1, max(-1, i - 5), -1):
            if self.kinds[k] == "line":
                return True
            if k == i - 4 or not _LEADS.fullmatch(self._word(k)):
                return False
        return i < 4

    def literals(self) -> dict[tuple[int, int], float]:
        """Score of every literal that a sensitive target reaches."""
        by_name: dict[str, list[int]] = {}
        for k, (target, *_) in enumerate(self.made):
            by_name.setdefault(target, []).append(k)
        weights = sorted(((sensitivity(t), k) for k, (t, *_) in enumerate(self.made)), reverse=True)
        seen, scored = set(), {}
        for weight, start in weights:
            if weight < LEAST:
                break
            left = [start]
            while left:
                k = left.pop()
                if k in seen:
                    continue
                seen.add(k)  # weights fall, so the first visit has the highest
                _, spans, names, looks = self.made[k]
                left += (self._before(by_name[name], k) for name in names if name in by_name)
                for s in spans:
                    if self.text[slice(*s)] not in by_name:  # a bare word may be a name
                        scored[s] = max(scored.get(s, 0.0), weight * looks)
        return scored

    @staticmethod
    def _before(places: list[int], k: int) -> int:
        """The last assignment before k, or else the first."""
        at = bisect_left(places, k)
        return places[at - 1] if at else places[0]


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans of a text."""
    low, found = text.lower(), []
    if any(s in low for s in _ASSIGN_STEMS):
        found += [("assign", *m.span(), 1.0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), 1.0) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), 1.0) for m in _HEX.finditer(text)]
    if any(s in low for s in _STEMS) and ("=" in text or ":" in text or "</" in text or "(" in text or "define" in text):
        covered = sorted((a, b) for _, a, b, _ in found)
        at = reach = 0
        for (a, b), score in sorted(Pairs(text).literals().items()):
            while at < len(covered) and covered[at][0] <= a:
                reach, at = max(reach, covered[at][1]), at + 1
            if score >= LEAST and b > reach:
                found.append(("literal", a, b, score))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, array of (kind, start, end, score)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t)] if t else [] for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, shape)], ["doc_id", "spans"])

    return rows.mapInArrow(frugal(run), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
