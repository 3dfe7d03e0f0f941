"""Secrets in texts: assignments are lexed into names and literals, constants followed, literals scored by names.

Source and configuration syntax is read wherever it stands, in prose, comments or code: ``name = "x"``,
``name: x``, ``"name": "x"``, ``name => 'x'``, ``map["name"] = "x"``, ``name: type = "x"``, ``export NAME=x``,
``#define NAME "x"``, ``<name>x</name>`` and ``--name x``. The right side may join literals, call functions
and name other constants; a constant's literals count for every name they flow into. A literal is a secret
where the product of its name's and its own score reaches a threshold.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns every scan reports, with the group measured and the code points it needs.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (
    ("assign", re.compile(ASSIGN, re.ASCII | re.IGNORECASE), 2, 8),
    ("access", re.compile(ACCESS), 0, 16),
    ("hex", re.compile(HEX), 0, 32),
)
LITERAL = "literal"
KINDS = (*(kind for kind, *_ in BASE), LITERAL)

# A literal of fewer code points is no secret; its shape is judged by at most so many.
LEAST_CHARS = 8
JUDGED_CHARS = 256
# Bits of a literal from which it scores 1, and the product of both scores from which it is a secret.
FULL_BITS = 40.0
THRESHOLD = 0.5
# Nested calls on a right side that are looked into.
CALL_DEPTH = 3

# Words of names, alone or as the end of a word written together, and pairs of words.
STRONG = ("password", "passwd", "passphrase", "passwort", "contraseña", "pwd", "secret", "token", "apikey", "credential", "credentials")
STRONG_ALONE = {"pass", "bearer", "jwt", "creds", "pw"}
STRONG_KEYS = {"access", "api", "account", "auth", "client", "encryption", "master", "private", "secret", "service", "shared", "signing", "storage"}
WEAK = {"auth", "authorization", "cookie", "hash", "key", "license", "pin", "salt", "seed", "session", "signature", "webhook"}
# Last words of names that hold something about a secret, not the secret.
BENIGN = {
    "age", "class", "count", "column", "enabled", "endpoint", "expires", "expiry", "field", "file", "format", "header", "hint",
    "id", "label", "length", "limit", "max", "min", "name", "path", "policy", "prefix", "prompt", "size", "suffix", "ttl", "type",
    "uri", "url", "version",
}
PLACEHOLDER = re.compile(
    r"(?i)change.?me|your[-_. ]?|example|placeholder|dummy|redacted|insert|replace|xxxx|\*\*\*\*|\.\.\.\.|none|null|undefined|<.*>|todo"
)
URL = re.compile(r"(?i)[a-z][a-z0-9+.-]*://[^\s/@]*(?:/|$)|(?:\.{0,2}/)?(?:[\w.-]+/)+[\w.-]*\.[a-z]{1,5}$")

NAME = r"[A-Za-z_$][\w$]*+(?:[.\-][\w$]++)*+"
STATEMENT = re.compile(
    rf"""
    (?<![\w$.\-])(?P<name>{NAME})
    (?:["'`]\]?|\[\d*\]|[ \t]++string(?=[ \t]*+=))?
    (?: [ \t]*+:[ \t]*+[A-Za-z_][\w.]*+(?:\[[^\]\n]{{0,80}}\])?[ \t]*+=(?![=~>])
      | [ \t]*+(?P<op>:=|=>|=(?![=~>])|:(?![:=/\\])) )
  | (?:\#[ \t]*+define|\bsetenv)[ \t]++(?P<defined>{NAME})(?=[ \t])
  | <(?P<tag>[A-Za-z_][\w:.\-]*+)>(?P<content>[^<>\n]++)</
  | (?<!\S)--(?P<flag>[A-Za-z][\w\-]*+)(?=[ \t]++[^\s\-])
    """,
    re.VERBOSE,
)
STRING = re.compile(
    r'''(?:[rRbBuUfFL@$]{0,2})(?P<s>"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)''', re.DOTALL
)
REFERENCE = re.compile(rf"\$\{{(?P<braced>{NAME})\}}|(?P<plain>{NAME})(?![\w+/=@%!-])")
BARE = re.compile(r"""[^\s"'`,;#<>(){}\[\]|&\\]++""")
SPACE = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)*+")
WIDE_SPACE = re.compile(r"\s*+")
JOIN = re.compile(r"[ \t]*+(?:\\?\r?\n[ \t]*+)?(?:\+|\.\.?(?!\w)|\|\||&(?!&))[ \t]*+(?:\\?\r?\n[ \t]*+)?")
INSIDE = re.compile(r"\$\{(\w+)\}|\{\{?[ ]*(\w+)[ ]*\}?\}|%\((\w+)\)s|\$(\w+)")
WORDS = re.compile(r"[^\W\d_]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def name_words(name: str) -> list[str]:
    """Lower-cased words of a name in snake, kebab, dotted or camel case."""
    return [w.lower() for part in WORDS.findall(name) for w in HUMP.split(part)]


def name_score(name: str) -> float:
    """How surely a name stands for a secret: 1, 0.6 or 0."""
    words = name_words(name)
    if not words or words[-1] in BENIGN:
        return 0.0
    pairs = set(zip(words, words[1:]))
    if any(w.endswith(STRONG) or w in STRONG_ALONE for w in words) or any(b in ("key", "keys") and a in STRONG_KEYS for a, b in pairs):
        return 1.0
    return 0.6 if WEAK.intersection(words) else 0.0


def literal_score(value: str, quoted: bool) -> float:
    """How much a value looks like a secret: its bits by letter frequencies as a share of ``FULL_BITS``, 0 for
    short values, several words, placeholders, addresses and, without quotes, values without a digit."""
    value = value[:JUDGED_CHARS]
    if len(value) < LEAST_CHARS or any(c.isspace() for c in value) or PLACEHOLDER.search(value) or URL.match(value):
        return 0.0
    if not quoted and not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return 0.0
    bits = -sum(n * math.log2(n / len(value)) for n in Counter(value).values())
    return min(bits / FULL_BITS, 1.0)


def plain(name: str) -> str:
    """The name by which a constant is found again."""
    name = name.lstrip("$")
    for own in ("self.", "this."):
        name = name.removeprefix(own)
    return name


class Assignment:
    """One name with the terms of its right side: literals ``(start, end, quoted)`` and references ``(name, at)``.

    A literal that is an argument of a call is judged by itself and left out of ``terms`` if it scores nothing.
    """

    __slots__ = ("name", "at", "terms", "value", "quoted")

    def __init__(self, name: str, at: int) -> None:
        self.name, self.at, self.terms, self.value, self.quoted = name, at, [], None, False


class Reader:
    """Assignments of one text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: list[Assignment] = []
        self.bare = (0, 0)
        at = 0
        while m := STATEMENT.search(text, at):
            at = m.end()
            if m["tag"]:
                own = Assignment(m["tag"].rsplit(":", 1)[-1], m.start())
                own.terms = [self._trimmed(m.start("content"), m.end("content"), False)]
            else:
                own = Assignment(m["name"] or m["defined"] or m["flag"], m.start())
                self._side(own, m.end(), CALL_DEPTH, m["op"] != "=>" and m["defined"] is None)
            if own.terms:
                self.found.append(own)
        self.by_name: dict[str, list[Assignment]] = {}
        for own in self.found:
            self.by_name.setdefault(plain(own.name), []).append(own)

    def _trimmed(self, start: int, end: int, quoted: bool):
        while start < end and self.text[start].isspace():
            start += 1
        while end > start and self.text[end - 1].isspace():
            end -= 1
        return start, end, quoted

    def _side(self, own: Assignment, at: int, depth: int, bare: bool, alone: bool = False) -> int:
        """Read joined terms from ``at``; returns where they end. ``alone``: each literal stands for itself."""
        text = self.text
        while True:
            at = SPACE.match(text, at).end()
            while depth and at < len(text) and text[at] == "(":
                at, depth = WIDE_SPACE.match(text, at + 1).end(), depth - 1
            if m := STRING.match(text, at):
                width = 3 if m["s"].startswith('"""') else 1
                start, end = m.start("s") + width, m.end("s") - width
                if not alone or literal_score(text[start : min(end, start + JUDGED_CHARS)], True):
                    own.terms.append((start, end, True))
                for name in INSIDE.finditer(text, start, end):
                    own.terms.append((next(filter(None, name.groups())), start))
                at = m.end()
                beside = WIDE_SPACE.match(text, at).end() if depth < CALL_DEPTH else SPACE.match(text, at).end()
                if STRING.match(text, beside):  # adjacent literals are joined
                    at = beside
                    continue
            elif m := REFERENCE.match(text, at):
                after = m.end()
                if m["plain"] and text[after : after + 1] == "(":
                    if not depth:
                        return after
                    at = self._arguments(own, after + 1, depth - 1)
                else:
                    own.terms.append((plain(m["braced"] or m["plain"]), m.start()))
                    if bare and m["plain"] and self._line_value(after):
                        own.terms.append((m.start(), after, False))
                    at = after
            elif bare and (end := self._bare_end(at)) > at:
                own.terms.append((at, end, False))
                return end
            else:
                return at
            joined = JOIN.match(text, at)
            if not joined:
                return at
            at = joined.end()

    def _bare_end(self, at: int) -> int:
        """End of a value without quotes; one that holds further assignments is measured once."""
        if not self.bare[0] <= at < self.bare[1]:
            m = BARE.match(self.text, at)
            end = m.end() if m else at
            while end > at and self.text[end - 1] in ".:":
                end -= 1
            self.bare = (at, end)
        return self.bare[1]

    def _line_value(self, at: int) -> bool:
        """Whether a word that ends at ``at`` is all of a value: then it may be a literal without quotes."""
        return at >= len(self.text) or self.text[at] in " \t\r\n,;}]"

    def _arguments(self, own: Assignment, at: int, depth: int) -> int:
        while True:
            at = self._side(own, WIDE_SPACE.match(self.text, at).end(), depth, False, True)
            at = WIDE_SPACE.match(self.text, at).end()
            if self.text[at : at + 1] != ",":
                return at + (self.text[at : at + 1] == ")")
            at += 1

    def source(self, name: str, at: int) -> Assignment | None:
        """The last assignment of a name before ``at``, else the first after it."""
        held = self.by_name.get(name)
        if not held:
            return None
        place = bisect_left(held, at, key=lambda a: a.at)
        return held[place - 1] if place else held[0]

    def _sources(self, own: Assignment) -> list[Assignment]:
        found = (self.source(*term) for term in own.terms if len(term) == 2)
        return [s for s in found if s is not None and s is not own]

    def resolve(self, own: Assignment) -> None:
        """Fill ``value``, the text of all terms with constants put in, and ``quoted``. Names in a cycle add nothing."""
        stack = [(own, False)]
        while stack:
            node, ready = stack.pop()
            if ready:
                parts = []
                for term in node.terms:
                    if len(term) == 3:
                        raw = self.text[term[0] : min(term[1], term[0] + JUDGED_CHARS)]
                        node.quoted |= term[2]
                        parts.append(INSIDE.sub("", raw) if term[2] else raw)
                    else:
                        origin = self.source(*term)
                        if origin is not None and origin is not node and origin.value:
                            node.quoted |= origin.quoted
                            # A constant in place of a word that could be a literal itself.
                            parts.append(origin.value)
                    if sum(map(len, parts)) >= JUDGED_CHARS:
                        break
                node.value = "".join(parts)[:JUDGED_CHARS]
            elif node.value is None:
                node.value = ""
                stack.append((node, True))
                stack += [(s, False) for s in self._sources(node) if s.value is None]

    def secrets(self):
        """``(start, end, name, score)`` of the literals that reach the threshold, each once under its surest name."""
        named = sorted(((name_score(a.name), a) for a in self.found), key=lambda x: (-x[0], x[1].at))
        done, out = set(), {}
        for certainty, own in named:
            if not certainty:
                break
            self.resolve(own)
            score = certainty * literal_score(own.value, own.quoted)
            if score < THRESHOLD:
                continue
            todo = [own]
            while todo:
                node = todo.pop()
                if id(node) in done:
                    continue
                done.add(id(node))
                sources = self._sources(node)
                for term in node.terms:
                    if len(term) == 3 and (INSIDE.sub("", self.text[term[0] : term[1]]) if term[2] else not sources):
                        out.setdefault(term[:2], (own.name, score))
                todo += sources
        return [(s, e, name, score) for (s, e), (name, score) in out.items()]


def base_spans(text: str):
    """``(start, end, kind number)`` of the fixed patterns, leftmost and non-overlapping for each kind."""
    for number, (_, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield m.start(), m.end(), number


def scan(text: str) -> list[dict]:
    """All spans of a text by start, then kind."""
    spans = [(start, number, end, None, None) for start, end, number in base_spans(text)]
    spans += [(start, len(BASE), end, name, score) for start, end, name, score in Reader(text).secrets()]
    spans.sort(key=lambda s: s[:3])
    return [
        {"kind": KINDS[number], "start": start, "end": end, "name": name, "score": score}
        for start, number, end, name, score in spans
    ]


SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
)


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans)`` per row: ``array<struct<kind, start, end, name, score>>`` by start, then kind.

    Places are code points, ends exclusive. ``name`` and ``score`` belong to spans of kind ``literal``.
    Null and empty texts have no spans; null and repeated keys stay rows of their own; an empty table gives
    no rows. Other columns are ignored, whatever their names.
    """

    def run(batches):
        for batch in batches:
            found = pa.array([scan(t.as_py() or "") for t in batch.column(1)], SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spans = "array<struct<kind: string, start: long, end: long, name: string, score: double>>"
    return rows.mapInArrow(run, f"key {kind}, spans {spans}").withColumnRenamed("key", key)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_assign, n_access, n_hex, base_sha256, spans)`` per row; odd rows as in :func:`secret_spans`."""
    own = F.col("spans")

    def counted(kind):
        return F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secret_spans(docs, key, text).select(
        key,
        *(counted(kind) for kind, *_ in BASE),
        F.sha2(listed(F.filter(own, lambda s: s["kind"] != LITERAL)), 256).alias("base_sha256"),
        listed(own).alias("spans"),
    )
