"""Secrets in texts: fixed patterns, and literals that reach a sensitive name by assignment.

*Base.* Three patterns (`BASE`), each by itself, leftmost and without overlap; a match that its check
fails is dropped, but what it covers is not looked at again.

*Assignments.* The text is read as source code or configuration. Every operator `=`, `:`, `:=` or `=>`
with a name on its left and a value on its right is a pair. A value is a chain of quoted literals, bare
words and names, joined by `+`, `.`, `||`, `or`, `??`, a call or by standing side by side. Constants are
propagated: a name in a value stands for the literals of its last assignment before (or, if there is
none, of its first one after). So a literal has a set of names that it reaches, and scores

    sensitivity of the most sensitive of these names + evidence in the literal itself

(`sensitivity`, `evidence`). From `THRESHOLD` on it is reported as kind `literal`, without its quotes,
unless it lies inside a base span or a base span lies inside it. Base spans always stay.

Work is linear in the text: an operator is looked at with at most `REACH` bytes on its left and `VALUE`
on its right, each name's literals are found once. Rows never leave their task.

Defined cases: null and empty texts have no spans and the hash of the empty string; rows are
independent, so ties and repeated rows get equal results; names that assign each other in a circle
have the literals met on the way round; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds, patterns and least lengths of the base spans. A-Z are lower-cased for `assign` alone.
BASE = {
    "assign": (rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)", 2, 6),
    "access": (rb"AKIA[A-Z0-9]+", 0, 20),
    "hex": (rb"[0-9a-f]+", 0, 24),
}
KINDS = [*BASE, "literal"]

#: Parts of names that call for a secret, and parts that speak against one.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "passcode": 3, "pwd": 3, "secret": 3, "credential": 3, "credentials": 3,
    "apikey": 3, "token": 2, "auth": 2, "bearer": 2, "private": 2, "signing": 2, "encryption": 2, "access": 1, "key": 1,
    "pass": 2, "api": 1, "client": 1, "session": 1, "salt": 1,
}
HARMLESS = {"length", "len", "count", "size", "public", "name", "file", "path", "url", "uri", "type", "hint", "policy", "field", "label", "expiry", "expires", "ttl", "format", "pattern", "regex", "id"}
PLACEHOLDER = re.compile(rb"(?i)^(?:x{3,}|\*+|<.*>|\$\{?.*\}?|%.*%|\{\{.*\}\}|true|false|none|null|nil|undefined|todo.*|.*(?:example|changeme|change_me|placeholder|your[_-]|dummy|redacted|sample).*)$")
THRESHOLD = 6

REACH, VALUE = 160, 4096

_OPERATOR = re.compile(rb"(?<![=!<>:+*/%&|^~-])(?::=|=>|=|:)(?![=:/~])")
_NAME = rb"[A-Za-z_$][\w$-]*(?:\.[A-Za-z_$][\w$-]*|\[[\"'][^\"'\]\n]{1,64}[\"']\])*+"
_TARGET = re.compile(rb"(?<![\w$.-])(" + _NAME + rb")[\"']?(?:\x20*:\x20*[A-Za-z_][\w.\[\]]*)?\x20*\Z")
_STRING = re.compile(rb"[rbfuRBFU]{0,2}(?:\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)")
_WORD = re.compile(_NAME)
_BARE = re.compile(rb"[^\s,;\"'`(){}\[\]<>#]+")
_JOIN = re.compile(rb"\x20*(?:\+|\|\||\?\?|\.\.?|\bor\b)?\x20*")
_LOOKUP = re.compile(rb"(?i)(?:getenv|environ|env|get|getproperty|config)\Z")
_PARTS = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_base = {kind: (re.compile(pattern), group, least) for kind, (pattern, group, least) in BASE.items()}


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Start, end and kind of the base spans, in bytes; every class is ASCII, so bytes match as characters do."""
    found = []
    for kind, (pattern, group, least) in _base.items():
        for match in pattern.finditer(text.lower() if kind == "assign" else text):
            if match.end(group) - match.start(group) >= least:
                found.append((match.start(), match.end(), kind))
    return found


@dataclass
class Assignment:
    """A name and what it is given: spans of literals, and names with the place they stand at."""

    at: int
    name: bytes
    literals: list[tuple[int, int, bool]] = field(default_factory=list)  # start, end, whether quoted
    names: list[bytes] = field(default_factory=list)


def assignments(text: bytes) -> list[Assignment]:
    """The name-literal pairs of a text, in its order."""
    found = []
    taken = 0  # operators inside a literal that was read are no assignments
    for operator in _OPERATOR.finditer(text):
        if operator.start() < taken:
            continue
        target = _TARGET.search(text, max(0, operator.start() - REACH, text.rfind(b"\n", 0, operator.start()) + 1), operator.start())
        if not target:
            continue
        one = Assignment(operator.start(), target.group(1))
        taken = _value(text, operator.end(), min(len(text), operator.end() + VALUE), one)
        if one.literals or one.names:
            found.append(one)
    return found


def _value(text: bytes, at: int, end: int, into: Assignment) -> int:
    """Read the value that starts at `at`; the end of its last literal is returned."""
    read, depth, lookup = at, 0, False
    joined = _JOIN.match(text, at, end)
    at = joined.end()
    while at < end:
        string = _STRING.match(text, at, end)
        if string:
            if not lookup:
                into.literals.append((*string.span(string.lastindex), True))
            read = at = string.end()
            lookup = False
        else:
            bare = _BARE.match(text, at, end)
            if not bare:
                break
            word = _WORD.match(text, at, end)
            if word and text[word.end() : word.end() + 1] == b"(":
                lookup = bool(_LOOKUP.search(word.group()))
                at, depth = word.end() + 1, depth + 1
                continue
            if word and word.end() == bare.end():
                into.names.append(word.group())
            if not into.literals:
                into.literals.append((*bare.span(), False))
            at = bare.end()
        while depth and text[at : at + 1] == b")":
            at, depth = at + 1, depth - 1
        joined = _JOIN.match(text, at, end)
        # side by side only quoted literals are one value; a bare word goes on behind an operator alone
        if not joined.group().strip() and not (string and _STRING.match(text, joined.end(), end)):
            break
        at = joined.end()
    return read


def sensitivity(name: bytes) -> int:
    """How much a name calls for a secret: the sum of its parts' weights, less those that speak against."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    words = {x.decode() for x in parts} | {(a + b).decode() for a, b in zip(parts, parts[1:], strict=False)}
    score = min(sum(SENSITIVE.get(x, 0) for x in words), 4)
    return score - 3 if parts and parts[-1].decode() in HARMLESS else score


def evidence(literal: bytes, quoted: bool) -> int:
    """What speaks for a secret in the literal: length, spread of its characters, mixed classes."""
    if len(literal) < 6 or PLACEHOLDER.match(literal) or b" " in literal.strip() and len(literal.split()) > 3:
        return -9
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    classes = [any(a <= c <= b for c in counts) for a, b in ((48, 57), (65, 90), (97, 122))]
    classes.append(any(c < 128 and not chr(c).isalnum() for c in counts))
    score = (len(literal) >= 8) + (len(literal) >= 16) + (entropy >= 2.5) + (entropy >= 3.5) + (sum(classes) >= 2) + (sum(classes) >= 3)
    return score - (0 if quoted else 1) - (3 if not classes[0] and not classes[3] else 0)


def reached(found: list[Assignment]) -> dict[tuple[int, int, bool], int]:
    """Of every literal, the sensitivity of the most sensitive name it reaches."""
    by_name: dict[bytes, list[int]] = {}
    for i, one in enumerate(found):
        by_name.setdefault(one.name, []).append(i)
    best: dict[tuple[int, int, bool], int] = {}
    # the most sensitive names first: an assignment is then entered once, with the best score it can get
    order = sorted(range(len(found)), key=lambda i: -sensitivity(found[i].name))
    entered: set[int] = set()
    for start in order:
        score = sensitivity(found[start].name)
        if score <= 0:
            break
        stack = [start]
        while stack:
            i = stack.pop()
            if i in entered:
                continue
            entered.add(i)
            for literal in found[i].literals:
                best.setdefault(literal, score)
            for name in found[i].names:
                places = by_name.get(name)
                if places:
                    before = bisect_left(places, i)
                    stack.append(places[max(before - 1, 0)])
    return best


def literal_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Literals that score as secrets."""
    if b"=" not in text and b":" not in text:
        return []
    names = reached(assignments(text))
    return sorted((s, e, "literal") for (s, e, quoted), score in names.items() if score + evidence(text[s:e], quoted) >= THRESHOLD)


def characters(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte spans as spans of code points."""
    if text.isascii():
        return spans
    place, at, n = {}, 0, 0
    for x in sorted({x for span in spans for x in span[:2]}):
        n += len(text[at:x].decode("utf-8", "replace"))
        at = x
        place[x] = n
    return [(place[s], place[e], kind) for s, e, kind in spans]


def written(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def scan(text: bytes) -> tuple[int, int, int, str, str]:
    """Counts of the three base kinds, the base spans and all spans as text."""
    base = base_spans(text)
    by_kind = [[(b, c) for b, c, kind in base if kind == k] for k in BASE]

    def meets(start: int, end: int) -> bool:
        """Whether a base span overlaps; those of one kind lie in order and apart."""
        return any(b < end and start < c for x in by_kind for b, c in x[max(bisect_left(x, (start,)) - 1, 0) : bisect_left(x, (end,))])

    more = [x for x in literal_spans(text) if not meets(*x[:2])]
    counts = Counter(kind for *_, kind in base)
    placed = characters(text, base + more)
    return *(counts[kind] for kind in BASE), written(placed[: len(base)]), written(placed)


def scanned(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_spans and spans (`kind:start:end`, comma-joined)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text at a time as bytes: memory follows the longest text, not the batch
            rows = [scan(text.as_buffer().to_pybytes() if text.is_valid else b"") for text in batch.column(1).cast(pa.large_binary())]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    schema = docs.select("doc_id").schema
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, "long")
    schema = schema.add("base_spans", "string").add("spans", "string")
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(find, schema)
