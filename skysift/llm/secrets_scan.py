"""Secret scans: base patterns, and assignment-aware lexing with constant propagation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Base patterns, in the order in which kinds are listed. Letter case is ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "named"]

#: name = value in source and configuration syntax: `a = "x"`, `a: x`, `"a": "x"`, `a := x`, `a => x`, `a += x`, `export A=x`; strings in any quotes, also
#: tripled, with a prefix, side by side in brackets, or added up over lines; beside these `<a>x</a>` and `f("a", "x")`.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_BARE = r'''"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'\'\'(?:[^'\\]|\\[\s\S]|'(?!''))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`'''
_STRING = rf"""(?:[rRbBuUfF]{{1,2}}(?=["']))?(?:{_BARE})"""
_ITEM = rf"(?:{_STRING}|{_NAME})"
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])(?P<q>["']?)(?P<name>{_NAME})(?P=q)[ \t]*(?P<how>:=|=>|\+=|=(?![=~>])|:(?![/:]))[ \t]*(?P<value>(?P<sum>\(\s*{_STRING}(?:\s*{_STRING})*\s*\)|\(\s*{_ITEM}(?:\s*\+\s*{_ITEM})*\s*\)|{_ITEM}(?:[ \t]*\+\s*{_ITEM})+)|{_STRING}|[A-Za-z0-9+/_.$={{}}()\-]+)""",
    re.ASCII,
)
ELEMENT = re.compile(rf"<(?P<name>{_NAME})(?:\s[^<>]*)?>\s*(?P<value>[^<>\s](?:[^<>\n]*[^<>\s])?)\s*</(?P=name)>", re.ASCII)
ARGUMENT = re.compile(rf"""\(\s*(?P<q>["'])(?P<name>{_NAME})(?P=q)\s*,\s*(?P<value>{_STRING})""", re.ASCII)
PART = re.compile(rf"(?P<string>{_STRING})|(?P<name>{_NAME})", re.ASCII)
REFERENCE = re.compile(rf"^\$?\{{?({_NAME})\}}?$", re.ASCII)
#: A name inside a template or a formatted string.
HOLE = re.compile(rf"\$?\{{[ \t]*({_NAME})[ \t]*\}}", re.ASCII)

#: Words of a target's name and what they add to its score.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "private": 1, "api": 1, "access": 1, "auth": 1, "key": 2, "signing": 1, "encryption": 1, "bearer": 2, "session": 1}
#: Values that are never secrets.
PLACEHOLDERS = {"changeme", "password", "secret", "example", "none", "null", "true", "false", "undefined", "placeholder", "xxxxxxxx", "todo", "string", "your_password"}
LEAST_SCORE = 3
LEAST_LENGTH = 8
LEAST_DISTINCT = 4
#: First characters of a value that its test looks at: more than the longest placeholder has, as longer values equal none.
HEAD = max(LEAST_LENGTH, *map(len, PLACEHOLDERS)) + 1
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def name_score(name: str) -> int:
    """How sensitive a target's name is: the sum over its words, split at _ . - and case changes."""
    words = {w.lower() for w in _SPLIT.findall(name)}
    return sum(SENSITIVE.get(w, 0) for w in words)


class _Value:
    """What a name stands for: its own literals and the values that it is put together from, by reference, and what the test of plausibility needs of
    the whole text: its first characters, up to four distinct ones, and three flags. So repeated doubling costs no more than the source text is long."""

    __slots__ = ("spans", "parts", "head", "some", "blank", "digit", "alpha")

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.parts: list[_Value] = []
        self.head, self.some, self.blank, self.digit, self.alpha = "", frozenset(), False, False, True

    def _extend(self, head: str, some: frozenset, blank: bool, digit: bool, alpha: bool) -> None:
        if len(self.head) < HEAD:
            self.head = (self.head + head)[:HEAD]
        if len(self.some) < LEAST_DISTINCT:
            self.some = frozenset([*(self.some | some)][:LEAST_DISTINCT])
        self.blank, self.digit, self.alpha = self.blank or blank, self.digit or digit, self.alpha and alpha

    def literal(self, text: str, a: int, b: int) -> None:
        self.spans.append((a, b))
        chars = frozenset(text[a:b])
        self._extend(text[a : min(b, a + HEAD)], chars, any(c.isspace() for c in chars), any(c.isdigit() for c in chars), all(c.isalpha() for c in chars))

    def value(self, other: _Value) -> None:
        self.parts.append(other)
        self._extend(other.head, other.some, other.blank, other.digit, other.alpha)

    def plausible(self) -> bool:
        return len(self.head) >= LEAST_LENGTH and self.head.lower() not in PLACEHOLDERS and len(self.some) >= LEAST_DISTINCT and not self.blank and (self.digit or not self.alpha)


def _string(text: str, a: int, b: int, v: _Value, constants: dict[str, _Value]) -> None:
    """Adds a string from its prefix to its last quote: what stands between the quotes, and the values of names in the holes of a template."""
    first = a
    while text[first] not in "\"'`":
        first += 1
    n = 3 if text[first : first + 3] in ('"""', "\'\'\'") and b - first >= 6 else 1
    low, high = first + n, b - n
    if text[first] == "`" or "f" in text[a:first].lower():
        for hole in HOLE.finditer(text, low, high):
            if hole.start() > low:
                v.literal(text, low, hole.start())
            if hole.group(1) in constants:
                v.value(constants[hole.group(1)])
            low = hole.end()
    if high > low or low == first + n:
        v.literal(text, low, high)


def named_literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, directly or through other names, templates and concatenation.

    Names have one scope, the text; comments are read like code, as secrets are left in them too."""
    constants: dict[str, _Value] = {}
    found = []
    for m in PAIR.finditer(text):
        at, value = m.start("value"), m.group("value")
        quoted = PART.match(value)
        quoted = not m.group("sum") and quoted is not None and quoted.group("string") is not None
        if not m.group("sum") and not quoted and (r := REFERENCE.match(value)) and r.group(1) in constants:
            v = constants[r.group(1)]
        else:
            v = _Value()
            if m.group("sum") or quoted:
                for p in PART.finditer(value):
                    if p.group("string"):
                        _string(text, at + p.start(), at + p.end(), v, constants)
                    elif p.group("name") in constants:
                        v.value(constants[p.group("name")])
            else:
                v.literal(text, at, at + len(value))
        if m.group("how") == "+=" and m.group("name") in constants:
            added, v = v, _Value()
            v.value(constants[m.group("name")])
            v.value(added)
        constants[m.group("name")] = v
        if name_score(m.group("name")) >= LEAST_SCORE and v.plausible():
            found.append(v)
    for pattern, on in ((ELEMENT, "</"), (ARGUMENT, ",")):
        for m in pattern.finditer(text) if on in text else ():
            if name_score(m.group("name")) >= LEAST_SCORE:
                v = _Value()
                if pattern is ELEMENT:
                    v.literal(text, *m.span("value"))
                else:
                    _string(text, *m.span("value"), v, constants)
                if v.plausible():
                    found.append(v)
    spans, visited = set(), set()
    while found:
        v = found.pop()
        if id(v) not in visited:
            visited.add(id(v))
            spans.update(v.spans)
            found += v.parts
    return sorted(spans)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans as (start, kind's number, end), sorted."""
    if not text:
        return [], []
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = [(a, 3, b) for a, b in named_literals(text)] if any(c in text for c in (":", "=", "</", "(")) else []
    base.sort()
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in part.column(1).to_pylist():
                base, every = scan(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row.

    Spans are kind:start:end in code points of the whole match, end exclusive, by start and then kind (assign, access, hex, named), joined by commas;
    base_sha256 is of the base kinds' spans. A null or empty text has no spans: the digest is that of the empty string. Repeated rows are scanned alike;
    a null doc_id is a row like any other. An empty table gives an empty one; extra columns, whatever their names, are not read. Texts are read whole."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
