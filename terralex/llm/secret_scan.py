"""Secret scan by assignment-aware lexing.

Three base patterns find assigned secrets, access keys and long hexadecimal runs. Beyond them, source and configuration
text is lexed into name-literal pairs; constants are propagated through later assignments and concatenations, and a
literal is scored by the most sensitive name it reaches and by how random it looks.

Spans are kind:start:end in code points, end exclusive. Defined results: null counts as empty and has no spans; repeated
rows are scanned alike; a literal that a base span covers adds no span of its own. A name keeps all of its literals, so
a text that grows one name over n assignments costs n * n steps; an empty table gives no rows; of a very long text only
the tokens of one assignment are held at a time; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from terralex.llm.arrow import mapped

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs are as long as they can be, so short ones can be left out by the pattern itself.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "literal": 3}
THRESHOLD = 0.6

SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "key": 0.6, "auth": 0.7, "bearer": 0.8, "authorization": 0.8, "cookie": 0.6, "dsn": 0.6, "webhook": 0.6,
}
PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|\.{3,}|^<.*>$|^\$|^%|\{\{|change.?me|example|placeholder|your[_-]|dummy|redacted|todo|none|null|true|false")
LEX = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.\-][A-Za-z_][A-Za-z0-9_]*)*)(?P<close>["']?\s?\]?)?"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|=|:|\+)|(?P<end>[\n;])|(?P<number>\d[^\s"'`;,)\]}]*)|(?P<other>[^\s])"""
)
#: Every name that sensitivity() scores has one of these, perhaps split by what may stand between words of a name.
HINT = re.compile("|".join(r"(?:[_.\-]|[^\x00-\x7F])*".join(w) for w in "pass pwd secret token key cred auth bearer cookie dsn webhook".split()), re.I)
BARE = re.compile(r"""[^\s"'`;,()\[\]{}<>]{8,}""")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def sensitivity(name: str) -> float:
    """Of the most telling word or pair of words of an identifier."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))]), default=0.0)


def randomness(literal: str) -> float:
    """0 for words and placeholders, up to 1 for long strings of mixed characters."""
    n = len(literal)
    if n < 8 or PLACEHOLDER.search(literal) or " " in literal.strip():
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(any(map(f, literal)) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in literal)
    if classes < 2:
        return 0.0
    return min(1.0, entropy / min(4.0, math.log2(n))) * min(1.0, n / 16) ** 0.5 * (0.8 + 0.1 * min(classes, 3) - 0.1)


class _Tokens:
    """Tokens of a text by number, lexed when first asked for; those before the latest ``drop`` are forgotten."""

    def __init__(self, text: str):
        self.matches, self.held, self.first = LEX.finditer(text), deque(), 0

    def __call__(self, i: int) -> tuple[str, re.Match] | None:
        while i - self.first >= len(self.held):
            m = next(self.matches, None)
            if m is None:
                return None
            self.held.append((m.lastgroup if m.lastgroup != "close" else "name", m))
        return self.held[i - self.first]

    def drop(self, before: int) -> None:
        while self.first < before and self.held:
            self.held.popleft()
            self.first += 1


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Name and literal spans of each assignment in order; references stand for what they were last assigned."""
    known: dict[str, list[tuple[int, int]]] = {}
    token, i = _Tokens(text), 0
    while (follows := token(i + 1)) is not None:
        kind, m = token(i)
        quoted = kind == "string" and re.fullmatch(r"[\w.\-]+", m.group("string")[1:-1] or " ")
        if not (kind == "name" or quoted) or follows[0] != "op" or follows[1].group() not in (":=", "=>", "=", ":"):
            i += 1
            token.drop(i)
            continue
        name = m.group("name") if kind == "name" else m.group("string")[1:-1]
        j, value = i + 2, []
        while (here := token(j)) is not None:  # literals and references joined by + or by standing side by side
            kind, t = here
            if kind == "string":
                value.append((t.start() + 1, t.end() - 1))
            elif kind == "name" and t.group("name") in known and ((more := token(j + 1)) is None or more[1].group() not in (":", "=")):
                value += known[t.group("name")]
            elif kind in ("name", "number", "other") and not value and j == i + 2 and (b := BARE.match(text, t.start())) and any(map(str.isdigit, b.group())):
                value.append(b.span())
                while (more := token(j + 1)) is not None and more[1].start() < b.end():
                    j += 1
                j += 1
                break
            elif kind != "op" or t.group() != "+":
                break
            j += 1
        if value:
            value = list(dict.fromkeys(value))
            known[name] = value
            yield name, value
        i = max(j, i + 1) if value else i + 2
        token.drop(i)


def literal_spans(text: str) -> list[tuple[int, str, int]]:
    if not HINT.search(text) or not ("=" in text or ":" in text):
        return []
    scores: dict[tuple[int, int], float] = {}
    for name, value in assignments(text):
        if (s := sensitivity(name)) > 0:
            joined = randomness("".join(text[a:b] for a, b in value))
            for span in value:
                scores[span] = max(scores.get(span, 0.0), s * max(joined, randomness(text[span[0] : span[1]])))
    return [(a, "literal", b) for (a, b), s in scores.items() if s >= THRESHOLD]


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans), by start and kind."""
    text = text or ""
    order = lambda s: (s[0], KINDS[s[1]], s[2])
    base = sorted(base_spans(text), key=order)
    added = [s for s in literal_spans(text) if not any(a < s[2] and s[0] < b for a, _, b in base)]
    return base, sorted(base + added, key=order)


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _rows(batch: pa.RecordBatch) -> list:
    rows = []
    for text in batch.column("text").to_pylist():
        base, every = scan(text)
        kinds = Counter(k for _, k, _ in every)
        rows.append((*(kinds[k] for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
    return list(zip(*rows, strict=True)) if rows else [[]] * 6


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the checksum of its base spans and all its spans."""
    columns = "n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"
    return mapped(docs.select("doc_id", "text"), ["doc_id"], columns, _rows)
