"""Secret scan: strong patterns, and weak parts of credentials that complete each other."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame

from lumenary.llm.common import add_columns, documents

KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
#: Strong patterns with the least length of a group; leftmost matches, later ones don't overlap.
STRONG = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: The same matches as hex has after its length is asked for: its runs are maximal.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CUES = ("password", "passwd", "secret", "token", "api")
#: Parts that mean little alone.
WEAK = {
    "identifier": re.compile(r"\b(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}\b|\b(?:user(?:name)?|login|client_id|account|key_id)\b[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", re.I | re.A),
    "key": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A),
    "endpoint": re.compile(r"\b(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3|jdbc:[a-z]+)://[^\s\"'<>]{4,}|\b[a-z0-9.-]+\.(?:amazonaws\.com|blob\.core\.windows\.net|googleapis\.com)\b", re.A),
}
#: What ends a scope: a blank line, or a line that begins a section.
BORDER = re.compile(r"\n[ \t]*\n|\n(?=\[[^\]\n]+\]|---|===|#)")
#: What completes a part: an identifier needs a key, a key one of the others, an endpoint a key.
MATES = {"identifier": ("key", "assign", "hex"), "key": ("identifier", "access", "endpoint"), "endpoint": ("key", "assign", "hex", "access")}


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower() if not text.isascii() else text.casefold()
    if any(c in low for c in CUES):
        pattern, group, least = STRONG["assign"]
        out += [(m.start(), m.end(), "assign") for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    if "AKIA" in text:
        pattern, group, least = STRONG["access"]
        out += [(m.start(), m.end(), "access") for m in pattern.finditer(text) if m.end() - m.start() >= least]
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return out


def is_random(s: str) -> bool:
    """Whether a run looks like key material: letters and digits mixed, over 3.5 bits a character."""
    if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) > 3.5


def weak_spans(text: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates outside strong spans."""
    taken = sorted((a, b) for a, b, _ in strong)
    starts = [a for a, _ in taken]
    reach, most = [], 0  # the furthest end of all spans that start so far
    for _, b in taken:
        most = max(most, b)
        reach.append(most)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or reach[k - 1] <= a

    out = []
    for kind, pattern in WEAK.items():
        for m in pattern.finditer(text):
            if free(m.start(), m.end()) and (kind != "key" or is_random(m.group())):
                out.append((m.start(), m.end(), kind))
    return out


def linked(text: str, strong: list[tuple[int, int, str]], weak: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The weak candidates with a complementary part in their scope, beside, around or inside them.

    An interval join of parts and scopes by sorted starts: for each candidate and complementary
    kind, one lookup finds whether any part of that kind begins in the scope, so no pairs are made.
    """
    starts: dict[str, list[int]] = {}
    for a, _, k in [*strong, *weak]:
        starts.setdefault(k, []).append(a)
    for k in starts:
        starts[k].sort()
    borders = [0, *(m.end() for m in BORDER.finditer(text)), len(text) + 1]
    out = []
    for a, b, kind in weak:
        s = bisect_right(borders, a)
        low, high = borders[s - 1], borders[s]
        if any(bisect_left(starts[mate], high) > bisect_left(starts[mate], low) for mate in MATES[kind] if mate in starts):
            out.append((a, b, kind))
    return out


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def find(text: str) -> tuple[list, list]:
    """Strong spans, and the weak ones that are linked."""
    strong = strong_spans(text)
    weak = weak_spans(text, strong)
    return strong, linked(text, strong, weak) if weak else []


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans as [kind] of its first."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and masked (null for a null text)."""

    def start():
        def step(part):
            out: list[list] = [[] for _ in range(6)]
            for t in part.column(text).to_pylist():
                strong, weak = find(t or "")
                n = Counter(k for _, _, k in strong)
                row = (n["assign"], n["access"], n["hex"], hashlib.sha256(join_spans(strong).encode()).hexdigest(), join_spans([*strong, *weak]), masked(t, [*strong, *weak]) if strong or weak else t)
                for c, v in zip(out, row):
                    c.append(v)
            return out

        return step

    return add_columns(docs, start, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, masked string", text)


def op5_credential_links(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document.

    A null or empty text has none (spans is the empty string); a repeated row is scanned again;
    other columns play no part; an empty table gives no rows; a text is scanned whole, however
    long; spans that begin together come in the order of KINDS.
    """
    return scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "masked")
