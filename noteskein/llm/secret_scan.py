"""Secrets in texts: fixed patterns, and windows of high entropy in long strings.

Base kinds are the patterns ``assign``, ``access`` and ``hex``. The method adds ``entropy``: a window of
fixed width slides over the runs of each character class inside a candidate string, its Shannon entropy
is kept up to date from two changed counts per step, and windows at or above the limit of the class are
joined to spans. Spans that meet a base span or an allow-listed form are left out.

Offsets are code points, the end is exclusive. Defined results: a null or empty text has no spans;
a null ``doc_id`` stays null; repeated rows give repeated rows; an empty table gives no rows; other
columns are not looked at. Nothing is shuffled: a text is scanned where it lies.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from noteskein.llm.common import decode, id_and_text, map_rows

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: A failing run of one class fails at every later start too, so the length can be part of the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


class CharClass(NamedTuple):
    """Characters of a class, the width of its window and the least entropy in bits that counts."""

    name: str
    runs: re.Pattern
    width: int
    least: float


CLASSES = [
    CharClass("hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 3.1),
    CharClass("alnum", re.compile(r"[0-9A-Za-z]{20,}"), 20, 3.7),
    CharClass("base64", re.compile(r"[0-9A-Za-z+/_=-]{24,}"), 24, 3.9),
]

#: Forms that look random and are none of secrets: identifiers in the common dashed form, words and
#: numbers joined by dashes, underscores or slashes, plain words, numbers, and documented examples.
ALLOWED = [
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+)(?:[-_/=+]++(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+))*"),
    re.compile(r".*(?:EXAMPLE|example|0123456789|abcdefgh|ABCDEFGH).*"),
]

_PLOGP = [0.0] + [n * math.log2(n) for n in range(1, 65)]


def high_windows(run: str, width: int, least: float) -> Iterator[tuple[int, int]]:
    """Joined windows of ``run`` whose entropy reaches ``least``; a step changes two counts."""
    if len(run) < width:
        return
    counts: dict[str, int] = {}
    total = 0.0  # sum of n * log2(n) over the counts
    log_width = math.log2(width)
    begin = end = -1
    for i, char in enumerate(run):
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += _PLOGP[n + 1] - _PLOGP[n]
        if i >= width:
            old = run[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += _PLOGP[n - 1] - _PLOGP[n]
        if i >= width - 1 and log_width - total / width >= least - 1e-9:
            start = i - width + 1
            if begin >= 0 and start <= end:
                end = i + 1
            else:
                if begin >= 0:
                    yield begin, end
                begin, end = start, i + 1
    if begin >= 0:
        yield begin, end


def allowed(token: str) -> bool:
    return any(form.fullmatch(token) for form in ALLOWED)


def base_spans(text: str, assign: bool = True, runs: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    found = []
    if assign:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        token = m.group()
        if allowed(token):
            continue
        spans = sorted(
            (run.start() + a, run.start() + b)
            for c in CLASSES for run in c.runs.finditer(token) if not allowed(run.group())
            for a, b in high_windows(run.group(), c.width, c.least)
        )
        joined: list[list[int]] = []
        for a, b in spans:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        found += [(m.start() + a, 3, m.start() + b) for a, b in joined]
    # Both lists are sorted by start; a span that meets a base span is that secret again.
    ends, k, reach, kept = base, 0, -1, []
    for start, kind, end in found:
        while k < len(ends) and ends[k][0] < end:
            reach = max(reach, ends[k][2])
            k += 1
        if reach <= start:
            kept.append((start, kind, end))
    return kept


def spans_of(data: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base and added spans of one text. Texts without a keyword or a long string are done after two quick looks."""
    lower = data.lower()
    assign = any(word in lower for word in KEYWORDS)
    runs = max(map(len, data.split()), default=0) >= 20
    if not assign and not runs:
        return [], []
    text = decode(data)
    base = base_spans(text, assign, runs)
    return base, entropy_spans(text, base) if runs else []


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans, of every document."""
    def make():
        def rows_of(doc_id, data):
            base, added = spans_of(data)
            counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
            digest = hashlib.sha256(written_spans(base).encode()).hexdigest()
            yield (doc_id, *counts, digest, written_spans(sorted(base + added)))
        return rows_of

    return map_rows(
        id_and_text(docs), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
