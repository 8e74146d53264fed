"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base kinds are found by fixed patterns and always stay. Looser patterns give further candidates. On each
candidate - base ones too - a set of labelers votes yes, no or nothing: patterns, gazetteers of short
fixed lists, and words around the span. The votes of all candidates of the corpus are counted by pattern
(kind, votes and features; a few thousand patterns at most, whatever the size of the corpus). From these counts
expectation-maximisation estimates how reliable each labeler is, and a logistic classifier is trained on
its posteriors. A second pass over the texts adds the loose candidates that the classifier accepts and
that meet no base span.

Offsets are code points, the end is exclusive. Defined results: a null or empty text has no spans; a null
``doc_id`` stays null; repeated rows give repeated rows (and count repeatedly in EM); an empty table
gives no rows; other columns are not looked at (``mask`` returns them unchanged).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noteskein.llm.common import decode, id_and_text, map_rows, replace_column, sliced, text_bytes

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_words", "phone_local", "national_id", "ip_long")
KINDS = BASE_KINDS + ADDED_KINDS

LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match of this form can only begin where a run of digits begins.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
#: A run with fewer digits fails from every start in it, so the least length can be part of the pattern.
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE = [
    (4, re.compile(r"\b[A-Za-z0-9._-]{2,64}\x20?[(\[]?\b(?:at|AT)\b[)\]]?\x20?[A-Za-z0-9-]{2,63}\x20?[(\[]?\b(?:dot|DOT)\b[)\]]?\x20?[A-Za-z]{2,24}\b")),
    (5, re.compile(r"(?<![0-9+().-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])")),
    (6, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (7, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
]

#: The first loose form needs this word; looking for it is cheaper than trying the form at every word.
DOT_WORD = re.compile(r"\b(?:dot|DOT)\b")

# The gazetteers of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es it uk eu nl ch at be pl se no dk fi pt ie us ca au jp cn in br mx".split())
FREE_MAIL = frozenset("gmail yahoo hotmail outlook proton icloud mail gmx web".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 61 62 63 64 65 66 81 82 86 90 91".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
PRIVATE_WORDS = re.compile(
    r"\b(?:call|phone|tel|telephone|mobile|fax|whatsapp|contact|mail|email|e-mail|write|reach|card|visa|mastercard|credit|ssn|social|security|ip|host|address|login|client)\b",
    re.IGNORECASE,
)
PUBLIC_WORDS = re.compile(
    r"\b(?:version|release|isbn|issn|doi|page|pages|section|chapter|figure|table|order|invoice|ticket|build|sku|part|model|score)\b",
    re.IGNORECASE,
)
CONTEXT = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain, found from the at signs outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_PART.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _octet(part: str) -> bool:
    kept = part.lstrip("0")
    return len(kept) <= 3 and int(kept or "0") <= 255


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns that meet no base span."""
    forms = LOOSE if DOT_WORD.search(text) else LOOSE[1:]
    found = sorted((m.start(), kind, m.end()) for kind, form in forms for m in form.finditer(text))
    free, k, reach = [], 0, 0
    for start, kind, end in found:
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= start:
            free.append((start, kind, end))
    return free


# Labelers: a vote is 0 for none, 1 for yes, 2 for no.

def _votes(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    span = text[start:end]
    digits = _digits(span)
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    near = before + " " + after
    return (
        _shape(kind, span, digits), _checked(kind, span, digits), _gazetteer(kind, span, digits),
        1 if PRIVATE_WORDS.search(near) else 0, 2 if PUBLIC_WORDS.search(near) else 0, _edges(before[-1:], after[:1]),
        _plain(digits),
    )


def _shape(kind: int, span: str, digits: str) -> int:
    """The strict form of the kind."""
    if kind in (0, 4):
        return 1 if re.search(r"[A-Za-z]", span[:2]) else 2
    if kind in (1, 7):
        return 1
    if kind == 2:
        return 1 if len(digits) in (15, 16) else 0
    return 1 if 9 <= len(digits) <= 13 else 2


def _checked(kind: int, span: str, digits: str) -> int:
    """What can be computed: check digits, number ranges."""
    if kind == 2:
        return 1 if luhn(digits) else 2
    if kind == 1:
        return 1 if all(_octet(p) for p in span.split(".")) else 2
    if kind == 6:
        return 2 if digits[:3] in ("000", "666") or digits[3:5] == "00" or digits[5:] == "0000" or digits[0] == "9" else 1
    return 0


def _gazetteer(kind: int, span: str, digits: str) -> int:
    if kind == 0:
        labels = span.lower().rsplit("@", 1)[1].split(".")
        return 1 if labels[-1] in TOP_DOMAINS or labels[0] in FREE_MAIL else 2
    if kind == 4:
        return 1 if re.split(r"[^A-Za-z]+", span.lower())[-1] in TOP_DOMAINS else 2
    if kind == 2:
        return 1 if digits.startswith(CARD_STARTS) else 0
    if kind == 3:
        return 1 if any(digits[:k] in COUNTRY_CODES for k in (1, 2)) else 0
    return 0


def _edges(before: str, after: str) -> int:
    """A span that goes on in a longer string is rarely meant by itself."""
    return 2 if re.match(r"[A-Za-z0-9_/=]", before) or re.match(r"[A-Za-z0-9_/=]", after) else 1


def _plain(digits: str) -> int:
    """Repeated or counted digits are fillers."""
    if len(digits) < 6:
        return 0
    steps = {(int(b) - int(a)) % 10 for a, b in zip(digits, digits[1:])}
    return 2 if len(steps) == 1 else 0


N_LABELERS = 7
#: P(none, yes, no) of a labeler before any vote is seen, by class.
PRIOR = np.array([[0.3, 0.2, 0.5], [0.3, 0.5, 0.2]])
PATTERNS = len(KINDS) * 3**N_LABELERS


def pattern_of(text: str, start: int, kind: int, end: int) -> int:
    code = kind
    for vote in _votes(text, start, kind, end):
        code = code * 3 + vote
    return code


def votes_of(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and votes (one column per labeler) of pattern numbers."""
    votes = np.empty((len(pattern), N_LABELERS), np.int64)
    rest = pattern.copy()
    for k in range(N_LABELERS - 1, -1, -1):
        votes[:, k] = rest % 3
        rest //= 3
    return rest, votes


def spans_of(data: bytes) -> tuple[str, list, list]:
    if b"@" not in data and not any(map(data.__contains__, _DIGITS)) and b"dot" not in data and b"DOT" not in data:
        return "", [], []
    text = decode(data)
    base = base_spans(text)
    return text, base, loose_spans(text, base)


_DIGITS = [bytes([c]) for c in b"0123456789"]


def vote_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of all candidates of the corpus with their counts: at most ``PATTERNS`` rows."""
    def make():
        def rows_of(_, data):
            text, base, loose = spans_of(data)
            for start, kind, end in base + loose:
                yield (pattern_of(text, start, kind, end),)
        return rows_of

    rows = map_rows(id_and_text(docs), make, "pattern int").groupBy("pattern").count().collect()
    rows = sorted((r["pattern"], r["count"]) for r in rows)
    return np.array([p for p, _ in rows], np.int64), np.array([n for _, n in rows], np.float64)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over two classes: posterior of each pattern, and P(vote | class) of each labeler.

    Class shares are kept by kind. The start trusts every labeler a little, which fixes the meaning of the classes;
    pseudo-counts keep each probability above zero.
    """
    kinds, votes = votes_of(patterns)
    share = np.full(len(KINDS), 0.5)
    table = np.empty((N_LABELERS, 2, 3))
    table[:] = PRIOR
    posterior = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        odds = np.log(share[kinds]) - np.log(1 - share[kinds])
        for k in range(N_LABELERS):
            odds += np.log(table[k, 1, votes[:, k]]) - np.log(table[k, 0, votes[:, k]])
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for y, weight in ((1, counts * posterior), (0, counts * (1 - posterior))):
            for k in range(N_LABELERS):
                seen = np.bincount(votes[:, k], weight, 3) + 10 * PRIOR[y]
                table[k, y] = seen / seen.sum()
        yes = np.bincount(kinds, counts * posterior, len(KINDS))
        share = (yes + 1) / (np.bincount(kinds, counts, len(KINDS)) + 2)
    return posterior, table


def train(patterns: np.ndarray, counts: np.ndarray, posterior: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier over kind and votes, fitted to the posteriors by Newton steps."""
    x = features(patterns)
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (posterior - p)) - ridge * weights
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights = weights + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return weights


def features(patterns: np.ndarray) -> np.ndarray:
    kinds, votes = votes_of(patterns)
    return np.hstack([np.eye(len(KINDS))[kinds], *[np.eye(3)[votes[:, k]] for k in range(N_LABELERS)]])


def fit(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier, from the votes on all candidates of ``docs``."""
    patterns, counts = vote_counts(docs)
    if not len(patterns):
        return np.zeros(len(KINDS) + 3 * N_LABELERS)
    posterior, _ = reliabilities(patterns, counts)
    return train(patterns, counts, posterior)


def decisions(weights: np.ndarray) -> np.ndarray:
    """Whether the classifier accepts a candidate, by pattern number."""
    return features(np.arange(PATTERNS)) @ weights > 0


def _accepted(accepts: np.ndarray, text: str, loose: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    kept, done = [], 0
    for start, kind, end in loose:
        if start >= done and accepts[pattern_of(text, start, kind, end)]:
            kept.append((start, kind, end))
            done = end
    return kept


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans, of every document."""
    accepts = decisions(fit(docs) if weights is None else weights)

    def make():
        def rows_of(doc_id, data):
            text, base, loose = spans_of(data)
            counts = [sum(kind == k for _, kind, _ in base) for k in range(len(BASE_KINDS))]
            digest = hashlib.sha256(written_spans(base).encode()).hexdigest()
            yield (doc_id, *counts, digest, written_spans(sorted(base + _accepted(accepts, text, loose))))
        return rows_of

    return map_rows(
        id_and_text(docs), make,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in brackets; of spans that meet, the union gets the first one's kind."""
    pieces, done = [], 0
    for start, kind, end in sorted(spans):
        if start >= done:
            pieces += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join(pieces) + text[done:]


def mask(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``n_chars`` follows where the text changed."""
    accepts = decisions(fit(docs) if weights is None else weights)
    at, counted = docs.columns.index("text"), "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            texts = batch.column(at).to_pylist()
            lengths = batch.column(batch.schema.get_field_index("n_chars")).to_pylist() if counted else []
            changed = False
            for i, data in enumerate(text_bytes(batch.column(at))):
                text, base, loose = spans_of(data or b"")
                spans = base + _accepted(accepts, text, loose)
                if spans:
                    changed, texts[i] = True, masked(text, spans)
                    if counted:
                        lengths[i] = len(texts[i])
            if changed:
                batch = replace_column(batch, "text", texts)
                batch = replace_column(batch, "n_chars", lengths) if counted else batch
            yield batch

    return docs.mapInArrow(run, docs.schema)
