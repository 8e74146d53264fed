"""Quality rules as a short-circuit cascade.

Base counters are taken for every whole text. A document that passes the base limits then goes through
rules in an order found on a sample: each rule's cost and rejection rate are measured there, and rules
are tried by rejections per second of cost, until the first one rejects. The verdict is that no rule
rejects, which no order can change; the order decides only how much work a rejected document takes.

Defined results: a null or empty text has no words and fails the base limits; a null ``doc_id`` stays
null; repeated rows give repeated rows; an empty table gives no rows; other columns are not looked at
(``keep_good`` returns them unchanged).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noteskein.llm.common import WHITE, id_and_text, map_rows, sliced, text_bytes

COUNTERS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
NOT_LETTERS = bytes(c for c in range(128) if c not in UPPER + LOWER)

#: Rows of each partition that the order of the rules is estimated on. It has no part in any verdict.
SAMPLE_PER_PARTITION = 20


class Facts:
    """One text with its base counters; what only some rules need is computed when they ask."""

    __slots__ = ("text", "words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def __init__(self, text: bytes):
        self.text = text
        self.words = words = text.split()
        self.n_words = len(words)
        continuation = len(text) - len(text.translate(None, bytes(range(128, 192))))
        self.word_chars = len(text.translate(None, WHITE)) - continuation
        self.n_symbols = len(text) - len(text.translate(None, SYMBOLS))
        self.lines = [line for line in text.split(b"\n") if line and not line.isspace()]
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.n_repeat_words = repeated_words(words)

    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words

    def counters(self) -> tuple[int, ...]:
        return self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in some window of ``width`` words found at least twice in the text."""
    n = len(words)
    if n <= width:
        return 0
    distinct = dict.fromkeys(words)
    if len(distinct) == n:
        return 0
    number = dict(zip(distinct, range(len(distinct))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    size, codes = len(distinct), ids[: n - width + 1]
    for k in range(1, width):
        if size * len(distinct) >= 2**62:
            size, codes = n, np.unique(codes, return_inverse=True)[1]
        size, codes = size * len(distinct), codes * len(distinct) + ids[k : n - width + 1 + k]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(codes, twice))
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(steps[:n])))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Facts], bool]


def _many_symbols(f: Facts) -> bool:
    return f.n_symbols > 0.1 * f.n_words


def _dup_lines(f: Facts) -> bool:
    return f.n_dup_lines > 0.4 * len(f.lines)


def _word_length(f: Facts) -> bool:
    return not 2 * f.n_words <= f.word_chars <= 12 * f.n_words


def _shouting(f: Facts) -> bool:
    """More than four in ten ASCII letters are capitals; a text in another script has none and passes."""
    upper = len(f.text) - len(f.text.translate(None, UPPER))
    lower = len(f.text) - len(f.text.translate(None, LOWER))
    return upper >= 50 and upper > 0.4 * (upper + lower)


def _exclaiming(f: Facts) -> bool:
    return f.text.count(b"!") + f.text.count(b"?") > 0.5 * f.n_words


def _few_letters(f: Facts) -> bool:
    """Bytes of words that are neither ASCII letters nor part of a character beyond ASCII."""
    letters = len(f.text.translate(None, NOT_LETTERS))
    return letters < 0.6 * len(f.text.translate(None, WHITE))


def _one_word(f: Facts) -> bool:
    return max(Counter(f.words).values()) > 0.2 * f.n_words


def _ellipses(f: Facts) -> bool:
    return sum(line.rstrip().endswith((b"...", "…".encode())) for line in f.lines) > 0.3 * len(f.lines)


RULES = [
    Rule("many_symbols", _many_symbols), Rule("dup_lines", _dup_lines), Rule("word_length", _word_length),
    Rule("shouting", _shouting), Rule("exclaiming", _exclaiming), Rule("few_letters", _few_letters),
    Rule("one_word", _one_word), Rule("ellipses", _ellipses),
]


def estimate(docs: DataFrame, rules: list[Rule] = RULES, per_partition: int = SAMPLE_PER_PARTITION) -> dict[str, tuple[float, float]]:
    """Mean seconds and rejection rate of each rule, on the first rows of each partition.

    One row per rule comes back, whatever the size of the table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, rejected, tried = [0.0] * len(rules), [0] * len(rules), 0
        left = per_partition
        for batch in batches:
            for text in text_bytes(batch.column(1)[:left]):
                left -= 1
                facts = Facts(text)
                if facts.base_failed():
                    continue
                tried += 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[k] += rule.rejects(facts)
                    took[k] += time.perf_counter() - began
            if left <= 0:
                break
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "took": took, "rejected": rejected, "tried": [tried] * len(rules)})

    seen = id_and_text(docs).mapInArrow(run, "rule long, took double, rejected long, tried long")
    sums = seen.groupBy("rule").agg(F.sum("took").alias("took"), F.sum("rejected").alias("rejected"), F.sum("tried").alias("tried"))
    return {rules[r["rule"]].name: (r["took"] / max(r["tried"], 1), r["rejected"] / max(r["tried"], 1)) for r in sums.collect()}


def order_rules(measured: dict[str, tuple[float, float]], rules: list[Rule] = RULES) -> list[Rule]:
    """Rules by rejections per second of cost, the best first; ties and rules not measured keep their place."""
    def gain(rule: Rule) -> float:
        cost, rate = measured.get(rule.name, (1.0, 0.0))
        return rate / max(cost, 1e-9)

    return sorted(rules, key=gain, reverse=True)


def passes(facts: Facts, rules: list[Rule]) -> bool:
    return not any(rule.rejects(facts) for rule in rules)


def judge(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Base counters, base verdict and final verdict of every document, in one pass without a shuffle."""
    ordered = rules if rules is not None else order_rules(estimate(docs))

    def make():
        def rows_of(doc_id, text):
            facts = Facts(text)
            failed = facts.base_failed()
            yield (doc_id, *facts.counters(), failed, not failed and passes(facts, ordered))
        return rows_of

    return map_rows(id_and_text(docs), make, COUNTERS + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns; rows stay where they are."""
    ordered = rules if rules is not None else order_rules(estimate(docs))
    at = docs.columns.index("text")

    def good(text: bytes | None) -> bool:
        facts = Facts(text or b"")
        return not facts.base_failed() and passes(facts, ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            yield batch.filter(pa.array([good(t) for t in text_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
