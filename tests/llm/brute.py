"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    text = text or ""
    own = words(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    grams = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    marked = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(own) < 50 or 100 * len(marked) > 50 * len(own)
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(marked), failed


def _spans(text, kinds):
    found = [(m.start(), k, m.end()) for k, (_, form, test) in enumerate(kinds) for m in form.finditer(text) if test(m)]
    return sorted(found)


def joined(spans, names):
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


SECRETS = [
    ("assign", re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(2)) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
]


def secrets(text):
    return _spans(text or "", SECRETS)


def _digits(text):
    return [int(c) for c in text if c in "0123456789"]


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(_digits(m.group())) <= 19 and _luhn(_digits(m.group()))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(_digits(m.group())) <= 15),
]


def personal(text):
    return _spans(text or "", PII)


def fingerprint(text, width=3):
    own = words((text or "").translate(LOWER))
    if not own:
        return 0
    grams = [" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints, radius=2):
    """Component id of each (id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        root = find(i)
        least[root] = min((x for x in (least.get(root), doc_id) if x is not None), default=None)
    return [least[find(i)] for i in range(len(prints))]


def repeated_bytes(texts, length):
    """Mask of the bytes of each text that a string of ``length`` bytes found elsewhere too covers."""
    places = defaultdict(int)
    for text in texts:
        for i in range(len(text) - length + 1):
            places[text[i : i + length]] += 1
    masks = []
    for text in texts:
        mask = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if places[text[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        masks.append(mask)
    return masks


def bare_words(text):
    edges = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    return [w for w in (w.strip(edges) for w in words((text or "").translate(LOWER))) if w]


def tiling(document, item, least):
    """Greedy tiling by looking at every pair of places; words covered."""
    free_d, free_i, covered = [True] * len(document), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(document)):
            for i in range(len(item)):
                n = 0
                while d + n < len(document) and i + n < len(item) and free_d[d + n] and free_i[i + n] and document[d + n] == item[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < least:
            return covered
        for k in range(n):
            free_d[d + k] = free_i[i + k] = False
        covered += n


def leaks(docs, items, coverage=0.6, seed=5):
    """(doc_id, item_id, covered)."""
    found = set()
    for doc_id, text in docs:
        own = bare_words(text)
        for item_id, item in items:
            theirs = bare_words(item)
            if not theirs:
                continue
            width = min(seed, len(theirs))
            grams = {tuple(theirs[i : i + width]) for i in range(len(theirs) - width + 1)}
            if any(tuple(own[i : i + width]) in grams for i in range(len(own) - width + 1)):
                covered = tiling(own, theirs, width)
                if covered >= coverage * len(theirs):
                    found.add((doc_id, item_id, covered))
    return found


def warc(pages):
    """page_id -> (bytes, digest, type, refers_to)."""
    first = {}
    for page_id, html in pages:
        data = (html or "").encode()
        if data not in first or page_id > first[data]:
            first[data] = page_id
    return {
        page_id: (
            len(data := (html or "").encode()), base64.b32encode(hashlib.sha1(data).digest()).decode(),
            "response" if first[data] == page_id else "revisit", None if first[data] == page_id else first[data],
        )
        for page_id, html in pages
    }


def unigrams(docs):
    """doc_id -> (held_out, tokens, known, N, base score)."""
    tokens = {d: words((t or "").translate(LOWER)) + [None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d, own in tokens.items() if not held[d] for w in own)
    n, v = sum(counts.values()), len(counts)
    return {
        d: (held[d], len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        for d, own in tokens.items()
    }
