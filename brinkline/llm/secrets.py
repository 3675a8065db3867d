"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class.

Candidate strings of each class are walked once with a window whose symbol counts and entropy sum are updated
incrementally; windows at or over the class's threshold that mix letters and digits are merged into spans.
Candidates on the allow-list, parts of candidates that hold one of its words, and spans inside a span of a fixed
pattern are suppressed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The contract's patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_token")
WINDOW = 20
#: (kind, candidate strings, least entropy of a window in bits a character)
CLASSES = (
    ("entropy_hex", re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}"), 3.0),
    ("entropy_token", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"), 3.9),
)
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"(.{1,8})\1{2,}.{0,7}"),  # a short unit over and over
    re.compile(r"[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?\d{0,4}"),  # words joined to a slug, perhaps with a number or year
)
#: A part of a candidate, between its separators, that has one of these is no secret.
ALLOWED_PART = re.compile(r"example|sample|dummy|placeholder|changeme|xxxxxx|123456789|abcdefgh", re.IGNORECASE)
_PART = re.compile(r"[^-_/+=]+")
_XLOG = [0.0] + [i * math.log2(i) for i in range(1, WINDOW + 1)]
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def entropy_runs(s: str, least: float) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of ``s`` with at least this entropy and both letters and digits."""
    counts: dict[str, int] = {}
    total, digits, letters, out = 0.0, 0, 0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _XLOG[n + 1] - _XLOG[n]
        counts[c] = n + 1
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= WINDOW:
            o = s[i - WINDOW]
            n = counts[o]
            total += _XLOG[n - 1] - _XLOG[n]
            counts[o] = n - 1
            digits -= o.isdigit()
            letters -= o.isalpha()
        if i >= WINDOW - 1 and digits >= 2 and letters >= 2 and math.log2(WINDOW) - total / WINDOW >= least - 1e-12:
            start = i - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def _candidates(s: str) -> list[tuple[int, str]]:
    """(offset, string) to be walked of a candidate: all of it, or its other parts where one is on the allow-list."""
    if any(p.fullmatch(s) for p in ALLOWED):
        return []
    if not ALLOWED_PART.search(s):
        return [(0, s)]
    parts = [(m.start(), m[0]) for m in _PART.finditer(s) if len(m[0]) >= WINDOW and not ALLOWED_PART.search(m[0])]
    return [(i, x) for i, x in parts if not any(p.fullmatch(x) for p in ALLOWED)]


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, added spans), each (start, kind, end) in code points."""
    text = text or ""
    low = text.lower()
    base = []
    # a lower-cased text of another length can't hide a key: keys are ASCII, and lower() keeps ASCII letters
    if any(k in low for k in _KEYS):
        base += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    added = []
    if any(len(w) >= WINDOW and not w.isalpha() and any(c in w for c in "0123456789abcdef") for w in text.split()):
        base += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
        # a base span that starts no later than another and ends no earlier covers it: furthest end by start
        order = sorted((a, b) for a, _, b in base)
        starts, ends = [a for a, _ in order], list(accumulate((b for _, b in order), max))
        for kind, pattern, least in CLASSES:
            for m in pattern.finditer(text):
                for at, string in _candidates(m[0]):
                    for i, j in entropy_runs(string, least):
                        i, j = i + at + m.start(), j + at + m.start()
                        before = bisect_right(starts, i)
                        if not before or ends[before - 1] < j:
                            added.append((i, kind, j))
    elif len(text) >= 24 and any(len(w) >= 24 for w in text.split()):
        base += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    return sorted(base, key=order), sorted(added, key=order)


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for i, k, j in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def secret_scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base (joined base spans), spans (joined base and added spans), n_assign, n_access, n_hex, n_entropy.

    A null text counts as empty and has no spans. Every row gives a row, repeated ones too; spans that start at one
    place are in the order of ``KINDS``; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base, added = scan(text)
                kinds = [k for _, k, _ in base]
                for column, value in zip(out, (joined(base), joined(base + added), *(kinds.count(k) for k in KINDS[:3]), len(added)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in out[:2]), *(pa.array(c, pa.int64()) for c in out[2:])],
                names=["doc_id", "base", "spans", "n_assign", "n_access", "n_hex", "n_entropy"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, base string, spans string, n_assign long, n_access long, n_hex long, n_entropy long")
