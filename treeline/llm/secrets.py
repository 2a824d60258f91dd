"""Secret scans: three fixed patterns, and a guess-cost estimate for values in credential contexts.

A value that follows a credential word may be a real secret or a plain word. Its cost is
log10 of the guesses an attacker needs: the least sum, over all segmentations into words, dates,
repeats, keyboard walks, separators and brute-force spans, of the costs of the segments, with JOIN for each
segment after the first. best[j] is the least, over the segments that end at j, of best[start] +
cost; brute-force spans of every length are covered by one running minimum. A repeat is a
whole run of two or more equal parts (as many as there are), a walk a whole run along a row of keys or of code points, of three characters at
least, so their number grows with the length of the value and not with its square. Values
of at least `LEAST_COST` become spans of kind "guess", whatever their characters: a word of the
ranked list stays below by its cost, several words in a row may not.

Offsets are code points, end exclusive, of the whole match (assignment word to value for
"assign"). Base spans always stay; a guess span inside a base span is not added again.

Defined cases: null and empty texts have no spans; texts and values of any length are judged whole, no
segment is bounded but by its kind; repeated rows each give a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from treeline.llm.ranked_words import WORDS
from treeline.llm.shared import text_slices, with_plain_names

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "guess")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Words before a value that make it a credential, beyond those of the base pattern.
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:password|passwd|passphrase|pwd|secret|token|api_?key|credentials?|auth)["']?\x20*[:=]\x20*(?:"([^"\n]{4,})"|'([^'\n]{4,})'|([^\s"'<>,;]{4,}))""", re.ASCII | re.IGNORECASE)
#: log10 of guesses from which a value counts as a secret.
LEAST_COST = 8.0

# Rows of a keyboard, common words of passwords by rank; the ranked words of English follow them.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
COMMON = (
    "password", "the", "and", "you", "that", "love", "dragon", "monkey", "letmein", "admin", "welcome", "login", "master", "sunshine", "princess",
    "football", "shadow", "secret", "token", "user", "test", "hello", "root", "guest", "default", "changeme", "example", "sample", "dummy",
    "none", "null", "true", "false", "redacted", "placeholder", "your", "here", "value", "key", "api", "home", "work", "summer", "winter", "spring",
    "autumn", "super", "star", "baby", "angel", "michael", "charlie", "computer", "internet", "server", "service", "house", "orange", "purple",
    "green", "black", "white", "silver", "golden", "tiger", "lion", "eagle", "cookie", "coffee", "pepper", "ginger", "flower", "freedom", "whatever",
)
RANK = {w: r for r, w in enumerate(dict.fromkeys((*COMMON, *WORDS)), 1)}
_LEET = str.maketrans("013457@$!", "oleastasi")
_NEXT = {a: b for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)}
_LOG2 = math.log10(2)


#: log10 of the choices that each segment after the first adds.
JOIN = math.log10(3)
#: What stands between words as a segment of its own.
SEPARATORS = " -_./:"
_SEPARATOR = math.log10(len(SEPARATORS))
_LONGEST = max(map(len, RANK))
_STARTS = {w[:k] for w in RANK for k in range(1, len(w) + 1)}


def _brute(value: str) -> list[float]:
    """Running cost of guessing each character of its kind."""
    return list(accumulate((1.0 if c.isdigit() else _LOG26 if c.isalpha() else _LOG33 for c in value), initial=0.0))


_LOG26, _LOG33 = math.log10(26), math.log10(33)


def _words(value: str, low: str, plain: str) -> Iterator[tuple[int, int, float]]:
    """Ranked words, with the cost of look-alike digits and of capitals. Words are letters alone, so look-alikes are always read as letters."""
    swaps = list(accumulate((a != b for a, b in zip(low, plain, strict=True)), initial=0))
    capitals = list(accumulate((c.isupper() for c in value), initial=0))
    for i in range(len(value) - 2):
        for j in range(i + 1, min(len(value), i + _LONGEST) + 1):
            part = plain[i:j]
            if part not in _STARTS:
                break
            if j - i >= 3 and part in RANK:
                upper = capitals[j] - capitals[i]
                yield i, j, math.log10(RANK[part]) + _LOG2 * (swaps[j] - swaps[i]) + (0 if not upper else _LOG2 if upper in (1, j - i) else _LOG2 * upper)


_DATE = re.compile(r"(?:(19|20)\d\d)(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d", re.ASCII)
_DATE_SIZES = {4: math.log10(120), **dict.fromkeys((6, 7, 8, 10), math.log10(365 * 120))}


def _dates(value: str) -> Iterator[tuple[int, int, float]]:
    for i in range(len(value) - 3):
        if value[i] in "0123456789":
            for size, cost in _DATE_SIZES.items():
                if i + size <= len(value) and _DATE.fullmatch(value, i, i + size):
                    yield i, i + size, cost


def _walks(low: str) -> Iterator[tuple[int, int, float]]:
    """Whole runs along one row of keys, either way, or up or down the code points."""
    steps = (lambda a, b: _NEXT.get(a) == b, lambda a, b: _NEXT.get(b) == a, lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(a) - ord(b) == 1)
    for follows in steps:
        i = 0
        for j in range(1, len(low) + 1):
            if j == len(low) or not follows(low[j - 1], low[j]):
                if j - i >= 3:
                    yield i, j, math.log10(47 * 2 * (j - i))
                i = j


def _separators(value: str) -> Iterator[tuple[int, int, float]]:
    """Blanks and marks between words: one of the few that people use."""
    for i, c in enumerate(value):
        if c in SEPARATORS:
            yield i, i + 1, _SEPARATOR


def runs(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of all maximal runs: stretches of two or more periods, the least period of each.

    A run of period p covers two neighbours among the places 0, p, 2p, ...; equal neighbours are
    grown both ways, and a place inside a run whose period divides p is passed over, so the
    work is near n log n.
    """
    n = len(value)
    reach: list[tuple[int, int]] = [(0, 0)] * n  # the farthest end of a run over a place, and its period
    for p in range(1, n // 2 + 1):
        x = 0
        while x + p < n:
            end, known = reach[x]
            if known and p % known == 0 and end >= x + p:
                x = max(x + p, (end - p) // p * p + p)
                continue
            if value[x] != value[x + p]:
                x += p
                continue
            j = x + p
            while j < n and value[j] == value[j - p]:
                j += 1
            i = x
            while i > 0 and value[i - 1] == value[i - 1 + p]:
                i -= 1
            if j - i >= 2 * p:
                yield i, j, p
                for k in range(i, j):
                    if reach[k][0] < j:
                        reach[k] = (j, p)
            x = max(x + p, (j - p) // p * p + p)


def _repeats(value: str, brute: list[float]) -> Iterator[tuple[int, int, float]]:
    for start, end, p in runs(value):
        for i in range(start, min(start + p, end - 2 * p + 1)):
            times = (end - i) // p
            if times * p >= 3:
                yield i, i + times * p, brute[i + p] - brute[i] + math.log10(times)


def segments(value: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of all segments but brute-force spans."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return [*_words(value, low, low.translate(_LEET)), *_dates(value), *_walks(low), *_separators(value), *_repeats(value, _brute(value))]


@lru_cache(maxsize=4096)
def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation; 0 for the empty string."""
    n, brute = len(value), _brute(value)
    into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in segments(value):
        into[j].append((i, cost))
    best = [-JOIN]  # so that the first segment joins nothing
    open_ = math.inf  # least of best[i] - brute[i] over the starts of a brute-force span
    for j in range(1, n + 1):
        open_ = min(open_, best[j - 1] - brute[j - 1])
        best.append(min([open_ + brute[j] + _LOG2, *(best[i] + cost for i, cost in into[j])]) + JOIN)
    return max(0.0, best[n]) if n else 0.0


_HEX_CLASS = bytes(0x68 if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x66 else 0x20 for c in range(256))
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_MORE = (b"passphrase", b"pwd", b"credential", b"auth")
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, cost) of all spans, by start, then kind as in KINDS. cost: log10 guesses of the value."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.translate(_LOWER)
    base: list[tuple[int, int, str, float]] = []
    keyed = any(k in low for k in _KEYWORDS)
    if keyed:
        base += [(m.start(), m.end(), "assign", guess_cost(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        base += [(m.start(), m.end(), "access", guess_cost(m[0])) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"h" * LEAST["hex"] in raw.translate(_HEX_CLASS):
        base += [(m.start(), m.end(), "hex", guess_cost(m[0])) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    out = list(base)
    if keyed or any(k in low for k in _MORE):
        base.sort()
        starts, ends = [x for x, *_ in base], list(accumulate((y for _, y, *_ in base), max))
        for m in CONTEXT.finditer(text):
            k = next(g for g in (1, 2, 3) if m[g] is not None)
            a, b = m.span(k)
            before = bisect_right(starts, a)  # of the base spans that begin by then, does one end no sooner?
            if not (before and ends[before - 1] >= b) and (cost := guess_cost(m[k])) >= LEAST_COST:
                out.append((a, b, "guess", cost))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, max_log10_guesses for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            rows = [find_spans(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in rows], pa.int64()) for k in KINDS]
            base = [hashlib.sha256(_joined([s for s in spans if s[2] != "guess"]).encode()).hexdigest() for spans in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(base), pa.array([_joined(s) for s in rows], pa.string()), pa.array([max([x[3] for x in s], default=None) for s in rows], pa.float64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "max_log10_guesses"],
            )

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, max_log10_guesses double")


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span replaced by the mark; spans that overlap become one."""
    if not text or not (spans := find_spans(text)):
        return text
    out, at, last = [], 0, -1
    for a, b, _, _ in spans:
        if a >= last:
            out += [text[at:a], mark]
            at = b
        else:
            at = max(at, b)
        last = max(last, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with all spans masked and n_chars, where there is such a column, counted anew for changed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            new = [redact(t) for t in texts]
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(b) if b != a else n for a, b, n in zip(texts, new, old, strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return with_plain_names(docs, ("text", "n_chars"), lambda plain: plain.mapInArrow(run, plain.schema))

